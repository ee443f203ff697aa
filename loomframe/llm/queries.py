"""Registered queries of this folder: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomframe.llm.chat import CLOSE, OPEN, PART, format_chats
from loomframe.llm.common import LOWER, ORACLES, QUERIES, UPPER, query, read
from loomframe.llm.exact_dedup import exact_dedup
from loomframe.llm.fill_middle import fill_middle, restore
from loomframe.llm.jaccard import near_duplicates
from loomframe.llm.packing import default_tokenizer, pack
from loomframe.llm.phrases import mine_phrases
from loomframe.llm.pieces import decode_pieces, default_pieces, encode_pieces
from loomframe.llm.quality import score_quality
from loomframe.llm.secrets import scan_secrets
from loomframe.llm.substrings import remove_repeats
from loomframe.llm.toxicity import score_toxicity
from loomframe.llm.urls import filter_urls, rules_table
from loomframe.llm.vectors import near_vectors

__all__ = ["ORACLES", "QUERIES"]

#: The words of a text in SQL.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


@query(
    "op4_exact_dedup",
    f"""
    with t as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as text_sha256 from documents),
    g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by 1)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
    """,
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(read(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False)
    return packed.drop("ids").withColumnRenamed("id", "doc_id")


@query("op10_secret_scans")
def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("found", lambda f: f["kind"].isin("assign", "access", "hex"))
    line = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["first"], f["last"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return rows.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted", F.size("segments").alias("n_segments"))


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return rows.withColumnRenamed("id", "doc_id")


@query(
    "op1_ngram_jaccard_join",
    f"""
    with recursive w as (select doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} as w from documents),
    s as (
        select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w
    ),
    e as (select doc_id, len(s) as n, unnest(s) as x from s),
    p as (
        select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id and 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
        group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
    ),
    r(a, b) as (select a, b from p union select r.a, p.b from r join p on r.b = p.a)
    select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) as component_id
    from s left join r on r.a = s.doc_id group by s.doc_id, s.s
    """,
)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("text_key").withColumnRenamed("id", "doc_id")


@query(
    "op8_substring_dedup",
    f"""
    with w as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
    g as (select doc_id, unnest(range(1, len(w) - 48)) as i, w from w where len(w) >= 50),
    h as (select doc_id, i, hash(array_to_string(w[i:i+49], ' ')) as h from g),
    m as (select h, min(doc_id) as low from h group by h),
    c as (select distinct doc_id, unnest(range(i, i + 50)) as k from h join m using (h) where low < doc_id),
    r as (select doc_id, list(k) as ks from c group by doc_id),
    f as (
        select w.doc_id, len(w) as n, coalesce(len(ks), 0) as gone,
        list_filter(w, lambda x, i: not list_contains(coalesce(ks, []), i)) as kept from w left join r using (doc_id)
    )
    select doc_id, cast(n as bigint) as n_words, cast(gone as bigint) as n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) as kept_sha256 from f
    """,
)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(read(spark, sf_dir, "documents"))
    return rows.drop("kept").withColumnRenamed("id", "doc_id")


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode_pieces(read(spark, sf_dir, "documents"), default_pieces())
    decoded = decode_pieces(ids, default_pieces())
    return decoded.select(F.col("id").alias("doc_id"), F.size("ids").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


@query(
    "op7_chat_formatting",
    f"""
    with t as (
        select conv_id, coalesce(cast(floor(turn / {PART}.0) as bigint), -1) as part,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as nth,
        '{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{CLOSE.strip()}' || chr(10) as line from conversations where conv_id is not null
    ),
    p as (select conv_id, nth, sha256(array_to_string(list(line) over (partition by conv_id order by nth), '')) as prefix, count(*) over (partition by conv_id) as n from t),
    d as (select n, prefix, min(conv_id) as conv_id from p where nth = n group by n, prefix),
    i as (select p.conv_id, p.nth, p.prefix from p join d using (conv_id) where p.nth < p.n),
    k as (
        select d.conv_id, 1 + count(e.conv_id) as n_snapshots from d left join i on i.conv_id = d.conv_id left join d e on e.n = i.nth and e.prefix = i.prefix
        where not exists (select 1 from i x where x.nth = d.n and x.prefix = d.prefix) group by d.conv_id
    )
    select conv_id, part, count(*) as n_turns, any_value(n_snapshots) as n_snapshots, string_agg(line, '' order by nth) as text
    from t join k using (conv_id) group by conv_id, part
    """,
)
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


@query(
    "op5_embedding_near_dedup",
    """
    with recursive v as (
        select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
    r(a, b) as (select a, b from p union select r.a, p.b from r join p on r.b = p.a),
    n as (select a, count(*) as n_links from p group by a),
    c as (select e.vec_id, least(e.vec_id, coalesce(min(r.b), e.vec_id)) as component_id from embeddings e left join r on r.a = e.vec_id group by e.vec_id)
    select vec_id, coalesce(n_links, 0) as n_links, component_id, component_id = vec_id as kept from c left join n on n.a = vec_id
    """,
)
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query(
    "op13_fill_in_middle",
    r"""
    with t as (select doc_id, coalesce(text, '') as x, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
    w as (select *, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, list_transform(range(4), lambda k: cast('0x' || substr(h, 8 * k + 1, 8) as bigint)) as d from t),
    c as (select *, len(u) as n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) as a, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) as b from w),
    p as (
        select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf,
        case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or d[3] % 100 >= 50 then 'plain' when d[4] % 100 < 80 then 'spm' else 'psm' end as form from c
    )
    select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
    sha256(case form when 'plain' then x when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
    sha256(x) as restored_sha256 from p
    """,
)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle(read(spark, sf_dir, "documents"))
    sha = lambda text: F.sha2(text, 256)
    return rows.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


@query(
    "op12_url_filters",
    rf"""
    with rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    u as (select page_id, row_number() over () as row, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    s as (select page_id, row, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
    m as (select s.*, h, p, v, row_number() over (partition by row order by length(h) + length(p) desc, length(h) desc) as rn from s left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
    select page_id, host, path, h || p as rule, coalesce(v, 'allow') as verdict from m where rn = 1
    """,
)
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), rules_table(spark)).withColumnRenamed("id", "page_id")


@query(
    "op11_phrase_mining",
    rf"""
    with t as (select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as x from documents),
    p as (select lang, unnest(regexp_split_to_array(x, '[.,;:!?
-
]')) as x from t),
    w as (select lang, regexp_extract_all(x, '[^ 	]+') as w from p),
    z as (select lang, unnest(list_zip(w, w[2:], w[3:], w[4:])) as z from w),
    e as (
        select lang, 1 as k, z[1] as phrase from z union all select lang, 2, concat_ws(' ', z[1], z[2]) from z where z[2] is not null
        union all select lang, 3, concat_ws(' ', z[1], z[2], z[3]) from z where z[3] is not null union all select lang, 4, concat_ws(' ', z[1], z[2], z[3], z[4]) from z where z[4] is not null
    ),
    c as (select lang, k, phrase, count(*) as a from e group by all),
    n as (select lang, sum(a) as n from c where k = 1 group by lang),
    f as (select lang, k, phrase, a, string_split(phrase, ' ') as w from c where a >= 30),
    i as (select lang, array_to_string(w[j:j + m - 1], ' ') as phrase, max(a) as longer from f, range(2, 4) as s(m), range(1, 4) as o(j) where m < k and j + m - 1 <= k group by all),
    u as (
        select f.lang, f.phrase, f.a, s.j, x.a as l, y.a as r, cast(2000000::hugeint * f.a // (x.a + y.a) as bigint) as score
        from f cross join range(1, 4) as s(j) join f x on x.lang = f.lang and x.phrase = array_to_string(f.w[1:s.j], ' ') join f y on y.lang = f.lang and y.phrase = array_to_string(f.w[s.j + 1:], ' ')
        where f.k > 1 and s.j < f.k qualify row_number() over (partition by f.lang, f.phrase order by score, s.j) = 1
    ),
    g as (select u.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from u left join i using (lang, phrase) where longer is null or 100 * longer < 80 * a)
    select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from g join n using (lang) where rank <= 2000
    """,
)
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(read(spark, sf_dir, "documents"))
