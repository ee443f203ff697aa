"""Imputation, encoding, scaling, selection, preprocessing and text queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loomframe.functions import text as X
from loomframe.operators import encode, features, impute, preprocess, scale, textfeatures
from loomframe.plans import views
from loomframe.plans.profiles import ORDERS, iqr_sql, missing_sql, robust_sql, types_sql
from loomframe.plans.registry import Tables, num, query, quote, union, whole
from loomframe.plans.views import with_views
from loomframe.session import scratch_path
from loomframe.sources import catalog


@query(
    "impute_numeric",
    with_views(
        "events_nulls",
        f"""CTE f as (select median(value) as a, avg(value) as b from events_nulls),
m as (select value as c from events_nulls where value is not null group by value order by count(*) desc, value limit 1)
select {whole('event_id', 'event_id')}, {num('coalesce(value, a)', 'by_median')}, {num('coalesce(value, b)', 'by_mean')}, {num('coalesce(value, c)', 'by_mode')}
from events_nulls, f, m""",
    ),
)
def impute_numeric(t: Tables) -> DataFrame:
    rows = views.events_nulls(t)
    copies = rows.select("event_id", *[F.col("value").alias(f"by_{s}") for s in ("median", "mean", "mode")])
    fills = {f"by_{s}": impute.fit_imputer(rows, ["value"], [], s)["value"] for s in ("median", "mean", "mode")}
    return impute.apply_imputer(copies, fills)


@query(
    "impute_categorical",
    with_views(
        "events_nulls",
        f"""CTE m as (select event_type as c from events_nulls where event_type is not null group by 1 order by count(*) desc, 1 limit 1)
select {whole('event_id', 'event_id')}, coalesce(event_type, c) as event_type from events_nulls, m""",
    ),
)
def impute_categorical(t: Tables) -> DataFrame:
    rows = views.events_nulls(t).select("event_id", "event_type")
    return impute.apply_imputer(rows, impute.fit_imputer(rows, [], ["event_type"]))


STATUSES = ["F", "O", "P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def onehot_sql() -> str:
    flags = [f"cast(o_orderstatus = '{v}' as bigint) as \"o_orderstatus_{v}\"" for v in STATUSES]
    flags += [f"cast(o_orderpriority = '{v}' as bigint) as \"o_orderpriority_{v}\"" for v in PRIORITIES]
    return ", ".join(flags)


@query("encode_onehot", f"select {whole('o_orderkey', 'o_orderkey')}, {onehot_sql()} from orders")
def encode_onehot(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return encode.apply_onehot(rows, encode.fit_onehot(rows, ["o_orderstatus", "o_orderpriority"]))


@query(
    "encode_onehot_capped",
    f"""with top as (select p_name from part group by 1 order by count(*) desc, p_name limit 50)
select {whole('p_partkey', 'p_partkey')}, 'p_name' as feature, case when p_name in (select p_name from top) then p_name else 'other' end as category from part""",
)
def encode_onehot_capped(t: Tables) -> DataFrame:
    """More categories than the cap, in the sparse long form."""
    return encode.onehot_long(t.part, "p_partkey", encode.fit_onehot(t.part, ["p_name"], 50))


CODES = "(select o_orderpriority as v, row_number() over (order by o_orderpriority) - 1 as code from (select distinct o_orderpriority from orders) x) d"


@query("encode_ordinal", f"select {whole('o_orderkey', 'o_orderkey')}, o_orderpriority, {whole('code', 'code')} from orders join {CODES} on o_orderpriority = v")
def encode_ordinal(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return encode.apply_ordinal(rows, "o_orderpriority", encode.fit_ordinal(rows, "o_orderpriority"), "code")


@query("target_label_roundtrip", f"select {whole('o_orderkey', 'o_orderkey')}, {whole('code', 'code')}, v as decoded from orders join {CODES} on o_orderpriority = v")
def target_label_roundtrip(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    dictionary = encode.fit_ordinal(rows, "o_orderpriority")
    coded = encode.apply_ordinal(rows, "o_orderpriority", dictionary, "code")
    return encode.decode_ordinal(coded, "code", dictionary, "decoded").select("o_orderkey", "code", "decoded")


@query(
    "encode_target",
    f"""with g as (select o_orderpriority as v, sum(o_totalprice) as s, count(*) as n from orders group by 1), a as (select avg(o_totalprice) as m from orders)
select {whole('o_orderkey', 'o_orderkey')}, {num('(s + 10 * m) / (n + 10)', 'encoding')} from orders join g on o_orderpriority = v, a""",
)
def encode_target(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    state = encode.fit_target(rows, "o_orderpriority", "o_totalprice", 10.0)
    return encode.apply_target(rows, "o_orderpriority", state, "encoding").select("o_orderkey", "encoding")


def date_parts_sql(column: str, cast: str = "bigint") -> str:
    parts = {"year": f"year({column})", "month": f"month({column})", "day": f"day({column})", "dayofweek": f"isodow({column}) - 1", "hour": f"hour({column})", "minute": f"minute({column})"}
    return ", ".join(f"cast({e} as {cast}) as {column}_{p}" for p, e in parts.items())


@query("expand_datetime", f"select {whole('o_orderkey', 'o_orderkey')}, {date_parts_sql('o_orderdate')} from orders")
def expand_datetime(t: Tables) -> DataFrame:
    return features.expand_datetime(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate"])


@query("scale_robust", robust_sql())
def scale_robust(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_size", "p_retailprice")
    return scale.apply_scaler(rows, scale.fit_scaler(rows, ["p_size", "p_retailprice"], "robust"))


SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scale_sql(centre: str, width: str) -> str:
    q = ", ".join(f"{centre.format(c)} as {c}_a, {width.format(c)} as {c}_b" for c in SCALED)
    out = ", ".join(num(f"({c} - {c}_a) / case when {c}_b = 0 then 1 else {c}_b end", c) for c in SCALED)
    return f"select {whole('l_orderkey', 'l_orderkey')}, {out} from lineitem, (select {q} from lineitem) q"


@query("scale_standard", _scale_sql("avg({0})", "stddev_pop({0})"))
def scale_standard(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", *SCALED)
    return scale.apply_scaler(rows, scale.fit_scaler(rows, SCALED, "standard"))


@query("scale_minmax", _scale_sql("min({0})", "max({0}) - min({0})"))
def scale_minmax(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", *SCALED)
    return scale.apply_scaler(rows, scale.fit_scaler(rows, SCALED, "minmax"))


POLY = ["l_quantity", "l_discount", "l_tax"]


def _poly_sql() -> str:
    terms = features.polynomial_terms(POLY)
    return f"select {whole('l_orderkey', 'l_orderkey')}, {', '.join(num(' * '.join(g), n) for n, g in terms.items())} from lineitem"


@query("polynomial_features", _poly_sql())
def polynomial_features(t: Tables) -> DataFrame:
    return features.polynomial_features(t.lineitem.select("l_orderkey", *POLY), POLY, max_features=100, max_inputs=10)


@query(
    "select_variance",
    union([f"select '{c}' as column_name, {num(f'var_pop({c})', 'score')}, var_pop({c}) > 0.01 as selected from lineitem" for c in SCALED]),
)
def select_variance(t: Tables) -> DataFrame:
    return features.select_variance(t.lineitem, SCALED)


def _ranked_sql(scores: str, k: int) -> str:
    return f"select column_name, {num('score', 'score')}, rn as rank, rn <= {k} as selected from (select *, row_number() over (order by score desc, column_name) as rn from ({scores}) s) r"


def _anova_sql(column: str) -> str:
    return f"""select '{column}' as column_name, (sum(n * power(m - g.gm, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) as score
 from (select o_orderstatus, count(*) as n, avg({column}) as m, var_pop({column}) as v from orders group by 1) x, (select avg({column}) as gm from orders) g"""


@query("select_f_classif", _ranked_sql(union([_anova_sql(c) for c in ("o_totalprice", "o_custkey")]), 1))
def select_f_classif(t: Tables) -> DataFrame:
    return features.top_k(features.f_classif(t.orders, ["o_totalprice", "o_custkey"], "o_orderstatus"), 1)


@query(
    "select_f_regression",
    _ranked_sql(
        union([f"select '{c}' as column_name, power(r, 2) / (1 - power(r, 2)) * (n - 2) as score from (select corr({c}, l_extendedprice) as r, count(*) as n from lineitem) x" for c in POLY]), 2
    ),
)
def select_f_regression(t: Tables) -> DataFrame:
    return features.top_k(features.f_regression(t.lineitem, POLY, "l_extendedprice"), 2)


def _mutual_sql(column: str) -> str:
    probs = "[" + ", ".join(str(i / 10) for i in range(1, 10)) + "]"
    return f"""select '{column}' as column_name, sum(n / total * ln(n * total / (nb * nc))) as score from (
 select n, sum(n) over () as total, sum(n) over (partition by b) as nb, sum(n) over (partition by y) as nc from (
  select len(list_filter(e, lambda q: v > q)) as b, y, cast(count(*) as double) as n
  from (select cast({column} as double) as v, event_type as y from events) x, (select quantile_cont(cast({column} as double), {probs}) as e from events) z group by 1, 2) j) w"""


@query("select_mutual_info", _ranked_sql(union([_mutual_sql(c) for c in ("value", "user_id")]), 1))
def select_mutual_info(t: Tables) -> DataFrame:
    return features.top_k(features.mutual_information(t.events, ["value", "user_id"], "event_type"), 1)


def _correlation_sql() -> str:
    names = ["l_quantity", "l_extendedprice", "l_tax", "twice", "near"]
    base = "select l_quantity, l_extendedprice, l_tax, 2 * l_quantity as twice, l_extendedprice + 100 * l_quantity as near from lineitem"
    parts = []
    for i, c in enumerate(names):
        tests = [f"abs(corr({e}, {c})) > 0.95" for e in names[:i]]
        parts.append(f"select {i} as pos, '{c}' as column_name, {' or '.join(tests) or 'count(*) < 0'} as dropped from b")
    return f"with b as ({base}) select {whole('pos', 'position')}, column_name, dropped from ({union(parts)}) x"


@query("select_correlation", _correlation_sql())
def select_correlation(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_quantity", "l_extendedprice", "l_tax", (2 * F.col("l_quantity")).alias("twice"), (F.col("l_extendedprice") + 100 * F.col("l_quantity")).alias("near")
    )
    kept = features.select_correlation(rows, rows.columns)
    return t.spark.createDataFrame([(i, c, c not in kept) for i, c in enumerate(rows.columns)], "position int, column_name string, dropped boolean")


def _default_sql() -> str:
    numeric = ["o_custkey", "o_totalprice"]
    stats = ", ".join(
        f"avg({c}) as {c}_m, stddev_pop({c}) as {c}_s, quantile_cont(cast({c} as double), 0.25) as {c}_a, quantile_cont(cast({c} as double), 0.75) as {c}_b" for c in numeric
    )

    def scaled(c: str) -> str:
        low, high = f"{c}_a - 1.5 * ({c}_b - {c}_a)", f"{c}_b + 1.5 * ({c}_b - {c}_a)"
        return num(f"(least(greatest({c}, {low}), {high}) - {c}_m) / {c}_s", c)

    flags = ", ".join(f"cast(o_orderpriority = '{v}' as double) as \"o_orderpriority_{v}\"" for v in PRIORITIES)
    return f"""select {whole('o_orderkey', 'o_orderkey')}, o_orderstatus, {', '.join(map(scaled, numeric))}, {flags}, {date_parts_sql('o_orderdate', 'double')}
from orders, (select {stats} from orders) q"""


@query("preprocess_default", _default_sql())
def preprocess_default(t: Tables) -> DataFrame:
    return preprocess.apply_preprocessor(t.orders, preprocess.fit_preprocessor(t.orders, "o_orderkey", "o_orderstatus"))


@query("preprocessor_roundtrip", _default_sql())
def preprocessor_roundtrip(t: Tables) -> DataFrame:
    """Stored, reloaded and applied state gives the same features."""
    path = scratch_path(t.spark, "preprocessor")
    catalog.save_preprocessor(t.spark, preprocess.fit_preprocessor(t.orders, "o_orderkey", "o_orderstatus"), path)
    return preprocess.apply_preprocessor(t.orders, catalog.load_preprocessor(t.spark, path))


@query("preprocess_advanced")
def preprocess_advanced(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id")
    return preprocess.apply_advanced(rows, preprocess.fit_advanced(rows, "doc_id", "quality", "text"))


def _info_sql() -> str:
    names = ["o_custkey", "o_totalprice", *[f"o_orderpriority_{v}" for v in PRIORITIES]]
    names += [f"o_orderdate_{p}" for p in ("year", "month", "day", "dayofweek", "hour", "minute")]
    parts = [f"select 'type' as section, column_name as name, column_type as value from ({types_sql('orders')}) t"]
    feature = [c for c in ORDERS if c not in ("o_orderkey", "o_orderstatus")]
    parts.append(f"select 'missing', column_name, cast(missing as varchar) from ({missing_sql('orders', feature)}) m")
    parts += [f"select 'output', {quote(n)}, '{i}'" for i, n in enumerate(names)]
    parts += [f"select 'outliers', column_name, cast(n_outliers as varchar) from ({iqr_sql('orders', c)}) o" for c in ("o_custkey", "o_totalprice")]
    return union(parts)


@query("preprocess_info", _info_sql())
def preprocess_info(t: Tables) -> DataFrame:
    return preprocess.preprocess_info(t.orders, preprocess.fit_preprocessor(t.orders, "o_orderkey", "o_orderstatus"))


STOPS = ", ".join(quote(w) for w in X.STOP_WORDS)


def _tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1), lambda w: w not in ({STOPS}))"


def _tfidf_sql(corpus: str, n_docs: str, limit: int, min_df: int, max_df: float) -> str:
    """``corpus`` gives (doc_id, part, words); weights are for part 0."""
    return f"""with corpus as materialized ({corpus}),
n as (select cast({n_docs} as double) as n),
tf as (select doc_id, part, term, count(*) as tf from (select doc_id, part, unnest(words) as term from corpus) x group by 1, 2, 3),
vocab as (select term, sum(tf) as total, count(*) as df from tf group by 1 having count(*) >= {min_df} and count(*) <= {max_df} * (select n from n) order by 2 desc, 1 limit {limit}),
feats as (select term, row_number() over (order by term) - 1 as feature, ln((1 + n) / (1 + df)) + 1 as idf from vocab, n),
w as (select doc_id, feature, tf.term, tf * idf as w from tf join feats on tf.term = feats.term where part = 0)
select {whole('doc_id', 'doc_id')}, {whole('feature', 'feature')}, term, {num('w / sqrt(sum(w * w) over (partition by doc_id))', 'weight')} from w"""


@query("tfidf_unigram", _tfidf_sql(f"select doc_id, 0 as part, {_tokens_sql('text')} as words from documents", "(select count(*) from documents)", 100, 2, 1.0))
def tfidf_unigram(t: Tables) -> DataFrame:
    text = F.col("text")
    return textfeatures.apply_tfidf(t.documents, "doc_id", text, textfeatures.fit_tfidf(t.documents, [text], 100, 2))


def _bigram_sql() -> str:
    marked, plain = X.accent_table()

    def words(text: str) -> str:
        bare = f"regexp_replace(translate({text}, '{marked}', '{plain}'), '\\p{{M}}', '', 'g')"
        return f"(select list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from (select {_tokens_sql(bare)} as w) y)"

    corpus = union([f"select doc_id, {i} as part, {words(c)} as words from documents" for i, c in enumerate(("text", "lang || ' ' || source"))])
    return _tfidf_sql(corpus, "(select 2 * count(*) from documents)", 1000, 2, 0.95)


@query("tfidf_bigram", _bigram_sql())
def tfidf_bigram(t: Tables) -> DataFrame:
    """Two text columns make one corpus; the weights are those of ``text``."""
    columns = [F.col("text"), F.concat_ws(" ", "lang", "source")]
    vocabulary = textfeatures.fit_tfidf(t.documents, columns, 1000, 2, 0.95, bigrams=True, plain=True)
    return textfeatures.apply_tfidf(t.documents, "doc_id", columns[0], vocabulary)


WORDS = r"len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> ''))"


@query(
    "text_length_features",
    f"""select {whole('doc_id', 'doc_id')}, {whole('length(text)', 'char_count')}, {whole(WORDS, 'word_count')},
{whole("len(regexp_extract_all(text, '[.!?]+'))", 'sentence_count')}, {num(f"{WORDS} / cast(greatest(length(text), 1) as double)", 'avg_word_length')} from documents""",
)
def text_length_features(t: Tables) -> DataFrame:
    return textfeatures.length_features(t.documents, "text").drop("text", "lang", "source", "n_chars")


# A toy lexicon over words of the invented prose: word -> (polarity, subjectivity).
LEXICON = {"with": (0.5, 0.2), "the": (0.1, 0.1), "le": (-0.4, 0.6), "un": (0.3, 0.9), "und": (-0.7, 0.5), "by": (0.8, 0.4), "que": (-0.2, 0.3)}


def _sentiment_sql() -> str:
    rows = ", ".join(f"('{w}', {p}, {s})" for w, (p, s) in LEXICON.items())
    tokens = "regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]{2,})', 1)"
    return f"""with lex as (select * from (values {rows}) v(term, p, s)),
w as (select doc_id, unnest({tokens}) as term from documents)
select {whole('d.doc_id', 'doc_id')}, {num('coalesce(avg(p), 0)', 'polarity')}, {num('coalesce(avg(s), 0)', 'subjectivity')}
from documents d left join (select w.doc_id, cast(p as double) as p, cast(s as double) as s from w join lex on w.term = lex.term) h on d.doc_id = h.doc_id group by 1"""


@query("text_sentiment", _sentiment_sql())
def text_sentiment(t: Tables) -> DataFrame:
    return textfeatures.sentiment(t.documents, "doc_id", "text", LEXICON)


@query("text_embedding")
def text_embedding(t: Tables) -> DataFrame:
    model = textfeatures.word_vectors(t.documents, "doc_id", "text", size=8)
    return textfeatures.embedding_columns(textfeatures.embed_text(t.documents, "doc_id", "text", model), "doc_id", "embedding", 8)


@query("embedding_columns", f"select {whole('vec_id', 'vec_id')}, {', '.join(num(f'embedding[{i + 1}]', f'embedding_embed_{i}') for i in range(64))} from embeddings")
def embedding_columns(t: Tables) -> DataFrame:
    return textfeatures.embedding_columns(t.embeddings, "vec_id", "embedding", 64)
