"""Projections, predicates, input validation and simple joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomframe.operators import preprocess, validate
from loomframe.plans import views
from loomframe.plans.registry import Tables, num, query, quote, union, whole
from loomframe.plans.views import with_views

SECRET = b"example signing key"
STRINGS = {"documents": ["text", "lang", "source"], "pages": ["url", "html"]}


def _hex(data: bytes) -> str:
    return f"unhex('{data.hex()}')"


def _hmac_sql(message: str) -> str:
    block = SECRET.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    return f"sha256({_hex(outer)} || unhex(sha256({_hex(inner)} || encode({message}))))"


@query(
    "split_target",
    f"select {whole('c_custkey', 'c_custkey')}, c_name, {whole('c_nationkey', 'c_nationkey')}, {num('c_acctbal', 'c_acctbal')}, c_mktsegment as target, 'c_mktsegment' as target_name from customer",
)
def split_target(t: Tables) -> DataFrame:
    features, target = preprocess.split_target(t.customer)
    return t.customer.select(*features, F.col(target).alias("target"), F.lit(target).alias("target_name"))


@query(
    "preview",
    f"select {whole('c_custkey', 'c_custkey')}, c_name, {whole('c_nationkey', 'c_nationkey')}, {num('c_acctbal', 'c_acctbal')}, c_mktsegment from customer order by c_custkey limit 10",
)
def preview(t: Tables) -> DataFrame:
    return preprocess.preview(t.customer, "c_custkey", 10)


def _pattern_sql(tables: list[str], patterns: list[str], fold: bool) -> str:
    parts = []
    for name in tables:
        for c in STRINGS[name]:
            text = f"lower({c})" if fold else c
            for p in patterns:
                parts.append(
                    f"select '{name}' as table_name, '{c}' as column_name, {quote(p)} as pattern, count(*) filter (where contains({text}, {quote(p)})) as n_rows from {name}"
                )
    return union(parts)


@query("scan_sql_patterns", _pattern_sql(["documents", "pages"], validate.SQL_PATTERNS, False))
def scan_sql_patterns(t: Tables) -> DataFrame:
    a = validate.scan_sql_patterns(t.documents).withColumn("table_name", F.lit("documents"))
    b = validate.scan_sql_patterns(t.pages).withColumn("table_name", F.lit("pages"))
    return a.unionByName(b)


@query("scan_script_patterns", _pattern_sql(["pages"], validate.SCRIPT_PATTERNS, True))
def scan_script_patterns(t: Tables) -> DataFrame:
    return validate.scan_script_patterns(t.pages).withColumn("table_name", F.lit("pages"))


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "check_large_values",
    union([f"select '{c}' as column_name, {num(f'max(abs({c}))', 'max_abs')}, max(abs({c})) > 1e10 as flagged from lineitem" for c in LINE_NUMBERS]),
)
def check_large_values(t: Tables) -> DataFrame:
    return validate.check_large_values(t.lineitem)


@query(
    "check_long_strings",
    union([f"select '{c}' as column_name, {whole(f'max(length({c}))', 'max_length')}, max(length({c})) > 10000 as flagged from documents" for c in STRINGS["documents"]]),
)
def check_long_strings(t: Tables) -> DataFrame:
    return validate.check_long_strings(t.documents)


def _validate_sql() -> str:
    fixed = [
        ("pages", "expected_columns", "title", "error", "missing"),
        ("pages", "expected_columns", "html", "warning", "unexpected"),
        ("pages", "leakage", "page_id", "warning", "id"),
        ("documents", "leakage", "doc_id", "warning", "id"),
    ]
    parts = ["select * from (values " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in fixed) + ") v(table_name, \"check\", column_name, severity, detail)"]
    for name in ("documents", "pages"):
        for c in STRINGS[name]:
            for check, patterns, text in (("sql_pattern", validate.SQL_PATTERNS, c), ("script_pattern", validate.SCRIPT_PATTERNS, f"lower({c})")):
                for p in patterns:
                    parts.append(
                        f"select '{name}', '{check}', '{c}', 'warning', {quote(p)} from {name} having count(*) filter (where contains({text}, {quote(p)})) > 0"
                    )
            parts.append(f"select '{name}', 'long_string', '{c}', 'warning', cast(max(length({c})) as varchar) from {name} having max(length({c})) > 10000")
    return union(parts)


@query("validate_input", _validate_sql())
def validate_input(t: Tables) -> DataFrame:
    a = validate.validate_input(t.pages, ["page_id", "url", "title"]).withColumn("table_name", F.lit("pages"))
    b = validate.validate_input(t.documents).withColumn("table_name", F.lit("documents"))
    return a.unionByName(b)


@query(
    "sanitize_html",
    f"select {whole('page_id', 'page_id')}, replace(replace(url, '<', '&lt;'), '>', '&gt;') as url, replace(replace(html, '<', '&lt;'), '>', '&gt;') as html from pages",
)
def sanitize_html(t: Tables) -> DataFrame:
    return validate.sanitize_html(t.pages)


@query("hash_rows", f"select {whole('page_id', 'page_id')}, sha256(html) as sha256 from pages")
def hash_rows(t: Tables) -> DataFrame:
    return validate.hash_rows(t.pages, "html").select("page_id", "sha256")


@query("hmac_sign", f"select {whole('event_id', 'event_id')}, {_hmac_sql('props')} as signature from events")
def hmac_sign(t: Tables) -> DataFrame:
    return validate.hmac_sign(t.events, "props", SECRET).select("event_id", "signature")


@query("hmac_verify", f"select {whole('event_id', 'event_id')}, event_id % 10 <> 0 as valid from events")
def hmac_verify(t: Tables) -> DataFrame:
    """Every tenth message is altered after signing."""
    signed = validate.hmac_sign(t.events, "props", SECRET)
    altered = signed.withColumn("props", F.when(F.col("event_id") % 10 == 0, F.concat("props", F.lit("x"))).otherwise(F.col("props")))
    return validate.hmac_verify(altered, "props", "signature", SECRET).select("event_id", "valid")


CHECKS = {
    "price_positive": "o_totalprice > 0",
    "price_below_400k": "o_totalprice < 400000",
    "status_known": "o_orderstatus in ('F', 'O', 'P')",
    "customer_present": "o_custkey is not null",
}


def _suite_sql() -> str:
    parts = [f"select '{n}' as \"check\", count(*) filter (where not coalesce({p}, false)) as failures from orders" for n, p in CHECKS.items()]
    return f"""with c as ({union(parts)})
select "check", cast(failures as bigint) as failures, failures = 0 as healthy from c
union all select '(overall)', cast(sum(failures) as bigint), sum(failures) = 0 from c"""


@query("expectation_suite", _suite_sql())
def expectation_suite(t: Tables) -> DataFrame:
    return validate.expectation_suite(t.orders, {n: F.expr(p) for n, p in CHECKS.items()})


# numbers for most rows, the whole JSON text for some
CODE = "case when event_id % 7 = 0 then props else regexp_extract(props, '[0-9]+') end"


@query(
    "coerce_fill",
    f"select {whole('event_id', 'event_id')}, {num('coalesce(try_cast(event_type as double), 0)', 'event_type')}, {num('value', 'value')}, {num(f'coalesce(try_cast({CODE} as double), 0)', 'code')} from events",
)
def coerce_fill(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", "value", F.expr(CODE.replace("'[0-9]+'", "'[0-9]+', 0")).alias("code"))
    return validate.coerce_fill(rows, ["event_type", "value", "code"])


@query(
    "join_predictions",
    with_views("preds", f"select {whole('d.doc_id', 'doc_id')}, d.lang, p.model, {whole('p.y', 'y')}, {whole('p.pred', 'pred')}, {num('p.p', 'p')} from documents d join preds p on d.doc_id = p.row_id"),
)
def join_predictions(t: Tables) -> DataFrame:
    features = t.documents.select("doc_id", "lang")
    return features.join(views.preds(t).withColumnRenamed("row_id", "doc_id"), "doc_id").select("doc_id", "lang", "model", "y", "pred", "p")
