"""Profiling and outlier queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loomframe.operators import iforest, neighbours, outliers, quality
from loomframe.plans import views
from loomframe.plans.registry import Tables, num, query, union, whole
from loomframe.plans.views import with_views

SCHEMAS = {
    "documents": ("doc_id", {"doc_id": "int", "text": "str", "lang": "str", "source": "str", "n_chars": "int"}),
    "orders": (
        "o_orderkey",
        {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "float", "o_orderdate": "time", "o_orderpriority": "str"},
    ),
    "events": ("event_id", {"event_id": "int", "ts": "time", "user_id": "int", "event_type": "str", "value": "float", "props": "str"}),
    "lineitem": (
        "",
        {
            **{c: "int" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")},
            **{c: "float" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")},
            **{c: "str" for c in ("l_returnflag", "l_linestatus")},
            "l_shipdate": "time",
        },
    ),
}
DATES = r"regexp_matches(v, '\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{4}/\d{2}/\d{2}')"


def first_sql(name: str, key: str, column: str) -> str:
    return f"(select {column} as v from {name} where {column} is not null order by {key} limit 10)"


def types_sql(name: str) -> str:
    key, columns = SCHEMAS[name]
    parts = []
    for c, kind in columns.items():
        if kind == "str":
            first = first_sql(name, key, c)
            parts.append(
                f"""select '{c}' as column_name, case
 when (select avg(cast({DATES} as int)) from {first} f) > 0.5 then 'datetime'
 when (select count(distinct {c}) / cast(count(*) as double) from {name}) < 0.1 then 'categorical'
 when (select avg(length(v)) from {first} f) > 20 then 'text' else 'categorical' end as column_type"""
            )
        else:
            parts.append(f"select '{c}' as column_name, '{'datetime' if kind == 'time' else 'numeric'}' as column_type")
    return union(parts)


@query("detect_types", union([f"select '{n}' as table_name, column_name, column_type from ({types_sql(n)}) t_{n}" for n in ("documents", "orders", "events")]))
def detect_types(t: Tables) -> DataFrame:
    parts = [quality.detect_types(getattr(t, n), SCHEMAS[n][0]).withColumn("table_name", F.lit(n)) for n in ("documents", "orders", "events")]
    return reduce(DataFrame.unionByName, parts)


def missing_sql(name: str, columns: list[str]) -> str:
    return union([f"select '{c}' as column_name, count(*) - count({c}) as missing, count(*) as n_rows from {name}" for c in columns])


EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


@query(
    "missing_summary",
    with_views(
        "events_nulls",
        f"""CTE m as ({missing_sql('events_nulls', EVENT_COLUMNS)})
select column_name, {whole('missing', 'missing')}, {num('missing / cast(n_rows as double)', 'ratio')} from m
union all select '(all)', cast(sum(missing) as bigint), {num('sum(missing) / cast(sum(n_rows) as double)', 'ratio')} from m""",
    ),
)
def missing_summary(t: Tables) -> DataFrame:
    return quality.missing_summary(views.events_nulls(t))


CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query(
    "schema_report",
    union(
        [
            f"select '{c}' as column_name, '{k}' as data_type, count({c}) as non_null, count(*) - count({c}) as missing, {num(f'100.0 * (count(*) - count({c})) / count(*)', 'missing_pct')} from customer"
            for c, k in CUSTOMER.items()
        ]
    ),
)
def schema_report(t: Tables) -> DataFrame:
    return quality.schema_report(t.customer)


@query(
    "missing_ranking",
    with_views("events_nulls", f"select column_name, {whole('missing', 'missing')} from ({missing_sql('events_nulls', EVENT_COLUMNS)}) m where missing > 0 order by missing desc"),
)
def missing_ranking(t: Tables) -> DataFrame:
    return quality.missing_ranking(views.events_nulls(t))


def row_text_sql(columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        if kind == "float":
            text = f"printf('%.14e', cast({c} as double) + 0.0)"
        elif kind == "time":
            text = f"cast(epoch_us({c}) as varchar)"
        else:
            text = f"cast({c} as varchar)"
        parts.append(f"coalesce(length({text}) || ':' || {text}, '-')")
    return f"concat({', '.join(parts)})"


def fingerprint_sql(columns: dict[str, str]) -> str:
    return f"cast(coalesce(sum(cast('0x' || substr(md5({row_text_sql(columns)}), 1, 15) as bigint)::hugeint), 0) as varchar)"


ORDERS = SCHEMAS["orders"][1]


@query(
    "dataset_profile",
    f"""with c as (select o_orderstatus, count(*) as n from orders group by 1),
l as (select avg(length(o_orderstatus)) as a, avg(length(o_orderpriority)) as b from orders)
select count(*) as n_rows, cast(6 as bigint) as n_cols, cast(3 as bigint) as n_numeric,
 cast((select 2 - cast(a > 20 as int) - cast(b > 20 as int) from l) as bigint) as n_categorical, cast(1 as bigint) as n_datetime,
 cast((select cast(a > 20 as int) + cast(b > 20 as int) from l) as bigint) as n_text,
 cast(0 as double) as missing_ratio, {num('(select min(n) / cast(max(n) as double) from c)', 'class_balance')},
 'classification' as task_type, 'o_orderstatus' as target, 'o_orderkey,o_custkey,o_totalprice,o_orderdate,o_orderpriority' as features,
 {fingerprint_sql(ORDERS)} as data_hash from orders""",
)
def dataset_profile(t: Tables) -> DataFrame:
    return quality.dataset_profile(t.orders, "o_orderstatus").withColumn("features", F.array_join("features", ","))


def _task_sql() -> str:
    parts = []
    for c, kind in SCHEMAS["lineitem"][1].items():
        test = {"int": "u <= 20", "float": "u <= 20 and u / cast(n as double) < 0.05"}.get(kind, "true")
        parts.append(
            f"select '{c}' as column_name, u as n_unique, case when {test} then 'classification' else 'regression' end as task_type from (select count(distinct {c}) as u, count(*) as n from lineitem) x"
        )
    return union(parts)


@query("detect_task_type", _task_sql())
def detect_task_type(t: Tables) -> DataFrame:
    return quality.task_types(t.lineitem)


@query(
    "class_balance",
    f"select count(*) as n_classes, {num('min(n) / cast(max(n) as double)', 'class_balance')} from (select quality, count(*) as n from labels group by 1) c",
)
def class_balance(t: Tables) -> DataFrame:
    return quality.class_balance(t.labels, "quality")


@query(
    "recommended_metric",
    union(
        [
            f"select '{c}' as target, 'classification' as task_type, {num('b', 'class_balance')}, case when b < 0.3 then 'balanced_accuracy' else 'f1' end as metric from (select min(n) / cast(max(n) as double) as b from (select {c}, count(*) as n from labels group by 1) x) y"
            for c in ("quality", "toxic")
        ]
    ),
)
def recommended_metric(t: Tables) -> DataFrame:
    return quality.recommended_metric(t.labels, "quality").unionByName(quality.recommended_metric(t.labels, "toxic"))


@query(
    "duplicate_rows",
    f"select {whole('sum(n - 1)', 'duplicate_rows')}, {num('sum(n - 1) / cast(sum(n) as double)', 'duplicate_ratio')} from (select text, count(*) as n from documents group by 1) g",
)
def duplicate_rows(t: Tables) -> DataFrame:
    return quality.duplicate_rows(t.documents, ["text"])


@query("cardinalities", union([f"select '{c}' as column_name, count(distinct {c}) as n_unique from orders" for c in ("o_orderstatus", "o_orderpriority")]))
def cardinalities(t: Tables) -> DataFrame:
    return quality.cardinalities(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("type_counts", f"select column_type, count(*) as n_columns from ({types_sql('orders')}) x group by 1")
def type_counts(t: Tables) -> DataFrame:
    return quality.type_counts(t.orders, "o_orderkey")


def iqr_sql(name: str, column: str) -> str:
    """n values, outliers and fences of one column."""
    return f"""select '{name}' as table_name, '{column}' as column_name, count(x.{column}) as n,
 count(*) filter (where q3 > q1 and (x.{column} < q1 - 1.5 * (q3 - q1) or x.{column} > q3 + 1.5 * (q3 - q1))) as n_outliers
 from {name} x, (select quantile_cont({column}, 0.25) as q1, quantile_cont({column}, 0.75) as q3 from (select cast({column} as double) as {column} from {name}) z) q"""


def _quality_sql() -> str:
    numeric = ["o_orderkey", "o_custkey", "o_totalprice"]
    columns = ", ".join(ORDERS)
    parts = [f"select 'type' as section, column_name, column_type as name, cast(1 as double) as value from ({types_sql('orders')}) t"]
    parts.append(f"select 'missing', column_name, 'count', cast(missing as double) from ({missing_sql('orders', list(ORDERS))}) m")
    parts.append("select 'shape', '(all)', 'rows', cast(count(*) as double) from orders")
    parts.append("select 'shape', '(all)', 'columns', cast(6 as double)")
    parts.append(f"select 'duplicates', '(all)', 'rows', cast(sum(n - 1) as double) from (select count(*) as n from orders group by {columns}) d")
    for kind in ("numeric", "categorical", "datetime", "text"):
        parts.append(f"select 'type_count', '(all)', '{kind}', cast(count(*) as double) from ({types_sql('orders')}) t where column_type = '{kind}'")
    for c in numeric:
        parts.append(f"select 'outliers', column_name, 'count', cast(n_outliers as double) from ({iqr_sql('orders', c)}) o")
    for c in ("o_orderstatus", "o_orderpriority"):
        parts.append(
            f"select 'cardinality', '{c}', 'distinct', cast(count(distinct {c}) as double) from orders having (select column_type from ({types_sql('orders')}) t where column_name = '{c}') = 'categorical'"
        )
    return union(parts)


@query("quality_report", _quality_sql())
def quality_report(t: Tables) -> DataFrame:
    return quality.quality_report(t.orders, "o_orderkey")


@query(
    "table_footprint",
    union([f"select '{c}' as column_name, {whole(f'sum(strlen(cast({c} as varchar)))', 'n_bytes')} from documents" for c in SCHEMAS["documents"][1]]),
)
def table_footprint(t: Tables) -> DataFrame:
    return quality.table_footprint(t.documents)


@query("dataset_fingerprint", f"select count(*) as n_rows, {fingerprint_sql(SCHEMAS['documents'][1])} as fingerprint from documents")
def dataset_fingerprint(t: Tables) -> DataFrame:
    return quality.dataset_fingerprint(t.documents)


def _text_sql() -> str:
    words = r"len(list_filter(regexp_split_to_array(trim(v), '\s+'), lambda x: x <> ''))"
    parts = [f"select '{c}' as column_name, avg(cast({words} > 1 as int)) as s from {first_sql('documents', 'doc_id', c)} f" for c in ("text", "lang", "source")]
    return f"select column_name, {num('s', 'multi_word_share')}, s > 0.3 as is_text from ({union(parts)}) x"


@query("text_columns", _text_sql())
def text_columns(t: Tables) -> DataFrame:
    return quality.text_columns(t.documents, "doc_id")


def _target_sql() -> str:
    parts = ["select 'quality' as target, 'class ' || cast(quality as varchar) as name, cast(count(*) as double) as value from labels group by quality"]
    parts.append("select 'o_orderpriority', 'class ' || o_orderpriority, cast(count(*) as double) from orders group by o_orderpriority")
    for name, expr in (("mean", "avg(o_totalprice)"), ("std", "stddev_samp(o_totalprice)"), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)")):
        parts.append(f"select 'o_totalprice', '{name}', {num(expr, 'value')} from orders")
    many = "(select o_custkey, count(*) as n from orders group by 1) c"
    for name, expr in (("classes", "count(*)"), ("top_count", "max(n)"), ("top_share", "max(n) / cast(sum(n) as double)")):
        parts.append(f"select 'o_custkey', '{name}', {num(expr, 'value')} from {many}")
    return union(parts)


@query("target_distribution", _target_sql())
def target_distribution(t: Tables) -> DataFrame:
    parts = [
        quality.target_distribution(t.labels, "quality").withColumn("target", F.lit("quality")),
        quality.target_distribution(t.orders, "o_orderpriority").withColumn("target", F.lit("o_orderpriority")),
        quality.target_distribution(t.orders, "o_totalprice").withColumn("target", F.lit("o_totalprice")),
        quality.target_distribution(t.orders, "o_custkey", "classification").withColumn("target", F.lit("o_custkey")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _feature_sql() -> str:
    numeric = [c for c, k in SCHEMAS["lineitem"][1].items() if k in ("int", "float")]
    means = " + ".join(f"avg({c})" for c in numeric)
    spreads = " + ".join(f"stddev_samp({c})" for c in numeric)
    gaps = " + ".join(f"(count(*) - count({c}))" for c in SCHEMAS["lineitem"][1])
    return f"""select count(*) as n_rows, {num(f'({means}) / 8', 'mean_of_means')}, {num(f'({spreads}) / 8', 'mean_of_stds')},
 cast(8 as bigint) as n_numeric, cast(2 as bigint) as n_categorical, cast(1 as bigint) as n_datetime,
 {num(f'100.0 * ({gaps}) / count(*) / 11', 'missing_pct')} from lineitem"""


@query("feature_statistics", _feature_sql())
def feature_statistics(t: Tables) -> DataFrame:
    return quality.feature_statistics(t.lineitem)


IQR_COLUMNS = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "events": ["user_id", "value"]}


@query(
    "outliers_iqr",
    union(
        [
            f"select table_name, column_name, {whole('n_outliers', 'n_outliers')}, {num('n_outliers / cast(n as double)', 'ratio')} from ({iqr_sql(n, c)}) x"
            for n, columns in IQR_COLUMNS.items()
            for c in columns
        ]
    ),
)
def outliers_iqr(t: Tables) -> DataFrame:
    parts = [outliers.iqr_counts(getattr(t, n), c).withColumn("table_name", F.lit(n)) for n, c in IQR_COLUMNS.items()]
    return reduce(DataFrame.unionByName, parts)


FENCES = "(select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events) q"
OUTSIDE = "(value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1))"


@query("outliers_iqr_rows", f"select {whole('event_id', 'event_id')}, 'value' as column_name, {num('value', 'value')} from events, {FENCES} where {OUTSIDE}")
def outliers_iqr_rows(t: Tables) -> DataFrame:
    return outliers.iqr_rows(t.events, "event_id", ["user_id", "value"])


@query("outlier_remove", f"select {whole('event_id', 'event_id')}, {num('value', 'value')} from events, {FENCES} where not {OUTSIDE}")
def outlier_remove(t: Tables) -> DataFrame:
    return outliers.remove_outliers(t.events, ["value"]).select("event_id", "value")


@query(
    "outliers_zscore",
    f"select {whole('event_id', 'event_id')}, 'value' as column_name, {num('value', 'value')} from events, (select avg(value) as m, stddev_samp(value) as s from events) z where abs((value - m) / s) > 3",
)
def outliers_zscore(t: Tables) -> DataFrame:
    return outliers.zscore_rows(t.events, "event_id", ["value"])


@query("outliers_iforest_1d")
def outliers_iforest_1d(t: Tables) -> DataFrame:
    return iforest.isolation_forest_by_column(t.events, "event_id", ["value"])


@query("outliers_iforest")
def outliers_iforest(t: Tables) -> DataFrame:
    return iforest.isolation_forest(t.part, "p_partkey", ["p_size", "p_retailprice"])


DISTANCE = "round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: power(z[1]::double - z[2]::double, 2)))), 9)"


def knn_sql(k: int) -> str:
    return f"""select vec_id, rn, other, d from (
 select vec_id, other, d, row_number() over (partition by vec_id order by d, other) as rn from (
  select a.vec_id, b.vec_id as other, {DISTANCE} as d from embeddings a join embeddings b on a.vec_id <> b.vec_id) x) y where rn <= {k}"""


@query("knn_join", f"select {whole('vec_id', 'vec_id')}, {whole('rn', 'rank')}, {whole('other', 'neighbour')}, {num('d', 'distance')} from ({knn_sql(5)}) n")
def knn_join(t: Tables) -> DataFrame:
    return neighbours.knn_join(t.embeddings, "vec_id", "embedding", 5)


@query(
    "outliers_lof",
    f"""with n as ({knn_sql(20)}),
k as (select vec_id, max(d) as kd from n group by 1),
r as (select n.vec_id, 1.0 / (avg(greatest(n.d, k.kd)) + 1e-10) as lrd from n join k on n.other = k.vec_id group by 1),
f as (select n.vec_id, round(avg(o.lrd) / any_value(m.lrd), 9) as lof from n join r o on n.other = o.vec_id join r m on n.vec_id = m.vec_id group by 1)
select {whole('vec_id', 'vec_id')}, {num('lof', 'lof')}, lof > (select quantile_cont(lof, 0.9) from f) as outlier from f""",
)
def outliers_lof(t: Tables) -> DataFrame:
    return neighbours.local_outlier_factor(t.embeddings, "vec_id", "embedding", 20, 0.1)


CLIPPED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _clip_sql() -> str:
    q = ", ".join(f"quantile_cont({c}, 0.25) as {c}_a, quantile_cont({c}, 0.75) as {c}_b" for c in CLIPPED)
    out = ", ".join(num(f"least(greatest({c}, {c}_a - 1.5 * ({c}_b - {c}_a)), {c}_b + 1.5 * ({c}_b - {c}_a))", c) for c in CLIPPED)
    return f"select {whole('l_orderkey', 'l_orderkey')}, {whole('l_linenumber', 'l_linenumber')}, {out} from lineitem, (select {q} from lineitem) q"


@query("outliers_clip", _clip_sql())
def outliers_clip(t: Tables) -> DataFrame:
    return outliers.clip_outliers(t.lineitem.select("l_orderkey", "l_linenumber", *CLIPPED), CLIPPED)


def robust_sql() -> str:
    columns = ["p_size", "p_retailprice"]
    q = ", ".join(f"quantile_cont(cast({c} as double), [0.25, 0.5, 0.75]) as {c}_q" for c in columns)
    out = ", ".join(num(f"({c} - {c}_q[2]) / case when {c}_q[3] = {c}_q[1] then 1 else {c}_q[3] - {c}_q[1] end", c) for c in columns)
    return f"select {whole('p_partkey', 'p_partkey')}, {out} from part, (select {q} from part) q"


@query("outliers_transform", robust_sql())
def outliers_transform(t: Tables) -> DataFrame:
    return outliers.robust_transform(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
