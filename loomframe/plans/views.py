"""Derived inputs, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomframe.plans.registry import Tables

VIEWS = {
    "events_nulls": """
select event_id, ts, user_id,
 case when event_id % 25 = 0 then null else event_type end as event_type,
 case when event_id % 20 = 0 then null else value end as value from events""",
    "preds": """
select row_id, model, y, p, case when p >= 0.5 then 1 else 0 end as pred from (
 select d.doc_id as row_id, 'm0' as model, l.quality as y, least(d.n_chars, 2000) / cast(2000 as double) as p from labels l join documents d on l.doc_id = d.doc_id
 union all select l.doc_id, 'm1', l.quality, ((l.doc_id * 37) % 101) / cast(100 as double) from labels l
 union all select l.doc_id, 'm2', l.quality, l.quality * cast(0.6 as double) + ((l.doc_id * 17) % 101) / cast(250 as double) from labels l) t""",
    "probs": """
select row_id, y, class, s / sum(s) over (partition by row_id) as p from (
 select e.vec_id as row_id, e.label as y, c.label as class,
  cast((e.vec_id * 31 + c.label * 17) % 97 + 1 + case when c.label = e.label then 60 else 0 end as double) as s
 from embeddings e cross join (select distinct label from embeddings) c) t""",
    "preds_reg": """
select row_id, model, y, pred from (
 select o_orderkey as row_id, 'm0' as model, o_totalprice as y, cast(250000 as double) as pred from orders
 union all select o_orderkey, 'm1', o_totalprice, o_totalprice * 0.9 + (o_orderkey % 101) * 100 from orders
 union all select o_orderkey, 'm2', o_totalprice, o_totalprice + ((o_custkey * 37) % 1009 - 504) * 200 from orders) t""",
    "trials": """
select p_partkey as trial_id, p_type as model_type, (p_retailprice - 900) / 100 as score, 'accuracy' as metric,
 p_size / cast(10 as double) as fit_time, p_size / cast(1000 as double) as predict_time, p_brand as params,
 case when p_partkey % 17 = 0 then 'failed' else 'completed' end as status from part""",
    "runs": """
select p_brand as run_id, case when count(*) % 2 = 0 then 'classification' else 'regression' end as task_type,
 count(*) as n_rows, max(p_size) as n_features, min(p_size) - 1 as n_numeric, count(distinct p_type) as n_categorical,
 avg(p_size) / 100 as missing_ratio, case when count(*) % 3 = 0 then null else min(p_size) / cast(max(p_size) as double) end as class_balance,
 min(p_type) as best_model, avg(p_retailprice) / 1000 as best_score, max(p_name) as best_params from part group by p_brand""",
    "metric_log": """
select event_id, ts, event_type as model_name, user_id as run_id, value / 500 as accuracy,
 case when event_id % 7 = 0 then null else value / 600 end as f1_weighted from events""",
    "order_runs": """
select 'run-' || cast(o_orderkey as varchar) as run_id, o_orderdate as created, o_orderpriority as task_type,
 o_orderstatus as best_model, o_totalprice / 1000000 as best_score from orders""",
}


def with_views(names: str, body: str) -> str:
    """SQL text that defines the named views before ``body``."""
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in names.split())
    return f"with {ctes}{', ' if body.lstrip().startswith('CTE ') else ' '}{body.lstrip().removeprefix('CTE ')}"


def _sql(t: Tables, view: str, *tables: str) -> DataFrame:
    names = {name: getattr(t, name) for name in tables}
    return t.spark.sql(VIEWS[view].replace(" from events", " from {events}").replace(" from part", " from {part}").replace(" from orders", " from {orders}").replace("varchar", "string"), **names)


def events_nulls(t: Tables) -> DataFrame:
    return _sql(t, "events_nulls", "events")


def trials(t: Tables) -> DataFrame:
    return _sql(t, "trials", "part")


def runs(t: Tables) -> DataFrame:
    return _sql(t, "runs", "part")


def metric_log(t: Tables) -> DataFrame:
    return _sql(t, "metric_log", "events")


def preds_reg(t: Tables) -> DataFrame:
    return _sql(t, "preds_reg", "orders")


def order_runs(t: Tables) -> DataFrame:
    return _sql(t, "order_runs", "orders")


def preds(t: Tables) -> DataFrame:
    """Three scorers per labelled document, from one join and one expansion."""
    row = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    doc, y = F.col("doc_id"), F.col("quality")
    scores = {
        "m0": F.least(F.col("n_chars"), F.lit(2000)) / F.lit(2000.0),
        "m1": ((doc * 37) % 101) / F.lit(100.0),
        "m2": y * F.lit(0.6) + ((doc * 17) % 101) / F.lit(250.0),
    }
    cells = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("p")) for m, p in scores.items()])
    rows = row.select(doc.alias("row_id"), y.alias("y"), F.inline(cells))
    return rows.withColumn("pred", (F.col("p") >= 0.5).cast("int"))


def probs(t: Tables) -> DataFrame:
    """Class probabilities; the class list is a small array, not a join."""
    classes = sorted(r["label"] for r in t.embeddings.select("label").distinct().collect())
    raw = [
        ((F.col("vec_id") * 31 + F.lit(c) * 17) % 97 + 1 + F.when(F.col("label") == c, 60).otherwise(0)).cast("double") for c in classes
    ]
    total = sum(raw[1:], raw[0])
    cells = F.array(*[F.struct(F.lit(c).alias("class"), (s / total).alias("p")) for c, s in zip(classes, raw)])
    return t.embeddings.select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"), F.inline(cells))
