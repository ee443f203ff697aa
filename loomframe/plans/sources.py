"""Scans and sinks: every query writes to the shared folder and reads back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loomframe.operators import models
from loomframe.plans import views
from loomframe.plans.registry import Tables, num, query, stamp, union, whole
from loomframe.plans.views import with_views
from loomframe.session import scratch_path
from loomframe.sources import catalog, tables

PART = f"{whole('p_partkey', 'p_partkey')}, p_name, p_brand, p_type, {whole('p_size', 'p_size')}, {num('p_retailprice', 'p_retailprice')}"
SUPPLIER = f"{whole('s_suppkey', 's_suppkey')}, s_name, {whole('s_nationkey', 's_nationkey')}, {num('s_acctbal', 's_acctbal')}"


def _round_trip(df: DataFrame, kind: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"scan-{kind}") + f".{kind}"
    tables.write_table(df, path, kind)
    schema = None if kind in ("arrow", "parquet") else df.schema
    return tables.read_table(df.sparkSession, path, kind, schema)


@query("scan_csv", f"select {PART} from part")
def scan_csv(t: Tables) -> DataFrame:
    return _round_trip(t.part, "csv")


@query("scan_json", f"select {PART} from part")
def scan_json(t: Tables) -> DataFrame:
    return _round_trip(t.part, "json")


@query(
    "scan_parquet",
    f"select {whole('o_orderkey', 'o_orderkey')}, {whole('o_custkey', 'o_custkey')}, o_orderstatus, {num('o_totalprice', 'o_totalprice')}, "
    f"{stamp('o_orderdate', 'o_orderdate')}, o_orderpriority from orders",
)
def scan_parquet(t: Tables) -> DataFrame:
    return tables.read_table(t.spark, f"{t.sf_dir}/orders.parquet")


@query("scan_arrow", f"select {whole('n_nationkey', 'n_nationkey')}, n_name, {whole('n_regionkey', 'n_regionkey')} from nation")
def scan_arrow(t: Tables) -> DataFrame:
    return _round_trip(t.nation, "arrow")


@query("scan_infer", union([f"select '{k}' as source, {PART} from part" for k in ("csv", "json", "parquet")]))
def scan_infer(t: Tables) -> DataFrame:
    """The same table behind three paths without a suffix."""
    parts = []
    for kind in ("csv", "json", "parquet"):
        path = scratch_path(t.spark, "unnamed")
        tables.write_table(t.part, path, kind)
        parts.append(tables.read_table(t.spark, path).select(F.lit(kind).alias("source"), *t.part.columns))
    return reduce(DataFrame.unionByName, parts)


@query("sink_roundtrip", union([f"select '{k}' as sink, {SUPPLIER} from supplier" for k in ("csv", "json", "parquet", "arrow")]))
def sink_roundtrip(t: Tables) -> DataFrame:
    parts = [_round_trip(t.supplier, k).withColumn("sink", F.lit(k)) for k in ("csv", "json", "parquet", "arrow")]
    return reduce(DataFrame.unionByName, parts)


@query(
    "export_xy",
    union(
        [
            "select 'X' as part, cast(5 as bigint) as n_columns, count(*) as n_rows, cast(sum(p_partkey) as bigint) as key_sum, cast(null as double) as target_sum from part",
            f"select 'y', cast(1 as bigint), count(*), cast(null as bigint), {num('sum(p_retailprice)', 'x')} from part",
            f"select 'full', cast(6 as bigint), count(*), cast(sum(p_partkey) as bigint), {num('sum(p_retailprice)', 'x')} from part",
        ]
    ),
)
def export_xy(t: Tables) -> DataFrame:
    paths = tables.export_xy(t.part, "p_retailprice", scratch_path(t.spark, "export"))
    rows = []
    for name, path in paths.items():
        part = t.spark.read.parquet(path)
        keys = F.sum("p_partkey") if "p_partkey" in part.columns else F.lit(None).cast("bigint")
        target = F.sum("p_retailprice") if "p_retailprice" in part.columns else F.lit(None).cast("double")
        rows.append(
            part.agg(
                F.lit(name).alias("part"), F.lit(len(part.columns)).alias("n_columns"), F.count(F.lit(1)).alias("n_rows"), keys.alias("key_sum"), target.alias("target_sum")
            )
        )
    return reduce(DataFrame.unionByName, rows)


@query(
    "leaderboard_roundtrip",
    with_views("trials", f"select {whole('trial_id', 'trial_id')}, model_type, {num('score', 'score')}, params as brand, status from trials"),
)
def leaderboard_roundtrip(t: Tables) -> DataFrame:
    rows = views.trials(t).select("trial_id", "model_type", "score", F.create_map(F.lit("brand"), F.col("params")).alias("params"), "status")
    path = scratch_path(t.spark, "leaderboard")
    catalog.write_leaderboard(rows, path)
    back = catalog.read_leaderboard(t.spark, path, "trial_id bigint, model_type string, score double, params string, status string")
    return back.select("trial_id", "model_type", "score", F.col("params.brand").alias("brand"), "status")


@query(
    "metrics_log_roundtrip",
    with_views(
        "metric_log",
        f"""select {whole('event_id', 'event_id')}, model_name, 'accuracy' as metric, {num('accuracy', 'value')} from metric_log
union all select event_id, model_name, 'f1_weighted', {num('f1_weighted', 'value')} from metric_log where f1_weighted is not null""",
    ),
)
def metrics_log_roundtrip(t: Tables) -> DataFrame:
    log, path = views.metric_log(t), scratch_path(t.spark, "metric-log")
    for name in ("accuracy", "f1_weighted"):
        rows = log.where(F.col(name).isNotNull()).select("event_id", "model_name", F.lit(name).alias("metric"), F.col(name).alias("value"))
        catalog.append_metrics(rows, path)
    return catalog.read_metrics(t.spark, path, "event_id bigint, model_name string, metric string, value double")


@query(
    "artifact_catalog",
    with_views("order_runs", f"select run_id, {stamp('created', 'created')}, task_type, best_model, {num('best_score', 'best_score')}, true as has_file from order_runs"),
)
def artifact_catalog(t: Tables) -> DataFrame:
    runs, path = views.order_runs(t), scratch_path(t.spark, "runs")
    catalog.save_runs(runs, path)
    listed = catalog.list_artifacts(t.spark, path, runs.schema)
    return listed.withColumn("has_file", F.col("file_path").endswith(".json")).drop("file_path")


@query(
    "artifact_retention",
    with_views(
        "order_runs",
        f"""select run_id, {stamp('created', 'created')} from (
 select run_id, created, row_number() over (order by created desc, run_id desc) as rn from order_runs) where rn > 10""",
    ),
)
def artifact_retention(t: Tables) -> DataFrame:
    return catalog.retention(views.order_runs(t), 10).select("run_id", "created")


@query("model_roundtrip", "select count(*) as n_rows, cast(0 as double) as max_gap, true as lists_steps from lineitem")
def model_roundtrip(t: Tables) -> DataFrame:
    """Predictions before and after a reload, compared row by row."""
    rows = t.lineitem.select("l_quantity", "l_discount", "l_extendedprice")
    model = models.fit_model(rows, ["l_quantity", "l_discount"], "l_extendedprice", "linear_regression", "regression")
    path = scratch_path(t.spark, "model")
    catalog.save_model(model, path)
    again = catalog.load_model(path)
    first = model.transform(rows).withColumnRenamed("prediction", "before").drop("features")
    both = again.transform(first)
    steps = len(models.step_listing(again)) > 0
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("prediction") - F.col("before"))).alias("max_gap"), F.lit(steps).alias("lists_steps")
    )


@query(
    "concat_columns",
    f"select {whole('d.doc_id', 'doc_id')}, d.source, {whole('d.n_chars', 'n_chars')}, {whole('l.quality', 'n_chars_1')}, {whole('l.toxic', 'toxic')} from documents d join labels l on d.doc_id = l.doc_id",
)
def concat_columns(t: Tables) -> DataFrame:
    left = t.documents.select("doc_id", "source", "n_chars")
    right = t.labels.select("doc_id", F.col("quality").alias("n_chars"), "toxic")
    return tables.concat_columns(left, right, "doc_id")
