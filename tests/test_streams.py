"""Streams give what the batch gives."""

import pytest
from pyspark.sql import functions as F

from loomframe.session import scratch_path, table
from loomframe.streaming import jobs
from tests.test_scale_paths import limiter_input, replay


def as_stream(df, files=3, per_trigger=None):
    path = scratch_path(df.sparkSession, "test-stream")
    df.repartition(files).write.parquet(path)
    return jobs.read_stream(df.sparkSession, path, df.schema, per_trigger)


def test_windows(spark, sf):
    events = table(spark, sf, "events")
    batch = jobs.windowed_performance(events, "event_type", "value")
    closed = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    want = batch.where(F.col("window_start") + F.expr("interval 1 day") <= F.lit(closed) - F.expr("interval 1 hour"))
    got = jobs.run_to_table(jobs.windowed_performance(as_stream(events), "event_type", "value"), "t")
    keys = ["window_start", "name", "n"]
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, want.select(keys).collect()))


@pytest.mark.parametrize("limit", [1, 3])
def test_stateful_limiter(spark, limit):
    """Micro-batches that overlap by less than the watermark's delay give the decisions of a replay, and no state stays."""
    df = limiter_input(spark).withColumn("at", F.unix_micros("ts"))
    cuts = [df.selectExpr(f"percentile(at, {q}) as m").first()["m"] for q in (0.3, 0.6)]
    # a request goes to an earlier or a later batch by up to half an hour
    moved = df.withColumn("seen", F.col("at") + F.expr("(id * 31 % 60 - 30) * 60000000"))
    path, kept = scratch_path(spark, "limit"), scratch_path(spark, "limited")
    last = df.selectExpr("-1L as id", "-1L as k", "timestamp_micros(max(at) + 86400000000) as ts")
    batches = [moved.where(F.col("seen") <= cuts[0]), moved.where((F.col("seen") > cuts[0]) & (F.col("seen") <= cuts[1])), moved.where(F.col("seen") > cuts[1]), last]
    for number, batch in enumerate(batches):
        batch.select("id", "k", "ts").coalesce(1).write.parquet(f"{path}/{number}")
        stream = spark.readStream.schema(last.schema).option("recursiveFileLookup", True).parquet(path)
        made = jobs.run_to_table(jobs.rate_limit_stream(stream, "id", "k", "ts", limit, 60, "2 hours"), "limited", settings=jobs.STATE_STORE, path=kept)
    rows, got = [(r["id"], r["k"], r["at"]) for r in df.collect()], made.collect()
    assert len(got) == len(rows) and {r["id"]: r["accepted"] for r in got} == replay(rows, limit, 3600_000_000)
    assert "RocksDB" not in spark.conf.get(*jobs.STATE_STORE, "")
    for name in ("waiting", "held"):
        left = spark.read.format("statestore").option("stateVarName", name).load(f"{kept}/mark").selectExpr("key.who as k").distinct().collect()
        assert [r["k"] for r in left] == ([-1] if name == "waiting" else [])


def test_rejects_go_to_their_own_table(spark):
    pages = spark.createDataFrame([(1, "<b>fine</b>"), (2, "<SCRIPT>x"), (3, None), (4, "a onload=b")], "page_id bigint, html string")
    base = scratch_path(spark, "reject")
    jobs.route_rejects(as_stream(pages, 2, 1), "html", f"{base}/good", f"{base}/bad", f"{base}/mark").awaitTermination()
    schema = "page_id bigint, html string, rejected boolean"
    good = {r["page_id"]: r["html"] for r in spark.read.schema(schema).parquet(f"{base}/good").collect()}
    bad = {r["page_id"] for r in spark.read.schema(schema).parquet(f"{base}/bad").collect()}
    assert good == {1: "&lt;b&gt;fine&lt;/b&gt;", 3: None} and bad == {2, 4}


def test_upsert_keeps_the_latest(spark):
    rows = spark.range(300).selectExpr("id % 20 as run_id", "id * 7919 % 1009 as version", "cast(id as double) as best_score")
    base = scratch_path(spark, "upsert")
    jobs.upsert_stream(as_stream(rows, 7, 1), f"{base}/runs", f"{base}/mark", compact_every=3).awaitTermination()
    got = {r["run_id"]: r["version"] for r in jobs.latest_snapshot(spark, f"{base}/runs", rows.schema).collect()}
    want = {r["run_id"]: r["v"] for r in rows.groupBy("run_id").agg(F.max("version").alias("v")).collect()}
    assert got == want
