"""Streaming queries: a table is written as files and drained as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomframe.operators import models, scoring
from loomframe.plans import views
from loomframe.plans.histories import LATEST, CHANGES, run_versions
from loomframe.plans.learning import WEIGHTS, part_rows, plane_sql
from loomframe.plans.registry import Tables, num, query, stamp, whole
from loomframe.plans.views import with_views
from loomframe.session import scratch_path
from loomframe.streaming import jobs


def _as_stream(df: DataFrame, label: str, files: int = 4, per_trigger: int | None = None) -> DataFrame:
    path = scratch_path(df.sparkSession, f"stream-{label}")
    df.repartition(files).write.parquet(path)
    return jobs.read_stream(df.sparkSession, path, df.schema, per_trigger)


def _limit_sql(limit: int, minutes: int) -> str:
    """One request per user and step, carrying the accepted times along."""
    alive = f"list_filter(r.held, lambda x: x > e.t - {minutes * 60_000_000})"
    return f"""with recursive e as (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
r as (select event_id, user_id, rn, true as accepted, [t] as held from e where rn = 1
 union all select e.event_id, e.user_id, e.rn, len({alive}) < {limit}, case when len({alive}) < {limit} then list_append({alive}, e.t) else {alive} end
 from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)
select {whole('event_id', 'event_id')}, {whole('user_id', 'user_id')}, accepted from r"""


@query("rate_limit", _limit_sql(2, 1440))
def rate_limit(t: Tables) -> DataFrame:
    return jobs.rate_limit(t.events, "event_id", "user_id", "ts", limit=2, minutes=1440)


@query("stream_rate_limit", f"select l.* from ({_limit_sql(2, 1440)}) l join events e on e.event_id = l.event_id where e.ts < (select max(ts) - interval '1 hour' from events)")
def stream_rate_limit(t: Tables) -> DataFrame:
    """Requests that the watermark has passed: the last hour is still waiting."""
    stream = _as_stream(t.events.select("event_id", "user_id", "ts"), "limiter")
    return jobs.run_to_table(jobs.rate_limit_stream(stream, "event_id", "user_id", "ts", 2, 1440), "limited", settings=jobs.STATE_STORE)


@query(
    "rate_window_count",
    f"""select {whole('event_id', 'event_id')}, {whole('user_id', 'user_id')}, {whole('''count(*) over (partition by user_id order by ts
 range between interval '3599.999999 seconds' preceding and current row)''', 'window_count')} from events""",
)
def rate_window_count(t: Tables) -> DataFrame:
    return jobs.window_counts(t.events, "user_id", "ts", 60).select("event_id", "user_id", "window_count")


PERFORMANCE = f"count(value) as n, {num('avg(value)', 'mean')}, {num('min(value)', 'min')}, {num('max(value)', 'max')}"


@query(
    "stream_performance",
    f"""select {stamp('w', 'window_start')}, name, n, mean, min, max from (
 select time_bucket(interval '1 day', ts) as w, event_type as name, {PERFORMANCE} from events group by 1, 2) x
where w + interval '1 day' <= (select max(ts) - interval '1 hour' from events)""",
)
def stream_performance(t: Tables) -> DataFrame:
    """Closed windows only: append mode holds the open ones back."""
    stream = _as_stream(t.events, "events")
    return jobs.run_to_table(jobs.windowed_performance(stream, "event_type", "value"), "performance")


@query(
    "stream_performance_sliding",
    f"""select {stamp('w', 'window_start')}, name, n, mean, min, max from (
 select w, event_type as name, {PERFORMANCE} from (
  select time_bucket(interval '12 hours', ts) as w, * from events union all select time_bucket(interval '12 hours', ts) - interval '12 hours', * from events) e group by 1, 2) x
where w + interval '1 day' <= (select max(ts) - interval '1 hour' from events)""",
)
def stream_performance_sliding(t: Tables) -> DataFrame:
    stream = _as_stream(t.events, "events")
    return jobs.run_to_table(jobs.windowed_performance(stream, "event_type", "value", slide="12 hours"), "performance")


@query("stream_score", plane_sql("run-1", "linear_regression"))
def stream_score(t: Tables) -> DataFrame:
    rows = part_rows(t)
    model = models.fit_model(rows, list(WEIGHTS), "y", "linear_regression", "regression")
    stream = _as_stream(rows, "part", 4, 1)
    return jobs.score_stream(stream, lambda s: scoring.score(s, model, "p_partkey", run_id="run-1", name="linear_regression"))


@query(
    "stream_validate",
    f"""select {whole('page_id', 'page_id')}, replace(replace(html, '<', '&lt;'), '>', '&gt;') as html,
 (contains(lower(html), '<script') or contains(lower(html), 'javascript:') or contains(lower(html), 'vbscript:') or contains(lower(html), 'onload=') or contains(lower(html), 'onerror=')) as rejected from pages""",
)
def stream_validate(t: Tables) -> DataFrame:
    """Accepted and rejected rows as the two side tables hold them."""
    stream = _as_stream(t.pages.select("page_id", "html"), "pages", 4, 1)
    base = scratch_path(t.spark, "validated")
    jobs.route_rejects(stream, "html", f"{base}/good", f"{base}/bad", f"{base}/mark").awaitTermination()
    schema = "page_id bigint, html string, rejected boolean"
    sides = [t.spark.read.schema(schema).parquet(f"{base}/{side}") for side in ("good", "bad")]
    return sides[0].unionByName(sides[1]).select("page_id", "html", "rejected")


@query(
    "stream_metric_log",
    with_views("metric_log", f"select {whole('event_id', 'event_id')}, model_name, {num('accuracy', 'accuracy')}, {num('f1_weighted', 'f1_weighted')} from metric_log"),
)
def stream_metric_log(t: Tables) -> DataFrame:
    rows = views.metric_log(t).select("event_id", "model_name", "accuracy", "f1_weighted")
    base = scratch_path(t.spark, "metric-stream")
    jobs.metric_log_stream(_as_stream(rows, "log"), f"{base}/log", f"{base}/mark").awaitTermination()
    return t.spark.read.schema(rows.schema).json(f"{base}/log")


@query("stream_runs_upsert", LATEST.format(CHANGES))
def stream_runs_upsert(t: Tables) -> DataFrame:
    rows = run_versions(t)
    base = scratch_path(t.spark, "runs-stream")
    jobs.upsert_stream(_as_stream(rows, "runs", 3, 1), f"{base}/runs", f"{base}/mark").awaitTermination()
    return jobs.latest_snapshot(t.spark, f"{base}/runs", rows.schema).where(F.col("run_id").isNotNull())
