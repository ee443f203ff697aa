"""Streams of events, validations, scores, metrics and run changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomframe.operators import history, validate
from loomframe.session import materialize, scratch_path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


# the store that states with timers need
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_to_table(stream: DataFrame, label: str, mode: str = "append", settings: dict[str, str] | None = None, path: str | None = None) -> DataFrame:
    """Drain the available input into Parquet and return the table; ``settings`` hold for this query only.

    With the same ``path`` again the query goes on where it stopped.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    out, mark = f"{path}/rows", f"{path}/mark"
    earlier = {name: spark.conf.get(name, None) for name in settings or {}}
    try:
        for name, value in (settings or {}).items():
            spark.conf.set(name, value)
        writer = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", mark)
        query = writer.trigger(availableNow=True).start()
    finally:
        for name, value in earlier.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with time zone; the session runs in UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_performance(df: DataFrame, name: str, value: str, ts: str = "ts", width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, mean, min and max per name and time window, batch or stream."""
    rows = with_event_time(df, ts)
    if df.isStreaming:
        rows = rows.withWatermark(ts, late)
    frame = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        rows.groupBy(frame.alias("w"), F.col(name).alias("name"))
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
        .select(F.col("w.start").alias("window_start"), "name", "n", "mean", "min", "max")
    )


def validated(df: DataFrame, column: str) -> DataFrame:
    """Script flag and sanitised text, stateless on batch and stream."""
    return df.withColumn("rejected", F.coalesce(validate.script_flag(F.col(column)), F.lit(False))).withColumn(
        column, validate.escape_markup(F.col(column))
    )


def route_rejects(stream: DataFrame, column: str, good: str, bad: str, mark: str):
    """Accepted rows to one table, rejected rows to another, per micro-batch.

    The batch id is part of the folder, so a replayed batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.where(~F.col("rejected")).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where("rejected").write.mode("overwrite").parquet(f"{bad}/batch={number}")

    return validated(stream, column).writeStream.foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, snapshot: str, mark: str, key: str = "run_id", version: str = "version", compact_every: int = 20):
    """Latest row per key as a stream: small deltas, now and then a new base.

    A micro-batch writes only its own latest rows, so its cost does not grow
    with the table; every ``compact_every`` batches the deltas are folded into
    a new base.  The folder carries the batch number, so a replayed batch
    replaces itself.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        if number and number % compact_every == 0:
            rows = history.upsert_runs(latest_snapshot(spark, snapshot, schema, key, version, number), batch, key, version)
            rows.write.mode("overwrite").parquet(f"{snapshot}/base={number}")
        else:
            rows = history.upsert_runs(batch, batch.limit(0), key, version)
            rows.write.mode("overwrite").parquet(f"{snapshot}/delta={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", mark).trigger(availableNow=True).start()


def latest_snapshot(
    spark: SparkSession, snapshot: str, schema: T.StructType, key: str = "run_id", version: str = "version", before: int | None = None
) -> DataFrame:
    """Newest base and the deltas after it, merged (only batches below ``before``)."""
    from loomframe.sources.tables import data_files

    found: dict[str, set[int]] = {"base": set(), "delta": set()}
    for name in data_files(spark, snapshot):
        for kind in found:
            if f"/{kind}=" in name:
                found[kind].add(int(name.split(f"/{kind}=")[1].split("/")[0]))
    usable = {kind: {n for n in numbers if before is None or n < before} for kind, numbers in found.items()}
    base = max(usable["base"], default=-1)
    paths = [f"{snapshot}/base={base}"] if base >= 0 else []
    paths += [f"{snapshot}/delta={n}" for n in sorted(usable["delta"]) if n > base]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return history.upsert_runs(rows, rows.limit(0), key, version)


SLICES = 60


def _sliced(df: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Time in microseconds and the number of its slice, 1/60 of the window."""
    width = minutes * 60_000_000 // SLICES
    return df.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__slice", F.floor(F.col("__t") / F.lit(width)))


def window_counts(df: DataFrame, key: str, ts: str, minutes: int = 60) -> DataFrame:
    """Requests of the same key in the last ``minutes``, the row included.

    A window of 60 slices ends in the row's own slice and begins in the slice
    60 before.  Whole slices come from a table of slice sizes; inside the own
    slice each request adds one and each request of 60 slices ago takes one
    away once it is out of the window (exactly ``minutes`` old is out).  So a
    hot key spreads over its slices and no window spans a key.
    """
    span = minutes * 60_000_000
    rows = _sliced(df, ts, minutes)
    before = Window.partitionBy(key).orderBy("__slice").rangeBetween(-SLICES, -1)
    sizes = rows.groupBy(key, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    earlier = sizes.select(key, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__earlier"))
    copies = F.array(
        F.struct(F.col("__slice").alias("__at"), F.col("__t").alias("__pos"), F.lit(1).alias("__step")),
        F.struct((F.col("__slice") + SLICES).alias("__at"), (F.col("__t") + span).alias("__pos"), F.lit(-1).alias("__step")),
    )
    moves = rows.select(*df.columns, F.inline(copies))
    running = Window.partitionBy(key, "__at").orderBy("__pos").rangeBetween(Window.unboundedPreceding, 0)
    counted = moves.withColumn("__run", F.sum("__step").over(running)).where("__step = 1")
    joined = counted.withColumnRenamed("__at", "__slice").join(earlier, [key, "__slice"])
    return joined.select(*df.columns, (F.col("__earlier") + F.col("__run")).alias("window_count"))


def _walk(times: np.ndarray, held: list[int], limit: int, span: int) -> list[int]:
    """Places of the accepted requests among sorted times; ``held`` keeps the accepted times in reach.

    Once the limit is reached the next request that can be accepted is the first one
    a whole window after the oldest in reach, so rejected requests are jumped over.
    """
    taken, at = [], 0
    while at < len(times):
        now = int(times[at])
        while held and held[0] <= now - span:
            held.pop(0)
        if len(held) < limit:
            held.append(now)
            taken.append(at)
            at += 1
        else:
            at = int(np.searchsorted(times, held[0] + span, "left"))
    return taken


PACK_ROWS = 50_000


def _packs(hot: DataFrame, row: str, key: str, minutes: int, pack_rows: int) -> DataFrame:
    """(key, part, pack, first, times, rows): runs of requests of about ``pack_rows`` in time order.

    Slices with more rows are cut into shorter ones of equal time first.
    """
    width = minutes * 60_000_000 // SLICES
    by = [key, "part", "slice"]
    cuts = hot.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / pack_rows).alias("cuts"))
    fine = hot.join(cuts, by).withColumn("bit", F.floor((F.col("__t") - F.col("slice") * width) * F.col("cuts") / width))
    sizes = fine.groupBy(*by, "bit").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key, "part").orderBy("slice", "bit").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sizes.select(*by, "bit", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / pack_rows).alias("pack"))
    runs = fine.join(numbered, [*by, "bit"]).groupBy(key, "part", "pack").agg(F.array_sort(F.collect_list(F.struct("__t", row))).alias("run"))
    return runs.select(key, "part", "pack", F.col("run")[0]["__t"].alias("first"), F.col("run.__t").alias("times"), F.col(f"run.{row}").alias("rows"))


def _entries(packs: DataFrame, key: str, limit: int, span: int) -> tuple[DataFrame, int]:
    """(key, part, pack, entry): accepted times in reach where each pack begins, and the rounds it took.

    All packs are walked at once, as if nothing was in reach before them. What a pack
    leaves behind is what the next one begins with; packs for which that differs from
    what they were walked with are walked again, until none does. What a pack began with
    fades as soon as two walks accept the same requests for one window, so few rounds
    are the rule; there are never more than packs in a row.
    """
    names = [key, "part", "pack"]
    out = T.StructType([*packs.select(*names).schema.fields, T.StructField("entry", T.ArrayType(T.LongType())), T.StructField("left", T.ArrayType(T.LongType()))])

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left = []
            for times, entry in zip(batch["times"], batch["entry"]):
                held = [int(t) for t in entry]
                _walk(np.asarray(times, np.int64), held, limit, span)
                left.append(held)
            yield batch[[*names, "entry"]].assign(left=left)

    nothing = F.array().cast("array<bigint>")
    walked = materialize(packs.select(*names, "times", nothing.alias("entry")).mapInPandas(leave, out), "limiter-walk")
    order = Window.partitionBy(key, "part").orderBy("pack")
    firsts, rounds = packs.select(*names, "first"), 1
    while True:
        in_reach = F.filter(F.coalesce(F.lag("left").over(order), nothing), lambda t: t > F.col("first") - span)
        known = walked.join(firsts, names).withColumn("due", in_reach)
        known = materialize(known.select(*names, "entry", "left", "due"), "limiter-due")
        due = known.filter("entry <> due")
        if due.isEmpty():
            return known.select(*names, "entry"), rounds
        again = due.select(*names, F.col("due").alias("entry")).join(packs.select(*names, "times"), names)
        same = known.filter("entry = due").select(*names, "entry", "left")
        walked = materialize(same.unionByName(again.select(*names, "times", "entry").mapInPandas(leave, out)), "limiter-walk")
        rounds += 1


def rate_limit(df: DataFrame, row: str, key: str, ts: str, limit: int = 100, minutes: int = 60, pack_rows: int = PACK_ROWS) -> DataFrame:
    """(row, key, accepted) of a sliding-log limiter that does not store rejects.

    A decision depends on earlier ones only through requests closer than the
    window, so each key is cut at quiet gaps into spans.  Spans in which the
    raw count never passes the limit are accepted by a plain projection.  Spans
    that do reach it are cut into packs of some ``pack_rows`` requests, which are
    walked side by side until each begins with what the one before it leaves.
    """
    span = minutes * 60_000_000
    rows = _sliced(window_counts(df.select(row, key, ts), key, ts, minutes), ts, minutes).withColumnRenamed("__slice", "slice")
    # read by the span search and by both branches below, so written once
    rows = materialize(rows.select(row, key, "__t", "slice", "window_count"), "limiter")
    # one row per key and slice: no quiet gap fits inside a slice
    slices = rows.groupBy(key, "slice").agg(F.min("__t").alias("first"), F.max("__t").alias("last"), F.max("window_count").alias("peak"))
    order = Window.partitionBy(key).orderBy("slice")
    cut = F.coalesce((F.col("first") - F.lag("last").over(order) >= span).cast("int"), F.lit(1))
    marked = slices.withColumn("cut", cut).withColumn("part", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    heat = marked.groupBy(key, "part").agg(F.max("peak").alias("heat"))
    parts = marked.select(key, "slice", "part").join(heat, [key, "part"])
    tagged = rows.join(parts, [key, "slice"])
    calm = tagged.where(F.col("heat") <= limit).select(row, key, F.lit(True).alias("accepted"))

    # of requests at the same time no more than the limit can be accepted
    tied = Window.partitionBy(key, "part", "__t").orderBy(row)
    hot = tagged.where(F.col("heat") > limit).withColumn("nth", F.row_number().over(tied))
    surplus = hot.where(F.col("nth") > limit).select(row, key, F.lit(False).alias("accepted"))
    packs = materialize(_packs(hot.where(F.col("nth") <= limit).select(row, key, "part", "slice", "__t"), row, key, minutes, pack_rows), "limiter-packs")
    entries, _ = _entries(packs, key, limit, span)
    schema = T.StructType([*rows.select(row, key).schema.fields, T.StructField("accepted", T.BooleanType())])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for who, times, members, entry in zip(batch[key], batch["times"], batch["rows"], batch["entry"]):
                accepted = np.zeros(len(times), bool)
                accepted[_walk(np.asarray(times, np.int64), [int(t) for t in entry], limit, span)] = True
                yield pd.DataFrame({row: members, key: who, "accepted": accepted})

    walked = packs.join(entries, [key, "part", "pack"]).select(key, "times", "rows", "entry").mapInPandas(decide, schema)
    return calm.unionByName(surplus).unionByName(walked)


@dataclass
class _Limiter(StatefulProcessor):
    """Requests wait until the watermark has passed them; then they are decided in order of time.

    The state of a key is its waiting requests and the accepted times in reach. A timer
    stands at the next waiting request or, if none waits, where the last accepted one
    falls out of reach; there the state of the key ends.
    """

    row: str
    key: str
    kinds: tuple[str, str]
    limit: int
    span: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"t bigint, row {self.kinds[0]}")
        self.held = handle.getListState("held", "t bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.waiting.appendList(list(zip(batch["t"].tolist(), batch["request"].tolist())))
        yield from self._decide(key, timerValues.getCurrentWatermarkInMs() * 1_000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._decide(key, timerValues.getCurrentWatermarkInMs() * 1_000)

    def _decide(self, key: tuple, mark: int) -> Iterator[pd.DataFrame]:
        waiting = sorted(tuple(x) for x in self.waiting.get())
        held = [int(x[0]) for x in self.held.get()]
        due = [x for x in waiting if x[0] < mark]
        waiting = waiting[len(due) :]
        if due:
            accepted = np.zeros(len(due), bool)
            accepted[_walk(np.array([x[0] for x in due], np.int64), held, self.limit, self.span)] = True
            yield pd.DataFrame({self.row: [x[1] for x in due], self.key: key[0], "accepted": accepted})
        held = [t for t in held if t > mark - self.span]
        for state, left in ((self.waiting, waiting), (self.held, [(t,) for t in held])):
            if left:
                state.put(left)
            else:
                state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting or held:
            due_at = min([waiting[0][0]] if waiting else [held[-1] + self.span])
            self.handle.registerTimer(due_at // 1_000 + 1)

    def close(self) -> None:
        pass


def rate_limit_stream(stream: DataFrame, row: str, key: str, ts: str, limit: int = 100, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """The limiter as a stateful stream over event time: (row, key, accepted) once the watermark has passed a request.

    Requests may arrive out of order by as much as ``late``; later ones are dropped.
    Start the query with the state store of STATE_STORE.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    at = F.col(ts).cast("timestamp")
    rows = stream.select(F.col(row).alias("request"), F.col(key).alias("who"), at.alias("at"), F.unix_micros(at).alias("t"))
    return rows.withWatermark("at", late).groupBy("who").transformWithStateInPandas(
        _Limiter(row, key, (kinds[row], kinds[key]), limit, minutes * 60_000_000), f"{row} {kinds[row]}, {key} {kinds[key]}, accepted boolean", "Append", "EventTime"
    )


def metric_log_stream(stream: DataFrame, path: str, mark: str):
    """Evaluations appended to a JSON log as they arrive."""
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", mark).trigger(availableNow=True).start()


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], label: str = "scores") -> DataFrame:
    """The batch scorer on a stream; it keeps no state."""
    return run_to_table(scorer(stream), label)
