"""Table readers and writers: CSV, JSON, Parquet, Arrow IPC, inferred."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

SUFFIXES = {
    ".csv": "csv",
    ".json": "json",
    ".parquet": "parquet",
    ".feather": "arrow",
    ".arrow": "arrow",
}
ARROW_FILE_ROWS = 1_000_000


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _spark_path(spark: SparkSession, path: str):
    """The file system Spark uses for ``path``, and the path on it with its scheme."""
    bare = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = bare.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(bare)


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Data files of a file or folder path on any file system Spark reads, markers left out."""
    system, place = _spark_path(spark, path)
    if not system.exists(place):
        raise FileNotFoundError(path)
    found, names = system.listFiles(place, True), []
    while found.hasNext():
        status = found.next()
        if status.getLen():
            names.append(status.getPath().toString())
    return sorted(n for n in names if not posixpath.basename(n).startswith(("_", ".")))


def _first_bytes(spark: SparkSession, path: str, size: int = 64) -> bytes:
    files = data_files(spark, path)
    if not files:
        return b""
    system, place = _spark_path(spark, files[0])
    stream = system.open(place)
    try:
        found = (stream.read() for _ in range(size))
        return bytes(b for b in found if b >= 0)
    finally:
        stream.close()


def infer_format(spark: SparkSession, path: str) -> str:
    """Format by suffix, or by the first bytes of the data when there is none."""
    bare = path.rstrip("/").lower()
    for suffix, kind in SUFFIXES.items():
        if bare.endswith(suffix):
            return kind
    head = _first_bytes(spark, path)
    if head.startswith(b"PAR1"):
        return "parquet"
    if head.startswith(b"ARROW1"):
        return "arrow"
    if head.lstrip()[:1] in (b"{", b"["):
        return "json"
    if head:
        return "csv"
    raise ValueError(f"cannot tell the format of {path!r}")


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Read a table; a given schema saves the inference pass over the data.

    ``multi_line`` lets CSV fields hold line breaks, at the price of one task
    per file; without it files are split.
    """
    kind = kind or infer_format(spark, path)
    if kind == "csv":
        reader = spark.read.option("header", True)
        # nulls are \N, so an empty field stays an empty string
        reader = reader.option("escape", '"').option("multiLine", multi_line).option("nullValue", "\\N")
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if kind == "json":
        first = _first_bytes(spark, path).lstrip()[:1]
        reader = spark.read.option("multiLine", first == b"[")
        return (reader.schema(schema) if schema else reader).json(path)
    if kind == "parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if kind == "arrow":
        return read_arrow(spark, path)
    raise ValueError(f"unknown format {kind!r}")


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files, one task per file; Spark hands the bytes of a file over."""
    files = spark.read.format("binaryFile").load(data_files(spark, path))
    schema = from_arrow_schema(pa.ipc.open_file(pa.BufferReader(files.orderBy("path").select("content").first()["content"])).schema, prefer_timestamp_ntz=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                reader = pa.ipc.open_file(pa.BufferReader(content.as_buffer()))
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i)

    return files.select("content").mapInArrow(scan, schema)


def write_arrow(df: DataFrame, path: str, rows_per_file: int = ARROW_FILE_ROWS) -> int:
    """Each task streams its rows into Arrow IPC files of bounded length.

    Files carry the partition number and appear under their final name only
    when complete, so a repeated task replaces its own files.  A path without a
    scheme lies where Spark's default file system puts it.
    """
    path = _spark_path(df.sparkSession, path)[1].toString()

    def sink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, base = _filesystem(path)
        system.create_dir(base, recursive=True)
        total, number, writer, handle, held = 0, 0, None, None, 0
        temp = ""

        def close() -> None:
            writer.close()
            handle.close()
            system.move(temp, f"{base}/part-{part:05d}-{number:05d}.arrow")

        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                temp = f"{base}/_writing-{part:05d}-{number:05d}-{TaskContext.get().taskAttemptId()}"
                handle = system.open_output_stream(temp)
                writer = pa.ipc.new_file(handle, batch.schema)
            writer.write_batch(batch)
            total, held = total + batch.num_rows, held + batch.num_rows
            if held >= rows_per_file:
                close()
                writer, held, number = None, 0, number + 1
        if writer is not None:
            close()
        yield pa.record_batch({"rows": pa.array([total], pa.int64())})

    written = df.mapInArrow(sink, "rows bigint")
    return sum(r["rows"] for r in written.collect())


def write_table(df: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists") -> None:
    """Write a table; an unknown suffix means CSV."""
    if kind is None:
        kind = next((k for s, k in SUFFIXES.items() if path.rstrip("/").lower().endswith(s)), "csv")
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).option("escape", '"').option("nullValue", "\\N").csv(path)
    elif kind == "json":
        writer.json(path)
    elif kind == "parquet":
        writer.parquet(path)
    elif kind == "arrow":
        write_arrow(df, path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def export_xy(df: DataFrame, target: str, path: str) -> dict[str, str]:
    """Features, target and both as three Parquet tables."""
    paths = {"X": f"{path}/X", "y": f"{path}/y", "full": f"{path}/full"}
    df.drop(target).write.parquet(paths["X"])
    df.select(target).write.parquet(paths["y"])
    df.write.parquet(paths["full"])
    return paths


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get _1, _2, ... in order of appearance."""
    taken, out, counts = set(names), [], {}
    for name in names:
        if name not in counts:
            counts[name] = 0
            out.append(name)
            continue
        while True:
            counts[name] += 1
            fresh = f"{name}_{counts[name]}"
            if fresh not in taken:
                break
        taken.add(fresh)
        out.append(fresh)
    return out


def concat_columns(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Columns of two tables side by side, aligned on an explicit key."""
    shared = right.toDF(*[f"__r_{c}" for c in right.columns])
    joined = left.join(shared, left[key] == shared[f"__r_{key}"], how).drop(f"__r_{key}")
    return joined.toDF(*unique_names([*left.columns, *[c for c in right.columns if c != key]]))
