"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASE: dict[str, str] = {}
# scratch tables of this process, for clear_scratch
_MADE: list[str] = []


def build_session(app: str = "loomframe", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the jobs assume: UTC, AQE, Arrow transfer."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder; on a
    cluster a machine-local path would be lost with its executor.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_BASE:
        _LOCAL_BASE[app] = tempfile.mkdtemp(prefix="loomframe-")
    return _LOCAL_BASE[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/loomframe/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process has named so far; returns how many were there.

    Call it when the results that were built on them have been written or collected.
    """
    gone = 0
    while _MADE:
        place = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return gone


def materialize(df: DataFrame, label: str, **options: str | int) -> DataFrame:
    """Write ``df`` once to the shared folder, with the writer's ``options``, and read it back.

    Cuts the lineage with a table that survives the loss of executors, for
    frames that several later jobs read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy work on a table that lies in very few files.

    A large table has more files than the cluster has cores and passes
    through untouched; only a small one pays for a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df.repartition(cores) if 0 < files < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the time zone is pinned for timestamp work."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
