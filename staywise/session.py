"""Session settings and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Spark's own setting by which a query's shuffle files go when it ends, not when the driver next collects garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folders: dict[str, str] = {}


def local_session(cores: str = "8", app_name: str = "staywise") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster
    session without it is refused, since a machine-local folder would be lost
    together with its executor.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    key = context.applicationId
    if key not in _local_folders:
        _local_folders[key] = tempfile.mkdtemp(prefix="staywise-")
    return _local_folders[key]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage with a durable columnar copy: later passes scan parquet with
    column pruning, and a lost executor never triggers the upstream again.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean_stage(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """``stage`` that leaves no shuffle files behind, as nothing reads them once the copy is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_SETTING, None)
    conf.set(CLEANUP_SETTING, "true")
    try:
        return stage(df, name, **options)
    finally:
        if before is None:
            conf.unset(CLEANUP_SETTING)
        else:
            conf.set(CLEANUP_SETTING, before)
