"""Session settings, shared work folder and small filesystem helpers."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake import config as C


def build_session(app: str = "seawake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on. Cluster sizing stays with spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    A machine-local folder is only ever chosen in local mode, where the driver
    and the executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="seawake-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_STORED: list[str] = []
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def stored(df: DataFrame, name: str, dealt_by: tuple[str, ...] = ()) -> DataFrame:
    """The rows written as a table below the shared folder and read back: cuts the
    lineage, survives lost executors, and later readers take only their columns.
    ``release_stored`` removes such tables. Rows that are ``dealt_by`` columns lie in buckets of
    their values, written by the tasks that have them: what is made of them joins on these
    columns without a shuffle."""
    spark = df.sparkSession
    path = work_path(spark, name)
    _STORED.append(path)
    if not dealt_by:
        df.write.parquet(path)
        return spark.read.parquet(path)
    table, writers = f"{name}_{uuid.uuid4().hex}", spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, C.STORED_BUCKETS)  # else each task sorts its rows by bucket
    try:
        # each task has all buckets open, so they hold little before they write it
        df.write.option("path", path).option("compression", "zstd").option("parquet.block.size", 4 << 20).bucketBy(C.STORED_BUCKETS, *dealt_by).saveAsTable(table, format="parquet")
    finally:
        spark.conf.set(WRITERS, writers)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its files stay, and the frame knows their buckets
    return rows


def release_stored(spark: SparkSession, since: int = 0, keep_last: int = 0) -> None:
    """Removes the tables that ``stored`` wrote in this process, from number ``since`` on
    (``stored_count`` before a job) but for the last ones. For the end of a job, when its
    results are written."""
    for path in _STORED[since : len(_STORED) - keep_last]:
        delete_path(spark, path)
        _STORED.remove(path)


def stored_count() -> int:
    return len(_STORED)


def broadcast_if_small(df: DataFrame, max_rows: int = C.BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored dimension after counting it; beyond ``max_rows`` it is left to
    a shuffled join, where AQE may split a hot key on the other side. Derived tables,
    which a count would compute, are left to AQE and its measured sizes instead."""
    if df.isStreaming:
        return df
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def path_of(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = path_of(spark, path)
    return fs.exists(hadoop_path)


def child_names(spark: SparkSession, path: str) -> list[str]:
    hadoop_path, fs = path_of(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop_path))


def child_ages(spark: SparkSession, path: str) -> dict[str, float]:
    """Seconds since each child of a folder was last changed."""
    hadoop_path, fs = path_of(spark, path)
    if not fs.exists(hadoop_path):
        return {}
    return {s.getPath().getName(): time.time() - s.getModificationTime() / 1000 for s in fs.listStatus(hadoop_path)}


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = path_of(spark, path)
    fs.delete(hadoop_path, True)
