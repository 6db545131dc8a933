"""Writers of tables, snapshots, messages and scenario files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seawake import config as C
from seawake import schema as S
from seawake.operators.enrich import merge_static
from seawake.session import child_names, delete_path
from seawake.sinks import segments as G
from seawake.sources.files import read_static_snapshot


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def _append(df: DataFrame, path: str, cluster: list[str], batch_id: int | None) -> None:
    """Rows clustered by ``cluster`` so that row groups can be skipped: in day partitions, or from
    a stream as a segment per batch, which ``read_table`` reads and maintenance merges and
    drops. A repeated batch leaves no duplicates."""
    if batch_id is not None:
        G.append_batch(df, path, batch_id, "timestamp", cluster)
        return
    out = df.withColumn("event_date", F.to_date("timestamp"))
    out.sortWithinPartitions("event_date", *cluster).write.mode("append").partitionBy("event_date").parquet(path)


POSITIONS_CLUSTER, ENCOUNTERS_CLUSTER = ["mmsi", "timestamp"], ["mmsi_a", "mmsi_b", "timestamp"]


def write_positions(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    _append(_conform(df, S.POSITIONS), path, POSITIONS_CLUSTER, batch_id)


def write_encounters(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    _append(_conform(df, S.ENCOUNTERS), path, ENCOUNTERS_CLUSTER, batch_id)


def read_table(spark: SparkSession, path: str, schema: T.StructType, low: int | None = None, high: int | None = None) -> DataFrame:
    """A table of positions or encounters that a stream writes, between two times in microseconds."""
    return G.read_span(spark, path, schema, "timestamp", low, high)


def maintain(spark: SparkSession, path: str, schema: T.StructType, ttl_seconds: int | None = None, as_of: int | None = None, **options) -> tuple[int, int]:
    """Drops what is older than ``ttl_seconds`` before ``as_of`` (microseconds) and merges small
    segments of a table that a stream writes. Returns how many were dropped and merged."""
    cluster = ENCOUNTERS_CLUSTER if "mmsi_a" in schema.fieldNames() else POSITIONS_CLUSTER
    gone = 0 if ttl_seconds is None else G.expire(spark, path, schema, "timestamp", as_of - ttl_seconds * 1_000_000, cluster, **options)
    return gone, G.compact(spark, path, schema, "timestamp", cluster, **options)


def write_static(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    out = _conform(df, S.STATIC).sortWithinPartitions("mmsi")
    if batch_id is None:
        out.write.mode("append").parquet(path)
    else:
        out.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(path)


def write_static_snapshot(batch: DataFrame, path: str, version: int, keep: int = 3, keep_s: int = C.VERSION_KEPT_S) -> DataFrame:
    """Merges ``batch`` into the newest version below ``version`` and commits the result as
    ``version``. Ships are dealt to buckets, and only those that the batch touches are
    written; the others are carried over by name. A repeated batch writes its own version
    anew. ``batch`` without rows writes nothing. Older versions than the last ``keep`` go once
    they are older than ``keep_s``."""
    spark = batch.sparkSession
    rows = batch.where("mmsi IS NOT NULL")
    G.upsert(rows, path, version, S.SNAPSHOT, merge_static, ["mmsi"], keep=keep, keep_s=keep_s)
    return read_static_snapshot(spark, path)


def to_message_text(messages: DataFrame) -> DataFrame:
    """Flat messages as JSON text in ``value``; absent values are written as null."""
    fields = [
        F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(f.name)
        if isinstance(f.dataType, T.TimestampType)
        else F.col(f.name)
        for f in S.MESSAGE
    ]
    return messages.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def publish_messages(messages: DataFrame, path: str | None, checkpoint: str | None = None, fmt: str = "text", trigger: dict | None = None, **options):
    """Writes messages to a folder or a queue; a stream gives its running query."""
    text = to_message_text(messages)
    if not messages.isStreaming:
        writer = text.write.format(fmt).mode("append").options(**options)
        return writer.save(path) if path else writer.save()
    writer = text.writeStream.format(fmt).options(**options).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start(path) if path else writer.start()


def publish_batch(messages: DataFrame, path: str | None, batch_id: int, fmt: str = "text", **options) -> None:
    """Messages of a micro-batch: a part of the folder that a repeated batch replaces, or a queue."""
    text = to_message_text(messages).write.format(fmt).options(**options)
    if path is None:
        text.save()
    else:
        text.mode("overwrite").save(f"{path}/batch_id={batch_id}")


def write_scenarios(documents: DataFrame, path: str) -> None:
    """Scenario documents as JSON lines in one folder per hour, ``hour=yyyyMMdd_HH``.
    Writing an hour again replaces that hour only. The documents of an hour meet in one task, or in
    several where they are large, so files do not grow as hours times tasks."""
    (
        documents.withColumn("hour", F.date_format("hour", "yyyyMMdd_HH"))
        .hint("rebalance", "hour")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("hour")
        .json(path)
    )


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None, by_day: bool = True) -> bool:
    """Creates the table unless it exists; says whether it did. Time-partitioned tables
    get an ``event_date`` partition column."""
    if spark.catalog.tableExists(name):
        return False
    columns = [f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema]
    if by_day:
        columns.append("event_date DATE")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(columns)}) USING parquet"
        + (" PARTITIONED BY (event_date)" if by_day else "")
        + (f" LOCATION '{path}'" if path else "")
    )
    return True


def drop_expired(spark: SparkSession, path: str, ttl_seconds: int, as_of: Column) -> list[str]:
    """Removes whole day partitions that ended more than ``ttl_seconds`` before ``as_of``."""
    limit = spark.range(1).select(
        F.date_format(as_of - F.make_dt_interval(secs=F.lit(float(ttl_seconds))), "yyyy-MM-dd").alias("d")
    ).first()["d"]
    prefix = "event_date="
    gone = [n for n in child_names(spark, path) if n.startswith(prefix) and n[len(prefix):] < limit]
    for name in gone:
        delete_path(spark, f"{path}/{name}")
    return gone
