"""Readers of feeds, message queues, snapshots and history documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake import schema as S
from seawake.operators.parse import read_envelopes
from seawake.operators.series import newest
from seawake.session import path_exists
from seawake.sinks import segments as G


def read_values(spark: SparkSession, path: str | None, fmt: str = "text", stream: bool = True, **options) -> DataFrame:
    """One ``value`` string column from a folder of text files or from a queue
    (``fmt="kafka"`` with its options). For files ``maxFilesPerTrigger`` bounds a batch."""
    reader = (spark.readStream if stream else spark.read).format(fmt).options(**options)
    raw = reader.load(path) if path else reader.load()
    return raw.select(F.col("value").cast("string").alias("value"))


def read_feed(spark: SparkSession, path: str | None, fmt: str = "text", stream: bool = True, **options) -> DataFrame:
    """Feed envelopes; text that does not decode is skipped."""
    return read_envelopes(read_values(spark, path, fmt, stream, **options))


def read_messages(spark: SparkSession, path: str | None, fmt: str = "text", stream: bool = True, **options) -> DataFrame:
    """Queue of position messages as JSON text."""
    return read_values(spark, path, fmt, stream, **options)


def snapshot_versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions of a snapshot folder, oldest first."""
    return G.manifest_versions(spark, folder)


def read_static_snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Static snapshot, one row per ship; nothing there gives an empty table.

    ``path`` is a versioned folder (the newest complete version is read, or the newest
    one below ``before``) or a JSON array file, in which the later entry of a ship wins.
    """
    if not path.endswith(".json"):
        return G.read_newest(spark, path, S.SNAPSHOT, before)
    if not path_exists(spark, path):
        return spark.createDataFrame([], S.SNAPSHOT)
    entries = spark.read.option("multiLine", True).schema(S.SNAPSHOT).json(path)
    # one array file is read by one task, in order
    numbered = entries.withColumn("_at", F.monotonically_increasing_id()).where("mmsi is not null")
    return newest(numbered, ["mmsi"], ["_at"]).drop("_at")


def list_history(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Listing of history: ``name, size, updated`` of each hour folder, or of each file
    that lies in none. Contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length", "modificationTime")
    )
    hour = F.regexp_extract("path", r"/hour=([^/]+)/", 1)
    name = F.when(hour != "", F.concat(F.lit("multiship_"), hour)).otherwise(F.regexp_extract("path", r"([^/]+)$", 1))
    return files.groupBy(name.alias("name")).agg(
        F.sum("length").alias("size"), F.max("modificationTime").alias("updated")
    )


_SHIP = "struct<mmsi:bigint,name:string,ship_length:double,lat:double,lon:double,sog:double,cog:double>"
_FRAME = f"struct<time:string,focus_dist:double,delta_minutes:double,shipPositions:array<{_SHIP}>>"
DOCUMENT = (
    "_parent boolean, scenario_id string, ships_involved array<bigint>, collisions_count bigint, "
    "min_ts string, max_ts string, collision_id string, focus_mmsi array<bigint>, title string, cpa double, "
    f"t_min string, all_involved_mmsi array<bigint>, icon_lat double, icon_lon double, frames array<{_FRAME}>"
)


def read_history(spark: SparkSession, path: str, single_document: bool = False) -> DataFrame:
    """Scenario documents, one row each: JSON lines as :func:`seawake.sinks.tables.write_scenarios`
    writes them, or one ``{"scenarios": [...]}`` document."""
    if not single_document:
        return spark.read.schema(DOCUMENT).option("recursiveFileLookup", True).json(path)
    whole = spark.read.schema(f"scenarios array<struct<{_as_struct(DOCUMENT)}>>").option("multiLine", True).json(path)
    return whole.select(F.inline("scenarios"))


def _as_struct(columns: str) -> str:
    """``name type`` column list in the ``name:type`` form of struct fields."""
    import re

    return re.sub(r"(^|, )(\w+) ", r"\1\2:", columns)
