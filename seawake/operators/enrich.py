"""Static-data enrichment and the aggregates that feed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake import config as C
from seawake import schema as S
from seawake.functions.display import is_unknown_name, present
from seawake.operators.series import last_known, newest, tumbling
from seawake.session import broadcast_if_small


def enrich_asof(positions: DataFrame, statics: DataFrame, slice_seconds: int = C.SLICE_S, slice_rows: int = C.SLICE_ROWS) -> DataFrame:
    """Each position with the ship's newest static data known by then."""
    fields = ["ship_name", *S.DIMS]
    bare = positions.drop(*fields)
    found = last_known(bare, statics.select("mmsi", "timestamp", *fields), "mmsi", fields, slice_seconds=slice_seconds, slice_rows=slice_rows)
    return found.withColumn("ship_name", F.coalesce("ship_name", F.lit(C.UNKNOWN_NAME)))


def fill_names(positions: DataFrame, snapshot: DataFrame, stored: bool = True) -> DataFrame:
    """Names from the snapshot, only where the position has none and the snapshot has one.

    ``snapshot`` has one row per ship. It is broadcast when its counted size allows; a derived
    one (``stored=False``) is not counted but left to AQE.
    """
    names = snapshot.select("mmsi", present(F.col("ship_name")).alias("_known")).where("_known is not null")
    names = broadcast_if_small(names) if stored else names
    filled = F.when(is_unknown_name(F.col("ship_name")), F.coalesce("_known", "ship_name")).otherwise(F.col("ship_name"))
    return positions.join(names, "mmsi", "left").withColumn("ship_name", filled).select(*positions.columns)


def broadcast_static(df: DataFrame, statics: DataFrame) -> DataFrame:
    """Rows with the static fields of their ship as a struct column ``static``."""
    side = broadcast_if_small(
        statics.select("mmsi", F.struct("ship_name", *S.DIMS).alias("static"))
    )
    return df.join(side, "mmsi", "left")


def latest_static(df: DataFrame, seconds: int = C.STATIC_WINDOW_S) -> DataFrame:
    """Newest row of each ship in each window."""
    return newest(tumbling(df, seconds), ["window_start", "window_end", "mmsi"], ["timestamp"])


def window_batch(statics: DataFrame, seconds: int = C.SNAPSHOT_WINDOW_S) -> DataFrame:
    """The static rows of each window with the ship's last row marked for the merge.

    One row per window and ship with the number of updates: what a snapshot merge
    needs, without gathering a window into one list.
    """
    keys = ["window_start", "window_end", "mmsi"]
    return (
        tumbling(statics, seconds)
        .groupBy(*keys)
        .agg(
            F.max(F.struct("timestamp", "ship_name", *S.DIMS)).alias("_row"),
            F.count("*").alias("updates"),
        )
        .select(*keys, "_row.*", "updates")
    )


def first_per_ship(df: DataFrame) -> DataFrame:
    if df.isStreaming:
        raise ValueError("use seawake.streaming.jobs.first_per_ship_stream on a stream")
    return newest(df, ["mmsi"], ["timestamp"], oldest=True)


def pick_one(df: DataFrame) -> DataFrame:
    """One row per ship; any would do, the smallest is taken so that runs agree."""
    rest = [c for c in df.columns if c != "mmsi"]
    return df.groupBy("mmsi").agg(F.min(F.struct(*rest)).alias("_row")).select("mmsi", "_row.*")


def merge_static(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Snapshot merge: rows of ``batch`` win over ``known``; in a batch the newest wins."""
    fields = list(S.STATIC_FIELDS)
    old = known.select(*fields, F.lit(None).cast("timestamp").alias("timestamp"), F.lit(0).alias("_new"))
    new = batch.select(*fields, "timestamp", F.lit(1).alias("_new"))
    return newest(old.unionByName(new), ["mmsi"], ["_new", "timestamp"]).select(*fields)


def derive_size(df: DataFrame) -> DataFrame:
    """``length`` and ``width`` in metres with defaults for unknown ships."""
    def side(one: str, two: str, default: float) -> Column:
        total = F.coalesce(F.col(one), F.lit(0.0)) + F.coalesce(F.col(two), F.lit(0.0))
        return F.when(total <= 0, F.lit(default)).otherwise(total)

    return df.withColumn("length", side("dim_a", "dim_b", C.DEFAULT_LENGTH_M)).withColumn(
        "width", side("dim_c", "dim_d", C.DEFAULT_WIDTH_M)
    )
