"""Latest ship states and short-term track prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake import config as C
from seawake.operators.series import newest, ranked_newest_first, recent


def last_per_key(positions: DataFrame, key: str = "mmsi") -> DataFrame:
    """Newest row per ship."""
    return newest(positions, [key], ["timestamp"])


def most_recent(ships: DataFrame, n: int = C.SHIPS_HELD) -> DataFrame:
    """The ``n`` ships that reported last: a distributed top-n."""
    return ships.orderBy(F.desc("timestamp"), "mmsi").limit(n)


def current_and_history(positions: DataFrame, slice_rows: int = C.SLICE_ROWS) -> DataFrame:
    """History newest first of ships with at least two points; ``recency`` 1 is the current one."""
    return ranked_newest_first(positions, "mmsi", ties=("latitude", "longitude"), slice_rows=slice_rows).where("n_points >= 2")


def predict_current(ships: DataFrame, history: DataFrame) -> DataFrame:
    """History rows of the ships in the current view."""
    return history.join(ships.select("mmsi"), "mmsi", "left_semi")


def uncertainty_radii(step: Column, sog: Column) -> Column:
    """Radii in nautical miles for the three confidence levels."""
    return F.array(*[F.lit(level) * step * sog * C.UNCERTAINTY_RATE for level in C.UNCERTAINTY_LEVELS])


def current_states(history: DataFrame) -> DataFrame:
    """Current state and point count of every ship, found by one aggregation."""
    state = F.struct("timestamp", "latitude", "longitude", "sog", "cog")
    return (
        history.groupBy("mmsi").agg(F.max(state).alias("_s"), F.count("*").alias("n_points")).select("mmsi", "_s.*", "n_points")
    )


def project_track(
    current: DataFrame, horizon_min: int = C.PREDICTION_HORIZON_MIN, steps: int = C.PREDICTION_STEPS
) -> DataFrame:
    """Constant-velocity path of each state that rests on at least two points."""
    course = F.radians(F.coalesce("cog", F.lit(0.0)))
    lat_speed = F.col("sog") * C.DEGREES_PER_KNOT_HOUR / 60
    lon_speed = F.when(F.abs("latitude") == 90, F.lit(0.0)).otherwise(lat_speed / F.cos(F.radians("latitude")))
    minutes = F.col("step") * (horizon_min / steps)
    return (
        current.where("n_points >= 2")
        .withColumn("_north", lat_speed * F.cos(course))
        .withColumn("_east", lon_speed * F.sin(course))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
        .select(
            "mmsi",
            "step",
            (F.col("latitude") + F.col("_north") * minutes).alias("latitude"),
            (F.col("longitude") + F.col("_east") * minutes).alias("longitude"),
            F.timestamp_micros(F.unix_micros("timestamp") + (minutes * 60_000_000).cast("long")).alias("timestamp"),
            uncertainty_radii(F.col("step"), F.col("sog")).alias("uncertainty"),
        )
    )


def predict_track(
    history: DataFrame, horizon_min: int = C.PREDICTION_HORIZON_MIN, steps: int = C.PREDICTION_STEPS
) -> DataFrame:
    """Path of every ship with at least two points in ``history``."""
    return project_track(current_states(history), horizon_min, steps)


def predict_tracks_for(ships: DataFrame, positions: DataFrame, minutes: int = C.HISTORY_MINUTES) -> DataFrame:
    """Tracks of the current view from its recent history."""
    return predict_track(recent(predict_current(ships, positions), minutes))
