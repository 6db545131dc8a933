"""Result shapes for callers: vessel and encounter views, risk, heatmap, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake import config as C
from seawake.functions import display as D
from seawake.functions import geo
from seawake.functions import risk as R
from seawake.operators.enrich import derive_size
from seawake.operators.tracks import most_recent


def ship_state(positions: DataFrame) -> DataFrame:
    """State rows with length and width from the dimensions."""
    return derive_size(positions).select(
        "mmsi", "ship_name", "latitude", "longitude", "sog", "cog", "heading", "timestamp", "length", "width"
    )


def vessel_view(ships: DataFrame) -> DataFrame:
    return ships.select(
        "mmsi",
        F.col("ship_name").alias("name"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        "sog",
        "cog",
        F.coalesce("heading", "cog").alias("heading"),
        "length",
        "width",
        "timestamp",
    )


def encounter_view(encounters: DataFrame) -> DataFrame:
    """Nested shape: ``vessel_a`` and ``vessel_b`` structs. Needs ``risk`` (see attach_risk)."""
    def vessel(side: str) -> Column:
        names = {"mmsi": "mmsi", "ship_name": "name", "latitude": "lat", "longitude": "lon", "sog": "sog", "cog": "cog"}
        return F.struct(*[F.col(f"{c}_{side}").alias(n) for c, n in names.items()]).alias(f"vessel_{side}")

    return encounters.select("id", vessel("a"), vessel("b"), "cpa", "tcpa", "risk", "timestamp")


def flat_view(encounters: DataFrame) -> DataFrame:
    """Flat shape of :func:`encounter_view`, one column per field and side."""
    sides = [
        F.col(f"vessel_{side}.{field}").alias(f"{name}_{side}")
        for side in "ab"
        for field, name in (("mmsi", "mmsi"), ("name", "ship_name"), ("lat", "latitude"), ("lon", "longitude"),
                            ("sog", "sog"), ("cog", "cog"))
    ]
    return encounters.select("id", *sides, "cpa", "tcpa", "risk", "timestamp")


def assess_risk(encounters: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Risk of each encounter with its factors; ``carry`` names columns to keep."""
    factors = R.risk_factors(*[F.col(c) for c in ("cpa", "tcpa", "sog_a", "sog_b", "cog_a", "cog_b")])
    scored = geo.computed(encounters, {"risk_factors": factors})
    f = F.col("risk_factors")
    return scored.select(
        *carry,
        F.col("id").alias("collision_id"),
        R.overall_risk(f).alias("overall_risk"),
        f,
        F.lit(C.RISK_UNCERTAINTY).alias("uncertainty"),
        R.risk_explanation(
            f,
            F.col("cpa"),
            F.col("tcpa"),
            F.col("sog_a") + F.col("sog_b"),
            geo.approach_angle(F.col("cog_a"), F.col("cog_b")),
        ).alias("explanation"),
    )


def attach_risk(encounters: DataFrame, risks: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Left join by encounter id; encounters not assessed yet get the default risk. ``within`` names
    columns that an encounter and its risk have in common besides, which sort faster than the id."""
    known = risks.select(*within, F.col("collision_id").alias("id"), F.col("overall_risk").alias("_risk"))
    return encounters.join(known, [*within, "id"], "left").withColumn(
        "risk", F.coalesce("_risk", F.lit(C.DEFAULT_RISK))
    ).drop("_risk")


def with_risk(encounters: DataFrame) -> DataFrame:
    """Encounters with their own risk: what :func:`attach_risk` finds when all are assessed,
    without assessing them apart and joining the two by id."""
    factors = R.risk_factors(*[F.col(c) for c in ("cpa", "tcpa", "sog_a", "sog_b", "cog_a", "cog_b")])
    scored = geo.computed(encounters, {"_factors": factors})
    return scored.withColumn("risk", F.coalesce(R.overall_risk(F.col("_factors")), F.lit(C.DEFAULT_RISK))).drop("_factors")


def risk_heatmap(ships: DataFrame, encounters: DataFrame, cell_degrees: float | None = None) -> DataFrame:
    """Weighted points of ships and encounter midpoints; with ``cell_degrees`` summed per grid cell."""
    spots = ships.select(
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.lit(C.SHIP_HEAT).alias("weight")
    )
    middle = geo.midpoint(*[F.col(c) for c in ("latitude_a", "longitude_a", "latitude_b", "longitude_b")])
    meets = encounters.select(middle.alias("_m"), R.heat_weight(F.col("cpa"), F.col("tcpa")).alias("weight")).select(
        "_m.lat", "_m.lon", "weight"
    )
    points = spots.unionByName(meets)
    if cell_degrees is None:
        return points
    return points.groupBy(
        F.floor(F.col("lat") / cell_degrees).cast("long").alias("cell_y"),
        F.floor(F.col("lon") / cell_degrees).cast("long").alias("cell_x"),
    ).agg(F.sum("weight").alias("weight"), F.count("*").alias("points"))


def replace_region(
    state: DataFrame, batch: DataFrame, centre: tuple[float, float], radius: float, keep: int = C.SHIPS_HELD
) -> DataFrame:
    """Drops the state rows around ``centre``, adds the batch and keeps the newest rows."""
    lat, lon = centre
    reach = radius * 1.5
    inside = (F.abs(F.col("latitude") - lat) < reach) & (F.abs(F.col("longitude") - lon) < reach)
    merged = state.where(~F.coalesce(inside, F.lit(False))).unionByName(batch)
    return most_recent(merged, keep)


def point_lookup(df: DataFrame, key: str, value: int | str) -> DataFrame:
    """Rows of one ship or one encounter; a ship number that is no integer is an error."""
    if key.startswith("mmsi"):
        value = int(value)
    return df.where(F.col(key) == F.lit(value))


def status_summary(ships: DataFrame, encounters: DataFrame, now: Column) -> DataFrame:
    """One row: counts, time of the last ship and the seconds since (−1 without ships)."""
    seen = ships.agg(F.count("*").alias("ship_count"), F.max("timestamp").alias("last_ship"))
    met = encounters.agg(F.count("*").alias("encounter_count"))
    both = seen.unionByName(met, allowMissingColumns=True).agg(
        F.max("ship_count").alias("ship_count"),
        F.max("encounter_count").alias("encounter_count"),
        F.max("last_ship").alias("last_ship"),
    )
    since = (F.unix_micros(now) - F.unix_micros("last_ship")) / 1_000_000
    return both.withColumn("seconds_since_last_ship", F.coalesce(since, F.lit(-1.0)))


def sample_head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def order_by_time(df: DataFrame, *ties: str) -> DataFrame:
    return df.orderBy("timestamp", *ties)


def removed_vessels(previous: DataFrame, current: DataFrame) -> DataFrame:
    return previous.join(current.select("mmsi"), "mmsi", "left_anti")


def pair_classes(encounters: DataFrame, ships: DataFrame, fallback: float = 0.0) -> DataFrame:
    """Length class of both ships of each encounter."""
    length = F.when((F.col("dim_a") > 0) & (F.col("dim_b") > 0), F.col("dim_a") + F.col("dim_b"))
    lengths = ships.select("mmsi", length.alias("_len")).where("_len is not null")
    out = encounters
    for side in "ab":
        named = lengths.select(F.col("mmsi").alias(f"mmsi_{side}"), F.col("_len").alias(f"_len_{side}"))
        out = out.join(named, f"mmsi_{side}", "left").withColumn(
            f"class_{side}", D.length_class(F.coalesce(f"_len_{side}", F.lit(fallback)))
        )
    return out.select(*encounters.columns, "class_a", "class_b")


def ship_summary(ships: DataFrame, now_s: Column) -> DataFrame:
    """Values a ship's info panel shows."""
    length = F.when((F.col("dim_a") != 0) & (F.col("dim_b") != 0), F.col("dim_a") + F.col("dim_b"))
    cog = F.coalesce("cog", F.lit(0.0))
    return ships.select(
        "mmsi",
        F.coalesce(D.present(F.col("ship_name")), F.lit(C.UNKNOWN_NAME)).alias("name"),
        D.fixed(F.coalesce("sog", F.lit(0.0)), 1).alias("sog"),
        D.fixed(cog, 1).alias("cog"),
        D.fixed(F.coalesce("heading", cog), 1).alias("heading"),
        F.when(length.isNotNull(), D.fixed(length, 1)).otherwise(F.lit("N/A")).alias("length"),
        D.age_text(F.unix_timestamp("timestamp"), now_s).alias("updated"),
    )


def pair_summary(pairs: DataFrame, ships: DataFrame) -> DataFrame:
    """Distance, CPA and TCPA (minutes) of chosen ship pairs ``mmsi_a, mmsi_b``.
    Pairs with a ship that is not in ``ships`` keep nulls."""
    states = ships.select("mmsi", "latitude", "longitude", "cog", "sog")
    out = pairs.select("mmsi_a", "mmsi_b")
    for side in "ab":
        out = out.join(states.select(*[F.col(c).alias(f"{c}_{side}") for c in states.columns]), f"mmsi_{side}", "left")
    a, b = geo.motion("_a"), geo.motion("_b")
    moving = geo.computed(out, geo.relative_flat(a, b))
    r = {n: F.col(n) for n in ("dx", "dy", "ux", "uy")}
    timed = geo.computed(moving, {"_hours": geo.not_negative(geo.time_to_closest(r))})
    return timed.select(
        "mmsi_a",
        "mmsi_b",
        geo.haversine_nm(a.lat, a.lon, b.lat, b.lon).alias("distance"),
        geo.separation_at(r, F.col("_hours")).alias("cpa"),
        (F.col("_hours") * 60).alias("tcpa"),
    )


def encounter_summary(encounters: DataFrame, now_s: Column) -> DataFrame:
    """List entry of an encounter: names, two-decimal numbers, age, marker position."""
    middle = geo.midpoint(*[F.col(c) for c in ("latitude_a", "longitude_a", "latitude_b", "longitude_b")])

    def name(side: str) -> Column:
        return F.coalesce(D.present(F.col(f"ship_name_{side}")), F.col(f"mmsi_{side}").cast("string"))

    return encounters.select(
        "mmsi_a",
        "mmsi_b",
        "timestamp",
        name("a").alias("name_a"),
        name("b").alias("name_b"),
        D.fixed(F.col("cpa"), 2).alias("cpa_text"),
        D.fixed(F.col("tcpa"), 2).alias("tcpa_text"),
        D.age_text(F.unix_timestamp("timestamp"), now_s).alias("updated"),
        middle.alias("marker"),
    )

