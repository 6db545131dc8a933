"""Geometry as Column expressions; nothing here leaves whole-stage codegen.

A moving ship is a ``Motion`` of four columns. Angles are degrees, speeds knots,
distances nautical miles.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake import config as C


class Motion(NamedTuple):
    lat: Column
    lon: Column
    cog: Column
    sog: Column


def motion(suffix: str = "") -> Motion:
    return Motion(*[F.col(f"{name}{suffix}") for name in ("latitude", "longitude", "cog", "sog")])


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # rounding may lift `a` a hair above 1 for antipodes
    return F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a))) * 2 * C.EARTH_RADIUS_NM


def velocity(cog: Column, sog: Column) -> tuple[Column, Column]:
    """East and north components in knots."""
    angle = F.radians(cog)
    return sog * F.sin(angle), sog * F.cos(angle)


def _local_offset_m(a: Motion, b: Motion) -> tuple[Column, Column]:
    scale = F.cos(F.radians((a.lat + b.lat) / 2)) * C.METRES_PER_DEGREE
    return (a.lon - b.lon) * scale, (a.lat - b.lat) * C.METRES_PER_DEGREE


def _relative_speed(a: Motion, b: Motion) -> tuple[Column, Column]:
    ax, ay = velocity(F.coalesce(a.cog, F.lit(0.0)), a.sog)
    bx, by = velocity(F.coalesce(b.cog, F.lit(0.0)), b.sog)
    return ax - bx, ay - by


def planar_distance_nm(a: Motion, b: Motion) -> Column:
    """Local plane scaled at the mean latitude of the two ships."""
    dx, dy = _local_offset_m(a, b)
    return F.sqrt(dx * dx + dy * dy) / C.METRES_PER_NM


def is_approaching(a: Motion, b: Motion) -> Column:
    dx, dy = _local_offset_m(a, b)
    ux, uy = _relative_speed(a, b)
    return dx * ux + dy * uy < 0


def relative_local(a: Motion, b: Motion) -> dict[str, Column]:
    """Offset (metres) and relative speed (metres per minute) in the local plane."""
    dx, dy = _local_offset_m(a, b)
    ux, uy = _relative_speed(a, b)
    per_minute = C.METRES_PER_NM / 60
    return {"dx": dx, "dy": dy, "ux": ux * per_minute, "uy": uy * per_minute}


def relative_flat(a: Motion, b: Motion) -> dict[str, Column]:
    """Offset (nautical miles) and relative speed (knots) in the flat plane."""
    ax, ay = flat_xy(a.lat, a.lon)
    bx, by = flat_xy(b.lat, b.lon)
    avx, avy = velocity(a.cog, a.sog)
    bvx, bvy = velocity(b.cog, b.sog)
    return {"dx": ax - bx, "dy": ay - by, "ux": avx - bvx, "uy": avy - bvy}


def time_to_closest(r: dict[str, Column]) -> Column:
    """Time of closest approach in the units of ``r``, negative when it is past."""
    speed2 = r["ux"] * r["ux"] + r["uy"] * r["uy"]
    return F.when(speed2 == 0, F.lit(0.0)).when(
        speed2.isNotNull(), -(r["dx"] * r["ux"] + r["dy"] * r["uy"]) / speed2
    )


def separation_at(r: dict[str, Column], time: Column) -> Column:
    x, y = r["dx"] + r["ux"] * time, r["dy"] + r["uy"] * time
    return F.sqrt(x * x + y * y)


def not_negative(time: Column) -> Column:
    return F.when(time > 0, time).when(time.isNotNull(), F.lit(0.0))


def cpa_tcpa_local(a: Motion, b: Motion) -> Column:
    """struct(cpa nm, tcpa minutes); the sentinel pair when nothing lies ahead."""
    r = relative_local(a, b)
    tcpa = time_to_closest(r)
    known = F.lit(True)
    for value in (*a, *b):
        known = known & value.isNotNull()
    ahead = known & (tcpa >= 0)
    return F.struct(
        F.when(ahead, separation_at(r, tcpa) / C.METRES_PER_NM).otherwise(F.lit(C.NO_CPA)).alias("cpa"),
        F.when(ahead, tcpa).otherwise(F.lit(C.NO_TCPA)).alias("tcpa"),
    )


def flat_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Flat plane in nautical miles; each ship is scaled by its own latitude."""
    return lon * C.NM_PER_DEGREE * F.cos(F.radians(lat)), lat * C.NM_PER_DEGREE


def cpa_tcpa_flat(a: Motion, b: Motion, unit: str = "hours") -> Column:
    """struct(cpa nm, tcpa) in the flat plane, tcpa never below zero.

    Unknown course or speed gives nulls, which no threshold accepts.
    """
    r = relative_flat(a, b)
    hours = not_negative(time_to_closest(r))
    return F.struct(separation_at(r, hours).alias("cpa"), in_unit(hours, unit).alias("tcpa"))


def in_unit(hours: Column, unit: str) -> Column:
    if unit not in ("hours", "minutes"):
        raise ValueError(f"unit must be hours or minutes, not {unit!r}")
    return hours * 60 if unit == "minutes" else hours


def cpa_tcpa_flat_min(a: Motion, b: Motion) -> Column:
    return cpa_tcpa_flat(a, b, unit="minutes")


def approach_angle(cog_a: Column, cog_b: Column) -> Column:
    turn = F.abs(cog_a - cog_b)
    return F.when(turn > 180, 360 - turn).otherwise(turn)


def midpoint(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    return F.struct(((lat_a + lat_b) / 2).alias("lat"), ((lon_a + lon_b) / 2).alias("lon"))


def metres_to_deg_lat(metres: Column) -> Column:
    return metres / C.HULL_METRES_PER_DEGREE


def metres_to_deg_lon(metres: Column, lat: Column, min_cos: float = C.HULL_MIN_COS) -> Column:
    scale = F.cos(F.radians(lat))
    return F.when(scale < min_cos, F.lit(0.0)).otherwise(metres / (scale * C.HULL_METRES_PER_DEGREE))


def hull_polygon(lat: Column, lon: Column, heading: Column, dims: tuple[Column, ...]) -> Column:
    """Five corners, stern left first, as array<struct<lat,lon>>; empty without all four dims."""
    bow, stern, left, right = dims
    shoulder = bow - (left + right)
    angle = F.radians(F.coalesce(heading, F.lit(0.0)))
    sin, cos = F.sin(angle), F.cos(angle)

    def corner(along: Column, across: Column) -> Column:
        north, east = along * cos - across * sin, along * sin + across * cos
        return F.struct(
            (lat + metres_to_deg_lat(north)).alias("lat"),
            (lon + metres_to_deg_lon(east, lat)).alias("lon"),
        )

    outline = F.array(
        corner(-stern, -left),
        corner(-stern, right),
        corner(shoulder, right),
        corner(bow, F.lit(0.0)),
        corner(shoulder, -left),
    )
    complete = F.lit(True)
    for dim in dims:
        complete = complete & (F.coalesce(dim, F.lit(0.0)) != 0)
    return F.when(complete, outline).otherwise(F.slice(outline, 1, 0))


def course_vector(m: Motion, minutes: Column | float = C.VECTOR_MINUTES) -> Column:
    """End point after ``minutes`` on the present course; null for a ship without course or way."""
    minutes = minutes if isinstance(minutes, Column) else F.lit(float(minutes))
    degrees = m.sog * minutes / 60 / C.NM_PER_DEGREE
    angle = F.radians(m.cog)
    scale = F.greatest(F.cos(F.radians(m.lat)), F.lit(C.VECTOR_MIN_COS))
    end = F.struct(
        (m.lat + degrees * F.cos(angle)).alias("lat"),
        (m.lon + degrees * F.sin(angle) / scale).alias("lon"),
    )
    return F.when((m.sog != 0) & m.cog.isNotNull(), end)


def encounter_vector_minutes(tcpa: Column) -> Column:
    """Vector length for an encounter: its TCPA to the nearest minute, at least one."""
    return F.greatest(F.lit(1.0), F.floor(tcpa + 0.5).cast("double"))


def pair_bounds(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    return F.struct(
        F.least(lat_a, lat_b).alias("south"),
        F.least(lon_a, lon_b).alias("west"),
        F.greatest(lat_a, lat_b).alias("north"),
        F.greatest(lon_a, lon_b).alias("east"),
    )


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are evaluated once per row.

    A one-element ``inline_outer`` keeps later filters on them from being expanded into
    the join below, where the geometry would be repeated for every mention.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
