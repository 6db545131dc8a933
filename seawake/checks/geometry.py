"""Queries over scalar and geometric expressions.

Pair expressions are evaluated on every ship and the next position report of another
ship: consecutive events, joined on ``event_id + 1``.
"""

from pyspark.sql import functions as F

from seawake import fixtures as X
from seawake.checks.registry import TIMED, TURN, flat_relative, haversine, local_relative, query
from seawake.functions import display as D
from seawake.functions import geo
from seawake.functions import risk as R

def ship(side):
    return geo.motion(f"_{side}")


NEXT = "a.event_id + 1 = b.event_id"


def pairs(spark, sf):
    vp = X.vessel_positions(spark, sf)
    sides = [
        vp.select(
            (F.col("event_id") + (1 if s == "a" else 0)).alias("k"),
            *[F.col(c).alias(f"{c}_{s}") for c in ("mmsi", "ship_name", "latitude", "longitude", "cog", "sog", "dim_a", "dim_b", "epoch_s")],
        )
        for s in "ab"
    ]
    return sides[0].join(sides[1], "k")


def named(sql_body: str) -> str:
    return f", p AS ({local_relative('vp', 'vp', NEXT)}), f AS ({flat_relative('vp', 'vp', NEXT)}) {sql_body}"


def key():
    return "mmsi_a", "mmsi_b", F.greatest("epoch_s_a", "epoch_s_b").alias("epoch_s")


@query(  # F1
    "haversine_nm",
    named(f"SELECT mmsi_a, mmsi_b, epoch_s, round({haversine('latitude_a', 'longitude_a', 'latitude_b', 'longitude_b')}, 6) AS nm FROM p"),
)
def haversine_nm(spark, sf):
    return pairs(spark, sf).select(*key(), F.round(geo.haversine_nm(ship("a").lat, ship("a").lon, ship("b").lat, ship("b").lon), 6).alias("nm"))


@query("planar_distance_nm", named("SELECT mmsi_a, mmsi_b, epoch_s, round(sqrt(dx * dx + dy * dy) / 1852e0, 6) AS nm FROM p"))  # F2
def planar_distance_nm(spark, sf):
    return pairs(spark, sf).select(*key(), F.round(geo.planar_distance_nm(ship("a"), ship("b")), 6).alias("nm"))


@query("is_approaching", named("SELECT mmsi_a, mmsi_b, epoch_s, dx * ux + dy * uy < 0 AS approaching FROM p"))  # F3
def is_approaching(spark, sf):
    return pairs(spark, sf).select(*key(), geo.is_approaching(ship("a"), ship("b")).alias("approaching"))


SEPARATION = "sqrt((dx + ux * t) * (dx + ux * t) + (dy + uy * t) * (dy + uy * t))"


@query(  # F4
    "cpa_tcpa_local",
    named(f"""SELECT mmsi_a, mmsi_b, epoch_s, round(CASE WHEN t >= 0 THEN {SEPARATION} / 1852e0 ELSE 9999e0 END, 6) AS cpa,
      round(CASE WHEN t >= 0 THEN t ELSE -1e0 END, 6) AS tcpa FROM (SELECT *, {TIMED} AS t FROM p)"""),
)
def cpa_tcpa_local(spark, sf):
    out = pairs(spark, sf).withColumn("c", geo.cpa_tcpa_local(ship("a"), ship("b")))
    return out.select(*key(), F.round("c.cpa", 6).alias("cpa"), F.round("c.tcpa", 6).alias("tcpa"))


def _flat(factor: str) -> str:
    return named(f"""SELECT mmsi_a, mmsi_b, epoch_s, round({SEPARATION}, 6) AS cpa, round(t * {factor}, 6) AS tcpa
      FROM (SELECT *, greatest({TIMED}, 0e0) AS t FROM f)""")


@query("cpa_tcpa_flat", _flat("1e0"))  # F5
def cpa_tcpa_flat(spark, sf):
    out = pairs(spark, sf).withColumn("c", geo.cpa_tcpa_flat(ship("a"), ship("b")))
    return out.select(*key(), F.round("c.cpa", 6).alias("cpa"), F.round("c.tcpa", 6).alias("tcpa"))


@query("cpa_tcpa_flat_min", _flat("6e1"))  # F6
def cpa_tcpa_flat_min(spark, sf):
    out = pairs(spark, sf).withColumn("c", geo.cpa_tcpa_flat_min(ship("a"), ship("b")))
    return out.select(*key(), F.round("c.cpa", 6).alias("cpa"), F.round("c.tcpa", 6).alias("tcpa"))


@query(  # F7
    "velocity", " SELECT event_id, round(sog * sin(radians(cog)), 6) + 0e0 AS vx, round(sog * cos(radians(cog)), 6) + 0e0 AS vy FROM vp"
)
def velocity(spark, sf):
    vx, vy = geo.velocity(F.col("cog"), F.col("sog"))
    return X.vessel_positions(spark, sf).select(
        "event_id", (F.round(vx, 6) + 0.0).alias("vx"), (F.round(vy, 6) + 0.0).alias("vy")
    )


@query("approach_angle", named(f"SELECT mmsi_a, mmsi_b, epoch_s, {TURN} AS angle FROM p"))  # F8
def approach_angle(spark, sf):
    return pairs(spark, sf).select(*key(), geo.approach_angle(ship("a").cog, ship("b").cog).alias("angle"))


FACTORS = named(f""", t AS (SELECT *, {SEPARATION} AS cpa, t * 6e1 AS tcpa FROM (SELECT *, greatest({TIMED}, 0e0) AS t FROM f))
  , k AS (SELECT *, 1 - least(cpa / 5e-1, 1e0) AS cpa_risk, CASE WHEN tcpa > 0 THEN 1 - least(tcpa / 3e1, 1e0) ELSE 1e0 END AS tcpa_risk,
      least((sog_a + sog_b) / 3e1, 1e0) AS speed_risk, sin(radians({TURN})) AS angle_risk FROM t)""")


def _scored(spark, sf):
    out = geo.computed(pairs(spark, sf), {"c": geo.cpa_tcpa_flat_min(ship("a"), ship("b"))})
    return geo.computed(out, {"f": R.risk_factors(F.col("c.cpa"), F.col("c.tcpa"), ship("a").sog, ship("b").sog, ship("a").cog, ship("b").cog)})


@query(  # F9
    "risk_factors",
    FACTORS + """ SELECT mmsi_a, mmsi_b, epoch_s, round(cpa_risk, 6) AS cpa_risk, round(tcpa_risk, 6) AS tcpa_risk,
      round(speed_risk, 6) AS speed_risk, round(angle_risk, 6) AS angle_risk FROM k""",
)
def risk_factors(spark, sf):
    names = {"cpa_risk": "cpa_risk", "tcpa_risk": "tcpa_risk", "speed_risk": "speed_risk", "approach_angle_risk": "angle_risk"}
    return _scored(spark, sf).select(*key(), *[F.round(f"f.{n}", 6).alias(a) for n, a in names.items()])


@query(  # F10
    "overall_risk",
    FACTORS + " SELECT mmsi_a, mmsi_b, epoch_s, round(4e-1 * cpa_risk + 3e-1 * tcpa_risk + 2e-1 * speed_risk + 1e-1 * angle_risk, 6) AS risk FROM k",
)
def overall_risk(spark, sf):
    return _scored(spark, sf).select(*key(), F.round(R.overall_risk(F.col("f")), 6).alias("risk"))


@query(  # F11
    "risk_explanation",
    FACTORS + f""" SELECT mmsi_a, mmsi_b, epoch_s, printf('CPA of %.2f nm contributes %.2f to risk', cpa, cpa_risk) AS cpa_factor,
      printf('TCPA of %.2f min contributes %.2f to risk', tcpa, tcpa_risk) AS tcpa_factor,
      printf('Combined speed of %.2f knots contributes %.2f to risk', sog_a + sog_b, speed_risk) AS speed_factor,
      printf('Approach angle of %.2f° contributes %.2f to risk', {TURN}, angle_risk) AS angle_factor FROM k""",
)
def risk_explanation(spark, sf):
    speed, angle = ship("a").sog + ship("b").sog, geo.approach_angle(ship("a").cog, ship("b").cog)
    out = _scored(spark, sf)
    return out.select(*key(), R.risk_explanation(F.col("f"), F.col("c.cpa"), F.col("c.tcpa"), speed, angle).alias("e")).select(
        "mmsi_a", "mmsi_b", "epoch_s", "e.*"
    )


@query(  # F14, F24
    "midpoint_and_bounds",
    named("""SELECT mmsi_a, mmsi_b, epoch_s, round((latitude_a + latitude_b) / 2, 6) AS lat, round((longitude_a + longitude_b) / 2, 6) AS lon,
      least(latitude_a, latitude_b) AS south, least(longitude_a, longitude_b) AS west,
      greatest(latitude_a, latitude_b) AS north, greatest(longitude_a, longitude_b) AS east FROM p"""), rounded=("south", "west", "north", "east"),
)
def midpoint_and_bounds(spark, sf):
    corners = (ship("a").lat, ship("a").lon, ship("b").lat, ship("b").lon)
    out = pairs(spark, sf).select(*key(), geo.midpoint(*corners).alias("m"), geo.pair_bounds(*corners).alias("b"))
    return out.select("mmsi_a", "mmsi_b", "epoch_s", F.round("m.lat", 6).alias("lat"), F.round("m.lon", 6).alias("lon"), "b.*")


@query(  # F15
    "heat_weight",
    FACTORS + """ SELECT mmsi_a, mmsi_b, epoch_s, round(least(1e0, (1 - cpa / 5e-1 * 5e-1)
      * CASE WHEN tcpa > 0 THEN 1 - tcpa / 3e1 * 5e-1 ELSE 1e0 END), 5) AS weight FROM k WHERE cpa < 5e-1 AND tcpa < 30""",
)
def heat_weight(spark, sf):
    out = geo.computed(pairs(spark, sf), {"c": geo.cpa_tcpa_flat_min(ship("a"), ship("b"))}).where("c.cpa < 0.5 and c.tcpa < 30")
    return out.select(*key(), F.round(R.heat_weight(F.col("c.cpa"), F.col("c.tcpa")), 5).alias("weight"))


@query(  # F16
    "hull_polygon",
    """, c AS (SELECT *, coalesce(heading, cog) AS hdg FROM vp WHERE coalesce(dim_a, 0) <> 0 AND dim_b <> 0 AND dim_c <> 0 AND dim_d <> 0)
    , k AS (
      SELECT event_id, 1 AS corner, -dim_b AS x, -dim_c AS y, latitude, longitude, hdg FROM c UNION ALL
      SELECT event_id, 2, -dim_b, dim_d, latitude, longitude, hdg FROM c UNION ALL
      SELECT event_id, 3, dim_a - (dim_c + dim_d), dim_d, latitude, longitude, hdg FROM c UNION ALL
      SELECT event_id, 4, dim_a, 0, latitude, longitude, hdg FROM c UNION ALL
      SELECT event_id, 5, dim_a - (dim_c + dim_d), -dim_c, latitude, longitude, hdg FROM c)
    SELECT event_id, corner, round(latitude + (x * cos(radians(hdg)) - y * sin(radians(hdg))) / 111320e0, 6) AS lat,
      round(longitude + (x * sin(radians(hdg)) + y * cos(radians(hdg))) / (111320e0 * cos(radians(latitude))), 6) AS lon FROM k""",
)
def hull_polygon(spark, sf):
    dims = tuple(F.col(d) for d in ("dim_a", "dim_b", "dim_c", "dim_d"))
    hull = geo.hull_polygon(F.col("latitude"), F.col("longitude"), F.coalesce("heading", "cog"), dims)
    out = X.vessel_positions(spark, sf).select("event_id", F.posexplode(hull).alias("i", "c"))
    return out.select(
        "event_id", (F.col("i") + 1).alias("corner"), F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon")
    )


@query(  # F17
    "metres_to_deg",
    """ SELECT event_id, round(dim_b / 111320e0, 9) AS lat_deg, round(dim_b / (111320e0 * cos(radians(latitude))), 9) AS lon_deg FROM vp""",
)
def metres_to_deg(spark, sf):
    return X.vessel_positions(spark, sf).select(
        "event_id",
        F.round(geo.metres_to_deg_lat(F.col("dim_b")), 9).alias("lat_deg"),
        F.round(geo.metres_to_deg_lon(F.col("dim_b"), F.col("latitude")), 9).alias("lon_deg"),
    )


CLASS = "CASE WHEN {x} IS NULL THEN 'gray' WHEN {x} < 50 THEN 'green' WHEN {x} < 150 THEN 'yellow' WHEN {x} < 250 THEN 'orange' ELSE 'red' END"


@query(  # F18, F19
    "length_class",
    f""" SELECT event_id, by_dims, by_length, CASE by_dims WHEN 'green' THEN 8e-1 WHEN 'orange' THEN 1.2e0 WHEN 'red' THEN 14e-1 ELSE 1e0 END AS scale
    FROM (SELECT event_id, {CLASS.format(x="(CASE WHEN dim_a <> 0 AND dim_c <> 0 THEN dim_a + dim_c END)")} AS by_dims,
      {CLASS.format(x="(dim_a + dim_b + dim_c * 4)")} AS by_length FROM vp)""",
)
def length_class(spark, sf):
    out = X.vessel_positions(spark, sf).select(
        "event_id",
        D.length_class_from_dims(F.col("dim_a"), F.col("dim_c")).alias("by_dims"),
        D.length_class(F.col("dim_a") + F.col("dim_b") + F.col("dim_c") * 4).alias("by_length"),
    )
    return out.withColumn("scale", D.length_scale(F.col("by_dims")))


@query(  # F20
    "course_vector",
    """ SELECT event_id, round(latitude + sog * 15e0 / 60 / 60 * cos(radians(cog)), 6) AS lat,
      round(longitude + sog * 15e0 / 60 / 60 * sin(radians(cog)) / cos(radians(latitude)), 6) AS lon FROM vp WHERE sog <> 0""",
)
def course_vector(spark, sf):
    out = X.vessel_positions(spark, sf).withColumn("v", geo.course_vector(geo.motion())).where("v is not null")
    return out.select("event_id", F.round("v.lat", 6).alias("lat"), F.round("v.lon", 6).alias("lon"))


@query(  # F21
    "age_text",
    """ SELECT event_id, CASE WHEN age < 60 THEN concat(age, 's ago') ELSE concat(age // 60, 'm ', age % 60, 's ago') END AS age
    FROM (SELECT event_id, greatest(0, 1704067200 + 5000 - epoch_s) AS age FROM vp)""",
)
def age_text(spark, sf):
    return X.vessel_positions(spark, sf).select(
        "event_id", D.age_text(F.col("epoch_s"), F.lit(1704067200 + 5000)).alias("age")
    )
