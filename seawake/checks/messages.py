"""Queries over messages: parsing, validity rules, enrichment (S, P, J1–J3, A1–A4)."""

from pyspark.sql import functions as F

from seawake import fixtures as X
from seawake.checks.registry import LATEST, UNDER_WAY, epoch, query, r6
from seawake.fixtures import VESSEL_STATIC_SQL
from seawake.functions.display import collision_id, pair_id, pair_key
from seawake.operators import enrich as N
from seawake.operators import parse as P
from seawake.operators import series as Q
from seawake.operators import views as V
from seawake.plans import live



def now():
    return F.timestamp_seconds(F.lit(1704067200 - 60))


DIMS = "dim_a, dim_b, dim_c, dim_d"
NAME = """CASE WHEN event_id % 29 = 3 THEN 'Unknown' WHEN event_id % 31 = 4 THEN NULL
  WHEN event_id % 37 = 5 THEN ' UNKNOWN ' ELSE ship_name END"""
MESSAGES = f""", msg AS (
  SELECT * EXCLUDE (ship_name, heading), {NAME} AS ship_name,
    CASE WHEN event_id % 19 = 1 THEN NULL ELSE heading END AS heading
  FROM vp)
, good AS (SELECT * FROM msg WHERE event_id % 17 <> 0)"""
STATICS = f", st AS ({VESSEL_STATIC_SQL.replace('FROM positions', 'FROM vp')})"
# envelopes
REPORTS = """, rep AS (
  SELECT mmsi, CASE WHEN event_id % 47 = 0 THEN 180.5e0 ELSE latitude END AS latitude, longitude, sog, cog,
    CASE WHEN event_id % 19 = 1 THEN NULL WHEN heading = 511 THEN cog ELSE heading END AS heading,
    CASE WHEN event_id % 43 = 0 THEN 1704067140 ELSE epoch_s END AS epoch_s
  FROM vp WHERE event_id % 41 <> 0)"""
ENVELOPE_STATICS = """, sta AS (
  SELECT mmsi, CASE WHEN event_id % 3 <> 0 THEN ship_name WHEN event_id % 2 = 0 THEN concat('ALT_', mmsi) ELSE 'Unknown' END AS ship_name,
    dim_a, dim_b, dim_c, dim_d, CASE WHEN event_id % 43 = 0 THEN 1704067140 ELSE epoch_s END AS epoch_s
  FROM vp WHERE event_id % 5 = 0 AND event_id % 41 <> 0)"""


def _envelopes(spark, sf):
    return P.read_envelopes(X.envelopes(spark, sf))


def _position_columns():
    return ["mmsi", "ship_name", "latitude", "longitude", "cog", "sog", "heading", epoch()]


@query(  # P1
    "parse_message",
    MESSAGES + f" SELECT mmsi, ship_name, latitude, longitude, cog, sog, heading, epoch_s, {DIMS}, 'none' AS geohash FROM good", rounded=("latitude", "longitude"),
)
def parse_message(spark, sf):
    parsed = P.parse_message(X.messages(spark, sf))
    return parsed.select(*_position_columns(), *DIMS.split(", "), "geohash")


@query(  # P2
    "parse_positions", MESSAGES + " SELECT mmsi, ship_name, latitude, longitude, cog, sog, heading, epoch_s FROM good", rounded=("latitude", "longitude"))
def parse_positions(spark, sf):
    return P.parse_positions(X.messages(spark, sf)).select(*_position_columns())


@query(  # P3: a missing speed or position does not matter to static data
    "parse_static",
    MESSAGES + f""" SELECT mmsi, ship_name, {DIMS} FROM msg
    WHERE NOT (event_id % 17 = 0 AND (event_id // 17) % 3 = 2) AND event_id % 29 <> 3
      AND lower(trim(ship_name)) <> 'unknown' AND dim_a IS NOT NULL""",
)
def parse_static(spark, sf):
    return P.parse_static(X.messages(spark, sf)).drop("timestamp")


@query(  # P6
    "rejected_messages",
    MESSAGES + " SELECT event_id // 17 % 3 AS kind, count(*) AS rejected FROM msg WHERE event_id % 17 = 0 GROUP BY 1",
)
def rejected_messages(spark, sf):
    bad = P.parse_message_rejects(X.messages(spark, sf))
    kind = F.when(~F.col("value").endswith("}"), 2).when(F.col("value").contains('"latitude":null'), 1).otherwise(0)
    return bad.groupBy(kind.cast("long").alias("kind")).agg(F.count("*").alias("rejected"))


@query(  # S1, P20
    "route_by_type",
    """, routed AS (SELECT CASE WHEN event_id % 41 = 0 THEN 0 ELSE mmsi END AS mmsi,
      CASE WHEN event_id % 43 = 0 THEN '' ELSE strftime(make_timestamp(epoch_s * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS received, event_id FROM vp)
    SELECT 'position' AS branch, mmsi, received FROM routed UNION ALL
    SELECT 'static', mmsi, received FROM routed WHERE event_id % 5 = 0""",
)
def route_by_type(spark, sf):
    positions, statics = P.route_by_type(_envelopes(spark, sf))
    fields = [F.col("MetaData.MMSI").alias("mmsi"), F.col("MetaData.TimeReceived").alias("received")]
    return positions.select(F.lit("position").alias("branch"), *fields).unionAll(statics.select(F.lit("static"), *fields))


@query("flatten_position", REPORTS + " SELECT * FROM rep", rounded=("latitude", "longitude"))  # P4, P9, P10
def flatten_position(spark, sf):
    return P.flatten_position(_envelopes(spark, sf).where(F.col("MessageType") == "PositionReport"), now()).select(
        "mmsi", "latitude", "longitude", "sog", "cog", "heading", epoch()
    )


@query("flatten_static", ENVELOPE_STATICS + " SELECT * FROM sta")  # P5
def flatten_static(spark, sf):
    _, statics = P.route_by_type(_envelopes(spark, sf))
    return P.flatten_static(statics, now()).select("mmsi", "ship_name", *DIMS.split(", "), epoch())


INGESTED = (
    REPORTS + ENVELOPE_STATICS + f""", good AS (SELECT * FROM rep WHERE sog >= 2 AND latitude BETWEEN -180 AND 180)
    , facts AS (SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY mmsi, epoch_s ORDER BY ship_name DESC, dim_a DESC) AS rn FROM sta) WHERE rn = 1)
    SELECT p.*, coalesce(s.ship_name, 'Unknown') AS ship_name, {", ".join("s." + d for d in DIMS.split(", "))}
    FROM good p ASOF LEFT JOIN facts s ON p.mmsi = s.mmsi AND p.epoch_s >= s.epoch_s"""
)


@query("ingest", INGESTED, rounded=("latitude", "longitude"))  # the whole ingest: S1, P4, P5, P7–P10, P20, J1
def ingest(spark, sf):
    return live.ingest(_envelopes(spark, sf), now()).select(
        "mmsi", "latitude", "longitude", "sog", "cog", "heading", epoch(), "ship_name", *DIMS.split(", ")
    )


@query("drop_rejects", " SELECT mmsi, heading, epoch_s FROM vp WHERE heading IS NOT NULL")  # P6
def drop_rejects(spark, sf):
    return P.drop_rejects(X.vessel_positions(spark, sf), ["heading"]).select("mmsi", "heading", "epoch_s")


@query(  # P7
    "valid_coordinate", REPORTS + " SELECT mmsi, latitude, longitude, epoch_s FROM rep WHERE latitude <= 180", rounded=("latitude", "longitude"))
def valid_coordinate(spark, sf):
    flat = P.flatten_position(_envelopes(spark, sf).where(F.col("MessageType") == "PositionReport"), now())
    return P.valid_coordinate(flat).select("mmsi", "latitude", "longitude", epoch())


@query("under_way", UNDER_WAY + " SELECT mmsi, sog, epoch_s FROM uw")  # P8
def under_way(spark, sf):
    return P.under_way(X.vessel_positions(spark, sf)).select("mmsi", "sog", "epoch_s")


@query("clean_heading", " SELECT event_id, CASE WHEN heading = 511 THEN cog ELSE heading END AS heading FROM vp")  # P9
def clean_heading(spark, sf):
    return X.vessel_positions(spark, sf).select(
        "event_id", P.clean_heading(F.col("heading").cast("string"), F.col("cog")).alias("heading")
    )


@query(  # P10
    "normalise_time",
    " SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1704067140 ELSE epoch_s END AS epoch_s FROM vp",
)
def normalise_time(spark, sf):
    vp = X.vessel_positions(spark, sf)
    n = F.col("event_id") % 6
    text = (
        F.when(n == 0, F.lit("")).when(n == 3, F.lit("no time"))
        .when(n == 1, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
        .otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return vp.select("event_id", F.unix_timestamp(P.normalise_time(text, now())).alias("epoch_s"))


@query(  # P11
    "project_positions", MESSAGES + " SELECT mmsi, ship_name, latitude, longitude, cog, sog, heading, epoch_s FROM good", rounded=("latitude", "longitude"))
def project_positions(spark, sf):
    out = P.project_positions(P.parse_message(X.messages(spark, sf)))
    return out.withColumn("epoch_s", F.unix_timestamp("timestamp")).drop("timestamp")


@query("project_static", f" SELECT mmsi, ship_name, {DIMS}, 1704067140 AS updated_s FROM vp")  # P12
def project_static(spark, sf):
    out = P.project_static(X.vessel_positions(spark, sf), now())
    return out.withColumn("updated_s", F.unix_timestamp("update_time")).drop("update_time")


@query(  # P13
    "has_dimensions",
    """ SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE dim_a END AS dim_a,
      CASE WHEN event_id % 2 = 0 THEN 0 ELSE dim_b END AS dim_b, CASE WHEN event_id % 6 = 0 THEN NULL ELSE dim_c END AS dim_c,
      0 AS dim_d FROM vp) WHERE coalesce(dim_a, 0) <> 0 OR coalesce(dim_b, 0) <> 0 OR coalesce(dim_c, 0) <> 0""",
)
def has_dimensions(spark, sf):
    n, zero = F.col("event_id"), F.lit(0.0)
    vp = X.vessel_positions(spark, sf).select(
        "event_id",
        F.when(n % 4 == 0, zero).otherwise(F.col("dim_a")).alias("dim_a"),
        F.when(n % 2 == 0, zero).otherwise(F.col("dim_b")).alias("dim_b"),
        F.when(n % 6 != 0, F.col("dim_c")).alias("dim_c"),
        zero.alias("dim_d"),
    )
    return P.has_dimensions(vp).select("event_id")


@query("long_enough", " SELECT event_id, dim_a + dim_b AS length FROM vp WHERE dim_a + dim_b > 50")  # P14
def long_enough(spark, sf):
    return P.long_enough(X.vessel_positions(spark, sf)).select("event_id", (F.col("dim_a") + F.col("dim_b")).alias("length"))


@query(  # P15
    "derive_size",
    """ SELECT event_id, coalesce(dim_a, 0) + dim_b AS length,
      CASE WHEN dim_c % 5 = 0 THEN 20 ELSE dim_c END AS width FROM vp""",
)
def derive_size(spark, sf):
    vp = X.vessel_positions(spark, sf).withColumn("dim_c", F.when(F.col("dim_c") % 5 != 0, F.col("dim_c")))
    return N.derive_size(vp.withColumn("dim_d", F.lit(0.0))).select("event_id", "length", "width")


@query(  # P19
    "in_boxes",
    """ SELECT event_id FROM vp WHERE (latitude BETWEEN 50 AND 501e-1 AND longitude BETWEEN 0 AND 1e-1)
      OR (latitude BETWEEN 5005e-2 AND 502e-1 AND longitude BETWEEN 5e-2 AND 3e-1)""",
)
def in_boxes(spark, sf):
    boxes = [[[50.0, 0.0], [50.1, 0.1]], [[50.2, 0.3], [50.05, 0.05]]]
    return P.in_boxes(X.vessel_positions(spark, sf), boxes).select("event_id")


@query(  # P19 with a table of boxes: one box around the origin cell of every long ship
    "in_box_table",
    """, boxes AS (SELECT DISTINCT 50e0 + (mmsi - 200000000) % 15 * 2e-2 AS lat, (mmsi - 200000000) % 10 * 3e-2 AS lon FROM vp WHERE dim_b > 30)
    SELECT event_id FROM vp WHERE EXISTS (SELECT 1 FROM boxes WHERE latitude BETWEEN lat - 1e-2 AND lat + 1e-2
      AND longitude BETWEEN lon - 1e-2 AND lon + 1e-2)""",
)
def in_box_table(spark, sf):
    vp = X.vessel_positions(spark, sf)
    n = F.col("mmsi") - 200000000
    lat, lon = F.lit(50.0) + n % 15 * 0.02, n % 10 * 0.03
    boxes = vp.where("dim_b > 30").select(
        (lat - 0.01).alias("lat_min"), (lat + 0.01).alias("lat_max"), (lon - 0.01).alias("lon_min"), (lon + 0.01).alias("lon_max")
    ).distinct()
    return P.in_boxes(vp, boxes).select("event_id")


@query(  # P21, P22, F22
    "identifiers",
    """ SELECT event_id, concat_ws('_', mmsi, mmsi + 7, strftime(make_timestamp(epoch_s * 1000000), '%Y%m%d%H%M%S')) AS collision_id,
      concat('coll-', mmsi, '-', mmsi + 7) AS pair_id, concat_ws('_', mmsi, mmsi + 7) AS pair_key FROM vp""",
)
def identifiers(spark, sf):
    a, b = F.col("mmsi"), F.col("mmsi") + 7
    return X.vessel_positions(spark, sf).select(
        "event_id",
        collision_id(a, b, F.col("timestamp")).alias("collision_id"),
        pair_id(a, b).alias("pair_id"),
        pair_key(b, a).alias("pair_key"),
    )


@query("point_lookup", " SELECT mmsi, epoch_s, sog FROM vp WHERE mmsi = 200000017")  # P23
def point_lookup(spark, sf):
    return V.point_lookup(X.vessel_positions(spark, sf), "mmsi", "200000017").select("mmsi", "epoch_s", "sog")


# --- joins with static data --------------------------------------------------
@query(  # J1
    "enrich_asof",
    STATICS + f""" SELECT p.event_id, p.mmsi, coalesce(s.ship_name, 'Unknown') AS ship_name,
      {", ".join("s." + d for d in DIMS.split(", "))}
    FROM vp p ASOF LEFT JOIN st s ON p.mmsi = s.mmsi AND p.epoch_s >= s.epoch_s""",
)
def enrich_asof(spark, sf):
    out = N.enrich_asof(X.vessel_positions(spark, sf), X.vessel_static(spark, sf))
    return out.select("event_id", "mmsi", "ship_name", *DIMS.split(", "))


#: One ship sends more than a third of all rows.
SKEWED = ", hot AS (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 200000001 ELSE mmsi END AS mmsi) FROM vp)"


def skewed(df):
    return df.withColumn("mmsi", F.when(F.col("event_id") % 3 == 0, F.lit(200000001)).otherwise(F.col("mmsi")))


@query(  # J1, a hot ship cut into small slices
    "enrich_asof_skewed",
    STATICS + SKEWED + f""" SELECT p.event_id, p.mmsi, coalesce(s.ship_name, 'Unknown') AS ship_name,
      {", ".join("s." + d for d in DIMS.split(", "))}
    FROM hot p ASOF LEFT JOIN st s ON p.mmsi = s.mmsi AND p.epoch_s >= s.epoch_s""",
)
def enrich_asof_skewed(spark, sf):
    out = N.enrich_asof(skewed(X.vessel_positions(spark, sf)), X.vessel_static(spark, sf), slice_rows=100)
    return out.select("event_id", "mmsi", "ship_name", *DIMS.split(", "))


NEWEST_STATIC = STATICS + """, snap AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY epoch_s DESC) AS rn FROM st) WHERE rn = 1)"""


def _snapshot(spark, sf):
    return Q.newest(X.vessel_static(spark, sf), ["mmsi"], ["timestamp"])


@query(  # J2
    "fill_names",
    MESSAGES + NEWEST_STATIC + """ SELECT g.event_id, g.mmsi, CASE WHEN coalesce(lower(trim(g.ship_name)), 'unknown') = 'unknown'
      THEN coalesce(s.ship_name, g.ship_name) ELSE g.ship_name END AS ship_name
    FROM good g LEFT JOIN snap s ON g.mmsi = s.mmsi""",
)
def fill_names(spark, sf):
    raw = X.messages(spark, sf)
    keyed = P.parse_positions(raw).withColumn("event_id", F.unix_timestamp("timestamp") - 1704067200)
    return N.fill_names(keyed, _snapshot(spark, sf)).select("event_id", "mmsi", "ship_name")


@query(  # J3
    "broadcast_static",
    NEWEST_STATIC + """ SELECT v.event_id, s.ship_name AS known_name, s.dim_a AS known_dim_a
    FROM vp v LEFT JOIN snap s ON v.mmsi = s.mmsi""",
)
def broadcast_static(spark, sf):
    out = N.broadcast_static(X.vessel_positions(spark, sf), _snapshot(spark, sf))
    return out.select("event_id", F.col("static.ship_name").alias("known_name"), F.col("static.dim_a").alias("known_dim_a"))


# --- static aggregates -------------------------------------------------------
@query(  # A1
    "latest_static",
    """ SELECT mmsi, ship_name, epoch_s // 300 * 300 AS window_s, epoch_s, dim_b FROM (
      SELECT *, row_number() OVER (PARTITION BY mmsi, epoch_s // 300 ORDER BY epoch_s DESC) AS rn FROM vp) WHERE rn = 1""",
)
def latest_static(spark, sf):
    return N.latest_static(X.vessel_positions(spark, sf)).select(
        "mmsi", "ship_name", epoch("window_start", "window_s"), "epoch_s", "dim_b"
    )


@query(  # A2
    "window_batch",
    """ SELECT mmsi, epoch_s // 600 * 600 AS window_s, max(epoch_s) AS epoch_s, count(*) AS updates FROM vp GROUP BY 1, 2""",
)
def window_batch(spark, sf):
    return N.window_batch(X.vessel_positions(spark, sf)).select(
        "mmsi", epoch("window_start", "window_s"), epoch(), "updates"
    )


@query(  # A3
    "first_per_ship",
    """ SELECT mmsi, epoch_s, sog FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY epoch_s) AS rn FROM vp) WHERE rn = 1""",
)
def first_per_ship(spark, sf):
    return N.first_per_ship(X.vessel_positions(spark, sf)).select("mmsi", "epoch_s", "sog")


@query(  # A4
    "pick_one", STATICS + """ SELECT mmsi, min(ship_name) AS ship_name, max(dim_b) AS dim_b FROM st GROUP BY mmsi"""
)
def pick_one(spark, sf):
    return N.pick_one(X.vessel_static(spark, sf).select("mmsi", "ship_name", "dim_b"))


@query(  # A9
    "last_per_key", LATEST + " SELECT mmsi, epoch_s, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM latest"
)
def last_per_key(spark, sf):
    from seawake.operators.tracks import last_per_key as op

    return op(X.vessel_positions(spark, sf)).select("mmsi", "epoch_s", *r6("latitude", "longitude"))


@query(  # the static job: P13, W1, A1, A3, P12
    "static_table",
    """ SELECT mmsi, dim_a, dim_b FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY epoch_s) AS rn FROM vp) WHERE rn = 1""",
)
def static_table(spark, sf):
    return live.static_table(X.vessel_positions(spark, sf), now()).select("mmsi", "dim_a", "dim_b")
