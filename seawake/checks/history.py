"""Queries over scenarios and replays."""

from pyspark.sql import functions as F

from seawake import fixtures as X
from seawake.checks.live import encounters, positions
from seawake.checks.registry import ENCOUNTERS, epoch, haversine, query, r6
from seawake.operators import scenarios as S
from seawake.plans import history as H
from seawake.session import stored

HISTORY = ENCOUNTERS + """, hist AS MATERIALIZED (
  SELECT *, epoch_s // 3600 AS h, concat_ws('_', mmsi_a, mmsi_b, strftime(make_timestamp(epoch_s * 1000000), '%Y%m%d%H%M%S')) AS collision_id
  FROM enc WHERE cpa < 3e-1 AND tcpa BETWEEN 0 AND 10)"""
COMPONENTS = HISTORY + """, sym AS MATERIALIZED (SELECT h, mmsi_a AS u, mmsi_b AS v FROM hist UNION SELECT h, mmsi_b, mmsi_a FROM hist)
, reach(h, node, root) AS (
  SELECT h, u, u FROM sym UNION SELECT r.h, s.v, r.root FROM reach r JOIN sym s ON r.h = s.h AND r.node = s.u)
, comp AS MATERIALIZED (SELECT h, node AS mmsi, min(root) AS component FROM reach GROUP BY 1, 2)
, placed AS MATERIALIZED (SELECT hist.*, component FROM hist JOIN comp ON hist.h = comp.h AND hist.mmsi_a = comp.mmsi)
, scen AS MATERIALIZED (
  SELECT h, component, min(epoch_s) AS min_s, max(epoch_s) AS max_s, count(*) AS collisions_count FROM placed GROUP BY 1, 2)
, fleet AS MATERIALIZED (SELECT h, component, string_agg(mmsi, '_' ORDER BY mmsi) AS ships, count(*) AS n_ships FROM comp GROUP BY 1, 2)
, parent AS MATERIALIZED (SELECT scen.*, ships, n_ships, concat('scenario_', min_s, '_', ships) AS scenario_id
  FROM scen JOIN fleet ON scen.h = fleet.h AND scen.component = fleet.component)"""
ROWS = COMPONENTS + """, mom AS MATERIALIZED (
  SELECT h, component, epoch_s AS t, mmsi_a, mmsi_b, count(*) AS copies FROM placed GROUP BY ALL)
, ws AS MATERIALIZED (SELECT DISTINCT m.h, m.component, m.t, c.mmsi FROM mom m JOIN comp c ON m.h = c.h AND m.component = c.component)
, pos AS MATERIALIZED (
  SELECT ws.h, ws.component, ws.t, ws.mmsi, v.epoch_s, v.latitude, v.longitude, v.sog, v.cog, v.ship_name, v.dim_a + v.dim_b AS ship_length
  FROM ws JOIN vp v ON v.mmsi = ws.mmsi AND v.epoch_s BETWEEN ws.t - 1200 AND ws.t + 600)"""
FRAMES = ROWS + """, seg AS MATERIALIZED (
  SELECT *, lead(epoch_s) OVER g AS s2, lead(latitude) OVER g AS lat2, lead(longitude) OVER g AS lon2, lead(sog) OVER g AS sog2,
    lead(cog) OVER g AS cog2, min(epoch_s) OVER (PARTITION BY h, component, t, mmsi) AS s0
  FROM pos WINDOW g AS (PARTITION BY h, component, t, mmsi ORDER BY epoch_s))
, pnt AS MATERIALIZED (SELECT seg.*, k, s0 + 60 * k AS frame_s,
    CASE WHEN s0 + 60 * k = epoch_s THEN 0e0 ELSE (s0 + 60 * k - epoch_s) / (s2 - epoch_s)::DOUBLE END AS q
  FROM seg, range(0, 31) AS grid(k) WHERE (k = 0 AND epoch_s = s0) OR (s0 + 60 * k > epoch_s AND s0 + 60 * k <= s2))
, fr AS MATERIALIZED (SELECT h, component, t, mmsi, k, frame_s, latitude + (coalesce(lat2, latitude) - latitude) * q AS latitude,
    longitude + (coalesce(lon2, longitude) - longitude) * q AS longitude, sog + (coalesce(sog2, sog) - sog) * q AS sog,
    cog + (coalesce(cog2, cog) - cog) * q AS cog FROM pnt)
, times AS MATERIALIZED (SELECT DISTINCT h, component, t, frame_s FROM fr)
, fill AS MATERIALIZED (
  SELECT tm.h, tm.component, tm.t, tm.frame_s, f.mmsi, arg_max(f.latitude, f.frame_s) AS latitude, arg_max(f.longitude, f.frame_s) AS longitude,
    arg_max(f.sog, f.frame_s) AS sog, arg_max(f.cog, f.frame_s) AS cog
  FROM times tm JOIN fr f ON tm.h = f.h AND tm.component = f.component AND tm.t = f.t AND f.frame_s <= tm.frame_s
  GROUP BY 1, 2, 3, 4, 5)
, fill_ahead AS MATERIALIZED (
  SELECT * FROM fill UNION ALL
  SELECT tm.h, tm.component, tm.t, tm.frame_s, f.mmsi, arg_max(f.latitude, f.frame_s), arg_max(f.longitude, f.frame_s),
    arg_max(f.sog, f.frame_s), arg_max(f.cog, f.frame_s)
  FROM times tm JOIN fr f ON tm.h = f.h AND tm.component = f.component AND tm.t = f.t
  GROUP BY 1, 2, 3, 4, 5 HAVING min(f.frame_s) > tm.frame_s)"""


def _focus(fill: str) -> str:
    return f""", pf AS MATERIALIZED (
  SELECT m.h, m.component, m.t, m.mmsi_a, m.mmsi_b, m.copies, tm.frame_s,
    {haversine('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS focus_dist,
    (a.latitude + b.latitude) / 2 AS mid_lat, (a.longitude + b.longitude) / 2 AS mid_lon
  FROM mom m JOIN times tm ON m.h = tm.h AND m.component = tm.component AND m.t = tm.t
  LEFT JOIN {fill} a ON a.h = m.h AND a.component = m.component AND a.t = m.t AND a.mmsi = m.mmsi_a AND a.frame_s = tm.frame_s
  LEFT JOIN {fill} b ON b.h = m.h AND b.component = m.component AND b.t = m.t AND b.mmsi = m.mmsi_b AND b.frame_s = tm.frame_s
  WHERE tm.frame_s BETWEEN m.t - 1200 AND m.t + 600)
, best AS MATERIALIZED (
  SELECT h, component, t, mmsi_a, mmsi_b, copies, coalesce(focus_dist, 999999e0) AS real_min_dist,
    CASE WHEN focus_dist IS NULL THEN t ELSE frame_s END AS real_min_s
  FROM (SELECT *, row_number() OVER (PARTITION BY h, component, t, mmsi_a, mmsi_b ORDER BY focus_dist NULLS LAST, frame_s) AS rn FROM pf) WHERE rn = 1)
, focus AS MATERIALIZED (
  SELECT pf.*, real_min_s, real_min_dist, round((frame_s - real_min_s) / 6e1, 2) AS delta_minutes
  FROM pf JOIN best ON pf.h = best.h AND pf.component = best.component AND pf.t = best.t AND pf.mmsi_a = best.mmsi_a AND pf.mmsi_b = best.mmsi_b
  WHERE frame_s BETWEEN real_min_s - 900 AND real_min_s + 300)
, icon AS MATERIALIZED (
  SELECT h, component, t, mmsi_a, mmsi_b, mid_lat, mid_lon FROM (
    SELECT *, row_number() OVER (PARTITION BY h, component, t, mmsi_a, mmsi_b ORDER BY abs(frame_s - real_min_s), frame_s) AS rn FROM focus) WHERE rn = 1)"""


FOCUS, FOCUS_AHEAD = FRAMES + _focus("fill"), FRAMES + _focus("fill_ahead")
LABELS = """, lab AS MATERIALIZED (SELECT h, component, t, mmsi, arg_max(ship_name, epoch_s) AS name, coalesce(arg_max(ship_length, epoch_s), 0e0) AS ship_length
  FROM pos GROUP BY ALL)"""


def hour():
    return F.floor(F.unix_timestamp("hour") / 3600).cast("long").alias("h")


def key():
    return hour(), "component", F.floor(F.col("t_us") / 1_000_000).cast("long").alias("t")


def chosen(spark, sf):
    return S.with_hour(S.read_encounters(encounters(spark, sf)))


def parts(spark, sf):
    """Stored encounters, members, moments and positions."""
    met = stored(chosen(spark, sf), "chosen")
    members = stored(S.scenario_members(met), "members")
    moments = stored(S.moments(S.edges_in_component(met, members)), "moments")
    return met, members, moments, S.positions_for_encounters(moments, members, positions(spark, sf))


def tracks_of(rows):
    return stored(S.ship_tracks(S.resample(rows, [*S.MOMENT, "mmsi"])), "tracks")


@query(  # S3, P21
    "read_encounters", HISTORY + " SELECT collision_id, mmsi_a, mmsi_b, epoch_s, round(cpa, 6) AS cpa FROM hist WHERE epoch_s // 3600 = 1704067200 // 3600 + 1"
)
def read_encounters(spark, sf):
    start, end = (F.timestamp_seconds(F.lit(1704067200 + s)) for s in (3600, 7200))
    return S.read_encounters(encounters(spark, sf), start, end).select("collision_id", "mmsi_a", "mmsi_b", epoch(), *r6("cpa"))


@query(  # S4: positions of all ships with a near encounter over half an hour, ends included
    "read_positions",
    HISTORY + """ SELECT mmsi, epoch_s FROM vp WHERE epoch_s BETWEEN 1704067200 + 1200 AND 1704067200 + 3000
      AND mmsi IN (SELECT mmsi_a FROM hist UNION SELECT mmsi_b FROM hist)""",
)
def read_positions(spark, sf):
    met = chosen(spark, sf)
    ships = met.select(F.explode(F.array("mmsi_a", "mmsi_b")).alias("mmsi"))
    start, end = (F.timestamp_seconds(F.lit(1704067200 + s)) for s in (1200, 3000))
    return S.read_positions(positions(spark, sf), ships, start, end).select("mmsi", "epoch_s")


@query("connected_components", COMPONENTS + " SELECT h, mmsi, component FROM comp")  # A6
def connected_components(spark, sf):
    return S.scenario_members(chosen(spark, sf)).select(hour(), "mmsi", "component")


@query("edges_in_component", COMPONENTS + " SELECT h, component, collision_id FROM placed")  # J8
def edges_in_component(spark, sf):
    met = stored(chosen(spark, sf).select("hour", "mmsi_a", "mmsi_b", "collision_id"), "chosen")  # detected once, read twice
    return S.edges_in_component(met, S.scenario_members(met)).select(hour(), "component", "collision_id")


@query(  # A7
    "scenario_summary", COMPONENTS + " SELECT scenario_id, n_ships, collisions_count, min_s, max_s FROM parent"
)
def scenario_summary(spark, sf):
    met = stored(chosen(spark, sf).select("hour", "mmsi_a", "mmsi_b", "timestamp"), "chosen")  # detected once, read twice
    members = stored(S.scenario_members(met), "members")
    return S.scenario_summary(S.edges_in_component(met, members), members).select(
        "scenario_id", F.size("ships_involved").cast("long").alias("n_ships"), "collisions_count",
        epoch("min_ts", "min_s"), epoch("max_ts", "max_s"),
    )


@query(  # J6
    "positions_for_encounters", ROWS + " SELECT h, component, t, mmsi, epoch_s, latitude, longitude FROM pos", rounded=("latitude", "longitude"))
def positions_for_encounters(spark, sf):
    rows = parts(spark, sf)[3]
    return rows.select(*key(), "mmsi", (F.col("ts_us") / 1_000_000).cast("long").alias("epoch_s"), "latitude", "longitude")


@query(  # A5: every position three times under two names
    "dedupe_positions", " SELECT mmsi, epoch_s, latitude, longitude, sog, cog, concat(ship_name, '_B') AS ship_name, dim_a + dim_b AS ship_length FROM vp", rounded=("latitude", "longitude"))
def dedupe_positions(spark, sf):
    vp = positions(spark, sf)
    again = vp.withColumn("ship_name", F.concat("ship_name", F.lit("_B")))
    out = S.dedupe_positions(vp.unionByName(vp).unionByName(again))
    return out.withColumn("epoch_s", F.unix_timestamp("timestamp")).drop("timestamp")


@query("ship_labels", ROWS + LABELS + " SELECT h, component, t, mmsi, name, ship_length FROM lab")  # A12
def ship_labels(spark, sf):
    return S.ship_labels(parts(spark, sf)[3], S.MOMENT).select(*key(), "mmsi", "name", "ship_length")


@query(  # W2 on the whole positions table
    "resample",
    """, seg AS MATERIALIZED (SELECT *, lead(epoch_s) OVER g AS s2, lead(latitude) OVER g AS lat2, lead(longitude) OVER g AS lon2,
      min(epoch_s) OVER (PARTITION BY mmsi, epoch_s // 3600) AS s0 FROM vp WINDOW g AS (PARTITION BY mmsi, epoch_s // 3600 ORDER BY epoch_s))
    , pt AS MATERIALIZED (SELECT seg.*, k, CASE WHEN s0 + 60 * k = epoch_s THEN 0e0 ELSE (s0 + 60 * k - epoch_s) / (s2 - epoch_s)::DOUBLE END AS q
      FROM seg, range(0, 61) AS grid(k) WHERE (k = 0 AND epoch_s = s0) OR (s0 + 60 * k > epoch_s AND s0 + 60 * k <= s2))
    SELECT mmsi, s0 + 60 * k AS frame_s, round(latitude + (coalesce(lat2, latitude) - latitude) * q, 6) AS latitude,
      round(longitude + (coalesce(lon2, longitude) - longitude) * q, 6) AS longitude FROM pt""",
)
def resample(spark, sf):
    vp = positions(spark, sf).withColumn("ts_us", F.unix_micros("timestamp")).withColumn("hour", F.date_trunc("hour", "timestamp"))
    return S.resample(vp, ["mmsi", "hour"]).select("mmsi", "frame_s", *r6("latitude", "longitude"))


#: Ships that turn at every report; segments between reports, and the start of each ship's hour.
TURNING = """, turning AS MATERIALIZED (SELECT * REPLACE (CAST(event_id * 37 % 360 AS DOUBLE) AS cog) FROM vp)
    , seg AS MATERIALIZED (SELECT *, lead(epoch_s) OVER g AS s2, lead(cog) OVER g AS cog2, lead(latitude) OVER g AS lat2,
      min(epoch_s) OVER (PARTITION BY mmsi, epoch_s // 3600) AS s0 FROM turning WINDOW g AS (PARTITION BY mmsi, epoch_s // 3600 ORDER BY epoch_s))"""


def _turning(spark, sf):
    vp = X.vessel_positions(spark, sf).withColumn("cog", (F.col("event_id") * 37 % 360).cast("double"))
    return vp.withColumn("ts_us", F.unix_micros("timestamp")).withColumn("hour", F.date_trunc("hour", "timestamp"))


@query(  # W2, courses the short way round
    "resample_circular",
    TURNING + """, pt AS MATERIALIZED (SELECT seg.*, k, CASE WHEN s0 + 60 * k = epoch_s THEN 0e0 ELSE (s0 + 60 * k - epoch_s) / (s2 - epoch_s)::DOUBLE END AS q
      FROM seg, range(0, 61) AS grid(k) WHERE (k = 0 AND epoch_s = s0) OR (s0 + 60 * k > epoch_s AND s0 + 60 * k <= s2))
    SELECT mmsi, s0 + 60 * k AS frame_s, round((cog + ((coalesce(cog2, cog) - cog + 540) % 360e0 - 180) * q + 360) % 360e0, 6) AS cog FROM pt""",
)
def resample_circular(spark, sf):
    return S.resample(_turning(spark, sf), ["mmsi", "hour"], circular=True).select("mmsi", "frame_s", *r6("cog"))


@query(  # W2, all grids at whole minutes
    "resample_aligned",
    TURNING + """, pt AS MATERIALIZED (SELECT seg.*, t, CASE WHEN t = epoch_s THEN 0e0 ELSE (t - epoch_s) / (s2 - epoch_s)::DOUBLE END AS q
      FROM (SELECT *, unnest([(s0 + 59) // 60 * 60 + 60 * k FOR k IN range(0, 61)]) AS t FROM seg) seg
      WHERE (epoch_s = s0 AND t = epoch_s) OR (t > epoch_s AND t <= s2))
    SELECT mmsi, t AS frame_s, round(latitude + (coalesce(lat2, latitude) - latitude) * q, 6) AS latitude,
      round(cog + (coalesce(cog2, cog) - cog) * q, 6) AS cog FROM pt""",
)
def resample_aligned(spark, sf):
    return S.resample(_turning(spark, sf), ["mmsi", "hour"], align=True).select("mmsi", "frame_s", *r6("latitude", "cog"))


@query(  # W2 per encounter
    "resample_windows",
    FRAMES + """ SELECT h, component, t, mmsi, k, frame_s, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
      round(sog, 6) AS sog, round(cog, 6) AS cog FROM fr""",
)
def resample_windows(spark, sf):
    out = S.resample(parts(spark, sf)[3], [*S.MOMENT, "mmsi"])
    return out.select(*key(), "mmsi", F.col("k").cast("long").alias("k"), "frame_s", *r6("latitude", "longitude", "sog", "cog"))


def _fill(spark, sf, look_ahead):
    tracks = tracks_of(parts(spark, sf)[3])
    out = S.fill_gaps(S.frame_times(tracks), tracks, look_ahead)
    return out.select(*key(), "frame_s", "mmsi", *r6("latitude", "longitude"))


FILLED = " SELECT h, component, t, frame_s, mmsi, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM "


@query("fill_gaps", FRAMES + FILLED + "fill")  # W3
def fill_gaps(spark, sf):
    return _fill(spark, sf, False)


@query("fill_gaps_look_ahead", FRAMES + FILLED + "fill_ahead")  # W3, compatible form
def fill_gaps_look_ahead(spark, sf):
    return _fill(spark, sf, True)


def _pair_frames(spark, sf):
    _, _, moments, rows = parts(spark, sf)
    tracks = tracks_of(rows)
    return moments, S.pair_frames(moments, tracks, S.frame_times(tracks))


@query(  # J9
    "pair_frames", FOCUS + " SELECT h, component, t, mmsi_a, mmsi_b, frame_s, round(focus_dist, 6) AS focus_dist FROM pf"
)
def pair_frames(spark, sf):
    return _pair_frames(spark, sf)[1].select(*key(), "mmsi_a", "mmsi_b", "frame_s", *r6("focus_dist"))


@query(  # A8
    "closest_approach",
    FOCUS + " SELECT h, component, t, mmsi_a, mmsi_b, round(real_min_dist, 6) AS real_min_dist, real_min_s FROM best",
)
def closest_approach(spark, sf):
    out = S.closest_approach(*_pair_frames(spark, sf))
    return out.select(*key(), "mmsi_a", "mmsi_b", *r6("real_min_dist"), (F.col("real_min_us") / 1_000_000).cast("long").alias("real_min_s"))


@query(  # W6
    "focus_window",
    FOCUS + " SELECT h, component, t, mmsi_a, mmsi_b, frame_s, delta_minutes, round(focus_dist, 6) AS focus_dist FROM focus",
)
def focus_window(spark, sf):
    moments, frames = _pair_frames(spark, sf)
    out = S.focus_window(frames, S.closest_approach(moments, frames))
    return out.select(*key(), "mmsi_a", "mmsi_b", "frame_s", "delta_minutes", *r6("focus_dist"))


@query(  # W7
    "encounter_icon",
    FOCUS + " SELECT h, component, t, mmsi_a, mmsi_b, round(mid_lat, 6) AS icon_lat, round(mid_lon, 6) AS icon_lon FROM icon",
)
def encounter_icon(spark, sf):
    moments, frames = _pair_frames(spark, sf)
    out = S.encounter_icon(S.focus_window(frames, S.closest_approach(moments, frames)))
    return out.select(*key(), "mmsi_a", "mmsi_b", *r6("icon_lat", "icon_lon"))


def _replays(focus: str) -> str:
    return focus + """, rep AS MATERIALIZED (
    SELECT scenario_id, concat_ws('_', best.mmsi_a, best.mmsi_b, strftime(make_timestamp(best.t * 1000000), '%Y%m%d%H%M%S')) AS collision_id,
      round(real_min_dist, 6) AS cpa, real_min_s AS t_min_s, round(mid_lat, 6) AS icon_lat, round(mid_lon, 6) AS icon_lon
    FROM best JOIN parent ON best.h = parent.h AND best.component = parent.component
    LEFT JOIN icon ON icon.h = best.h AND icon.component = best.component AND icon.t = best.t AND icon.mmsi_a = best.mmsi_a AND icon.mmsi_b = best.mmsi_b
    , range(0, copies))
    SELECT * FROM rep"""


def _replay_rows(spark, sf, **options):
    out = H.build_scenarios(encounters(spark, sf), positions(spark, sf), **options).replays
    return out.select("scenario_id", "collision_id", *r6("cpa"), epoch("t_min", "t_min_s"), *r6("icon_lat", "icon_lon"))


@query("replays", _replays(FOCUS))  # the history job, one row per encounter
def replays(spark, sf):
    return _replay_rows(spark, sf)


@query("replays_look_ahead", _replays(FOCUS_AHEAD))
def replays_look_ahead(spark, sf):
    return _replay_rows(spark, sf, look_ahead=True)


@query(  # the history job, one row per encounter, frame and ship
    "replay_frames",
    FOCUS + LABELS + """ SELECT f.h, f.component, f.t, f.mmsi_a, f.mmsi_b, f.frame_s, f.delta_minutes, round(f.focus_dist, 6) AS focus_dist,
      x.mmsi, l.name, l.ship_length, round(x.latitude, 6) AS lat, round(x.longitude, 6) AS lon, round(x.sog, 6) AS sog, round(x.cog, 6) AS cog
    FROM focus f JOIN fill x ON x.h = f.h AND x.component = f.component AND x.t = f.t AND x.frame_s = f.frame_s
    JOIN lab l ON l.h = x.h AND l.component = x.component AND l.t = x.t AND l.mmsi = x.mmsi""",
)
def replay_frames(spark, sf):
    out = H.build_scenarios(encounters(spark, sf), positions(spark, sf)).frames
    return out.select(
        *key(), "mmsi_a", "mmsi_b", "frame_s", "delta_minutes", *r6("focus_dist"), "mmsi", "name", "ship_length",
        F.round("latitude", 6).alias("lat"), F.round("longitude", 6).alias("lon"), *r6("sog", "cog"),
    )


@query(  # F25
    "replay_titles",
    FOCUS + LABELS + """ SELECT best.h, best.component, best.t, best.mmsi_a, best.mmsi_b,
      printf('%s – %s, realMinDist=%.3f nm', x.name, y.name, real_min_dist) AS title FROM best
    JOIN lab x ON x.h = best.h AND x.component = best.component AND x.t = best.t AND x.mmsi = best.mmsi_a
    JOIN lab y ON y.h = best.h AND y.component = best.component AND y.t = best.t AND y.mmsi = best.mmsi_b""",
)
def replay_titles(spark, sf):
    out = H.build_scenarios(encounters(spark, sf), positions(spark, sf)).replays
    keyed = out.withColumn("t_us", F.unix_micros("timestamp"))
    return keyed.select(*key(), F.col("focus_mmsi")[0].alias("mmsi_a"), F.col("focus_mmsi")[1].alias("mmsi_b"), "title")
