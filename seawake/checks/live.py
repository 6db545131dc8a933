"""Queries over live encounters, ship views, risk and tracks (J4, J5, J7, J10, J11, U, T, W4, W5)."""

from pyspark.sql import functions as F

from seawake import fixtures as X
from seawake.checks.geometry import CLASS
from seawake.checks.messages import SKEWED, skewed
from seawake.checks.registry import ENCOUNTERS, LATEST, LIVE, LIVE_HOURS, RISK, epoch, haversine, query, r6, TIMED, flat_relative
from seawake.functions import geo
from seawake.operators import encounters as E
from seawake.operators import parse as P
from seawake.operators import series as Q
from seawake.operators import tracks as K
from seawake.operators import views as V
from seawake.plans import serving
from seawake.session import stored

NOW_S = 1704067200 + 2_000_000


def now():
    return F.timestamp_seconds(F.lit(NOW_S))


def positions(spark, sf):
    return X.vessel_positions(spark, sf)


def latest(spark, sf):
    return K.last_per_key(positions(spark, sf))


def encounters(spark, sf):
    return E.detect_encounters_windowed(P.under_way(positions(spark, sf)))


def live(spark, sf, unit="minutes"):
    return E.detect_encounters_live(latest(spark, sf), tcpa_unit=unit)


@query(  # J5 with W1, P8, P14, F2–F4: the flagship query
    "encounters_windowed",
    ENCOUNTERS + """ SELECT mmsi_a, ship_name_a, mmsi_b, ship_name_b, epoch_s, round(cpa, 6) AS cpa, round(tcpa, 6) AS tcpa,
      round(distance, 6) AS distance, true AS is_active, latitude_a, longitude_a, latitude_b, longitude_b FROM enc""", rounded=("latitude_a", "longitude_a", "latitude_b", "longitude_b"),
)
def encounters_windowed(spark, sf):
    return encounters(spark, sf).select(
        "mmsi_a", "ship_name_a", "mmsi_b", "ship_name_b", epoch(), *r6("cpa", "tcpa", "distance"), "is_active",
        "latitude_a", "longitude_a", "latitude_b", "longitude_b",
    )


@query(  # J5 with every cell salted: the same rows
    "encounters_windowed_salted", ENCOUNTERS + " SELECT mmsi_a, mmsi_b, epoch_s, round(cpa, 6) AS cpa FROM enc"
)
def encounters_windowed_salted(spark, sf):
    out = E.detect_encounters_windowed(P.under_way(positions(spark, sf)), hot_cell_ships=1)
    return out.select("mmsi_a", "mmsi_b", epoch(), *r6("cpa"))


@query(  # J4
    "encounters_live", LIVE + " SELECT id, mmsi_a, mmsi_b, round(cpa, 6) AS cpa, round(tcpa, 6) AS tcpa, epoch_s FROM live"
)
def encounters_live(spark, sf):
    return live(spark, sf).select("id", "mmsi_a", "mmsi_b", *r6("cpa", "tcpa"), epoch())


@query(  # J4, threshold in hours
    "encounters_live_hours", LIVE_HOURS + " SELECT id, round(cpa, 6) AS cpa, round(tcpa, 6) AS tcpa FROM live_h"
)
def encounters_live_hours(spark, sf):
    return live(spark, sf, "hours").select("id", *r6("cpa", "tcpa"))


@query("filter_encounters", LIVE + " SELECT id FROM live WHERE cpa <= 3e-1 AND tcpa <= 10")  # P18
def filter_encounters(spark, sf):
    return E.filter_encounters(live(spark, sf), 0.3, 10.0).select("id")


@query(  # U3
    "dedupe_pairs",
    ENCOUNTERS + """ SELECT mmsi_a, mmsi_b, epoch_s, round(tcpa, 6) AS tcpa FROM (
      SELECT *, row_number() OVER (PARTITION BY mmsi_a, mmsi_b ORDER BY epoch_s DESC) AS rn FROM enc) WHERE rn = 1""",
)
def dedupe_pairs(spark, sf):
    return E.dedupe_pairs(encounters(spark, sf)).select("mmsi_a", "mmsi_b", epoch(), *r6("tcpa"))


RANKED = ENCOUNTERS + """ SELECT mmsi_a, mmsi_b, epoch_s, urgency FROM (
      SELECT *, row_number() OVER (ORDER BY tcpa, cpa, mmsi_a, mmsi_b, epoch_s) AS urgency FROM enc)"""


@query("rank_encounters", RANKED)  # T3
def rank_encounters(spark, sf):
    return E.rank_encounters(E.with_urgency(encounters(spark, sf))).select("mmsi_a", "mmsi_b", epoch(), "urgency")


@query("most_urgent", RANKED + " WHERE urgency <= 50")  # T3, as a report
def most_urgent(spark, sf):
    return E.most_urgent(encounters(spark, sf), 50).select("mmsi_a", "mmsi_b", epoch(), "urgency")


@query(  # T1
    "most_recent", LATEST + " SELECT mmsi, epoch_s FROM latest ORDER BY epoch_s DESC, mmsi LIMIT 100"
)
def most_recent(spark, sf):
    return K.most_recent(latest(spark, sf)).select("mmsi", "epoch_s")


@query("sample_head", LATEST + " SELECT mmsi, epoch_s FROM latest ORDER BY mmsi LIMIT 5")  # T2
def sample_head(spark, sf):
    return V.sample_head(latest(spark, sf), 5, "mmsi").select("mmsi", "epoch_s")


@query("order_by_time", " SELECT mmsi, epoch_s FROM vp ORDER BY epoch_s, mmsi")  # T4
def order_by_time(spark, sf):
    return V.order_by_time(positions(spark, sf), "mmsi").select("mmsi", "epoch_s")


@query(  # W1
    "tumbling", " SELECT event_id, epoch_s // 15 * 15 AS start_s, epoch_s // 15 * 15 + 15 AS end_s FROM vp"
)
def tumbling(spark, sf):
    return Q.tumbling(positions(spark, sf), 15).select(
        "event_id", epoch("window_start", "start_s"), epoch("window_end", "end_s")
    )


# --- views -------------------------------------------------------------------
@query(  # P15, P16
    "vessel_view",
    LATEST + """ SELECT mmsi, ship_name AS name, latitude AS lat, longitude AS lon, sog, cog, coalesce(heading, cog) AS heading,
      coalesce(dim_a, 0) + dim_b AS length, dim_c + dim_d AS width, epoch_s
    FROM latest""", rounded=("lat", "lon"),
)
def vessel_view(spark, sf):
    return serving.vessels(positions(spark, sf)).withColumn("epoch_s", F.unix_timestamp("timestamp")).drop("timestamp")


@query(  # P17, P18, J7
    "encounter_view",
    RISK + """ SELECT id, mmsi_a, ship_name_a, round(latitude_a, 6) AS latitude_a, round(longitude_a, 6) AS longitude_a, sog_a, cog_a,
      mmsi_b, ship_name_b, round(latitude_b, 6) AS latitude_b, round(longitude_b, 6) AS longitude_b, sog_b, cog_b,
      round(cpa, 6) AS cpa, round(tcpa, 6) AS tcpa, round(overall_risk, 6) AS risk, epoch_s FROM risk""",
)
def encounter_view(spark, sf):
    flat = V.flat_view(serving.collisions(positions(spark, sf)))
    return flat.select(
        "id", "mmsi_a", "ship_name_a", *r6("latitude_a", "longitude_a"), "sog_a", "cog_a",
        "mmsi_b", "ship_name_b", *r6("latitude_b", "longitude_b"), "sog_b", "cog_b", *r6("cpa", "tcpa", "risk"), epoch(),
    )


@query(  # F8–F10 per encounter
    "assess_risk",
    RISK + """ SELECT id AS collision_id, round(overall_risk, 6) AS overall_risk, round(cpa_risk, 6) AS cpa_risk,
      round(tcpa_risk, 6) AS tcpa_risk, round(speed_risk, 6) AS speed_risk, round(angle_risk, 6) AS angle_risk, 2e-1 AS uncertainty FROM risk""",
)
def assess_risk(spark, sf):
    out = V.assess_risk(live(spark, sf)).select("collision_id", "overall_risk", "risk_factors.*", "uncertainty")
    return out.select(
        "collision_id", *r6("overall_risk", "cpa_risk", "tcpa_risk", "speed_risk"),
        F.round("approach_angle_risk", 6).alias("angle_risk"), "uncertainty",
    )


@query(  # J7: encounters at their closest point are not assessed yet
    "attach_risk", RISK + " SELECT id, CASE WHEN tcpa = 0 THEN 5e-1 ELSE round(overall_risk, 6) END AS risk FROM risk"
)
def attach_risk(spark, sf):
    # detected once, read twice, and joined where it lies
    met = stored(live(spark, sf).select("mmsi_a", "id", "cpa", "tcpa", "sog_a", "sog_b", "cog_a", "cog_b"), "met", dealt_by=("mmsi_a", "id"))
    risks = V.assess_risk(met.where("tcpa > 0"), carry=("mmsi_a",))
    return V.attach_risk(met, risks, within=("mmsi_a",)).select("id", *r6("risk"))


@query(  # U1
    "risk_heatmap",
    RISK + """ SELECT round(latitude, 6) AS lat, round(longitude, 6) AS lon, 3e-1 AS weight FROM latest UNION ALL
    SELECT round((latitude_a + latitude_b) / 2, 6), round((longitude_a + longitude_b) / 2, 6), round(heat, 6) FROM risk""",
)
def risk_heatmap(spark, sf):
    return serving.heatmap(positions(spark, sf)).select(*r6("lat", "lon", "weight"))


@query(  # U1 summed per cell
    "risk_heatmap_cells",
    RISK + """ SELECT floor(lat / 5e-2)::BIGINT AS cell_y, floor(lon / 5e-2)::BIGINT AS cell_x, round(sum(weight), 4) AS weight, count(*) AS points FROM (
      SELECT latitude AS lat, longitude AS lon, 3e-1 AS weight FROM latest UNION ALL
      SELECT (latitude_a + latitude_b) / 2, (longitude_a + longitude_b) / 2, heat FROM risk) GROUP BY 1, 2""",
)
def risk_heatmap_cells(spark, sf):
    return serving.heatmap(positions(spark, sf), 0.05).withColumn("weight", F.round("weight", 4))


@query(  # U2
    "replace_region",
    LATEST + """ SELECT mmsi, epoch_s FROM (
      SELECT mmsi, epoch_s FROM latest WHERE NOT (abs(latitude - 50) < 15e-2 AND abs(longitude - 1e-1) < 15e-2) UNION ALL
      SELECT mmsi + 5000000, epoch_s + 1 FROM latest WHERE sog < 5) ORDER BY epoch_s DESC, mmsi LIMIT 100""",
)
def replace_region(spark, sf):
    state = latest(spark, sf).select("mmsi", "latitude", "longitude", "sog", "timestamp")
    batch = state.where("sog < 5").withColumn("mmsi", F.col("mmsi") + 5000000).withColumn(
        "timestamp", F.col("timestamp") + F.expr("INTERVAL 1 SECOND")
    )
    return V.replace_region(state, batch, (50.0, 0.1), 0.1).select("mmsi", epoch())


@query(  # A10
    "status_summary",
    LIVE + f""" SELECT (SELECT count(*) FROM latest) AS ship_count, (SELECT count(*) FROM live) AS encounter_count,
      max(epoch_s) AS last_ship_s, {NOW_S} - max(epoch_s) + 0e0 AS seconds_since_last_ship FROM latest""",
)
def status_summary(spark, sf):
    out = V.status_summary(latest(spark, sf), live(spark, sf), now())
    return out.withColumn("last_ship_s", F.unix_timestamp("last_ship")).drop("last_ship")


@query(  # J10
    "removed_vessels",
    """ SELECT DISTINCT mmsi FROM vp WHERE epoch_s < 1704067200 + 3600 AND mmsi NOT IN (
      SELECT mmsi FROM vp WHERE epoch_s >= 1704067200 + 3600 AND sog >= 5)""",
)
def removed_vessels(spark, sf):
    vp = positions(spark, sf)
    split = F.lit(1704067200 + 3600)
    before = K.last_per_key(vp.where(F.col("epoch_s") < split))
    after = K.last_per_key(P.under_way(vp.where(F.col("epoch_s") >= split), 5.0))
    return V.removed_vessels(before, after).select("mmsi")


@query(  # F23
    "pair_classes",
    ENCOUNTERS + f""", len AS (SELECT DISTINCT mmsi, dim_a + dim_b AS l FROM vp WHERE dim_a > 0 AND dim_b > 0 AND sog < 12)
    SELECT mmsi_a, mmsi_b, epoch_s, {CLASS.format(x="coalesce(x.l, 0)")} AS class_a, {CLASS.format(x="coalesce(y.l, 0)")} AS class_b
    FROM enc LEFT JOIN len x ON mmsi_a = x.mmsi LEFT JOIN len y ON mmsi_b = y.mmsi""",
)
def pair_classes(spark, sf):
    ships = latest(spark, sf).where("sog < 12")
    return V.pair_classes(encounters(spark, sf), ships).select("mmsi_a", "mmsi_b", epoch(), "class_a", "class_b")


@query(  # F26
    "ship_summary",
    LATEST + f""" SELECT mmsi, CASE WHEN ship_name = '' THEN 'Unknown' ELSE ship_name END AS name, printf('%.1f', sog) AS sog,
      printf('%.1f', cog) AS cog, printf('%.1f', coalesce(heading, cog)) AS heading,
      CASE WHEN dim_a IS NULL THEN 'N/A' ELSE printf('%.1f', dim_a + dim_b) END AS length,
      concat(({NOW_S} - epoch_s) // 60, 'm ', ({NOW_S} - epoch_s) % 60, 's ago') AS updated FROM latest""",
)
def ship_summary(spark, sf):
    return V.ship_summary(latest(spark, sf), F.lit(NOW_S))


@query(  # F27, on every pair of consecutive reports
    "pair_summary",
    LATEST + f""", chosen AS (SELECT DISTINCT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b FROM vp a JOIN vp b ON a.event_id + 1 = b.event_id)
    , p AS ({flat_relative("latest", "latest", "(a.mmsi, b.mmsi) IN (SELECT mmsi_a, mmsi_b FROM chosen)")})
    SELECT mmsi_a, mmsi_b, round({haversine("latitude_a", "longitude_a", "latitude_b", "longitude_b")}, 6) AS distance,
      round(sqrt((dx + ux * t) * (dx + ux * t) + (dy + uy * t) * (dy + uy * t)), 6) AS cpa, round(t * 60, 6) AS tcpa
    FROM (SELECT *, greatest({TIMED}, 0e0) AS t FROM p)""",
)
def pair_summary(spark, sf):
    vp = positions(spark, sf)
    a = vp.select((F.col("event_id") + 1).alias("k"), F.col("mmsi").alias("mmsi_a"))
    b = vp.select(F.col("event_id").alias("k"), F.col("mmsi").alias("mmsi_b"))
    chosen = a.join(b, "k").select("mmsi_a", "mmsi_b").distinct()
    return V.pair_summary(chosen, latest(spark, sf)).select("mmsi_a", "mmsi_b", *r6("distance", "cpa", "tcpa"))


@query(  # F28
    "encounter_summary",
    ENCOUNTERS + f""" SELECT mmsi_a, mmsi_b, epoch_s, ship_name_a AS name_a, ship_name_b AS name_b,
      concat(({NOW_S} - epoch_s) // 60, 'm ', ({NOW_S} - epoch_s) % 60, 's ago') AS updated,
      round((latitude_a + latitude_b) / 2, 6) AS marker_lat, round((longitude_a + longitude_b) / 2, 6) AS marker_lon FROM enc""",
)
def encounter_summary(spark, sf):
    out = V.encounter_summary(encounters(spark, sf), F.lit(NOW_S))
    return out.select(
        "mmsi_a", "mmsi_b", epoch(), "name_a", "name_b", "updated",
        F.round("marker.lat", 6).alias("marker_lat"), F.round("marker.lon", 6).alias("marker_lon"),
    )


def _vector_sql(side):
    return f"""round(latitude_{side} + sog_{side} * mins / 60 / 60 * cos(radians(cog_{side})), 6) AS end_lat_{side},
      round(longitude_{side} + sog_{side} * mins / 60 / 60 * sin(radians(cog_{side})) / cos(radians(latitude_{side})), 6) AS end_lon_{side}"""


@query(  # F20 for encounters, both ships
    "encounter_vectors",
    ENCOUNTERS + f""", m AS (SELECT *, greatest(1e0, floor(tcpa + 5e-1)) AS mins FROM enc)
    SELECT mmsi_a, mmsi_b, epoch_s, mins AS minutes, {_vector_sql("a")}, {_vector_sql("b")} FROM m""",
)
def encounter_vectors(spark, sf):
    out = E.detect_encounters_windowed(P.under_way(positions(spark, sf)), carry=("cog", "sog"))
    out = out.withColumn("minutes", geo.encounter_vector_minutes(F.col("tcpa")))
    out = out.withColumns({f"v_{side}": geo.course_vector(geo.motion(f"_{side}"), F.col("minutes")) for side in "ab"})
    ends = [F.round(f"v_{side}.{c}", 6).alias(f"end_{c}_{side}") for side in "ab" for c in ("lat", "lon")]
    return out.select("mmsi_a", "mmsi_b", epoch(), "minutes", *ends)


# --- history and tracks ------------------------------------------------------
@query(  # W4
    "current_and_history",
    """ SELECT mmsi, epoch_s, row_number() OVER (PARTITION BY mmsi ORDER BY epoch_s DESC) AS recency,
      count(*) OVER (PARTITION BY mmsi) AS n_points FROM vp QUALIFY n_points >= 2""",
)
def current_and_history(spark, sf):
    return K.current_and_history(positions(spark, sf)).select("mmsi", "epoch_s", "recency", "n_points")


@query(  # W4, a hot ship cut into small slices
    "current_and_history_skewed",
    SKEWED + """ SELECT mmsi, epoch_s, row_number() OVER (PARTITION BY mmsi ORDER BY epoch_s DESC) AS recency,
      count(*) OVER (PARTITION BY mmsi) AS n_points FROM hot QUALIFY n_points >= 2""",
)
def current_and_history_skewed(spark, sf):
    return K.current_and_history(skewed(X.vessel_positions(spark, sf)), slice_rows=100).select("mmsi", "epoch_s", "recency", "n_points")


@query(  # W5, counted back from each ship's newest report
    "recent",
    """ SELECT mmsi, epoch_s FROM (SELECT *, max(epoch_s) OVER (PARTITION BY mmsi) AS top FROM vp) WHERE epoch_s >= top - 3600""",
)
def recent(spark, sf):
    return Q.recent(positions(spark, sf)).select("mmsi", "epoch_s")


@query(  # W5 at a given time
    "recent_as_of", " SELECT mmsi, epoch_s FROM vp WHERE epoch_s BETWEEN 1704067200 + 1400 AND 1704067200 + 5000"
)
def recent_as_of(spark, sf):
    return Q.recent(positions(spark, sf), as_of=F.timestamp_seconds(F.lit(1704067200 + 5000))).select("mmsi", "epoch_s")


TRACK = """, hist AS (SELECT * FROM (SELECT *, max(epoch_s) OVER (PARTITION BY mmsi) AS top FROM vp) WHERE epoch_s >= top - 3600)
, cur AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY mmsi) AS n FROM hist) WHERE n >= 2 AND epoch_s = top)
, trk AS (
  SELECT mmsi, step, round(latitude + sog * 0.0166e0 / 60 * cos(radians(cog)) * step * 3, 6) AS latitude,
    round(longitude + sog * 0.0166e0 / 60 / cos(radians(latitude)) * sin(radians(cog)) * step * 3, 6) AS longitude, epoch_s + step * 180 AS epoch_s,
    round(1e-1 * step * sog * 2e-2, 6) AS r68, round(3e-1 * step * sog * 2e-2, 6) AS r95, round(5e-1 * step * sog * 2e-2, 6) AS r99
  FROM cur, range(1, 11) AS s(step))"""


def _track(df):
    return df.select(
        "mmsi", "step", *r6("latitude", "longitude"), epoch(),
        *[F.round(F.col("uncertainty")[i], 6).alias(n) for i, n in enumerate(("r68", "r95", "r99"))],
    )


@query("predict_track", TRACK + " SELECT mmsi, step, latitude, longitude, epoch_s, r68, r95, r99 FROM trk")  # F12, F13, W4, W5
def predict_track(spark, sf):
    return _track(serving.trajectories(positions(spark, sf)))


@query("predict_one_track", TRACK + " SELECT mmsi, step, latitude, longitude, epoch_s, r68, r95, r99 FROM trk WHERE mmsi = 200000021")  # P23
def predict_one_track(spark, sf):
    return _track(serving.trajectories(positions(spark, sf), "200000021"))


@query(  # J11
    "predict_current",
    LATEST + """, view AS (SELECT mmsi FROM latest ORDER BY epoch_s DESC, mmsi LIMIT 100)
    SELECT mmsi, epoch_s FROM vp WHERE mmsi IN (SELECT mmsi FROM view)""",
)
def predict_current(spark, sf):
    vp = positions(spark, sf)
    return K.predict_current(K.most_recent(K.last_per_key(vp)), vp).select("mmsi", "epoch_s")


@query("retain", " SELECT mmsi, epoch_s FROM vp WHERE epoch_s > 1704067200 + 9000 - 1500")  # K8
def retain(spark, sf):
    return Q.retain(positions(spark, sf), 1500, F.timestamp_seconds(F.lit(1704067200 + 9000))).select("mmsi", "epoch_s")
