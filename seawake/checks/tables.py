"""Queries that go through files: what is written comes back.

Folders are taken below the session's shared folder, a new one for each run.
"""

from pyspark.sql import functions as F

from seawake import fixtures as X
from seawake import schema as S
from seawake.checks.history import COMPONENTS, FOCUS, LABELS
from seawake.checks.live import encounters, positions
from seawake.checks.messages import DIMS, NEWEST_STATIC, STATICS, now
from seawake.checks.registry import ENCOUNTERS, epoch, query, r6
from seawake.operators import parse as P
from seawake.plans import history as H
from seawake.sinks import tables as W
from seawake.sources import files as R
from seawake.session import work_path


@query("write_positions", " SELECT mmsi, ship_name, latitude, longitude, cog, sog, heading, epoch_s FROM vp", rounded=("latitude", "longitude"))  # K1
def write_positions(spark, sf):
    path = work_path(spark, "positions")
    W.write_positions(positions(spark, sf), path)
    return spark.read.parquet(path).select("mmsi", "ship_name", "latitude", "longitude", "cog", "sog", "heading", epoch())


@query(  # K3
    "write_encounters", ENCOUNTERS + " SELECT mmsi_a, mmsi_b, epoch_s, round(cpa, 6) AS cpa, true AS is_active FROM enc"
)
def write_encounters(spark, sf):
    path = work_path(spark, "encounters")
    W.write_encounters(encounters(spark, sf), path)
    return spark.read.parquet(path).select("mmsi_a", "mmsi_b", epoch(), *r6("cpa"), "is_active")


@query(  # K2
    "write_static", STATICS + f" SELECT mmsi, ship_name, {DIMS}, 1704067140 AS updated_s FROM st"
)
def write_static(spark, sf):
    path = work_path(spark, "static")
    W.write_static(P.project_static(X.vessel_static(spark, sf), now()), path)
    return spark.read.parquet(path).select("mmsi", "ship_name", *DIMS.split(", "), epoch("update_time", "updated_s"))


@query("static_snapshot", NEWEST_STATIC + f" SELECT mmsi, ship_name, {DIMS} FROM snap")  # K4, S5: two batches
def static_snapshot(spark, sf):
    path = work_path(spark, "snapshot")
    statics = X.vessel_static(spark, sf)
    split = F.col("epoch_s") < 1704070800
    W.write_static_snapshot(statics.where(split), path, 1)
    return W.write_static_snapshot(statics.where(~split), path, 2)


@query(  # K5, S2: messages out and in again
    "publish_messages",
    " SELECT mmsi, ship_name, latitude, longitude, cog, sog, heading, epoch_s, dim_a, dim_b, dim_c, dim_d, 'none' AS geohash FROM vp", rounded=("latitude", "longitude"),
)
def publish_messages(spark, sf):
    path = work_path(spark, "messages")
    W.publish_messages(positions(spark, sf), path)
    back = P.parse_message(R.read_messages(spark, path, stream=False))
    return back.withColumn("epoch_s", F.unix_timestamp("timestamp")).drop("timestamp")


def _documents(spark, sf):
    path = work_path(spark, "scenarios")
    W.write_scenarios(H.scenario_documents(H.build_scenarios(encounters(spark, sf), positions(spark, sf))), path)
    return path


@query(  # K6, S7: what is read back, one row per document, frame and ship
    "history_documents",
    FOCUS + LABELS + """ SELECT parent.scenario_id, concat_ws('_', f.mmsi_a, f.mmsi_b, strftime(make_timestamp(f.t * 1000000), '%Y%m%d%H%M%S')) AS collision_id,
      f.frame_s, f.delta_minutes, round(f.focus_dist, 6) AS focus_dist, x.mmsi, l.name, l.ship_length,
      round(x.latitude, 6) AS lat, round(x.longitude, 6) AS lon, round(x.sog, 6) AS sog, round(x.cog, 6) AS cog
    FROM focus f JOIN parent ON parent.h = f.h AND parent.component = f.component
    JOIN fill x ON x.h = f.h AND x.component = f.component AND x.t = f.t AND x.frame_s = f.frame_s
    JOIN lab l ON l.h = x.h AND l.component = x.component AND l.t = x.t AND l.mmsi = x.mmsi, range(0, f.copies)""",
)
def history_documents(spark, sf):
    children = R.read_history(spark, _documents(spark, sf)).where("not _parent")
    frames = children.select("scenario_id", "collision_id", F.explode("frames").alias("f")).select("scenario_id", "collision_id", "f.*")
    ships = frames.withColumn("s", F.explode("shipPositions"))
    return ships.select(
        "scenario_id", "collision_id", F.unix_timestamp(F.to_timestamp("time")).alias("frame_s"), "delta_minutes", *r6("focus_dist"),
        "s.mmsi", "s.name", "s.ship_length", *[F.round(f"s.{c}", 6).alias(c) for c in ("lat", "lon", "sog", "cog")],
    )


@query(  # K6, S7: the parents of the documents
    "history_parents", COMPONENTS + " SELECT scenario_id, n_ships, collisions_count, min_s, max_s FROM parent"
)
def history_parents(spark, sf):
    parents = R.read_history(spark, _documents(spark, sf)).where("_parent")
    times = [F.unix_timestamp(F.to_timestamp(c)).alias(n) for c, n in (("min_ts", "min_s"), ("max_ts", "max_s"))]
    return parents.select("scenario_id", F.size("ships_involved").cast("long").alias("n_ships"), "collisions_count", *times)


@query(  # S6
    "list_history",
    COMPONENTS + """ SELECT DISTINCT concat('multiship_', strftime(make_timestamp(h * 3600 * 1000000), '%Y%m%d_%H')) AS name,
      true AS filled FROM placed""",
)
def list_history(spark, sf):
    files = R.list_history(spark, _documents(spark, sf))
    return files.select("name", ((F.col("size") > 0) & F.col("updated").isNotNull()).alias("filled"))


@query("ensure_table", " SELECT mmsi, ship_name, epoch_s FROM vp")  # K7
def ensure_table(spark, sf):
    path = work_path(spark, "table")
    name = "t_" + path.rsplit("-", 1)[1]
    assert W.ensure_table(spark, name, S.POSITIONS, path) and not W.ensure_table(spark, name, S.POSITIONS, path)
    columns = S.POSITIONS.fieldNames()
    rows = positions(spark, sf).select(*columns, F.to_date("timestamp").alias("event_date"))
    rows.write.insertInto(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay where they are
    return spark.read.parquet(path).select("mmsi", "ship_name", epoch())


@query(  # K8: day partitions that ended before the retention limit are dropped
    "drop_expired",
    " SELECT mmsi, epoch_s FROM vp WHERE epoch_s // 86400 * 86400 > 1704067200 - 86400",
)
def drop_expired(spark, sf):
    path = work_path(spark, "expiring")
    vp = positions(spark, sf)
    # each report once more, as long before 29 December as it lies after New Year: expired, whatever the table spans
    old = vp.withColumn("timestamp", F.timestamp_seconds(2 * 1704067200 - 3 * 86400 - F.col("epoch_s")))
    W.write_positions(vp.unionByName(old), path)
    W.drop_expired(spark, path, 3600, F.timestamp_seconds(F.lit(1704067200)))
    return spark.read.parquet(path).select("mmsi", epoch())


