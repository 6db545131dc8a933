"""Queries that run a stream over the derived tables to its end and give its output
(ST1–ST10). The input is written as files in time order; the stream reads them one
batch at a time. The SQL states the batch meaning of each job."""

from pyspark.sql import functions as F

from seawake import config as C
from seawake import fixtures as X
from seawake import schema as S
from seawake.checks.live import TRACK, _track, positions
from seawake.checks.messages import DIMS, INGESTED, MESSAGES, NEWEST_STATIC, STATICS
from seawake.checks.registry import ENCOUNTERS, LIVE, epoch, query, r6
from seawake.operators import parse as P
from seawake.session import child_names, work_path
from seawake.sinks import tables as W
from seawake.sources import files as R
from seawake.streaming import jobs as J

def stream_of(spark, df, name, at="timestamp"):
    """A stream over ``df`` that reads two time-ordered parts in two batches, and a
    folder for its outputs."""
    home = work_path(spark, name)
    first, last = df.agg(F.min(F.unix_timestamp(at)), F.max(F.unix_timestamp(at))).first()
    early = F.unix_timestamp(at) < (first + last) // 2
    df.where(early).write.parquet(f"{home}/in")
    files = [n for n in child_names(spark, f"{home}/in") if n.endswith(".parquet")]
    df.where(~early).write.mode("append").parquet(f"{home}/in")
    schema = spark.read.parquet(f"{home}/in").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, len(files)))
    return reader.parquet(f"{home}/in"), home


def done(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def to_files(df, home, mode="append"):
    done(
        df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{home}/c")
        .trigger(availableNow=True).start(f"{home}/out")
    )
    return df.sparkSession.read.parquet(f"{home}/out")


@query(  # ST1, ST2: windows that have closed by the last event
    "windowed_stream",
    """ SELECT mmsi, w * 10 AS window_s, epoch_s FROM (
      SELECT *, epoch_s // 10 AS w, row_number() OVER (PARTITION BY mmsi, epoch_s // 10 ORDER BY epoch_s DESC) AS rn FROM vp)
    WHERE rn = 1 AND w * 10 + 10 <= (SELECT max(epoch_s) FROM vp)""",
)
def windowed_stream(spark, sf):
    stream, home = stream_of(spark, positions(spark, sf), "windowed")
    out = to_files(J.latest_per_window(stream, delay="0 seconds"), home)
    return out.select("mmsi", epoch("window_start", "window_s"), epoch())


@query(  # ST3 (J1 on a stream)
    "enrich_stream",
    STATICS + f""" SELECT p.mmsi, p.epoch_s, coalesce(s.ship_name, 'Unknown') AS ship_name, {", ".join("s." + d for d in DIMS.split(", "))}
    FROM vp p ASOF LEFT JOIN st s ON p.mmsi = s.mmsi AND p.epoch_s >= s.epoch_s""",
)
def enrich_stream(spark, sf):
    statics = X.vessel_static(spark, sf).withColumn("is_static", F.lit(True))
    bare = positions(spark, sf).drop("ship_name", *S.DIMS)
    stream, home = stream_of(spark, bare.unionByName(statics, allowMissingColumns=True), "enrich")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{home}/out/batch_id={batch_id}")

    done(J.enrich_stream(stream.where("is_static is null").drop("is_static"), stream.where("is_static"), f"{home}/facts", f"{home}/c", write, J.ONCE))
    return spark.read.parquet(f"{home}/out").select("mmsi", epoch(), "ship_name", *S.DIMS)


@query(  # ST4, ST9: tracks from the stream's own history
    "refresh_stream", TRACK + " SELECT mmsi, step, latitude, longitude, epoch_s, r68, r95, r99 FROM trk"
)
def refresh_stream(spark, sf):
    stream, home = stream_of(spark, positions(spark, sf), "refresh")
    done(J.refresh_stream(stream, f"{home}/state", f"{home}/c", trigger=J.ONCE))
    return _track(J.read_state(spark, f"{home}/state/tracks"))


@query(  # ST5 (K4 on a stream)
    "snapshot_stream", NEWEST_STATIC + f" SELECT mmsi, ship_name, {DIMS} FROM snap"
)
def snapshot_stream(spark, sf):
    stream, home = stream_of(spark, X.vessel_static(spark, sf), "snapshot")
    done(J.snapshot_stream(stream, f"{home}/snapshot", f"{home}/c", trigger=J.ONCE))
    return R.read_static_snapshot(spark, f"{home}/snapshot")


FIRST_ROWS = f" SELECT DISTINCT mmsi, ship_name, {DIMS} FROM vp"  # the same for all rows of a ship


@query("first_per_ship_stream", FIRST_ROWS)  # ST6
def first_per_ship_stream(spark, sf):
    stream, home = stream_of(spark, positions(spark, sf), "first")
    return to_files(J.first_per_ship_stream(stream, forever=True), home).select("mmsi", "ship_name", *S.DIMS)


@query("first_per_ship_stream_bounded", FIRST_ROWS)  # ST6 with bounded state: no ship is silent for that long
def first_per_ship_stream_bounded(spark, sf):
    stream, home = stream_of(spark, positions(spark, sf), "first")
    return to_files(J.first_per_ship_stream(stream, delay="30 days"), home).select("mmsi", "ship_name", *S.DIMS)


@query(  # ST7 (J5 on a stream)
    "encounters_stream",
    ENCOUNTERS + """ SELECT mmsi_a, mmsi_b, epoch_s, round(cpa, 6) AS cpa, round(tcpa, 6) AS tcpa FROM enc
    WHERE epoch_s // 10 * 10 + 10 <= (SELECT max(epoch_s) FROM uw WHERE dim_a + dim_b > 50)""",
)
def encounters_stream(spark, sf):
    stream, home = stream_of(spark, P.under_way(positions(spark, sf)), "encounters")
    done(J.encounters_stream(stream, f"{home}/out", f"{home}/c", trigger=J.ONCE))
    return W.read_table(spark, f"{home}/out", S.ENCOUNTERS).select("mmsi_a", "mmsi_b", epoch(), *r6("cpa", "tcpa"))


@query(  # ST7 with its static side
    "encounters_stream_named",
    ENCOUNTERS + """ SELECT mmsi_a, mmsi_b, epoch_s,
      CASE WHEN ship_name_a = 'Unknown' THEN concat('N_', mmsi_a) ELSE ship_name_a END AS ship_name_a,
      CASE WHEN ship_name_b = 'Unknown' THEN concat('N_', mmsi_b) ELSE ship_name_b END AS ship_name_b FROM enc
    WHERE epoch_s // 10 * 10 + 10 <= (SELECT max(epoch_s) FROM uw WHERE dim_a + dim_b > 50)""",
)
def encounters_stream_named(spark, sf):
    rows = positions(spark, sf)
    stream, home = stream_of(spark, P.under_way(rows), "named")
    known = rows.groupBy("mmsi").agg(*[F.max(d).alias(d) for d in S.DIMS], F.max("timestamp").alias("update_time"))
    W.write_static(known.withColumn("ship_name", F.concat(F.lit("N_"), F.col("mmsi").cast("string"))), f"{home}/static")
    done(J.encounters_stream(stream, f"{home}/out", f"{home}/c", trigger=J.ONCE, statics_path=f"{home}/static"))
    return W.read_table(spark, f"{home}/out", S.ENCOUNTERS).select("mmsi_a", "mmsi_b", epoch(), "ship_name_a", "ship_name_b")


@query(  # K2, ST6: newest per window, first per ship, appended
    "static_table_stream",
    f""", closed AS (SELECT *, epoch_s // {C.STATIC_WINDOW_S} AS w FROM vp)
    SELECT mmsi, ship_name, {DIMS}, epoch_s FROM (
      SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY w, epoch_s DESC) AS rn FROM closed
      WHERE (w + 1) * {C.STATIC_WINDOW_S} <= (SELECT max(epoch_s) FROM vp)) WHERE rn = 1""",
)
def static_table_stream(spark, sf):
    stream, home = stream_of(spark, positions(spark, sf), "static")
    done(J.static_table_stream(stream, f"{home}/out", f"{home}/c", trigger=J.ONCE))
    return spark.read.parquet(f"{home}/out").select("mmsi", "ship_name", *S.DIMS, epoch("update_time"))


@query(  # ST8 (A9, J4 once per batch)
    "latest_state_stream", LIVE + " SELECT id, round(cpa, 6) AS cpa, round(tcpa, 6) AS tcpa FROM live"
)
def latest_state_stream(spark, sf):
    stream, home = stream_of(spark, positions(spark, sf), "latest")
    done(J.latest_state_stream(stream, f"{home}/state", f"{home}/c", trigger=J.ONCE))
    return J.read_state(spark, f"{home}/state/encounters").select("id", *r6("cpa", "tcpa"))


@query(  # ST10: one queue, two branches; a ship's name comes from the snapshot of the same queue
    "messages_stream",
    MESSAGES + f""", told AS (SELECT mmsi, ship_name, {DIMS}, epoch_s FROM msg
      WHERE NOT (event_id % 17 = 0 AND (event_id // 17) % 3 = 2) AND event_id % 29 <> 3 AND event_id % 31 <> 4 AND event_id % 37 <> 5
        AND lower(trim(ship_name)) <> 'unknown' AND dim_a IS NOT NULL)
    , snap AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY epoch_s DESC) = 1)
    SELECT 'positions' AS branch, g.mmsi, g.epoch_s,
      CASE WHEN g.ship_name IS NULL OR lower(trim(g.ship_name)) = 'unknown' THEN coalesce(s.ship_name, g.ship_name) ELSE g.ship_name END AS ship_name, NULL::DOUBLE AS dim_a
    FROM good g LEFT JOIN snap s USING (mmsi) UNION ALL SELECT 'snapshot', mmsi, NULL, ship_name, dim_a FROM snap""",
)
def messages_stream(spark, sf):
    home = work_path(spark, "messages")
    X.messages(spark, sf).select("value").write.text(f"{home}/in")
    stream = R.read_messages(spark, f"{home}/in")
    done(J.messages_stream(stream, f"{home}/positions", f"{home}/snapshot", f"{home}/c", trigger=J.ONCE))
    stored = W.read_table(spark, f"{home}/positions", S.POSITIONS)
    ships = R.read_static_snapshot(spark, f"{home}/snapshot")
    return stored.select(F.lit("positions").alias("branch"), "mmsi", epoch(), "ship_name", F.lit(None).cast("double").alias("dim_a")).unionAll(
        ships.select(F.lit("snapshot"), "mmsi", F.lit(None).cast("long"), "ship_name", "dim_a")
    )


def _live_table(spark, sf, batches=6):
    """A table of positions as a stream leaves it: a segment per batch."""
    vp, path = positions(spark, sf), work_path(spark, "live")
    first, last = vp.agg(F.min("epoch_s"), F.max("epoch_s")).first()
    step = (last - first) // batches + 1
    for k in range(batches):
        W.write_positions(vp.where(F.floor((F.col("epoch_s") - first) / step) == k), path, k)
    return path, last


@query(  # K1: segments of a stream's table merged by ship, a part of it read
    "compact_positions",
    " SELECT mmsi, epoch_s, ship_name, heading FROM vp WHERE epoch_s >= (SELECT max(epoch_s) - 5000 FROM vp)",
)
def compact_positions(spark, sf):
    path, last = _live_table(spark, sf)
    before = W.read_table(spark, path, S.POSITIONS).count()
    gone, merged = W.maintain(spark, path, S.POSITIONS)
    assert (gone, merged) == (0, 6) and W.read_table(spark, path, S.POSITIONS).count() == before
    return W.read_table(spark, path, S.POSITIONS, low=(last - 5000) * 1_000_000).select("mmsi", epoch(), "ship_name", "heading")


@query(  # K8: rows older than 10 minutes are gone from the files, by the spans in the manifest
    "expire_rows", " SELECT mmsi, epoch_s FROM vp WHERE epoch_s >= (SELECT max(epoch_s) - 600 FROM vp)"
)
def expire_rows(spark, sf):
    path, last = _live_table(spark, sf)
    W.maintain(spark, path, S.POSITIONS, C.ENCOUNTERS_TTL_S, last * 1_000_000, keep=0, keep_s=-1)
    return spark.read.schema(S.POSITIONS).option("recursiveFileLookup", True).parquet(f"{path}/data").select("mmsi", epoch())


@query(  # S1, K5: feed files to published messages, through the keyed state
    "feed_stream",
    INGESTED, rounded=("latitude", "longitude"),
)
def feed_stream(spark, sf):
    home = work_path(spark, "feed")
    X.envelopes(spark, sf).write.text(f"{home}/in")
    now = F.timestamp_seconds(F.lit(1704067140))
    done(J.ingest_stream(R.read_feed(spark, f"{home}/in"), f"{home}/out", f"{home}/c", now, trigger=J.ONCE))
    back = P.parse_message(spark.read.text(f"{home}/out").select("value"))
    return back.select("mmsi", "latitude", "longitude", "sog", "cog", "heading", epoch(), "ship_name", *S.DIMS)

