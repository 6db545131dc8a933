"""Streaming jobs. Batch operators run inside ``foreachBatch``, so a stream and a batch
over the same rows give the same result; batch ids make every write repeatable."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from seawake import config as C
from seawake import schema as S
from seawake.operators import encounters as E
from seawake.operators import enrich as N
from seawake.operators import parse as P
from seawake.operators import tracks as K
from seawake.operators import views as V
from seawake.operators.series import newest, recent, tumbling
from seawake.session import broadcast_if_small, path_exists
from seawake.sinks import segments as G
from seawake.sinks import tables as W
from seawake.sources.files import read_static_snapshot, snapshot_versions
from seawake.streaming.state import with_facts

ONCE = {"availableNow": True}


def _start(
    stream: DataFrame,
    checkpoint: str,
    each: Callable[[DataFrame, int], None],
    trigger: dict | None,
    mode: str = "append",
    keep: bool = True,
) -> StreamingQuery:
    """Runs ``each`` per batch. If it reads the batch more than once, the batch is kept
    meanwhile: keyed state is then worked through once per batch."""

    def kept(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            each(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(kept if keep else each).outputMode(mode).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()


# --- windows, late rows, de-duplication --------------------------------------
def with_lateness(stream: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Rows older than the newest event time less ``delay`` are discarded by the
    windows and joins that follow."""
    return stream.withWatermark("timestamp", delay)


def latest_per_window(stream: DataFrame, seconds: int = C.ENCOUNTER_WINDOW_S, delay: str = "0 seconds") -> DataFrame:
    """Newest row of each ship in each closed event-time window."""
    rest = [c for c in E.STATE if c not in ("mmsi", "timestamp", "latitude", "longitude")]
    return (
        with_lateness(stream, delay)
        .groupBy(F.window("timestamp", f"{seconds} seconds").alias("_w"), "mmsi")
        .agg(F.max(F.struct("timestamp", "latitude", "longitude", *rest)).alias("_row"))
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "mmsi", "_row.*")
    )


def latest_static_stream(stream: DataFrame, seconds: int = C.STATIC_WINDOW_S, delay: str = "0 seconds") -> DataFrame:
    """Newest static row of each ship in each closed window."""
    return (
        with_lateness(P.has_dimensions(stream), delay)
        .groupBy(F.window("timestamp", f"{seconds} seconds").alias("_w"), "mmsi")
        .agg(F.max(F.struct("timestamp", "ship_name", *S.DIMS)).alias("_row"))
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "mmsi", "_row.*")
    )


def first_per_ship_stream(stream: DataFrame, delay: str = "1 hour", forever: bool = False) -> DataFrame:
    """First static row per ship. By default a ship is remembered for ``delay`` of event
    time, which bounds the state; ``forever`` remembers every ship for good."""
    if forever:
        return stream.dropDuplicates(["mmsi"])
    return with_lateness(stream, delay).dropDuplicatesWithinWatermark(["mmsi"])


# --- encounters --------------------------------------------------------------
def encounters_stream(
    positions: DataFrame,
    path: str,
    checkpoint: str,
    seconds: int = C.ENCOUNTER_WINDOW_S,
    delay: str = "0 seconds",
    trigger: dict | None = None,
    statics_path: str | None = None,
    **limits,
) -> StreamingQuery:
    """Appends the encounters of each closed window to the table at ``path``.

    A window closes in exactly one micro-batch, which therefore holds all of its ships.
    Unknown names are filled from the static table at ``statics_path``, as it is when the
    batch runs: one row per ship, the earliest.
    """
    closed = latest_per_window(P.long_enough(positions), seconds, delay)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if statics_path is not None and path_exists(spark, statics_path):
            table = spark.read.schema("mmsi long, ship_name string, update_time timestamp").parquet(statics_path)
            known = newest(table, ["mmsi"], ["update_time"], oldest=True)
            batch = N.fill_names(batch, known, stored=False)
        W.write_encounters(E.encounters_among(batch, ["window_start", "window_end"], **limits), path, batch_id)

    return _start(closed, checkpoint, each, trigger)


#: A ship's first static row while its window is open.
WAITING = T.StructType([*S.STATIC.fields[:-1], *[T.StructField(n, T.TimestampType()) for n in ("timestamp", "window_start", "window_end")]])


def _with_ticks(stream: DataFrame) -> DataFrame:
    """The rows of a stream with a watermark, ``_tick`` false, and beside them a row per hour that has
    closed. Nobody reads these: a stream that keeps state has one batch more when its watermark
    has moved and no rows come, in which windows close."""
    hours = stream.groupBy(F.window("timestamp", "1 hour")).agg(F.count("*").alias("n"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    return stream.withColumn("_tick", F.lit(False)).unionByName(hours.select(*nothing, F.lit(True).alias("_tick")))


def static_table_stream(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    seconds: int = C.STATIC_WINDOW_S,
    delay: str = "0 seconds",
    trigger: dict | None = None,
    waiting: str | None = None,
) -> StreamingQuery:
    """Appends a static row for every ship that the table at ``path`` does not have yet: the newest
    of its first window, when that has closed.

    A batch is reduced to a row per ship where it is read, so a ship that sends very much is
    combined there. What is remembered, in ``waiting``, beside the checkpoint by default, is a
    row per ship whose first window is open, not one per ship and window. Windows close as in
    Spark's own aggregations: those that end ``delay`` before the newest time of the batches
    before, and rows of windows that had closed by the batch before that are late.
    """
    folder = waiting or f"{checkpoint.rstrip('/')}-waiting"
    row = ["timestamp", "ship_name", *S.DIMS]
    # the first field is greatest for the earliest window; within it the newest row is
    first = F.max(F.struct(-F.unix_micros("window_start"), *row, "window_start", "window_end")).alias("_row")

    def ended(us: int) -> Column:
        return F.col("window_end") <= F.timestamp_micros(F.lit(us)) - F.expr(f"INTERVAL {delay}")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = G.segments_of(spark, folder, before=batch_id)
        before, newest_time = (known[0].low, known[0].high) if known else (None, None)
        rows = tumbling(batch.where("NOT _tick").drop("_tick"), seconds)
        rows = rows if before is None or before < 0 else rows.where(~ended(before))
        found = rows.groupBy("mmsi").agg(first, F.max("timestamp").alias("_last")).persist()
        try:
            last = found.agg(F.max(F.unix_micros("_last"))).first()[0]
            ships = found.select("mmsi", "_row.*").select(WAITING.fieldNames())
            if known and known[0].rows:
                both = ships.union(G.read_segments(spark, folder, known, WAITING))
                ships = both.groupBy("mmsi").agg(first).select("mmsi", "_row.*").select(WAITING.fieldNames())
            if path_exists(spark, path):
                table = spark.read.schema("mmsi long, batch_id long").parquet(path)  # a first batch may have left it without rows
                others = table.where(~F.col("batch_id").eqNullSafe(batch_id)).select("mmsi").distinct()
                ships = ships.join(others, "mmsi", "left_anti")
            closed = F.lit(False) if newest_time is None else ended(newest_time)
            W.write_static(P.project_static(ships.where(closed), F.col("timestamp")), path, batch_id)
            latest = max((t for t in (newest_time, last) if t is not None), default=None)
            if latest is not None:
                held = G.append_segment(ships.where(~closed), folder, batch_id, "timestamp", ["mmsi"]) or [G.Segment(f"{G.DATA}/{batch_id:012d}", -1, -1, -1, 0)]
                # of the span only the times up to this batch and the one before are of use
                G.commit(spark, folder, batch_id, [held[0]._replace(low=-1 if newest_time is None else newest_time, high=latest)])
        finally:
            found.unpersist()

    stream = with_lateness(P.has_dimensions(messages).select("mmsi", *row), delay)
    return _start(_with_ticks(stream), checkpoint, each, trigger, keep=False)


def enrich_stream(
    positions: DataFrame,
    statics: DataFrame,
    facts: str,
    checkpoint: str,
    write: Callable[[DataFrame, int], None],
    trigger: dict | None = None,
) -> StreamingQuery:
    """Streaming :func:`seawake.operators.enrich.enrich_asof`: ``write`` gets each batch of
    positions with the static data known at their times. ``facts`` is the folder of what is
    remembered of all ships."""
    fields = ["mmsi", "timestamp", "ship_name", *S.DIMS]
    bare = positions.drop("ship_name", *S.DIMS)
    both = bare.withColumn("_static", F.lit(False)).unionByName(statics.select(*fields, F.lit(True).alias("_static")), allowMissingColumns=True)

    def each(batch: DataFrame, batch_id: int) -> None:
        write(with_facts(batch.where("NOT _static").select(bare.columns), batch.where("_static").select(fields), facts, batch_id), batch_id)

    return _start(both, checkpoint, each, trigger)


def ingest_stream(
    feed: DataFrame,
    path: str | None,
    checkpoint: str,
    ingest_time: Column | None = None,
    boxes=None,
    trigger: dict | None = None,
    facts: str | None = None,
    fmt: str = "text",
    **options,
) -> StreamingQuery:
    """Feed to published messages: routed, valid, under way, with the ship's last static data.

    A folder gets a part per batch, which a repeated batch replaces; a queue (``fmt`` and its
    options) gets the messages of a repeated batch again. ``facts`` is where static data is
    remembered, beside the checkpoint by default.
    """
    reports, statics = P.route_by_type(feed)
    positions = P.valid_coordinate(P.under_way(P.flatten_position(reports, ingest_time)))
    if boxes is not None:
        positions = P.in_boxes(positions, boxes)

    def write(messages: DataFrame, batch_id: int) -> None:
        W.publish_batch(messages, path, batch_id, fmt, **options)

    return enrich_stream(positions, P.flatten_static(statics, ingest_time), facts or f"{checkpoint.rstrip('/')}-facts", checkpoint, write, trigger)


# --- static snapshot ---------------------------------------------------------
def snapshot_stream(statics: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Merges new static rows into the versioned snapshot every ten minutes."""

    def each(batch: DataFrame, batch_id: int) -> None:
        W.write_static_snapshot(batch, path, batch_id)

    return _start(statics, checkpoint, each, trigger or {"processingTime": f"{C.SNAPSHOT_WINDOW_S} seconds"})


def messages_stream(
    messages: DataFrame,
    positions_path: str,
    snapshot_path: str,
    checkpoint: str,
    trigger: dict | None = None,
    refresh_names: bool = True,
) -> StreamingQuery:
    """One queue, two branches: the snapshot merge and the named positions table.

    Names come from the newest snapshot at each
    batch; with ``refresh_names=False`` from the one that was there at the start.
    """
    spark = messages.sparkSession
    fixed = None if refresh_names else max(snapshot_versions(spark, snapshot_path), default=-1) + 1

    def each(batch: DataFrame, batch_id: int) -> None:
        W.write_static_snapshot(P.parse_static(batch), snapshot_path, batch_id)
        names = read_static_snapshot(spark, snapshot_path, before=fixed)
        W.write_positions(N.fill_names(P.parse_positions(batch), names), positions_path, batch_id)

    return _start(messages, checkpoint, each, trigger)


# --- latest state and periodic refresh ---------------------------------------
def _stored_state(spark, folder: str) -> DataFrame | None:
    folders = [f"{folder}/{s.folder}" for s in G.segments_of(spark, folder) if s.rows]
    return spark.read.parquet(*folders) if folders else None


def read_state(spark, folder: str) -> DataFrame | None:
    """The newest version of a state table, or None where there are no rows yet; encounters are
    made of the states of their ships that are kept."""
    rows = _stored_state(spark, folder)
    return E.encounters_of(rows) if rows is not None and "mmsi_v" in rows.columns else rows


def _table(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])


def _by_cell(meetings: DataFrame) -> DataFrame:
    """Meetings with the bucket of their cell: the join that finds them has few cells in a task."""
    return meetings.withColumn(G.BUCKET, G.bucket_of(*E.CELL)).drop(*E.CELL)


def update_encounters(ships: DataFrame, changed: DataFrame, path: str, version: int) -> list[G.Segment]:
    """Brings the encounters up to date after some ships have changed: only pairs of a changed
    ship are dropped, and only such pairs are looked for. ``ships`` is the new state of all,
    ``changed`` (mmsi) has no repeats.

    There may be very many pairs, so they do not move: new ones are written, once, by the tasks
    that find them, as segments beside the known ones. Known buckets that have lost a pair, or
    that consist of many segments, are written anew by the tasks that read them.
    """
    spark, ids = ships.sparkSession, broadcast_if_small(changed, C.BROADCAST_IDS)
    blocks = E.blocks_live(ships, changed=changed).persist()
    try:
        known, met = G.segments_of(spark, path, before=version), _by_cell(E.meetings_of(blocks))
        schema = _table(met.drop(G.BUCKET))
        new = G.write_segments(met, path, version, dealt=True)
    finally:
        blocks.unpersist()
    held = Counter(s.bucket for s in known)
    worn = {b for b, n in held.items() if n >= C.BUCKET_SEGMENTS}
    if known:
        pairs = G.read_segments(spark, path, known, schema).select("mmsi_v", "mmsi_h", G.bucket_here().alias(G.BUCKET))
        hit = [pairs.join(ids.withColumnRenamed("mmsi", f"mmsi_{side}"), f"mmsi_{side}", "left_semi").select(G.BUCKET) for side in "vh"]
        worn |= {r[0] for r in hit[0].union(hit[1]).distinct().collect()}  # at most a number per bucket
    if worn:
        rest = G.read_segments(spark, path, [s for s in known if s.bucket in worn], schema).withColumn(G.BUCKET, G.bucket_here())
        for side in "vh":
            rest = rest.join(ids.withColumnRenamed("mmsi", f"mmsi_{side}"), f"mmsi_{side}", "left_anti")
        new = new + G.write_segments(rest, path, version, part="-rest", dealt=True)
    if new or worn:
        G.commit(spark, path, version, [s for s in known if s.bucket not in worn] + new)
    return new


def latest_state_stream(
    positions: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None, ships_held: int | None = None
) -> StreamingQuery:
    """Upserts the latest state per ship and keeps the encounters among them, table ``ships``
    and ``encounters`` of ``folder``. A batch writes the buckets of its ships, and only they
    are paired anew. ``ships_held=100`` keeps encounters of the newest hundred ships alone, as
    the serving view does; these few are paired as a whole."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, _table(batch)
        rows = newest(batch.where("mmsi IS NOT NULL"), ["mmsi"], ["timestamp"]).persist()
        try:
            def merge(known: DataFrame, new: DataFrame) -> DataFrame:
                return newest(known.unionByName(new), ["mmsi"], ["timestamp"])

            G.upsert(rows, f"{folder}/ships", batch_id, schema, merge, ["mmsi"])
            ships = G.read_newest(spark, f"{folder}/ships", schema, before=batch_id + 1)
            if ships_held is None:
                update_encounters(ships, rows.select("mmsi"), f"{folder}/encounters", batch_id)
            else:
                met = _by_cell(E.meetings_live(K.most_recent(ships, ships_held)))
                G.commit(spark, f"{folder}/encounters", batch_id, G.write_segments(met, f"{folder}/encounters", batch_id, dealt=True))
        finally:
            rows.unpersist()

    return _start(positions, checkpoint, each, trigger)


MOVE = ("latitude", "longitude", "sog", "cog")


def instants(batch: DataFrame) -> DataFrame:
    """``(mmsi, timestamp, n, state)``: reports of one instant counted together, the greatest kept."""
    return batch.groupBy("mmsi", "timestamp").agg(F.count("*").alias("n"), F.max(F.struct(*MOVE)).alias("state"))


def recent_history(rows: DataFrame, minutes: int = C.HISTORY_MINUTES) -> DataFrame:
    """Instants of several batches: each ship's of the last ``minutes`` before its newest one."""
    return recent(rows.groupBy("mmsi", "timestamp").agg(F.sum("n").alias("n"), F.max("state").alias("state")), minutes)


def current_of(history: DataFrame) -> DataFrame:
    """Newest state and number of reports of each ship in its history."""
    found = history.groupBy("mmsi").agg(F.max(F.struct("timestamp", "state")).alias("_s"), F.sum("n").alias("n_points"))
    return found.select("mmsi", "_s.timestamp", "_s.state.*", "n_points")


def add_history(rows: DataFrame, path: str, version: int, minutes: int = C.HISTORY_MINUTES, fold: int = 16) -> DataFrame:
    """Appends the instants of a batch as a segment of the history and returns the whole history.

    A segment is dropped whole once its last row is older than ``minutes`` before the newest
    report; ``fold`` of them at a time, as ships that have been silent since keep their last
    reports: these few rows are carried into one segment.
    """
    spark, schema = rows.sparkSession, _table(rows)
    known = G.segments_of(spark, path, before=version)
    new = G.append_segment(rows, path, version, "timestamp", ["mmsi", "timestamp"])
    live = known + new
    limit = max((s.high for s in live), default=0) - minutes * 60_000_000
    old = [s for s in live if s.high < limit]
    if len(old) >= fold:
        newest_of = G.read_segments(spark, path, live, schema).groupBy("mmsi").agg(F.max("timestamp").alias("_latest"))
        since = F.col("_latest") - F.expr(f"INTERVAL {minutes} MINUTES")
        kept = G.read_segments(spark, path, old, schema).join(newest_of, "mmsi").where(F.col("timestamp") >= since)
        live = [s for s in live if s not in old] + G.append_segment(kept.select(rows.columns), path, version, "timestamp", ["mmsi", "timestamp"], "-carried")
    G.commit(spark, path, version, live)
    return G.read_segments(spark, path, live, schema)


def refresh_stream(positions: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Renews predicted tracks and risks every fifteen seconds: tracks of the ships that have
    reported, from the stream's own recent history, and risks of the encounters that
    latest_state_stream has found since, in tables of ``folder``. A batch appends its own
    reports; nothing that has not changed is written again."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = instants(batch.where("mmsi IS NOT NULL AND timestamp IS NOT NULL")).persist()
        try:
            history = add_history(rows, f"{folder}/history", batch_id)
            ids = broadcast_if_small(rows.select("mmsi").distinct())
            tracks = K.project_track(current_of(recent_history(history.join(ids, "mmsi", "left_semi"))))

            def merge(known: DataFrame, new: DataFrame) -> DataFrame:
                return known.join(ids, "mmsi", "left_anti").select(new.columns).union(new)

            G.upsert(tracks, f"{folder}/tracks", batch_id, _table(tracks), merge, ["mmsi"], also=G.buckets_of(rows, "mmsi"))
            met = _stored_state(spark, f"{folder}/encounters")
            if met is not None:
                def assessed(pairs: DataFrame) -> DataFrame:
                    return V.assess_risk(E.encounters_of(pairs, carry=(G.BUCKET,)), carry=(G.BUCKET,))

                G.derive(spark, f"{folder}/encounters", _table(met), f"{folder}/risks", batch_id, assessed)
        finally:
            rows.unpersist()

    return _start(positions, checkpoint, each, trigger or {"processingTime": f"{C.REFRESH_S} seconds"})
