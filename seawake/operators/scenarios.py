"""Replay scenarios: encounters of an hour grouped into connected scenarios, with
resampled and gap-filled frames around each encounter.

All hours of the input are built in one job: a scenario is a connected component of
the encounters of one hour, known inside by ``(hour, component)`` where component is
its smallest ship number. Frames depend only on the scenario and the encounter time,
so they are built once per ``(hour, component, t)`` and shared by the encounters of
that instant.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from seawake import config as C
from seawake.functions import display as D
from seawake.functions import geo
from seawake.operators.encounters import with_collision_id
from seawake.session import broadcast_if_small, cut_lineage

# What runs in Python workers travels to them whole, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCENARIO = ["hour", "component"]
MOMENT = [*SCENARIO, "t_us"]
ENCOUNTER = [*MOMENT, "mmsi_a", "mmsi_b"]
MICROS = 1_000_000


def _interval(seconds: int) -> Column:
    return F.make_dt_interval(secs=F.lit(float(seconds)))


# --- S3: encounters of a span of hours ---------------------------------------
def in_span(df: DataFrame, start: Column | None, end: Column | None, before_s: int = 0, after_s: int = 0) -> DataFrame:
    """Rows in ``[start - before, end + after)``; an open end is no bound. Plain
    comparisons on stored columns, so they reach the Parquet scan; a table that is
    partitioned by ``event_date`` is pruned as well."""
    ts, day = F.col("timestamp"), F.col("event_date")
    dated = "event_date" in df.columns
    if start is not None:
        first = start - _interval(before_s)
        df = df.where(ts >= first)
        df = df.where(day >= F.to_date(first)) if dated else df
    if end is not None:
        last = end + _interval(after_s)
        df = df.where(ts < last)
        df = df.where(day <= F.to_date(last)) if dated else df
    return df


def read_encounters(
    encounters: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    max_cpa: float = C.HISTORY_MAX_CPA_NM,
    tcpa: tuple[float, float] = C.HISTORY_TCPA_MIN,
) -> DataFrame:
    """Close encounters in ``[start, end)`` with ``collision_id``."""
    close = (F.col("cpa") < max_cpa) & F.col("tcpa").between(*tcpa)
    return with_collision_id(in_span(encounters.where(close), start, end))


def with_hour(encounters: DataFrame) -> DataFrame:
    return encounters.withColumn("hour", F.date_trunc("hour", "timestamp"))


# --- A6: connected components ------------------------------------------------
def connected_components(edges: DataFrame, by: list[str] = (), max_rounds: int = 60) -> DataFrame:
    """Component of each ship: ``(*by, mmsi, component)``, component = smallest ship number.

    Each task first joins what its own edges connect and passes on a star per part: a
    forest of at most one edge per node. Then two star contractions alternate until the
    edges no longer change: each node is linked to the smallest of its neighbourhood, first
    for the larger neighbours, then for the smaller ones. The smallest neighbour is a partial
    aggregation; it comes back by an equi-join, in which the edges of a hub that different
    tasks have passed on meet. Every round is checkpointed to the shared folder. Too many
    rounds raise; partial labels are never returned.
    """
    by = list(by)
    u, v = F.col("u"), F.col("v")
    ends = edges.select(*by, F.least("mmsi_a", "mmsi_b").cast("long").alias("v"), F.greatest("mmsi_a", "mmsi_b").cast("long").alias("u"))
    current, mark = _settled(ends.mapInArrow(_stars, ends.schema).distinct(), by)
    nodes = current.select(*by, u.alias("mmsi")).union(current.select(*by, v.alias("mmsi"))).distinct()
    for _ in range(max_rounds):
        both = current.where("u <> v").select(*by, "u", "v")
        both = both.union(both.select(*by, v.alias("u"), u.alias("v")))
        least = both.groupBy(*by, "u").agg(F.least(F.min("v"), u).alias("m"))
        wide = both.where("v > u").join(least, [*by, "u"]).select(*by, v.alias("u"), F.col("m").alias("v")).distinct()
        least = wide.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = (
            wide.join(least, [*by, "u"])
            .where("v <> m")
            .select(*by, v.alias("u"), F.col("m").alias("v"))
            .union(least.select(*by, "u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        before = mark
        current, mark = _settled(small, by)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(*by, u.alias("mmsi"), v.alias("component"))
    return nodes.join(roots, [*by, "mmsi"], "left").withColumn("component", F.coalesce("component", "mmsi"))


#: Edges that a task joins at a time.
EDGES_AT_ONCE = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``(*by, v, u)`` of a task as stars: each node with the smallest that it is connected
    to by the edges at hand; a node alone with itself."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= EDGES_AT_ONCE:
            yield from _joined(pa.Table.from_batches(held))
            held, size = [], 0
    if size:
        yield from _joined(pa.Table.from_batches(held))


def _joined(edges: pa.Table) -> Iterator[pa.RecordBatch]:
    group, table = np.zeros(len(edges), np.int64), edges.combine_chunks()
    for name in table.column_names[:-2]:
        codes = pa.compute.dictionary_encode(table.column(name).combine_chunks(), "encode").indices.to_numpy()
        group = np.unique(np.stack([group, codes]), axis=1, return_inverse=True)[1].ravel()
    v, u = (table.column(c).to_numpy() for c in table.column_names[-2:])
    both = np.concatenate([v, u])
    if group.any():
        nodes, where = np.unique(np.stack([np.tile(group, 2), both]), axis=1, return_inverse=True)
    else:
        nodes, where = np.unique(both, return_inverse=True)
        nodes = np.stack([np.zeros_like(nodes), nodes])
    a, b = where.ravel().reshape(2, -1)
    root, before = np.arange(nodes.shape[1]), None
    while before is None or not np.array_equal(before, root):
        before = root
        low, root = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
    row = np.zeros(len(root), np.int64)
    row[np.concatenate([a, b])] = np.tile(np.arange(len(a)), 2)
    kept = np.flatnonzero((root != np.arange(len(root))) | (np.bincount(root, minlength=len(root)) == 1))
    own = table.select(table.column_names[:-2]).take(pa.array(row[kept]))
    out = pa.table([*own.columns, pa.array(nodes[1][root[kept]]), pa.array(nodes[1][kept])], names=table.column_names)
    yield from out.to_batches()


def _settled(edges: DataFrame, by: list[str]) -> tuple[DataFrame, tuple]:
    """The checkpointed edges and a mark of them, observed while they are written."""
    h = F.xxhash64(*by, "u", "v")
    seen = Observation()
    watched = edges.observe(seen, F.count("*").alias("n"), F.sum(F.shiftright(h, 40)).alias("total"), F.bit_xor(h).alias("bits"))
    done = cut_lineage(watched)
    return done, tuple(seen.get[c] for c in ("n", "total", "bits"))


def scenario_members(encounters: DataFrame) -> DataFrame:
    """``(hour, component, mmsi)`` of all encounters with an ``hour`` column."""
    return connected_components(encounters.select("hour", "mmsi_a", "mmsi_b"), ["hour"]).select(*SCENARIO, "mmsi")


# --- J8, A7: scenarios -------------------------------------------------------
def edges_in_component(encounters: DataFrame, members: DataFrame) -> DataFrame:
    """Encounters with their component; both ends share it, so one end is looked up."""
    return encounters.join(members.withColumnRenamed("mmsi", "mmsi_a"), ["hour", "mmsi_a"])


def scenario_summary(encounters: DataFrame, members: DataFrame) -> DataFrame:
    """One row per scenario. ``encounters`` carry their component."""
    spans = encounters.groupBy(*SCENARIO).agg(
        F.count("*").alias("collisions_count"),
        F.min("timestamp").alias("min_ts"),
        F.max("timestamp").alias("max_ts"),
    )
    # the ship list is part of the result; members are distinct, so it is one fleet at most
    ships = members.groupBy(*SCENARIO).agg(F.sort_array(F.collect_list("mmsi")).alias("ships_involved"))
    sid = F.concat_ws(
        "_", F.lit("scenario"), F.unix_seconds("min_ts").cast("string"), F.array_join(F.col("ships_involved").cast("array<string>"), "_")
    )
    return spans.join(ships, SCENARIO).withColumn("scenario_id", sid)


# --- J6, A5, S4: positions around each encounter ------------------------------
def moments(encounters: DataFrame) -> DataFrame:
    """Distinct encounters as ``(hour, component, t_us, mmsi_a, mmsi_b)`` with ``copies``.

    Equal encounters have equal replays; they are built once and repeated at the end.
    """
    return (
        encounters.withColumn("t_us", F.unix_micros("timestamp"))
        .groupBy(*ENCOUNTER)
        .agg(F.count("*").alias("copies"))
    )


def _scenario_ships(moment_rows: DataFrame, members: DataFrame, salts: int = C.COMPONENT_SALTS) -> DataFrame:
    """Every ship of the scenario for every moment; salted, as one scenario may hold
    a large share of all encounters."""
    left = moment_rows.withColumn("_salt", F.pmod(F.xxhash64("t_us"), F.lit(salts)).cast("int"))
    right = members.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*SCENARIO, "_salt"]).drop("_salt")


def read_positions(positions: DataFrame, ships: DataFrame, start: Column, end: Column) -> DataFrame:
    """Positions of a set of ships with both ends of the time range included."""
    kept = positions.where(F.col("timestamp").between(start, end))
    return kept.join(ships.select("mmsi").distinct(), "mmsi", "left_semi")


def _bucket(us: Column) -> Column:
    return F.floor(us / (C.JOIN_BUCKET_S * MICROS)).cast("long")


def positions_for_encounters(
    moment_rows: DataFrame,
    members: DataFrame,
    positions: DataFrame,
    before_s: int = C.WIDE_BEFORE_S,
    after_s: int = C.WIDE_AFTER_S,
) -> DataFrame:
    """Positions of all ships of the scenario around each distinct moment.

    One range join for all encounters. Windows are cut into five-minute buckets and
    joined on ``(mmsi, bucket)``, which also spreads a ship that sends very much. The
    positions are shuffled once, on those keys: restricting them to needed buckets,
    removing repeats and the join itself share that partitioning. Before that the scan is
    bounded by the first and last moment, and rows of other ships are dropped.
    """
    span = moment_rows.agg(F.min("t_us"), F.max("t_us")).first()
    if span[0] is None:
        positions = positions.limit(0)
    else:
        low, high = (F.timestamp_micros(F.lit(us)) for us in (span[0] - before_s * MICROS, span[1] + after_s * MICROS + 1))
        positions = in_span(positions, low, high)
    ships = broadcast_if_small(members.select("mmsi").distinct())
    positions = positions.join(ships, "mmsi", "left_semi")
    windows = _scenario_ships(moment_rows.select(*MOMENT).distinct(), members)
    first, last = F.col("t_us") - before_s * MICROS, F.col("t_us") + after_s * MICROS
    windows = windows.withColumn("bucket", F.explode(F.sequence(_bucket(first), _bucket(last))))
    needed = windows.select("mmsi", "bucket").distinct()
    bucketed = positions.withColumn("ts_us", F.unix_micros("timestamp")).withColumn("bucket", _bucket(F.col("ts_us")))
    rows = dedupe_positions(bucketed.join(needed, ["mmsi", "bucket"], "left_semi"), ["mmsi", "bucket", "ts_us"])
    return windows.join(rows, ["mmsi", "bucket"]).where(F.col("ts_us").between(first, last)).drop("bucket")


def _length(positions: DataFrame) -> Column:
    """Ship length as the table has it: its own column, the dimensions, or none."""
    if "ship_length" in positions.columns:
        return F.col("ship_length")
    if {"dim_a", "dim_b"} <= set(positions.columns):
        return F.col("dim_a") + F.col("dim_b")
    return F.lit(None).cast("double")


def dedupe_positions(positions: DataFrame, keys: list[str] = ("mmsi", "timestamp")) -> DataFrame:
    """One row per ship, time, position, speed and course; greatest name and length."""
    return (
        positions.withColumn("ship_length", _length(positions))
        .groupBy(*keys, "latitude", "longitude", "sog", "cog")
        .agg(F.max("ship_name").alias("ship_name"), F.max("ship_length").alias("ship_length"))
    )


def lengths_from_static(tracks: DataFrame, statics: DataFrame) -> DataFrame:
    """Tracks whose unknown ship length (0) is filled from static rows, one per ship."""
    known = statics.select("mmsi", (F.col("dim_a") + F.col("dim_b")).alias("_len"))
    return tracks.join(known, "mmsi", "left").withColumn(
        "ship_length", F.when(F.col("ship_length") == 0, F.coalesce("_len", F.lit(0.0))).otherwise(F.col("ship_length"))
    ).drop("_len")


# --- A12, W2: labels and resampling ------------------------------------------
LABEL = ("ship_name", "ship_length")


def _labelled(df: DataFrame) -> DataFrame:
    """Name and length of a ship's last row with their fallbacks, as ``name`` and ``ship_length``."""
    return df.withColumn("name", F.coalesce(D.present(F.col("ship_name")), F.col("mmsi").cast("string"))).withColumn(
        "ship_length", F.coalesce("ship_length", F.lit(0.0))
    )


def ship_labels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Name and length from the last row of each ship."""
    last = F.max(F.struct("ts_us", "latitude", "longitude", "sog", "cog", *LABEL))
    found = rows.groupBy(*keys, "mmsi").agg(last.alias("_l")).select(*keys, "mmsi", *[f"_l.{c}" for c in LABEL])
    return _labelled(found).select(*keys, "mmsi", "name", "ship_length")


def resample(
    rows: DataFrame,
    keys: list[str],
    step_s: int = C.FRAME_STEP_S,
    circular: bool = False,
    align: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Linear resampling of each series to ``first + k * step``; one row per grid point.

    ``rows`` have ``keys``, ``ts_us`` and the four values. Each segment between
    consecutive records emits the grid points in its half-open span itself, so no
    join is needed. ``circular`` turns courses the short way round; ``align`` starts
    all grids at a whole multiple of the step; ``carry`` names columns whose last
    value in the series goes with every point. All windows share one sort.
    """
    step = step_s * MICROS
    values = ("latitude", "longitude", "sog", "cog")
    ordered = Window.partitionBy(*keys).orderBy("ts_us", *values, *carry)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = F.lead(F.struct("ts_us", *values)).over(ordered)
    start = F.min("ts_us").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    grid0 = F.ceil(F.col("_start") / step) * step if align else F.col("_start")
    segments = (
        rows.select(
            *keys,
            "ts_us",
            *values,
            nxt.alias("_b"),
            start.alias("_start"),
            F.row_number().over(ordered).alias("_i"),
            *[F.last(c).over(whole).alias(c) for c in carry],
        )
        .withColumn("_grid0", grid0.cast("long"))
        .withColumn("_lo", F.floor((F.col("ts_us") - F.col("_grid0")) / step).cast("long") + 1)
        .withColumn("_hi", F.floor((F.col("_b.ts_us") - F.col("_grid0")) / step).cast("long"))
    )
    # the first record itself is grid point 0 when the grid starts on it
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    own = (F.col("_i") == 1) & (F.col("_grid0") == F.col("ts_us"))
    lo = F.when(own, zero).otherwise(F.greatest("_lo", zero))
    hi = F.greatest(F.coalesce("_hi", none), F.when(own, zero).otherwise(none))
    points = segments.withColumn("k", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    at = F.col("_grid0") + F.col("k") * step
    span = F.col("_b.ts_us") - F.col("ts_us")
    ratio = F.when(span > 0, (at - F.col("ts_us")) / span).otherwise(F.lit(0.0))

    def between(name: str) -> Column:
        a, b = F.col(name), F.coalesce(F.col(f"_b.{name}"), F.col(name))
        if name == "cog" and circular:
            turn = F.pmod(b - a + 540, F.lit(360.0)) - 180
            return F.pmod(a + turn * F.col("_ratio") + 360, F.lit(360.0))
        return a + (b - a) * F.col("_ratio")

    placed = points.withColumn("frame_us", at).withColumn("_ratio", ratio)
    return placed.select(
        *keys,
        F.col("k").cast("int").alias("k"),
        F.floor(F.col("frame_us") / MICROS).cast("long").alias("frame_s"),
        *[between(v).alias(v) for v in values],
        *carry,
    )


# --- W3: gap filling ---------------------------------------------------------
def ship_tracks(frames: DataFrame) -> DataFrame:
    """Frames of each moment and ship as one array in step order, with the ship's label
    where the frames carry it. Steps are contiguous, so the frame of any time is an
    index, not a search; an array holds at most the frames of the wide window."""
    point = F.struct("k", "frame_s", "latitude", "longitude", "sog", "cog")
    label = [F.max(c).alias(c) for c in LABEL if c in frames.columns]
    tracks = (
        frames.groupBy(*MOMENT, "mmsi")
        .agg(F.sort_array(F.collect_list(point)).alias("track"), *label)
        .withColumn("first_s", F.col("track")[0]["frame_s"])
        .withColumn("steps", F.size("track"))
    )
    return _labelled(tracks).drop("ship_name") if label else tracks


def _at_time(prefix: str, time_s: Column, step_s: int, look_ahead: bool) -> Column:
    """Frame of a track at ``time_s``: its own or the last one before. Times before
    the first frame give null, or the ship's final frame with ``look_ahead``."""
    track, steps, first = (F.col(f"{prefix}{c}") for c in ("track", "steps", "first_s"))
    index = F.least(F.floor((time_s - first) / step_s).cast("int") + 1, steps)
    known = F.element_at(track, F.when(index >= 1, index).otherwise(F.lit(1)))
    early = F.element_at(track, -1) if look_ahead else F.lit(None)
    return F.when(index >= 1, known).otherwise(early)


def frame_times(tracks: DataFrame) -> DataFrame:
    """Distinct frame times of each moment."""
    return tracks.select(*MOMENT, F.explode("track.frame_s").alias("frame_s")).distinct()


def fill_gaps(times: DataFrame, tracks: DataFrame, look_ahead: bool = False, step_s: int = C.FRAME_STEP_S) -> DataFrame:
    """Every ship of the scenario at every frame time, by its own or its last known frame."""
    return (
        times.join(tracks, MOMENT)
        .withColumn("_p", _at_time("", F.col("frame_s"), step_s, look_ahead))
        .where(F.col("_p").isNotNull())
        .select(*MOMENT, "frame_s", "mmsi", *[c for c in ("name", "ship_length") if c in tracks.columns], *[F.col(f"_p.{c}").alias(c) for c in ("latitude", "longitude", "sog", "cog")])
    )


# --- J9, A8, W6, W7: focus on the pair ---------------------------------------
def pair_frames(
    encounters: DataFrame, tracks: DataFrame, times: DataFrame, look_ahead: bool = False, step_s: int = C.FRAME_STEP_S
) -> DataFrame:
    """Both focus ships at every frame time of the wide window, with their distance.

    Filling only the two focus ships first keeps the full fill of all ships for the
    times that the final window needs.
    """
    out = encounters
    for side in "ab":
        named = tracks.select(
            *MOMENT, F.col("mmsi").alias(f"mmsi_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in ("track", "steps", "first_s")]
        )
        out = out.join(named, [*MOMENT, f"mmsi_{side}"], "left")
    wide = F.col("frame_s") * MICROS
    at = out.join(times, MOMENT).where(
        wide.between(F.col("t_us") - C.WIDE_BEFORE_S * MICROS, F.col("t_us") + C.WIDE_AFTER_S * MICROS)
    )
    placed = geo.computed(
        at,
        {"_a": _at_time("a_", F.col("frame_s"), step_s, look_ahead), "_b": _at_time("b_", F.col("frame_s"), step_s, look_ahead)},
    )
    a, b = F.col("_a"), F.col("_b")
    return placed.select(
        *ENCOUNTER,
        "frame_s",
        geo.haversine_nm(a["latitude"], a["longitude"], b["latitude"], b["longitude"]).alias("focus_dist"),
        ((a["latitude"] + b["latitude"]) / 2).alias("mid_lat"),
        ((a["longitude"] + b["longitude"]) / 2).alias("mid_lon"),
    )


def closest_approach(encounters: DataFrame, frames: DataFrame) -> DataFrame:
    """Smallest distance of the pair and its earliest time; pairs never seen together
    get the no-distance value at the encounter's own time."""
    best = (
        frames.where("focus_dist is not null")
        .groupBy(*ENCOUNTER)
        .agg(F.min(F.struct("focus_dist", "frame_s")).alias("_best"))
    )
    return (
        encounters.join(best, ENCOUNTER, "left")
        .withColumn("real_min_dist", F.coalesce("_best.focus_dist", F.lit(C.NO_DISTANCE)))
        .withColumn("real_min_us", F.coalesce(F.col("_best.frame_s") * MICROS, F.col("t_us")))
        .drop("_best")
    )


def focus_window(frames: DataFrame, closest: DataFrame) -> DataFrame:
    """Final frames around the closest time with ``delta_minutes`` to it."""
    centre = F.col("real_min_us")
    at = F.col("frame_s") * MICROS
    return (
        frames.join(closest.select(*ENCOUNTER, "real_min_us"), ENCOUNTER)
        .where(at.between(centre - C.FINAL_BEFORE_S * MICROS, centre + C.FINAL_AFTER_S * MICROS))
        .withColumn("delta_minutes", F.round((at - centre) / MICROS / 60, 2))
    )


def encounter_icon(focus: DataFrame) -> DataFrame:
    """Midpoint of the pair in the final frame nearest the best time, earliest on ties;
    null when either ship is missing from it."""
    gap = F.abs(F.col("frame_s") * MICROS - F.col("real_min_us"))
    return (
        focus.groupBy(*ENCOUNTER)
        .agg(F.min(F.struct(gap.alias("gap"), F.col("frame_s"), F.col("mid_lat"), F.col("mid_lon"))).alias("_i"))
        .select(*ENCOUNTER, F.col("_i.mid_lat").alias("icon_lat"), F.col("_i.mid_lon").alias("icon_lon"))
    )
