"""History job: encounters → scenarios → replays with frames."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake import config as C
from seawake.functions import display as D
from seawake.operators import scenarios as S
from seawake.session import stored


class Scenarios(NamedTuple):
    parents: DataFrame  # one row per scenario
    replays: DataFrame  # one row per encounter
    frames: DataFrame   # one row per encounter, frame time and ship
    focus: DataFrame    # one row per encounter and frame time


def build_scenarios(
    encounters: DataFrame,
    positions: DataFrame,
    statics: DataFrame | None = None,
    start: Column | None = None,
    end: Column | None = None,
    look_ahead: bool = False,
    circular: bool = False,
    align: bool = False,
) -> Scenarios:
    """Scenarios of every hour in ``[start, end)``; without bounds of all hours.

    ``statics`` (one row per ship) gives the ship lengths that the positions lack.

    ``look_ahead=True`` fills times before a ship's first frame with its last one, as
    older output files do; by default the ship is left out of those frames.
    """
    # Read by every branch below. The table is small next to the positions, and
    # cutting it here keeps the branches from repeating encounter detection.
    chosen = stored(S.with_hour(S.read_encounters(encounters, start, end)), "chosen")
    members = stored(S.scenario_members(chosen), "members")
    placed = S.edges_in_component(chosen, members)
    summary = S.scenario_summary(placed, members)

    moments = stored(S.moments(placed), "moments")
    # one second more at the end, as the replay windows include their ends
    near = S.in_span(positions, start, end, C.WIDE_BEFORE_S, C.WIDE_AFTER_S + 1)
    rows = S.positions_for_encounters(moments, members, near)
    frames = S.resample(rows, [*S.MOMENT, "mmsi"], circular=circular, align=align, carry=S.LABEL)
    tracks = S.ship_tracks(frames)
    if statics is not None:
        tracks = S.lengths_from_static(tracks, statics)
    tracks = stored(tracks, "tracks")  # feeds times, pairs, fill and names
    times = S.frame_times(tracks)

    pairs = stored(S.pair_frames(moments, tracks, times, look_ahead), "pairs")  # feeds closest, focus and icon
    closest = S.closest_approach(moments, pairs)
    focus = S.focus_window(pairs, closest)
    icon = S.encounter_icon(focus)

    ids = summary.select(*S.SCENARIO, "scenario_id", "ships_involved")
    replays = closest.join(icon, S.ENCOUNTER, "left")
    for side in "ab":
        name = tracks.select(*S.MOMENT, F.col("mmsi").alias(f"mmsi_{side}"), F.col("name").alias(f"name_{side}"))
        replays = replays.join(name, [*S.MOMENT, f"mmsi_{side}"], "left").withColumn(
            f"name_{side}", F.coalesce(f"name_{side}", F.col(f"mmsi_{side}").cast("string"))
        )
    at = F.timestamp_micros("t_us")
    replays = (
        replays.join(ids, S.SCENARIO)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "hour",
            "component",
            "scenario_id",
            D.collision_id(F.col("mmsi_a"), F.col("mmsi_b"), at).alias("collision_id"),
            at.alias("timestamp"),
            F.array("mmsi_a", "mmsi_b").alias("focus_mmsi"),
            D.replay_title(F.col("name_a"), F.col("name_b"), F.col("real_min_dist")).alias("title"),
            F.col("real_min_dist").alias("cpa"),
            F.timestamp_micros("real_min_us").alias("t_min"),
            F.col("ships_involved").alias("all_involved_mmsi"),
            "icon_lat",
            "icon_lon",
        )
    )
    needed = focus.select(*S.MOMENT, "frame_s").distinct()
    filled = S.fill_gaps(needed, tracks, look_ahead)
    frames = focus.drop("mid_lat", "mid_lon", "real_min_us").join(filled, [*S.MOMENT, "frame_s"])
    parents = summary.select(*S.SCENARIO, "scenario_id", "ships_involved", "collisions_count", "min_ts", "max_ts")
    return Scenarios(parents, replays, frames, focus)


def scenario_documents(s: Scenarios) -> DataFrame:
    """Parents and replays as nested documents with an ``hour`` column, one per row.

    A replay's document holds its own frames only; no scenario or hour is gathered.
    """
    iso = D.iso_time
    parents = s.parents.select(
        "hour",
        F.lit(True).alias("_parent"),
        "scenario_id",
        "ships_involved",
        "collisions_count",
        iso(F.col("min_ts")).alias("min_ts"),
        iso(F.col("max_ts")).alias("max_ts"),
    )
    ship = F.struct(
        "mmsi", "name", "ship_length", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "sog", "cog"
    )
    moment = iso(F.timestamp_seconds("frame_s")).alias("time")
    shots = (
        s.frames.groupBy(*S.ENCOUNTER, "frame_s", "focus_dist", "delta_minutes")
        .agg(F.sort_array(F.collect_list(ship)).alias("shipPositions"))
        .groupBy(*S.ENCOUNTER)
        .agg(
            F.sort_array(F.collect_list(F.struct(moment, "focus_dist", "delta_minutes", "shipPositions"))).alias("frames")
        )
    )
    keyed = (
        s.replays.withColumn("t_us", F.unix_micros("timestamp"))
        .withColumn("mmsi_a", F.col("focus_mmsi")[0])
        .withColumn("mmsi_b", F.col("focus_mmsi")[1])
    )
    children = keyed.join(shots, S.ENCOUNTER, "left").select(
        "hour",
        F.lit(False).alias("_parent"),
        "scenario_id",
        "collision_id",
        "focus_mmsi",
        "title",
        "cpa",
        iso(F.col("t_min")).alias("t_min"),
        "all_involved_mmsi",
        "icon_lat",
        "icon_lon",
        "frames",
    )
    return parents.unionByName(children, allowMissingColumns=True)
