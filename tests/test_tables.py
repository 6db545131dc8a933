"""Sinks and sources."""

import json
import os

from pyspark.sql import functions as F

from seawake import schema as S
from seawake.operators import encounters as E
from seawake.operators import scenarios as C
from seawake.plans import history as H
from seawake.sinks import segments as G
from seawake.sinks import tables as W
from seawake.sources import files as R


def test_positions_layout_and_pruning(spark, positions, tmp_path):
    path = f"{tmp_path}/p"
    later = positions.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 2 DAYS"))
    W.write_positions(positions.unionByName(later), path)
    days = sorted(n for n in os.listdir(path) if n.startswith("event_date="))
    assert days == ["event_date=2024-01-01", "event_date=2024-01-03"]
    plan = spark.read.parquet(path).where("event_date = date'2024-01-03' and mmsi = 200000001")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "EqualTo(mmsi" in plan
    assert W.drop_expired(spark, path, 3600, F.lit("2024-01-03 00:30:00").cast("timestamp")) == ["event_date=2024-01-01"]
    assert spark.read.parquet(path).count() == positions.count()


def test_expired_copy_of_a_long_table_goes_whole(spark, tmp_path):
    """The query's repeated rows are all expired, however many days its table spans."""
    from seawake.checks.tables import drop_expired

    spark.range(0, 6 * 86400, 3600).selectExpr("id AS event_id", "id % 7 AS user_id").write.parquet(f"{tmp_path}/sf/events.parquet")
    kept = drop_expired(spark, f"{tmp_path}/sf")
    assert kept.count() == 6 * 24 and kept.agg(F.min("epoch_s")).first()[0] == 1704067200


def test_repeated_batch_leaves_no_duplicates(spark, positions, tmp_path):
    path = f"{tmp_path}/p"
    for batch in (0, 1, 1, 0):
        W.write_positions(positions, path, batch)
    assert W.read_table(spark, path, S.POSITIONS).count() == 2 * positions.count()


def test_encounters_reach_the_scan(spark, positions, tmp_path):
    path = f"{tmp_path}/e"
    W.write_encounters(E.detect_encounters_windowed(positions), path)
    stored = spark.read.parquet(path)
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-01 00:00:00", "2024-01-01 01:00:00"))
    got = C.read_encounters(stored, start, end)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(cpa,0.3)" in plan and "PartitionFilters: [isnotnull(event_date" in plan
    assert got.count() == stored.where("cpa < 0.3 and tcpa between 0 and 10").count()


def test_snapshot_versions(spark, tmp_path):
    path = f"{tmp_path}/s"
    assert R.read_static_snapshot(spark, path).count() == 0

    def batch(*rows):
        return spark.createDataFrame(rows, "mmsi long, ship_name string, dim_a double, dim_b double, dim_c double, dim_d double, timestamp timestamp")

    W.write_static_snapshot(batch((1, "A", 1.0, 1.0, 1.0, 1.0, None), (2, "B", 1.0, 1.0, 1.0, 1.0, None)), path, 0)
    for _ in range(2):  # a repeated batch
        W.write_static_snapshot(batch((1, "C", 1.0, 1.0, 1.0, 1.0, None)), path, 1)
    assert {r.mmsi: r.ship_name for r in R.read_static_snapshot(spark, path).collect()} == {1: "C", 2: "B"}
    assert {r.ship_name for r in R.read_static_snapshot(spark, path, before=1).collect()} == {"A", "B"}
    W.write_static_snapshot(batch(), path, 2)
    assert R.snapshot_versions(spark, path) == [0, 1]
    os.mkdir(f"{path}/version=9")  # a version whose write did not finish
    assert R.snapshot_versions(spark, path) == [0, 1]
    for v in range(3, 8):
        W.write_static_snapshot(batch((v, "N", 1.0, 1.0, 1.0, 1.0, None)), path, v)
    assert R.snapshot_versions(spark, path) == [0, 1, 3, 4, 5, 6, 7]  # young versions stay for their readers
    W.write_static_snapshot(batch((7, "N", 1.0, 1.0, 1.0, 1.0, None)), path, 7, keep_s=-1)
    assert R.snapshot_versions(spark, path) == [4, 5, 6, 7]
    assert R.read_static_snapshot(spark, path).count() == 7


def test_snapshot_array_file(spark, tmp_path):
    entries = [{"mmsi": 1, "ship_name": "A"}, {"mmsi": 2, "ship_name": "B", "dim_a": 5}, {"mmsi": 1, "ship_name": "LATER"}]
    (tmp_path / "s.json").write_text(json.dumps(entries, indent=2))
    got = {r.mmsi: (r.ship_name, r.dim_a) for r in R.read_static_snapshot(spark, f"{tmp_path}/s.json").collect()}
    assert got == {1: ("LATER", None), 2: ("B", 5.0)}
    assert R.read_static_snapshot(spark, f"{tmp_path}/none.json").count() == 0


def test_history_files(spark, positions, tmp_path):
    built = H.build_scenarios(E.detect_encounters_windowed(positions), positions)
    path = f"{tmp_path}/h"
    for _ in range(2):
        W.write_scenarios(H.scenario_documents(built), path)
    docs = R.read_history(spark, path)
    assert docs.where("_parent").count() == built.parents.count()
    assert docs.where("not _parent").count() == built.replays.count()
    shown = docs.where("not _parent").select(F.explode("frames").alias("f")).select(F.size("f.shipPositions").alias("n"))
    assert shown.agg(F.sum("n")).first()[0] == built.frames.count()
    names = {r.name for r in R.list_history(spark, path).collect()}
    assert names == {r.n for r in built.parents.select(F.concat(F.lit("multiship_"), F.date_format("hour", "yyyyMMdd_HH")).alias("n")).collect()}


def test_history_single_document(spark, tmp_path):
    doc = {"scenarios": [
        {"_parent": True, "scenario_id": "s", "ships_involved": [1, 2], "collisions_count": 1, "min_ts": "2024-01-01T00:00:00"},
        {"_parent": False, "scenario_id": "s", "collision_id": "c", "focus_mmsi": [1, 2], "cpa": 0.5,
         "frames": [{"time": "t", "focus_dist": 1.5, "delta_minutes": -0.5, "shipPositions": [{"mmsi": 1, "name": "A", "lat": 1.0, "lon": 2.0}]}]},
    ]}
    (tmp_path / "doc.json").write_text(json.dumps(doc, indent=2))
    got = R.read_history(spark, f"{tmp_path}/doc.json", single_document=True).collect()
    assert sorted(r["_parent"] for r in got) == [False, True]
    child = next(r for r in got if not r["_parent"])
    assert child["frames"][0]["shipPositions"][0]["lat"] == 1.0
    assert R.list_history(spark, str(tmp_path)).first().name == "doc.json"


def test_ensure_table(spark, tmp_path):
    assert W.ensure_table(spark, "made_once", S.ENCOUNTERS, f"{tmp_path}/t")
    assert not W.ensure_table(spark, "made_once", S.ENCOUNTERS, f"{tmp_path}/t")
    assert spark.table("made_once").columns == [*S.ENCOUNTERS.fieldNames(), "event_date"]
    spark.sql("DROP TABLE made_once")


def test_messages_round_trip(spark, positions, tmp_path):
    W.publish_messages(positions, f"{tmp_path}/m")
    (line,) = spark.read.text(f"{tmp_path}/m").limit(1).collect()
    assert list(json.loads(line.value)) == S.MESSAGE.fieldNames()


def test_stored_tables_are_removed(spark):
    from seawake import session

    first = session.stored_count()
    a, b = (session.stored(spark.range(3), name) for name in "ab")
    paths = list(session._STORED[first:])
    session.release_stored(spark, first, keep_last=1)
    assert [session.path_exists(spark, p) for p in paths] == [False, True] and b.count() == 3
    session.release_stored(spark, first)
    assert session.stored_count() == first and not session.path_exists(spark, paths[1])


def test_segments_of_a_stream_are_merged_and_expire(spark, positions, tmp_path):
    """Repeated batches leave no duplicates, before or after a merge; a merge changes no row and lets
    a reader of one ship skip files; old rows are gone from the disk, and expiring again
    changes nothing."""
    path, second = f"{tmp_path}/live", F.unix_timestamp("timestamp")
    lo, hi = positions.agg(F.min(second), F.max(second)).first()
    step = (hi - lo) // 5 + 1

    def batch(k):
        return positions.where(F.floor((second - lo) / step) == k)

    def stored(**bounds):
        return sorted(map(tuple, W.read_table(spark, path, S.POSITIONS, **bounds).select("mmsi", second).collect()))

    whole = sorted(map(tuple, positions.select("mmsi", second).collect()))
    for k in (0, 1, 2, 2, 3, 4):
        W.write_positions(batch(k), path, k)
    assert stored() == whole and len(G.segments_of(spark, path)) == 5
    assert W.maintain(spark, path, S.POSITIONS) == (0, 5) and stored() == whole
    W.write_positions(batch(4), path, 4)  # the stream repeats a batch that is merged already
    assert stored() == whole and W.maintain(spark, path, S.POSITIONS)[1] in (0, 2)
    W.write_positions(batch(0), path, 5)  # and goes on
    assert len(stored()) == len(whole) + batch(0).count()
    since = (lo + 2 * step) * 1_000_000
    assert stored(low=since) == [r for r in whole if r[1] >= lo + 2 * step]
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual" in W.read_table(spark, path, S.POSITIONS, low=since)._jdf.queryExecution().executedPlan().toString()
    for _ in range(2):
        W.maintain(spark, path, S.POSITIONS, 60, hi * 1_000_000, keep=0, keep_s=-1)
        left = spark.read.schema(S.POSITIONS).option("recursiveFileLookup", True).parquet(f"{path}/data")
        assert sorted(map(tuple, left.select("mmsi", second).collect())) == [r for r in whole if r[1] >= hi - 60] == stored()


def test_a_merge_that_a_batch_overtakes_is_without_effect(spark, positions, tmp_path, monkeypatch):
    path = f"{tmp_path}/live"
    for k in range(2):
        W.write_positions(positions.where(f"mmsi % 2 = {k}"), path, k)
    write = G.write_segments

    def overtaken(*args, **kwargs):
        out = write(*args, **kwargs)
        W.write_positions(positions.limit(3), path, 2)
        return out

    monkeypatch.setattr(G, "write_segments", overtaken)
    G.compact(spark, path, S.POSITIONS, "timestamp", ["mmsi", "timestamp"])
    assert W.read_table(spark, path, S.POSITIONS).count() == positions.count() + 3


def test_one_changed_ship_writes_one_bucket(spark, positions, tmp_path):
    statics = positions.select("mmsi", "ship_name", *S.DIMS, "timestamp")
    W.write_static_snapshot(statics, f"{tmp_path}/s", 0)
    before = {s.folder for s in G.segments_of(spark, f"{tmp_path}/s")}
    one = statics.limit(1).withColumn("ship_name", F.lit("NEW"))
    W.write_static_snapshot(one, f"{tmp_path}/s", 1)
    after = {s.folder for s in G.segments_of(spark, f"{tmp_path}/s")}
    assert len(before) > 5 and len(after - before) == len(before - after) == 1


def test_scenario_files_do_not_grow_with_tasks(spark, tmp_path):
    """Forty hours in each of sixteen tasks: a file per hour, not one per hour and task."""
    hours = spark.range(3200).repartition(16).selectExpr(
        "timestamp_seconds(1704067200 + id % 40 * 3600) AS hour", "true AS _parent", "concat('scenario_', id) AS scenario_id"
    )
    W.write_scenarios(hours, str(tmp_path / "s"))
    assert len(list((tmp_path / "s").rglob("*.json"))) == 40
    assert R.read_history(spark, str(tmp_path / "s")).select("scenario_id").distinct().count() == 3200
