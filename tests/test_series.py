"""As-of enrichment, ranking and static aggregates; slices never show in the result."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from seawake import schema as S
from seawake.operators import enrich as N
from seawake.operators import series as Q
from seawake.operators import tracks as K
from seawake.operators import views as V

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def statics(spark, *rows):
    data = [(m, name, a, None, None, None, at(s)) for m, s, name, a in rows]
    return spark.createDataFrame(data, "mmsi long, ship_name string, dim_a double, dim_b double, dim_c double, dim_d double, timestamp timestamp")


@pytest.mark.parametrize("slice_seconds", [1, 7, 60, 3600, 10**6])
def test_asof_is_the_same_for_any_slice(spark, slice_seconds):
    facts = statics(spark, (1, 10, "A", 1.0), (1, 500, "B", None), (1, 500, "C", 2.0), (2, 4000, "X", 3.0))
    times = [(1, 5), (1, 10), (1, 499), (1, 500), (1, 90000), (2, 100), (2, 4001), (3, 1)]
    rows = spark.createDataFrame([(m, at(s), s) for m, s in times], "mmsi long, timestamp timestamp, s int")
    got = {(r.mmsi, r.s): (r.ship_name, r.dim_a) for r in N.enrich_asof(rows, facts, slice_seconds).collect()}
    assert got == {
        (1, 5): ("Unknown", None), (1, 10): ("A", 1.0), (1, 499): ("A", 1.0), (1, 500): ("C", 2.0), (1, 90000): ("C", 2.0),
        (2, 100): ("Unknown", None), (2, 4001): ("X", 3.0), (3, 1): ("Unknown", None),
    }


def test_asof_plan_shuffles_positions_once(spark, positions):
    facts = statics(spark, (1, 10, "A", 1.0))
    plan = N.enrich_asof(positions, facts)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [last(" in line]
    assert any("_slice" in line for line in windows) and "Python" not in plan


@pytest.mark.parametrize("slice_seconds", [1, 30, 3600])
def test_rank_is_the_same_for_any_slice(spark, positions, slice_seconds):
    got = Q.ranked_newest_first(positions, "mmsi", slice_seconds=slice_seconds).select("mmsi", "timestamp", "recency", "n_points")
    by_ship = {}
    for r in positions.select("mmsi", "timestamp").collect():
        by_ship.setdefault(r.mmsi, []).append(r.timestamp)
    want = {(m, t, i + 1, len(ts)) for m, ts in by_ship.items() for i, t in enumerate(sorted(ts, reverse=True))}
    assert {tuple(r) for r in got.collect()} == want


def test_names(spark):
    rows = [(1, None), (2, ""), (3, " unknown "), (4, "KEPT"), (5, "Unknown"), (6, "Unknown")]
    df = spark.createDataFrame(rows, "mmsi long, ship_name string")
    snap = spark.createDataFrame([(i, f"N{i}" if i != 5 else "") for i in range(1, 6)], "mmsi long, ship_name string")
    got = {r.mmsi: r.ship_name for r in N.fill_names(df, snap).collect()}
    assert got == {1: "N1", 2: "N2", 3: "N3", 4: "KEPT", 5: "Unknown", 6: "Unknown"}


def test_merge_static(spark):
    known = statics(spark, (1, 0, "OLD", 1.0), (2, 0, "STAYS", 1.0)).select(*S.STATIC_FIELDS)
    batch = statics(spark, (1, 5, "NEW", 2.0), (1, 3, "EARLIER", 9.0), (3, 1, "FIRST", 4.0))
    got = {r.mmsi: r.ship_name for r in N.merge_static(known, batch).collect()}
    assert got == {1: "NEW", 2: "STAYS", 3: "FIRST"}


def test_first_and_latest(spark):
    df = statics(spark, (1, 0, "A", 1.0), (1, 299, "B", 1.0), (1, 301, "C", 1.0), (2, 5, "Z", 0.0))
    latest = {(r.mmsi, r.ship_name) for r in N.latest_static(df).collect()}
    assert latest == {(1, "B"), (1, "C"), (2, "Z")}
    assert {(r.mmsi, r.ship_name) for r in N.first_per_ship(df).collect()} == {(1, "A"), (2, "Z")}
    assert {(r.mmsi, r.updates) for r in N.window_batch(df).collect()} == {(1, 3), (2, 1)}


def test_size_defaults(spark):
    df = spark.createDataFrame([(1, None, None, 0.0, 0.0), (2, 60.0, 40.0, 5.0, None)], "id int, dim_a double, dim_b double, dim_c double, dim_d double")
    assert [(r.length, r.width) for r in N.derive_size(df).collect()] == [(100.0, 20.0), (100.0, 5.0)]


def track(spark, rows):
    return spark.createDataFrame([(m, at(s), la, 0.0, sog, cog) for m, s, la, sog, cog in rows], "mmsi long, timestamp timestamp, latitude double, longitude double, sog double, cog double")


def test_prediction(spark):
    df = track(spark, [(1, 0, 49.9, 12.0, 0.0), (1, 60, 50.0, 12.0, None), (2, 0, 50.0, 5.0, 0.0), (3, 0, 90.0, 12.0, 90.0), (3, 1, 90.0, 12.0, 90.0)])
    got = K.predict_track(df).collect()
    assert {r.mmsi for r in got} == {1, 3} and len(got) == 20
    last = next(r for r in got if r.mmsi == 1 and r.step == 10)
    assert last.latitude == pytest.approx(50 + 12 * 0.0166 / 60 * 30)
    assert last.uncertainty == pytest.approx([0.24, 0.72, 1.2])
    assert last.timestamp.replace(tzinfo=timezone.utc) == at(60 + 1800)
    assert all(r.longitude == 0.0 for r in got if r.mmsi == 3)


def test_recent(spark):
    df = track(spark, [(1, 0, 1.0, 1.0, 1.0), (1, 3600, 2.0, 1.0, 1.0), (1, 7000, 3.0, 1.0, 1.0), (2, 0, 4.0, 1.0, 1.0)])
    assert sorted(r.latitude for r in Q.recent(df).collect()) == [2.0, 3.0, 4.0]
    assert sorted(r.latitude for r in Q.recent(df, as_of=F.lit(at(3600))).collect()) == [1.0, 2.0, 4.0]
    assert sorted(r.latitude for r in Q.retain(df, 3400, F.lit(at(7000))).collect()) == [3.0]


def test_status(spark):
    ships = track(spark, [(1, 0, 1.0, 1.0, 1.0), (2, 90, 1.0, 1.0, 1.0)])
    r = V.status_summary(ships, ships.limit(1), F.lit(at(100))).first()
    assert (r.ship_count, r.encounter_count, r.seconds_since_last_ship) == (2, 1, 10.0)
    r = V.status_summary(ships.where("false"), ships.where("false"), F.lit(at(100))).first()
    assert (r.ship_count, r.encounter_count, r.seconds_since_last_ship, r.last_ship) == (0, 0, -1.0, None)


def test_lookup_and_region(spark):
    ships = track(spark, [(1, 0, 1.0, 1.0, 1.0), (2, 90, 5.0, 1.0, 1.0)])
    assert V.point_lookup(ships, "mmsi", "2").count() == 1 and V.point_lookup(ships, "mmsi", 9).count() == 0
    with pytest.raises(ValueError):
        V.point_lookup(ships, "mmsi", "two")
    batch = track(spark, [(3, 100, 1.1, 1.0, 1.0)])
    assert sorted(r.mmsi for r in V.replace_region(ships, batch, (1.2, 0.0), 0.2).collect()) == [2, 3]
    assert [r.mmsi for r in V.replace_region(ships, batch, (1.2, 0.0), 0.2, keep=1).collect()] == [3]
    assert [r.mmsi for r in V.removed_vessels(ships, batch).orderBy("mmsi").collect()] == [1, 2]


def test_busy_slices_are_cut(spark):
    """A ship with a third of all rows: windows hold a bounded number of its rows."""
    rows = [(1, i / 10) for i in range(3000)] + [(2 + i % 50, float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "mmsi long, s double").selectExpr("mmsi", "timestamp_micros(CAST(1704067200000000 + s * 1000000 AS LONG)) AS timestamp")
    busy = Q.busy_slices(df, "mmsi", "timestamp", 3600, 100)
    sliced = Q.with_slices(df, busy, "mmsi", "timestamp", 3600)
    assert busy.count() == 1 and sliced.groupBy("mmsi", "_slice").count().agg({"count": "max"}).first()[0] <= 100
    ranks = Q.ranked_newest_first(df, "mmsi", slice_rows=100).where("mmsi = 1").orderBy("timestamp").select("recency").collect()
    assert [r["recency"] for r in ranks] == list(range(3000, 0, -1))
