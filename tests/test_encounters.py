"""Grid-blocked pairs equal all pairs, on random and on awkward traffic."""

import math
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from seawake.operators import encounters as E

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "mmsi long, ship_name string, latitude double, longitude double, cog double, sog double, timestamp timestamp, dim_a double, dim_b double, g int"


def ships(seed, n, lat, lon, spread, speeds):
    rnd = random.Random(seed)
    return [
        (
            1000 + i, f"S{i}", lat + rnd.uniform(-spread, spread), lon + rnd.uniform(-spread, spread),
            rnd.choice([0.0, 90.0, 180.0, 270.0, rnd.uniform(0, 360)]), rnd.choice(speeds) * rnd.uniform(0.5, 1.0), T0, 100.0, 50.0, seed,
        )
        for i in range(n)
    ]


def local(a, b):
    scale = 111000 * math.cos(math.radians((a[2] + b[2]) / 2))
    dx, dy = (a[3] - b[3]) * scale, (a[2] - b[2]) * 111000

    def v(s):
        return s[5] * math.sin(math.radians(s[4])), s[5] * math.cos(math.radians(s[4]))

    ux, uy = ((p - q) * 1852 / 60 for p, q in zip(v(a), v(b)))
    if dx * ux + dy * uy >= 0:
        return None
    t = -(dx * ux + dy * uy) / (ux * ux + uy * uy)
    return math.hypot(dx + ux * t, dy + uy * t) / 1852, t


def flat(a, b):
    def xy(s):
        return s[3] * 60 * math.cos(math.radians(s[2])), s[2] * 60

    def v(s):
        return s[5] * math.sin(math.radians(s[4])), s[5] * math.cos(math.radians(s[4]))

    dx, dy = (p - q for p, q in zip(xy(a), xy(b)))
    ux, uy = (p - q for p, q in zip(v(a), v(b)))
    v2 = ux * ux + uy * uy
    t = max(0.0, -(dx * ux + dy * uy) / v2) if v2 else 0.0
    return math.hypot(dx + ux * t, dy + uy * t), t


def brute(rows, metric, max_cpa, max_t):
    found = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            lo, hi = sorted((a, b))
            r = metric(lo, hi)
            if r and r[0] < max_cpa and r[1] <= max_t:
                found.add((lo[0], hi[0]))
    return found


CASES = {
    "channel": (1, 120, 50.0, 0.0, 0.2, [3, 10, 19]),
    "dense and slow": (2, 150, 51.0, 1.0, 0.03, [2, 3]),
    "fast and bad speeds": (3, 120, -33.0, 151.0, 0.4, [5, 30, 102.3]),
    "north": (4, 120, 84.0, 20.0, 0.3, [10, 20]),
    "pole": (5, 100, 89.6, 0.0, 0.3, [10, 20]),
    "equator": (6, 120, 0.0, -179.8, 0.19, [10, 20]),
    "beyond the pole": (7, 80, 120.0, 10.0, 0.2, [10, 20]),
    "absurd speeds": (8, 60, 10.0, 10.0, 1.0, [5, 3000]),
}


@pytest.fixture(scope="module")
def everything(spark):
    rows = [r for case in CASES.values() for r in ships(*case)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("hot", [None, 3])
@pytest.mark.parametrize("limits", [(0.5, 10.0), (2.0, 3.0)])
def test_local_pairs_equal_all_pairs(everything, hot, limits):
    found = {}
    for r in E.encounters_among(everything, ["g"], *limits, hot_cell_ships=hot).select("g", "mmsi_a", "mmsi_b").collect():
        assert (r.mmsi_a, r.mmsi_b) not in found.setdefault(r.g, set())
        found[r.g].add((r.mmsi_a, r.mmsi_b))
    for name, case in CASES.items():
        want = brute(ships(*case), local, *limits)
        assert found.get(case[0], set()) == want, name
        assert want or name in ("absurd speeds",), name


@pytest.mark.parametrize("unit", ["minutes", "hours"])
def test_flat_pairs_equal_all_pairs(spark, unit):
    rows = [r[:1] + r[1:] for name in ("channel", "fast and bad speeds", "pole") for r in ships(*CASES[name])]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = E.detect_encounters_live(spark.createDataFrame(rows, SCHEMA), tcpa_unit=unit, hot_cell_ships=20)
    pairs = [(r.mmsi_a, r.mmsi_b) for r in got.select("mmsi_a", "mmsi_b").collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(rows, flat, 0.5, 30.0 if unit == "hours" else 0.5)


def test_nothing_to_meet(spark):
    one = spark.createDataFrame(ships(1, 1, 50, 0, 0, [5]), SCHEMA)
    assert E.detect_encounters_live(one).count() == 0
    assert E.detect_encounters_live(one.where("false")).count() == 0
    assert E.encounters_among(one.where("false"), ["g"]).count() == 0


def test_unknown_values_meet_nobody(spark):
    rows = [
        (1, "A", 50.0, 0.0, 90.0, 10.0, T0, 100.0, 50.0, 0),
        (2, "B", 50.0, 0.01, None, 10.0, T0, 100.0, 50.0, 0),
        (3, "C", 50.0, 0.01, 270.0, float("inf"), T0, 100.0, 50.0, 0),
        (4, "D", float("nan"), 0.01, 270.0, 10.0, T0, 100.0, 50.0, 0),
        (5, "E", 50.0, 0.02, 270.0, 10.0, T0, 100.0, 50.0, 0),
    ]
    got = E.encounters_among(spark.createDataFrame(rows, SCHEMA), ["g"]).select("mmsi_a", "mmsi_b").collect()
    assert [tuple(r) for r in got] == [(1, 5)]


def test_latest_row_of_a_window(spark):
    def row(second, lat):
        return (1, "A", lat, 0.0, 90.0, 10.0, T0.replace(second=second), 100.0, 50.0, 0)

    df = spark.createDataFrame([row(1, 50.0), row(9, 50.1), row(9, 50.2), row(12, 50.3)], SCHEMA)
    got = E.latest_in_window(df).orderBy("window_start").select("latitude").collect()
    assert [r.latitude for r in got] == [50.2, 50.3]


def test_length_filter(spark):
    rows = ships(1, 2, 50, 0, 0.001, [5])
    short = [r[:7] + (30.0, 20.0, 0) for r in rows]
    unknown = [r[:7] + (None, 60.0, 0) for r in rows]
    for data in (short, unknown):
        assert E.detect_encounters_windowed(spark.createDataFrame(data, SCHEMA)).count() == 0


def test_plan_has_no_all_pairs_join(positions):
    plan = E.detect_encounters_windowed(positions)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "Python" not in plan


def test_dedupe_and_rank(spark):
    schema = "mmsi_a long, mmsi_b long, timestamp timestamp, tcpa double, cpa double"
    rows = [(1, 2, T0, 5.0, 0.1), (2, 1, T0.replace(minute=1), 4.0, 0.2), (3, 4, T0, 1.0, 0.3)]
    df = spark.createDataFrame(rows, schema)
    kept = E.rank_encounters(E.dedupe_pairs(df)).select("mmsi_a", "tcpa").collect()
    assert [tuple(r) for r in kept] == [(3, 1.0), (2, 4.0)]
    assert E.filter_encounters(df, 0.2, 4.0).count() == 1
    assert F.col("x") is not None


def _visitors_per_window(df):
    boxes = E._boxes(E._usable(df.select("window", *E.STATE)), "local", 0.5, 1 / 6)
    rows = E._visited(boxes, ["window"]).groupBy("window").count().collect()
    return {r["window"]: r["count"] for r in rows}


def test_one_bad_speed_changes_no_other_window(spark):
    rows = [(w, m, "x", 50 + m / 1e3, 1.0, 90.0, float(m % 15 + 2), None) for w in range(4) for m in range(40)]
    schema = "window int, mmsi long, ship_name string, latitude double, longitude double, cog double, sog double, timestamp timestamp"
    before = _visitors_per_window(spark.createDataFrame(rows, schema))
    after = _visitors_per_window(spark.createDataFrame([*rows, (2, 99, "bad", 50.0, 1.0, 0.0, 1e6, None)], schema))
    assert {w: n for w, n in after.items() if w != 2} == {w: n for w, n in before.items() if w != 2}
    assert after[2] == before[2] + 41  # each ship visits the one new tier


def test_every_crowded_cell_is_salted(spark):
    """More crowded cells than any list of them could be cut at: same pairs with and without salt."""
    rows = [(c, c * 10 + k, "x", 50.0 + k / 1e4, c / 10, 90.0 + 180 * (k % 2), 10.0, None) for c in range(30) for k in range(6)]
    schema = "window int, mmsi long, ship_name string, latitude double, longitude double, cog double, sog double, timestamp timestamp"
    df = spark.createDataFrame(rows, schema)

    def pairs(hot):
        return {(r["a"]["mmsi"], r["b"]["mmsi"]) for r in E.candidate_pairs(df, ["window"], "local", 0.5, 10, hot).select("a", "b").collect()}

    assert pairs(1) == pairs(None) and len(pairs(1)) >= 30 * 9
    plan = E.candidate_pairs(df, ["window"], "local", 0.5, 10, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "broadcast" not in plan.lower()


def test_collisions_take_their_own_risk(spark, positions):
    """The same rows as when risks are assessed apart and joined by id, without that join."""
    from seawake.operators import tracks, views
    from seawake.plans import serving

    met = E.detect_encounters_live(tracks.last_per_key(positions))
    cols = ("id", "cpa", "tcpa", "risk")
    want = views.attach_risk(met, views.assess_risk(met)).select(*cols)
    got = serving.collisions(positions).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0

    def joins(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert joins(got) == joins(met.select("id")) < joins(want)


def test_attach_risk_query_detects_once(spark):
    from seawake.checks import live

    out = live.attach_risk(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and all("/met-" in f for f in out.inputFiles())


def test_live_pairs_share_one_scan_and_do_not_wait_for_one_task(spark):
    """States are read once for all branches; their pairs, many for few bytes, are dealt by a shuffle."""
    from seawake.checks import live

    out = live.live(spark, "/root/testdata/sf0.001", "hours")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "SortMergeJoin" in plan and "BroadcastHashJoin [_g" not in plan


@pytest.mark.parametrize("name", ["channel", "fast and bad speeds", "equator"])
def test_hours_of_look_ahead_equal_all_pairs(spark, name):
    """The bound on paths drops no pair that the exact test takes, ships of equal motion among them."""
    rows = ships(*CASES[name])
    rows += [(r[0] + 5000, r[1], r[2] + 1e-3, *r[3:]) for r in rows[:20]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = E.detect_encounters_live(df, tcpa_unit="hours", hot_cell_ships=20)
    pairs = [(r.mmsi_a, r.mmsi_b) for r in got.select("mmsi_a", "mmsi_b").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows, flat, 0.5, 30.0)


def test_parts_of_a_crowded_cell_repeat_rows_by_their_root(spark):
    """Ninety ships in one cell in parts of ten: three by three parts, so a host is there three times, not nine."""
    rows = [(1000 + k, "x", 50.0, k / 1e5, 90.0, 10.0, T0, 100.0, 50.0, 1) for k in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = E.candidate_pairs(df, [], "flat", 0.5, 10, 10)
    assert pairs.count() == 90 * 89 // 2
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "_part_v" in plan and "_part_h" in plan


def test_cells_of_small_groups_are_dealt_out_once(spark):
    """Without a large group there are no hot cells to count; a large one beside small ones is salted alone."""

    def met(sizes, hot):
        ships = [(m, f"S{m}", 50 + (m % 7) * 1e-3, (m % 5) * 1e-3, (m * 40.0) % 360, 8.0, g) for g, n in enumerate(sizes) for m in range(1, n + 1)]
        columns = "mmsi long, ship_name string, latitude double, longitude double, cog double, sog double, g int"
        states = spark.createDataFrame(ships, columns).withColumn("timestamp", F.lit(datetime(2024, 1, 1)))
        out = E.encounters_among(states, ["g"], hot_cell_ships=hot).select("g", "mmsi_a", "mmsi_b")
        found = sorted(map(tuple, out.collect()))
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return found, sum("Exchange hashpartitioning(" in line and "_cy" in line for line in plan.splitlines())

    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plain, exchanges = met([12, 12], None)
        assert plain and exchanges == 2
        assert met([12, 12], 20) == (plain, 2)
        plain, _ = met([12, 90, 12], None)
        found, exchanges = met([12, 90, 12], 20)
        assert found == plain and exchanges > 2
    finally:
        spark.conf.set(threshold, before)


def test_ships_of_like_motion_are_compared_in_blocks(spark):
    """Convoys, crossing ships and bad values: few blocks for many ships, and the pairs of all-pairs, each once."""
    rows = [(1000 + k, "x", 50.0 + k % 3 * 1e-3, k / 1e5, 90.0, 10.0, T0, 100.0, 50.0, 1) for k in range(120)]
    rows += [(2000 + k, "x", 50.05 + k / 1e5, 0.05, 180.0, 12.0, T0, 100.0, 50.0, 1) for k in range(80)]
    rows += [(3000 + k, "x", 51.0, 1.0 + k / 1e5, 270.0, 11.0, T0, 100.0, 50.0, 1) for k in range(60)]
    rows += [(4000 + k, "x", 50.0, 0.0, 37.0 * k, s, T0, 100.0, 50.0, 1) for k, s in enumerate((0.0, 1e3, 1e9, 1e120))]
    df = spark.createDataFrame(rows, SCHEMA)
    boxes = E._boxes(E._usable(df.select(*E.STATE)), "flat", 0.5, 0.5)
    for held, hot in ((64, None), (64, 50), (7, 20), (1, None)):
        blocks = E._blocks(boxes, [], 0.5, 0.5, held)
        assert held == 1 or blocks.count() < len(rows) / 3
        pairs = [tuple(sorted(r)) for r in E.meetings_of(blocks, hot_cell_ships=hot).select("mmsi_v", "mmsi_h").collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows, flat, 0.5, 30.0)
    plan = E.meetings_live(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan


def test_attach_risk_query_joins_where_encounters_lie(spark):
    """Neither encounters nor risks are shuffled, and the rows are those of a join by id alone."""
    from seawake.checks import live
    from seawake.operators import views

    folder, threshold = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        out = live.attach_risk(spark, folder)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert "Exchange" not in plan and plan.count("FileScan") == 2 and "SortMergeJoin" in plan
    met = live.live(spark, folder)
    want = views.attach_risk(met, views.assess_risk(met.where("tcpa > 0"))).select("id", F.round("risk", 6))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert "met_" not in " ".join(t.name for t in spark.catalog.listTables())
