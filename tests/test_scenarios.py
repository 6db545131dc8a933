"""Components, resampling, gap filling and replays against plain-Python models."""

import bisect
import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from seawake.operators import encounters as E
from seawake.operators import parse as P
from seawake.operators import scenarios as S
from seawake.plans import history as H

T0 = datetime(2024, 1, 1, 10, tzinfo=timezone.utc)
US = 1_000_000


# --- components --------------------------------------------------------------
def components_of(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    return {x: root(x) for x in parent}


def graphs():
    rnd = random.Random(7)
    n = 60
    chain = list(range(n))
    rnd.shuffle(chain)
    yield "chain", list(zip(chain, chain[1:]))
    yield "star", [(50, i) for i in range(n) if i != 50]
    yield "random", [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)]
    yield "ring", [(i, (i + 1) % n) for i in range(n)]
    yield "pairs and repeats", [(2 * i, 2 * i + 1) for i in range(20)] * 2 + [(2 * i + 1, 2 * i) for i in range(20)]


def test_components(spark):
    data, want = [], {}
    for k, (_, edges) in enumerate(graphs()):
        edges = [(a, b) for a, b in edges if a != b]
        data += [(k, a, b) for a, b in edges]
        want.update({(k, x): c for x, c in components_of(edges).items()})
    df = spark.createDataFrame(data, "g int, mmsi_a long, mmsi_b long")
    for shuffled in (df, df.orderBy(F.desc("mmsi_b")).select("g", F.col("mmsi_b").alias("mmsi_a"), F.col("mmsi_a").alias("mmsi_b"))):
        got = {(r.g, r.mmsi): r.component for r in S.connected_components(shuffled, ["g"]).collect()}
        assert got == want


def test_components_never_return_partial_labels(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)], "mmsi_a long, mmsi_b long")
    with pytest.raises(RuntimeError):
        S.connected_components(df, max_rounds=1)


def test_no_encounters(spark):
    df = spark.createDataFrame([], "mmsi_a long, mmsi_b long")
    assert S.connected_components(df).count() == 0


# --- resampling --------------------------------------------------------------
def walk(points, step):
    points = sorted(points)
    out, t = [], points[0][0]
    while t <= points[-1][0]:
        i = bisect.bisect_left([p[0] for p in points], t, lo=1) if len(points) > 1 else 0
        if i == 0:
            out.append((t, points[0][1]))
        else:
            (ta, va), (tb, vb) = points[i - 1], points[i]
            out.append((t, va if tb <= ta else va + (vb - va) * (t - ta) / (tb - ta)))
        t += step
    return out


def test_resample_equals_walk(spark):
    rnd = random.Random(3)
    series, rows = {}, []
    for s in range(120):
        n = rnd.choice([1, 2, 3, 8, 20])
        times = [T_US + rnd.randrange(0, 1800 * US, rnd.choice([1, US, 30 * US, 60 * US])) for _ in range(n)]
        if n > 2:
            times[1] = times[2]
        series[s] = [(t, float(rnd.randrange(1000))) for t in times]
        rows += [(s, t, v, -v, v / 10, v / 3) for t, v in series[s]]
    df = spark.createDataFrame(rows, "s int, ts_us long, latitude double, longitude double, sog double, cog double")
    got = {}
    for r in S.resample(df, ["s"]).orderBy("s", "k").collect():
        got.setdefault(r.s, []).append((r.frame_s, r.latitude, r.longitude, r.sog))
    for s, points in series.items():
        want = walk(points, 60 * US)
        assert [g[0] for g in got[s]] == [t // US for t, _ in want]
        assert [g[1] for g in got[s]] == pytest.approx([v for _, v in want])
        assert [g[2] for g in got[s]] == pytest.approx([-v for _, v in want])


T_US = int(T0.timestamp()) * US


def test_resample_options(spark):
    rows = [(1, T_US + 10 * US, 0.0, 0.0, 0.0, 350.0), (1, T_US + 190 * US, 18.0, 0.0, 0.0, 10.0)]
    df = spark.createDataFrame(rows, "s int, ts_us long, latitude double, longitude double, sog double, cog double")
    plain = [(r.frame_s - T_US // US, r.cog) for r in S.resample(df, ["s"]).orderBy("k").collect()]
    assert [p[0] for p in plain] == [10, 70, 130, 190] and plain[1][1] == pytest.approx(350 - 340 / 3)
    turned = [r.cog for r in S.resample(df, ["s"], circular=True).orderBy("k").collect()]
    assert turned == pytest.approx([350, 350 + 20 / 3, 10 / 3, 10])
    aligned = [(r.frame_s - T_US // US, r.latitude) for r in S.resample(df, ["s"], align=True).orderBy("k").collect()]
    assert [a[0] for a in aligned] == [60, 120, 180] and [a[1] for a in aligned] == pytest.approx([5, 11, 17])


# --- whole replays -----------------------------------------------------------
def haversine(a, b):
    p, q = math.radians(b[0] - a[0]) / 2, math.radians(b[1] - a[1]) / 2
    h = math.sin(p) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(q) ** 2
    return 2 * 3440.065 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def frames_of(positions, ships, t, ahead):
    """time -> ship -> (lat, lon) for the ships of a scenario around ``t`` (microseconds)."""
    tracks = {}
    for m in ships:
        rows = sorted({p for p in positions if p[0] == m and t - 1200 * US <= p[1] <= t + 600 * US})
        if rows:
            lat, lon = walk([(r[1], r[2]) for r in rows], 60 * US), walk([(r[1], r[3]) for r in rows], 60 * US)
            tracks[m] = {a[0] // US: (a[1], b[1]) for a, b in zip(lat, lon)}
    out = {}
    for time in sorted({s for track in tracks.values() for s in track}):
        out[time] = {}
        for m, track in tracks.items():
            known = [s for s in track if s <= time]
            if known:
                out[time][m] = track[max(known)]
            elif ahead:
                out[time][m] = track[max(track)]
    return out


def replay(positions, ships, a, b, t, ahead):
    frames = {s: f for s, f in frames_of(positions, ships, t, ahead).items() if t - 1200 * US <= s * US <= t + 600 * US}
    dist = {s: haversine(f[a], f[b]) for s, f in frames.items() if a in f and b in f}
    best = min(dist, key=lambda s: (dist[s], s)) if dist else None
    centre = t if best is None else best * US
    final = {s: f for s, f in frames.items() if centre - 900 * US <= s * US <= centre + 300 * US}
    icon = None
    if final:
        near = min(final, key=lambda s: (abs(s * US - centre), s))
        if a in final[near] and b in final[near]:
            icon = tuple((x + y) / 2 for x, y in zip(final[near][a], final[near][b]))
    return (999999.0 if best is None else dist[best]), centre, icon, {(s, m) for s, f in final.items() for m in f}


@pytest.mark.parametrize("ahead", [False, True])
def test_replays_equal_model(spark, ahead):
    rnd = random.Random(11)
    positions = []
    for m in range(1, 9):
        lat, lon, t = 50 + rnd.random() / 10, rnd.random() / 10, T_US + rnd.randrange(0, 1500 * US)
        for _ in range(rnd.choice([1, 3, 25])):
            positions.append((m, t, lat, lon))
            t, lat, lon = t + rnd.randrange(5 * US, 240 * US), lat + rnd.uniform(-0.01, 0.01), lon + rnd.uniform(-0.01, 0.01)
    pairs = [(1, 2, 900), (2, 3, 1200), (1, 2, 1260), (4, 5, 1500), (6, 9, 1000), (1, 2, 900), (7, 8, 4000)]
    met = spark.createDataFrame(
        [(a, b, T0 + timedelta(seconds=s, microseconds=250000), 0.1, 5.0) for a, b, s in pairs],
        "mmsi_a long, mmsi_b long, timestamp timestamp, cpa double, tcpa double",
    )
    rows = [(m, datetime.fromtimestamp(t / US, timezone.utc), la, lo, 1.0, 2.0, f"S{m}", 10.0) for m, t, la, lo in positions]
    df = spark.createDataFrame(
        rows + rows[:10], "mmsi long, timestamp timestamp, latitude double, longitude double, sog double, cog double, ship_name string, ship_length double"
    )
    # the clock of the model is the one that reached Spark
    positions = [(r.mmsi, r.us, r.latitude, r.longitude) for r in df.withColumn("us", F.unix_micros("timestamp")).collect()]
    built = H.build_scenarios(met, df, look_ahead=ahead)
    members = {1: {1, 2, 3}, 4: {4, 5}, 6: {6, 9}, 7: {7, 8}}
    got = {}
    for r in built.replays.withColumn("us", F.unix_micros("timestamp")).withColumn("m", F.unix_micros("t_min")).collect():
        got.setdefault((*r.focus_mmsi, r.us), []).append(r)
    assert sum(map(len, got.values())) == len(pairs)
    shown = {}
    for r in built.frames.collect():
        shown.setdefault((r.mmsi_a, r.mmsi_b, r.t_us), set()).add((r.frame_s, r.mmsi))
    for a, b, s in pairs:
        t = T_US + s * US + 250000
        ships = next(c for c in members.values() if a in c)
        cpa, centre, icon, where = replay(positions, ships, a, b, t, ahead)
        for r in got[(a, b, t)]:
            assert r.cpa == pytest.approx(cpa) and r.m == centre
            assert (r.icon_lat, r.icon_lon) == (pytest.approx(icon) if icon else (None, None))
            assert r.all_involved_mmsi == sorted(ships)
        assert shown.get((a, b, t), set()) == where
    assert {r.collisions_count for r in built.parents.collect()} == {4, 1}


def test_parent_ids_and_counts(spark, positions):
    met = E.detect_encounters_windowed(P.under_way(positions))
    built = H.build_scenarios(met, positions)
    parents = built.parents.collect()
    assert sum(p.collisions_count for p in parents) == S.read_encounters(met).count() == built.replays.count()
    for p in parents:
        start = int(p.min_ts.replace(tzinfo=timezone.utc).timestamp())
        assert p.scenario_id == f"scenario_{start}_" + "_".join(map(str, p.ships_involved))
        assert p.ships_involved == sorted(p.ships_involved)


def test_hour_by_hour_equals_all_at_once(spark, positions, tmp_path):
    from seawake.sinks import tables as W

    W.write_encounters(E.detect_encounters_windowed(P.under_way(positions)), f"{tmp_path}/e")
    W.write_positions(positions, f"{tmp_path}/p")
    met, stored = spark.read.parquet(f"{tmp_path}/e"), spark.read.parquet(f"{tmp_path}/p")
    start, end = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 01:00:00").cast("timestamp")
    cols = ["scenario_id", "collision_id", "cpa", "t_min", "title"]
    ships = positions.select("mmsi", "dim_a", "dim_b").distinct()
    part = H.build_scenarios(met, stored, ships, start, end)
    lengths = {(r.mmsi, r.ship_length) for r in part.frames.select("mmsi", "ship_length").distinct().collect()}
    assert lengths <= {(r.mmsi, r.dim_a + r.dim_b) for r in ships.where("dim_a is not null").collect()}
    whole = H.build_scenarios(met, stored)
    assert part.replays.count() > 0
    assert sorted(map(tuple, part.replays.select(cols).collect())) == sorted(
        map(tuple, whole.replays.where(F.col("timestamp") < end).select(cols).collect())
    )


def test_hour_bounds(spark):
    met = spark.createDataFrame(
        [(1, 2, T0 + timedelta(minutes=m), c, t) for m, c, t in [(0, 0.29, 0.0), (59, 0.1, 10.0), (60, 0.1, 1.0), (30, 0.3, 1.0), (31, 0.1, 10.1)]],
        "mmsi_a long, mmsi_b long, timestamp timestamp, cpa double, tcpa double",
    )
    got = S.read_encounters(met, F.lit(T0), F.lit(T0 + timedelta(hours=1))).orderBy("timestamp").collect()
    assert [r.collision_id for r in got] == ["1_2_20240101100000", "1_2_20240101105900"]


def test_positions_are_pruned_before_they_are_shuffled(spark, positions):
    """The scan is bounded in time, and other ships' rows go before the exchange."""
    from pyspark.sql import functions as F

    members = spark.createDataFrame([(0, 1, 200000001)], "hour int, component long, mmsi long").withColumn("hour", F.timestamp_seconds(F.lit(1704067200)))
    at = 1704067200_000000 + 900_000000
    moments = members.select("hour", "component", F.lit(at).alias("t_us"))
    out = S.positions_for_encounters(moments, members, positions)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("bucket") :]
    assert "LeftSemi" in below and "timestamp#" in below and ">=" in below and "<" in below
    assert {r["mmsi"] for r in out.select("mmsi").distinct().collect()} <= {200000001}


def test_queries_over_components_detect_once(spark, monkeypatch):
    """Encounters are read from a table where they are grouped and where they are placed."""
    from seawake.checks import history

    seen, members = [], history.S.scenario_members
    monkeypatch.setattr(history.S, "scenario_members", lambda met: seen.append(met) or members(met))
    for query in (history.edges_in_component, history.scenario_summary):
        assert query(spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 2 and all("/chosen-" in f for met in seen for f in met.inputFiles())
