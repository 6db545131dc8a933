"""Streams over file sources agree with the batch operators on the same rows."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from seawake import schema as S
from seawake.operators import encounters as E
from seawake.operators import enrich as N
from seawake.operators import parse as P
from seawake.operators import series
from seawake.operators import tracks as K
from seawake.operators import views as V
from seawake.sinks import segments as G
from seawake.sinks import tables as W
from seawake.sources import files as R
from seawake.streaming import jobs as J

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def in_time_order(df, path, parts=3):
    """Files that a stream reads one by one in time order: written one after the other."""
    df = df.withColumn("_s", F.unix_timestamp("timestamp"))
    lo, hi = df.agg(F.min("_s"), F.max("_s")).first()
    step = (hi - lo) // parts + 1
    for i in range(parts):
        part = df.where((F.col("_s") >= lo + i * step) & (F.col("_s") < lo + (i + 1) * step)).drop("_s")
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def stream_of(spark, path, per_batch=1):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def finish(query):
    query.awaitTermination(180)
    assert query.exception() is None


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def statics(positions):
    first = positions.groupBy("mmsi").agg(F.min_by(F.struct("timestamp", *S.DIMS), "timestamp").alias("r"))
    base = first.select("mmsi", "r.*").where("mmsi % 4 <> 0")
    early = base.withColumn("ship_name", F.concat(F.lit("A"), F.col("mmsi").cast("string")))
    late = base.where("mmsi % 3 = 0").withColumn("ship_name", F.lit("LATER")).withColumn(
        "timestamp", F.col("timestamp") + F.expr("INTERVAL 300 SECONDS")
    )
    return early.unionByName(late)


def enriched(stream, tmp_path):
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch_id={batch_id}")

    finish(
        J.enrich_stream(stream.where("is_static is null").drop("is_static"), stream.where("is_static"), f"{tmp_path}/facts", f"{tmp_path}/c", write, J.ONCE)
    )


def test_equal_instants_take_the_greatest_fact(spark, tmp_path):
    """Ties within a batch and across batches, whatever file they come in; null times; the batch join agrees."""
    ddl = "mmsi long, ship_name string, dim_a double, dim_b double, dim_c double, dim_d double, timestamp timestamp, latitude double, is_static boolean"

    def fact(ship, name, second):
        return (ship, name, 1.0, 1.0, 1.0, 1.0, None if second is None else T0 + timedelta(seconds=second), None, True)

    def report(ship, second):
        return (ship, None, None, None, None, None, T0 + timedelta(seconds=second), 50.0, None)

    files = [
        [fact(1, "M", 5), fact(1, "Z", 5), fact(1, "A", 5), report(1, 5), report(1, 4), fact(2, "B", 7), fact(3, "X", None)],
        [fact(2, "C", 7), report(2, 8), report(1, 9), report(3, 9)],
        [fact(2, "A", 7), report(2, 9), fact(1, "Q", 9), report(1, 9)],
    ]
    for rows_of in files:
        spark.createDataFrame(rows_of, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    enriched(stream_of(spark, f"{tmp_path}/in"), tmp_path)
    got = sorted((r.mmsi, int((r.timestamp.replace(tzinfo=timezone.utc) - T0).total_seconds()), r.ship_name) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 4, "Unknown"), (1, 5, "Z"), (1, 9, "Q"), (1, 9, "Z"), (2, 8, "C"), (2, 9, "C"), (3, 9, "Unknown")]


def test_a_batch_of_days_knows_all_its_facts(spark, tmp_path):
    """Reports of a batch see its facts even where the log folds them afterwards."""
    from seawake.streaming import state

    def at(hour):
        return T0 + timedelta(hours=hour)

    facts = spark.createDataFrame([(1, at(h), f"N{h}", None, None, None, None) for h in (0, 10, 60)], state.FACTS)
    reports = spark.createDataFrame([(1, at(h)) for h in (1, 11, 61)], "mmsi long, timestamp timestamp")
    named = state.with_facts(reports, facts, f"{tmp_path}/facts", 0)
    assert sorted(r.ship_name for r in named.collect()) == ["N0", "N10", "N60"]
    later = state.with_facts(reports.where("hour(timestamp) = 13"), facts.limit(0), f"{tmp_path}/facts", 1)
    assert [r.ship_name for r in later.collect()] == ["N60"]
    assert sorted(r.ship_name for r in G.read_newest(spark, f"{tmp_path}/facts", state.FACTS).collect()) == ["N10", "N60"]


def test_old_facts_are_folded(spark):
    from seawake.streaming import state

    def facts(*seconds):
        return spark.createDataFrame([(1, T0 + timedelta(seconds=s), f"N{s}", None, None, None, None) for s in seconds], state.FACTS)

    kept = state.merge_facts(facts(1, 2, 3, 50), facts(100, 101), kept_s=60)
    assert sorted(r.ship_name for r in kept.collect()) == ["N100", "N101", "N3", "N50"]


def test_enrich_stream_equals_batch(spark, positions, statics, tmp_path):
    bare = positions.drop("ship_name", *S.DIMS)
    both = bare.unionByName(statics.withColumn("is_static", F.lit(True)), allowMissingColumns=True)
    stream = stream_of(spark, in_time_order(both, f"{tmp_path}/in"))
    enriched(stream, tmp_path)
    cols = ["mmsi", "timestamp", "ship_name", *S.DIMS]
    got = rows(spark.read.parquet(f"{tmp_path}/out"), *cols)
    want = rows(N.enrich_asof(positions, statics), *cols)
    assert got == want and any(r[2] == "LATER" for r in got) and any(r[2] == "Unknown" for r in got)


def test_track_stream_equals_batch(spark, positions, tmp_path):
    stream, sizes = stream_of(spark, in_time_order(positions, f"{tmp_path}/in", 4)), []

    def each(batch, k):
        history = J.add_history(J.instants(batch), f"{tmp_path}/history", k, minutes=5, fold=2)
        seen = J.current_of(J.recent_history(history, 5))
        sizes.append(sum(s.rows for s in G.segments_of(spark, f"{tmp_path}/history")))
        seen.write.mode("overwrite").parquet(f"{tmp_path}/seen/{k}")

    finish(stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
    cols = ["mmsi", "timestamp", "latitude", "longitude", "sog", "cog", "n_points"]
    last = spark.read.parquet(f"{tmp_path}/seen/{len(sizes) - 1}")
    assert rows(last, *cols) == rows(K.current_states(series.recent(positions, 5)), *cols)
    assert len(sizes) == 4


def test_history_segments_are_dropped_whole(spark, tmp_path):
    """A batch appends a segment; old ones go, but for the last reports of silent ships."""

    def batch(*reports):
        data = [(m, T0 + timedelta(minutes=t), 50.0, 0.0, 5.0, 0.0) for m, t in reports]
        return J.instants(spark.createDataFrame(data, "mmsi long, timestamp timestamp, latitude double, longitude double, sog double, cog double"))

    path = f"{tmp_path}/h"
    for k in range(6):
        more = [(7, 0), (7, 1)] if k == 0 else []
        history = J.add_history(batch((1, 2 * k), (2, 2 * k), *more), path, k, minutes=3, fold=2)
    found = G.segments_of(spark, path)
    assert [s.folder for s in found if s.folder.endswith("-carried")] and len(found) < 6
    got = {r.mmsi: r.n for r in J.recent_history(history, 3).groupBy("mmsi").agg(F.sum("n").alias("n")).collect()}
    assert got == {1: 2, 2: 2, 7: 2}
    before = rows(history, "mmsi", "timestamp", "n")
    repeated = J.add_history(batch((1, 10), (2, 10)), path, 5, minutes=3, fold=2)
    assert rows(repeated, "mmsi", "timestamp", "n") == before


def test_encounters_stream_equals_batch(spark, positions, tmp_path):
    source = P.under_way(positions)
    stream = stream_of(spark, in_time_order(source, f"{tmp_path}/in"))
    out = f"{tmp_path}/encounters"
    finish(J.encounters_stream(stream, out, f"{tmp_path}/c", trigger=J.ONCE))
    cols = ["mmsi_a", "mmsi_b", "timestamp", "cpa", "tcpa"]
    newest = source.agg(F.max("timestamp")).first()[0]
    batch = E.detect_encounters_windowed(source).where(F.col("window_end") <= F.lit(newest))
    assert rows(W.read_table(spark, out, S.ENCOUNTERS), *cols) == rows(batch, *cols)
    assert batch.count() > 0


def test_late_rows_are_discarded(spark, tmp_path):
    def batch(n, *seconds):
        data = [(1, "S", 50.0, 0.0, 0.0, 5.0, T0 + timedelta(seconds=s)) for s in seconds]
        spark.createDataFrame(data, "mmsi long, ship_name string, latitude double, longitude double, cog double, sog double, timestamp timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    batch(0, 1, 5)
    stream = stream_of(spark, f"{tmp_path}/in")
    agg = J.latest_per_window(stream)

    def run():
        finish(agg.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out"))

    run()
    batch(1, 25)
    run()
    batch(2, 3, 40)  # second 3 belongs to a window that is closed by now
    run()
    got = [r.timestamp for r in spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").collect()]
    assert [int((t.replace(tzinfo=timezone.utc) - T0).total_seconds()) for t in got] == [5, 25]


def test_first_per_ship_stream(spark, statics, tmp_path):
    stream = stream_of(spark, in_time_order(statics, f"{tmp_path}/in"))
    for forever in (True, False):
        out = f"{tmp_path}/out{forever}"
        finish(
            J.first_per_ship_stream(stream, forever=forever).writeStream.format("parquet")
            .option("checkpointLocation", f"{tmp_path}/c{forever}").trigger(availableNow=True).start(out)
        )
        assert rows(spark.read.parquet(out), "mmsi", "ship_name") == rows(N.first_per_ship(statics), "mmsi", "ship_name")


def test_messages_stream_two_branches(spark, positions, tmp_path):
    messages = W.to_message_text(positions.withColumn("ship_name", F.when(F.col("ship_name") == "Unknown", F.lit(" unknown ")).otherwise(F.col("ship_name"))))
    messages.repartition(2).write.text(f"{tmp_path}/in")
    stream = R.read_messages(spark, f"{tmp_path}/in", maxFilesPerTrigger=1)
    finish(J.messages_stream(stream, f"{tmp_path}/pos", f"{tmp_path}/snap", f"{tmp_path}/c", trigger=J.ONCE))
    stored = W.read_table(spark, f"{tmp_path}/pos", S.POSITIONS)
    assert stored.count() == positions.count()
    snapshot = R.read_static_snapshot(spark, f"{tmp_path}/snap")
    complete = positions.where("dim_a is not null and ship_name <> 'Unknown'")
    assert rows(snapshot, "mmsi") == rows(complete.distinct(), "mmsi") or snapshot.count() == complete.select("mmsi").distinct().count()


def test_snapshot_stream_merges(spark, statics, tmp_path):
    stream = stream_of(spark, in_time_order(statics, f"{tmp_path}/in"))
    finish(J.snapshot_stream(stream, f"{tmp_path}/snap", f"{tmp_path}/c", trigger=J.ONCE))
    want = series.newest(statics, ["mmsi"], ["timestamp"])
    assert rows(R.read_static_snapshot(spark, f"{tmp_path}/snap"), *S.STATIC_FIELDS) == rows(want, *S.STATIC_FIELDS)


def test_latest_state_and_refresh(spark, positions, tmp_path):
    stream = stream_of(spark, in_time_order(positions, f"{tmp_path}/in", 2))
    folder = f"{tmp_path}/state"
    finish(J.latest_state_stream(stream, folder, f"{tmp_path}/c1", trigger=J.ONCE))
    latest = K.last_per_key(positions)
    assert rows(J.read_state(spark, f"{folder}/ships"), "mmsi", "timestamp") == rows(latest, "mmsi", "timestamp")
    met = E.detect_encounters_live(latest)
    assert rows(J.read_state(spark, f"{folder}/encounters"), "id", "cpa") == rows(met, "id", "cpa")
    finish(J.refresh_stream(stream, folder, f"{tmp_path}/c2", trigger=J.ONCE))
    tracks = K.predict_track(series.recent(positions))
    assert rows(J.read_state(spark, f"{folder}/tracks"), "mmsi", "step", "latitude") == rows(tracks, "mmsi", "step", "latitude")
    assert J.read_state(spark, f"{folder}/risks").count() == met.count()


def test_encounters_follow_changed_ships(spark, positions, tmp_path):
    """After every batch the table is what a whole recomputation gives, and a batch of few ships
    writes the buckets of these and of their partners only."""
    folder, parts = f"{tmp_path}/state", 4
    second = F.unix_timestamp("timestamp")
    lo, hi = positions.agg(F.min(second), F.max(second)).first()
    one, total = positions.agg(F.max("mmsi")).first()[0], None
    for k in range(parts):
        at = positions.where((second >= lo + k * (hi - lo) // parts) & (second <= lo + (k + 1) * (hi - lo) // parts))
        batch = series.newest(at if k < parts - 1 else at.where(F.col("mmsi") == one), ["mmsi"], ["timestamp"]).persist()
        schema = J._table(batch)
        G.upsert(batch, f"{folder}/ships", k, schema, lambda old, new: series.newest(old.unionByName(new), ["mmsi"], ["timestamp"]), ["mmsi"])
        ships = G.read_newest(spark, f"{folder}/ships", schema)
        written = J.update_encounters(ships, batch.select("mmsi"), f"{folder}/encounters", k)
        whole = E.detect_encounters_live(ships)
        assert rows(J.read_state(spark, f"{folder}/encounters"), *whole.columns) == rows(whole, *whole.columns)
        total = total or len(written)
    assert len(written) < total


def test_static_table_remembers_a_row_per_ship(spark, tmp_path):
    """Not one per ship and window; a file that comes a batch late counts, one of two batches does not."""
    schema = "mmsi long, timestamp timestamp, ship_name string, dim_a double, dim_b double, dim_c double, dim_d double"
    parts = [range(0, 100), range(200, 300), range(100, 200), range(0, 1), range(300, 306)]  # seconds of the files, a batch each
    new_at = {1: 0, 2: 250, 3: 150, 4: 301, 5: 298}  # ship 6 is only in the fourth file, which is two batches late
    for n, seconds in enumerate(parts):
        found = [(s, T0 + timedelta(seconds=t), f"{s}-{t}", 9.0, None, 0.0, 1.0) for t in seconds for s, first in new_at.items() if t >= first and n != 3]
        found += [(6, T0, "late", 9.0, 1.0, 1.0, 1.0)] if n == 3 else []
        spark.createDataFrame(found, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = J.static_table_stream(stream_of(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c", seconds=10, trigger=J.ONCE)
    finish(query)
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "mmsi", "ship_name")
    # the newest row of each ship's first window; that of ship 4 has not closed
    assert got == [(1, "1-9"), (2, "2-259"), (3, "3-159"), (5, "5-299")]
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    assert max(held) <= len(new_at)
    waiting = G.segments_of(spark, f"{tmp_path}/c-waiting")
    assert sum(s.rows for s in waiting) == 1


def crossing(spark, numbers, minute):
    """Ships near two places that all meet: dense traffic, so many more pairs than ships."""
    found = [(n, f"S{n}", 50.0 + n % 2 * 5 + n / 1e5, n % 7 / 1e3, 90.0 + 180 * (n % 3 % 2), 5.0 + n % 4, T0 + timedelta(minutes=minute)) for n in numbers]
    return spark.createDataFrame(found, "mmsi long, ship_name string, latitude double, longitude double, cog double, sog double, timestamp timestamp")


def test_pairs_are_kept_once_and_where_they_are_found(spark, tmp_path, monkeypatch):
    """New pairs stand beside the known ones, which are written anew only where one is lost or
    a bucket has many segments; no shuffle takes part in it."""
    monkeypatch.setattr(J.C, "BUCKET_SEGMENTS", 2, raising=False)
    folder, state, before = f"{tmp_path}/encounters", {}, []
    for k, numbers in enumerate([range(40), range(40, 80), [3], [80]]):  # only ship 3 was there before
        batch = crossing(spark, numbers, k)
        state |= {r.mmsi: r for r in batch.collect()}
        ships = spark.createDataFrame(list(state.values()), batch.schema)
        J.update_encounters(ships, batch.select("mmsi"), folder, k)
        whole, now = E.detect_encounters_live(ships), G.segments_of(spark, folder)
        assert rows(J.read_state(spark, folder), *whole.columns) == rows(whole, *whole.columns)
        assert sum(s.rows for s in now) == whole.count() > 5 * len(state)
        assert k > 1 or set(before) <= set(now)
        assert all(sum(s.bucket == b for s in now) <= 3 for b in {s.bucket for s in now})
        before = now
    plan = J._by_cell(E.meetings_live(ships, changed=batch.select("mmsi")))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortMergeJoin") < plan.index("Exchange")


def test_risks_follow_encounters_of_changed_ships(spark, tmp_path):
    """Also those of pairs that were carried over when others of their bucket were lost."""
    folder = f"{tmp_path}/state"
    for k, numbers in enumerate([range(30), [3, 40]]):
        crossing(spark, numbers, k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stream_of(spark, f"{tmp_path}/in")
        finish(J.latest_state_stream(stream, folder, f"{tmp_path}/c1", trigger=J.ONCE))
        finish(J.refresh_stream(stream, folder, f"{tmp_path}/c2", trigger=J.ONCE))
        latest = K.last_per_key(spark.read.parquet(f"{tmp_path}/in"))
        want = V.assess_risk(E.detect_encounters_live(latest))
        assert rows(J.read_state(spark, f"{folder}/risks"), "collision_id", "overall_risk") == rows(want, "collision_id", "overall_risk")
    assert any("-rest" in s.folder for s in G.segments_of(spark, f"{folder}/encounters") if s.rows)
