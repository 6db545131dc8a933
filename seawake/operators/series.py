"""Time-series building blocks.

One ship may send a third of all rows, so no window here is partitioned by ship
alone. A series is cut into time slices; a window runs inside ``(ship, slice)``
and what has to cross slices travels in a small table with one row per slice,
built by a partial aggregation. Slices in which a ship sends very much are cut further,
by counted rows, so that a window holds a bounded number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seawake import config as C


def slice_of(ts: Column, seconds: int = C.SLICE_S) -> Column:
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000)).cast("long")


def busy_slices(rows: DataFrame, key: str, ts: str, seconds: int, max_rows: int) -> DataFrame:
    """``(key, _coarse, _parts)``: slices with more rows than one task should order, and into how
    many parts to cut them so that those of the busiest sixtieth hold few enough."""
    step = F.floor(F.unix_micros(ts) * 60 / (seconds * 1_000_000)).cast("long")
    counts = rows.groupBy(key, step.alias("_step")).agg(F.count("*").alias("_n"))
    busiest = counts.groupBy(key, F.floor(F.col("_step") / 60).cast("long").alias("_coarse")).agg(F.max("_n").alias("_n"), F.sum("_n").alias("_all"))
    parts = F.least(F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_n") * 60 / max_rows))), F.lit(float(MAX_PARTS))).cast("long")
    return busiest.where(F.col("_all") > max_rows).select(key, "_coarse", parts.alias("_parts"))


def with_slices(df: DataFrame, busy: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Adds ``_slice``, which grows with time; busy slices are cut into equal parts. The busy
    ones are few, so that the join is usually a broadcast; AQE decides by their size."""
    us = F.unix_micros(ts)
    rows = df.withColumn("_coarse", slice_of(F.col(ts), seconds)).join(busy, [key, "_coarse"], "left")
    within = us - F.col("_coarse") * (seconds * 1_000_000)
    part = F.floor(within / (seconds * 1_000_000) * F.coalesce("_parts", F.lit(1))).cast("long")
    return rows.withColumn("_slice", F.col("_coarse") * MAX_PARTS + part).drop("_coarse", "_parts")


#: Parts of a slice at most.
MAX_PARTS = 1 << 20


def tumbling(df: DataFrame, seconds: int, ts: str = "timestamp") -> DataFrame:
    """Adds the fixed window ``[window_start, window_end)`` the row falls in."""
    w = F.window(ts, f"{seconds} seconds")
    return df.withColumn("_w", w).select(
        *df.columns, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")
    )


def newest(df: DataFrame, keys: list[str], order: list[str], oldest: bool = False) -> DataFrame:
    """One whole row per key, the greatest (or smallest) by ``order``, remaining
    columns breaking ties. An aggregation, so a hot key is combined map-side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    pick = F.min(row) if oldest else F.max(row)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(
        *[f"_row.{c}" if c not in keys else c for c in df.columns]
    )


def last_known(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    fact_columns: list[str],
    ts: str = "timestamp",
    slice_seconds: int = C.SLICE_S,
    slice_rows: int = C.SLICE_ROWS,
) -> DataFrame:
    """As-of join: each row gets the newest fact of its key at or before its time.

    ``facts`` has ``key``, ``ts`` and ``fact_columns``. The big side is shuffled
    once, by ``(key, slice)``; facts older than the slice arrive as one carried row.
    """
    fact = F.struct(F.col(ts).alias("_at"), *fact_columns)
    busy = busy_slices(rows, key, ts, slice_seconds, slice_rows)
    facts = with_slices(facts.select(key, ts, fact.alias("_fact")), busy, key, ts, slice_seconds)
    columns = rows.columns
    rows = with_slices(rows, busy, key, ts, slice_seconds)

    slots = (
        rows.select(key, "_slice", F.lit(None).cast(facts.schema["_fact"].dataType).alias("_fact"))
        .unionByName(facts.select(key, "_slice", "_fact"))
        .groupBy(key, "_slice")
        .agg(F.max("_fact").alias("_fact"))
    )
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(key, "_slice", F.last("_fact", ignorenulls=True).over(earlier).alias("_carried"))

    both = rows.withColumn("_is_row", F.lit(True)).unionByName(
        facts.withColumn("_is_row", F.lit(False)), allowMissingColumns=True
    )
    # facts sort before rows of the same instant
    in_slice = (
        Window.partitionBy(key, "_slice")
        .orderBy(F.col(ts), F.col("_is_row"), F.col("_fact"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        both.join(carried, [key, "_slice"], "left")
        .withColumn("_found", F.coalesce(F.last("_fact", ignorenulls=True).over(in_slice), F.col("_carried")))
        .where("_is_row")
        .select(*columns, *[F.col("_found")[c].alias(c) for c in fact_columns])
    )


def ranked_newest_first(
    df: DataFrame,
    key: str,
    ts: str = "timestamp",
    ties: tuple[str, ...] = (),
    slice_seconds: int = C.SLICE_S,
    slice_rows: int = C.SLICE_ROWS,
) -> DataFrame:
    """Adds ``recency`` (1 = newest of its key) and ``n_points``.

    Ranks are taken inside slices and shifted by the counts of the later slices.
    """
    rows = with_slices(df, busy_slices(df, key, ts, slice_seconds, slice_rows), key, ts, slice_seconds)
    counts = rows.groupBy(key, "_slice").agg(F.count("*").alias("_n"))
    later = Window.partitionBy(key).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        key,
        "_slice",
        F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"),
        F.sum("_n").over(Window.partitionBy(key)).alias("n_points"),
    )
    in_slice = Window.partitionBy(key, "_slice").orderBy(F.desc(ts), *[F.desc(t) for t in ties])
    return (
        rows.join(counts, [key, "_slice"])
        .withColumn("recency", (F.row_number().over(in_slice) + F.col("_later")).cast("long"))
        .drop("_slice", "_later")
        .select(*df.columns, "recency", "n_points")
    )


def latest_report_times(df: DataFrame, key: str = "mmsi", ts: str = "timestamp") -> DataFrame:
    return df.groupBy(key).agg(F.max(ts).alias("_latest"))


def recent(df: DataFrame, minutes: int = C.HISTORY_MINUTES, as_of: Column | None = None) -> DataFrame:
    """Rolling history. With ``as_of`` a plain range filter that reaches the scan;
    without it each ship's history is counted back from its own newest report."""
    if as_of is not None:
        return df.where((F.col("timestamp") >= as_of - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("timestamp") <= as_of))
    newest_of = latest_report_times(df)
    return (
        df.join(newest_of, "mmsi")
        .where(F.col("timestamp") >= F.col("_latest") - F.expr(f"INTERVAL {minutes} MINUTES"))
        .select(*df.columns)
    )


def retain(df: DataFrame, ttl_seconds: int, as_of: Column, ts: str = "timestamp") -> DataFrame:
    return df.where(F.col(ts) > as_of - F.make_dt_interval(secs=F.lit(float(ttl_seconds))))
