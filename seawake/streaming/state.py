"""What streams remember of the ships' static data: a log of facts by ship and time.

Each micro-batch merges its static rows into the log, which is dealt to buckets by ship, and
its positions read the log as of their own times, by the same as-of join as in a batch job.
So rows of a micro-batch need no order, a loud ship spreads over tasks by time, and the
result does not depend on which batch or file a row came in, but for static rows that
arrive after the positions they would have told of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seawake import config as C
from seawake import schema as S
from seawake.operators.enrich import enrich_asof
from seawake.sinks import segments as G

_FIELDS = ["ship_name", *S.DIMS]
FACTS = T.StructType(
    [T.StructField("mmsi", T.LongType()), T.StructField("timestamp", T.TimestampType()), T.StructField("ship_name", T.StringType()), *[T.StructField(d, T.DoubleType()) for d in S.DIMS]]
)


def _all_facts(known: DataFrame, rows: DataFrame) -> DataFrame:
    """All facts of both, one per ship and instant: the greatest."""
    names = FACTS.fieldNames()
    both = known.select(names).union(rows.select(names)).where("mmsi IS NOT NULL AND timestamp IS NOT NULL")
    return both.groupBy("mmsi", "timestamp").agg(F.max(F.struct(*_FIELDS)).alias("_fact"))


def merge_facts(known: DataFrame, rows: DataFrame, kept_s: int = C.FACTS_KEPT_S) -> DataFrame:
    """All facts of both, one per ship and instant: the greatest. Those of more than ``kept_s``
    before a ship's newest one are reduced to the last of them."""
    facts = _all_facts(known, rows)
    newest = facts.groupBy("mmsi").agg((F.max("timestamp") - F.make_dt_interval(secs=F.lit(float(kept_s)))).alias("_from"))
    aged = facts.join(newest, "mmsi")
    last = aged.where(F.col("timestamp") < F.col("_from")).groupBy("mmsi").agg(F.max(F.struct("timestamp", "_fact")).alias("_l"))
    recent = aged.where(F.col("timestamp") >= F.col("_from")).select("mmsi", "timestamp", "_fact")
    return recent.union(last.select("mmsi", "_l.timestamp", "_l._fact")).select("mmsi", "timestamp", "_fact.*")


def with_facts(positions: DataFrame, statics: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Positions of a micro-batch with the static data known at their times: by the log before
    the batch and all of the batch's own static rows, as a batch may span more time than the
    log keeps. Only buckets of its ships are read."""
    spark = positions.sparkSession
    G.upsert(statics.where("mmsi IS NOT NULL AND timestamp IS NOT NULL"), path, batch_id, FACTS, merge_facts, ["mmsi"])
    known = G.read_buckets(spark, path, FACTS, G.buckets_of(positions, "mmsi"), before=batch_id)
    return enrich_asof(positions, _all_facts(known, statics).select("mmsi", "timestamp", "_fact.*"))
