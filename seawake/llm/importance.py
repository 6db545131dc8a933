"""Quality by importance resampling.

Two bag-of-n-grams models over hashed words and word pairs, of target text and of the raw
corpus, give each document the log of the ratio of its likelihoods. Documents are sampled
without replacement in proportion to that ratio: Gumbel noise is added to the log, and
the k greatest are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import batch, map_arrow, slices, windows, word_hashes
from seawake.session import stored

#: Buckets of n-grams.
BUCKETS = 1 << 14
#: Labelled documents that the target model is counted on, at most.
TARGET_ROWS = 20_000
SEED = 20
COUNTS = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])
WEIGHTS = pa.schema([("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64())])


def buckets_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of all texts, and the text of each."""
    hashes, bounds = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    pairs = windows(hashes, 2)
    same = row[1:] == row[:-1]
    every = np.concatenate([hashes, pairs[same]])
    return (every % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, row[1:][same]])


def log_ratios(docs: DataFrame, targets: DataFrame) -> np.ndarray:
    """Log of target over raw probability of each bucket, each count raised by one. The raw
    model counts every document of ``docs``, the target model those in ``targets`` (doc_id)."""
    marked = docs.join(F.broadcast(targets.withColumn("target", F.lit(True))), "doc_id", "left")  # TARGET_ROWS at most

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part, texts in slices(batches):
            bucket, row = buckets_of(texts)
            raw += np.bincount(bucket, minlength=BUCKETS)
            is_target = np.array(part.column(1).fill_null(False).to_pylist(), bool)
            target += np.bincount(bucket[is_target[row]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield batch(COUNTS, some, raw[some], target[some])

    totals = map_arrow(marked.select("text", "target"), count, COUNTS).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = totals.toArrow().to_pandas()  # BUCKETS rows at most
    counts = np.ones((2, BUCKETS))
    counts[:, found["bucket"].to_numpy(np.int64)] += found[["target", "raw"]].to_numpy(float).T
    shares = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return shares[0] - shares[1]


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    def weigh(batches):
        for part, texts in slices(batches):
            bucket, row = buckets_of(texts)
            n = np.bincount(row, minlength=len(texts))
            yield batch(WEIGHTS, part.column(0), n, np.bincount(row, held.value[bucket], len(texts)))

    return map_arrow(docs.select("doc_id", "text"), weigh, WEIGHTS)


def gumbel(*keys: str) -> Column:
    """Standard Gumbel noise that depends on the keys alone."""
    uniform = (F.pmod(F.xxhash64(*keys, F.lit(SEED)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def kth_greatest(df: DataFrame, key: str, k: int, steps: int = 6, parts: int = 4096) -> float:
    """The k-th greatest value of a double column, exactly: the range that holds it is
    divided until it is a single value. Each step counts at most ``parts`` ranges."""
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if n == 0 or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    while lo < hi:
        width = (hi - lo) / parts
        value = F.col(key)
        part = F.least(F.floor((value - lo) / width), F.lit(parts - 1)) if width > 0 else F.lit(0).cast("long")
        rows = df.where(value.between(lo, hi)).groupBy(part.alias("part")).agg(
            F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")
        ).collect()
        for row in sorted(rows, key=lambda r: -r["part"]):
            if above + row["n"] >= k:
                if (row["lo"], row["hi"]) == (lo, hi):  # neighbouring doubles: take the greater if they suffice
                    top = df.where(value == hi).count()
                    return hi if above + top >= k else lo
                lo, hi = row["lo"], row["hi"]
                break
            above += row["n"]
    return lo


def target_sample(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """At most ``rows`` doc_ids labelled good, the first in the order of a hash."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """``(doc_id, n_grams, log_weight, key, kept)`` for every row of ``docs`` (doc_id, text; other
    columns are ignored). ``labels`` (doc_id, quality) name the target documents.

    Kept are the k documents with the greatest key, k being ``share`` of the documents, by
    default the share of good ones among the labelled. Documents tied with the last are
    kept too, repeated rows among them. A null or empty text has the log weight 0, as one of
    which nothing is known. Without labels all are kept. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if share is None:
        known = labels.where("quality IS NOT NULL").agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        share = 1.0 if known is None else known
    weights = log_weights(docs, log_ratios(docs, target_sample(labels)))
    keyed = stored(weights.withColumn("key", F.col("log_weight") + gumbel("doc_id")), "weights")
    least = kth_greatest(keyed, "key", round(share * keyed.count()))
    return keyed.withColumn("kept", F.col("key") >= F.lit(least))
