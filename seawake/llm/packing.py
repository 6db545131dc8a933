"""Best-fit packing by minimum bin slack.

A sequence is planned at a time: the longest piece left, and the fullest combination of
other lengths that fits beside it, found by a subset-sum over the available lengths in a
bitset. The combination is removed as often as the supply of its lengths allows, so every
plan uses up a length: there are no more plans than lengths. Only the histogram of
lengths, whose size is the capacity, is planned with; the pieces themselves are ranked
within their length and find their place by rank, in parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seawake.llm import tokens
from seawake.llm.common import batch, map_arrow, slices
from seawake.session import stored

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())]
)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens: full ones, the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *[(s, capacity) for s in range(first, n, capacity)]]


def fullest(supply: dict[int, int], room: int) -> dict[int, int]:
    """How often to take which length so that their sum is the largest not over ``room``.

    ``reach`` has a bit for each sum that the lengths so far can make. A length that may
    be taken k times enters as 1, 2, 4, ... and a rest of copies.
    """
    reach, steps, mask = 1, [], (1 << room + 1) - 1
    for length in sorted((x for x in supply if x <= room and supply[x]), reverse=True):
        left, k = min(supply[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << length * k) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + k
            total -= length * k
    return taken


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(number of sequences, {length: pieces of it in each})`` until no piece is left."""
    supply = {x: c for x, c in histogram.items() if c}
    out = []
    while supply:
        seed = max(supply)
        supply[seed] -= 1
        mixture = fullest(supply, capacity - seed)
        supply[seed] += 1
        mixture[seed] = mixture.get(seed, 0) + 1
        times = min(supply[x] // k for x, k in mixture.items())
        for x, k in mixture.items():
            supply[x] -= times * k
            if not supply[x]:
                del supply[x]
        out.append((times, mixture))
    return out


def slots(plans: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows ``length, first rank, first sequence, offset`` in order of length and rank:
    ranks from the first one on go to that place of one sequence after the other."""
    used, rows, sequence = {}, [], 0
    for times, mixture in plans:
        offset = 0
        for length in sorted(mixture, reverse=True):
            for _ in range(mixture[length]):
                rows.append((length, used.get(length, 0), sequence, offset))
                used[length] = used.get(length, 0) + times
                offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece, with its rank among the task's pieces of the same length."""

    def emit(batches):
        part, seen, tail = TaskContext.get().partitionId(), {}, np.uint32(end_id).tobytes()
        for b, texts in slices(batches):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), tokens.encode(texts, tokenizer), strict=True):
                ids = memoryview(ids + tail)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rank = seen[length] = seen.get(length, -1) + 1
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, rank))
            yield batch(PIECES, *map(list, zip(*rows, strict=True)))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), emit, PIECES)


PLACED = pa.schema([*[f for f in PIECES if f.name not in ("part", "rank")], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece of
    ``docs`` (doc_id, text; other columns are ignored) in sequences of at most ``capacity`` tokens.

    A document's tokens are its ids and ``end_id``; only longer documents are cut, and
    their first piece may be shorter. A null or empty text has the one token ``end_id``.
    Repeated rows and rows without doc_id are packed like any other; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    table = stored(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = table.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # ``capacity`` rows at most
    where = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))

    def place(batches):
        at = where.value
        key = (at[:, 0] << 40) + at[:, 1]
        for b in batches:
            rank = b.column(len(PLACED) - 2).to_numpy()
            k = np.searchsorted(key, (b.column(3).to_numpy() << 40) + rank, "right") - 1
            yield batch(PLACED, *b.columns[: len(PLACED) - 2], at[k, 2] + rank - at[k, 1], at[k, 3])

    ranked = table.join(counts.select("length", "part", "before"), ["length", "part"])
    columns = [f.name for f in PLACED if f.name in table.columns]
    return map_arrow(ranked.select(*columns, (F.col("before") + F.col("rank")).alias("rank")), place, PLACED)
