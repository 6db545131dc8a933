"""Helpers of the operators: tables, Arrow batches, vectorised word hashes."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Text that a task works on at a time; the arrays made of it are some fifty times as large.
SLICE_BYTES = 1 << 18


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable, schema: pa.Schema | StructType) -> DataFrame:
    """``mapInArrow`` with an Arrow schema, or Spark's. Workers live on after a task, so that each
    task hands the memory it has freed back to the system."""

    def tidy(batches):
        yield from fn(batches)
        give_back()

    return df.mapInArrow(tidy, schema if isinstance(schema, StructType) else from_arrow_schema(schema))


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # not this C library: it keeps what it has freed


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


#: Rows of an Arrow batch while an operator works: texts of some thousand characters each.
BATCH_ROWS = "2000"


def small_batches(spark: SparkSession) -> None:
    """Small Arrow batches from now on, for rows that a caller asks for later. Results are the
    same with any size; batches of Spark's 10,000 texts are held several times per task, in the
    JVM and in its Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within this, the shuffle files of a query go when it has ended, not when the driver
    next collects garbage, and Arrow batches are small. What later steps read is a table by
    then. The session's settings are as before afterwards."""
    held = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the worker process, whatever task runs in it."""
    holder = sys.modules.setdefault("_worker_cache", types.ModuleType("_worker_cache"))
    return holder.__dict__.setdefault(name, {})


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with about ``max_bytes`` of text each, at least one row, and
    their texts; a null text is empty."""
    for b in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy()
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // max_bytes)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            if hi > lo:
                part = b.slice(lo, hi - lo)
                yield part, [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


#: Bytes that part words: white space, or all that is neither letter nor digit (bytes
#: above 127 belong to letters).
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
NOT_ALNUM = ~np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def word_hashes(texts: list[bytes], parts: np.ndarray = WHITE, lower: bool = True, spans: bool = False, first_bytes: int = 0):
    """64-bit hashes of the words of all texts and the bounds of each text in them.

    A word's hash is a sum of byte values times position values, all from fixed random
    streams, scrambled. Returns ``(hashes, bounds)``: the words of text i are
    ``hashes[bounds[i]:bounds[i + 1]]``. With ``first_bytes`` only so much of each word
    counts; with ``spans`` the words' byte offsets in their texts are returned too.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    inside = ~parts[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends_of_texts, "left")])
    if not len(starts):
        empty = np.zeros(0, np.uint64)
        return (empty, bounds, starts, ends) if spans else (empty, bounds)
    values = random_words(256, 1)
    if lower:
        values[65:91] = values[97:123]
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    terms = values[data[inside]] * random_words(int(lengths.max()), 2)[place]
    if first_bytes:
        terms[place >= first_bytes] = 0
        lengths = np.minimum(lengths, first_bytes)
    hashes = mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))
    if not spans:
        return hashes, bounds
    base = np.repeat(ends_of_texts - [len(t) + 1 for t in texts], np.diff(bounds))
    return hashes, bounds, starts - base, ends - base


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; empty if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = random_words(width, 3) | np.uint64(1)
    total = hashes[:n] * factors[0]
    for k in range(1, width):
        total += hashes[k : n + k] * factors[k]
    return mix(total)


def pair_hashes(hashes: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of all pairs of words that lie ``apart``; equal pairs are equal at any distance."""
    factors = random_words(2, 3) | np.uint64(1)
    return mix(hashes[:-apart] * factors[0] + hashes[apart:] * factors[1])


#: Bits of a filter of ids: sixteen per id, within these bounds (8 KB and 16 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the hashed numbers in the column ``id``, as many as their count asks for. No
    number is missed; beyond ``MOST_BITS`` more others pass."""
    size = 1 << max(0, 16 * ids.count() - 1).bit_length()
    size = min(max(size, LEAST_BITS), MOST_BITS)
    bit = F.pmod("id", F.lit(size))
    words = ids.select(F.shiftright(bit, 5).alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(id, {size}) & 31 AS INT))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_pandas()
    out = np.zeros(size // 32, np.uint32)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def in_filter(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bit = ids % (len(bits) * 32)
    return (bits[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1


def group_count(docs: DataFrame, per_group: int, bytes_per_unit: float) -> int:
    """Number of groups for work on ``docs`` in which a group gets about ``per_group`` units,
    with one unit per ``bytes_per_unit`` characters of text."""
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(64, int(total / bytes_per_unit / per_group))
