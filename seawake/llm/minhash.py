"""MinHash near-duplicates: banded candidates, sequential Bayesian verification, exact links.

* Equal sets are one from the start; each distinct set has a signature of ``BANDS`` times
  ``ROWS`` minima. Two sets of similarity 0.8 share no band once in 3 million pairs.
* A first round compares each set with one other of its buckets, the first set of the
  bucket that it shares most bands with: copies become groups before pairs are looked at.
* Two more rounds compare the sets of different groups that share a bucket, all of them,
  within tasks that take blocks of the bucket. A bucket's largest group is compared with the
  others only, and a pair is looked at in the first band that both share. The first of
  these rounds brings each set to its most similar one of another group, so that a large
  group of near copies has become one before the last round takes all pairs that are left.
* Signatures are compared batch by batch. After m equal minima of n the posterior of the
  similarity (uniform prior) says how likely it still reaches the threshold; a pair goes
  when that falls below ``MISS``. What is left is counted exactly, on the whole sets.

No bucket, candidate or text is cut.
"""

from __future__ import annotations

from itertools import islice
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import batch, id_filter, in_filter, map_arrow, mix, slices, tidy_shuffles, random_words
from seawake.llm.ngram_join import _groups, gram_sets, least_difference, sketch, without_id
from seawake.session import stored

BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
BATCH = 16
MISS = 1e-6
#: Rows of a bucket that a task compares with as many others.
BLOCK = 1000
#: Small buckets that share a task.
LOTS = 512

SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("signature", pa.binary()), ("sketch", pa.binary())])
BANDED = pa.schema([("key", pa.int64()), ("band", pa.int32()), ("doc", pa.int64()), ("n", pa.int64())])
SETS = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("set", pa.binary())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def signature(grams: np.ndarray) -> np.ndarray:
    """Minima of the set under ``HASHES`` linear maps of the upper halves of its hashes."""
    seeds = random_words(HASHES, 7)
    factor, shift = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1), seeds.astype(np.uint32)
    high = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), 1024):
        out = np.minimum(out, (high[at : at + 1024, None] * factor + shift).min(axis=0))
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each signature."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        out = mix(out + rows[:, :, k])
    return out


def least_matches(percent: int, miss: float = MISS) -> np.ndarray:
    """The equal minima needed after each batch: the fewest m of n with a posterior probability
    of ``miss`` or more that the similarity is ``percent`` or more. With a uniform prior that is
    the chance of m successes or fewer in n + 1 trials."""
    s, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return np.array(out)


def passes(equal: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of equal minima come through all batches, those of most matches first."""
    alive, matches = np.arange(len(equal)), np.zeros(len(equal), np.int64)
    for k, needed in enumerate(least):
        matches = matches + equal[alive, k * BATCH : (k + 1) * BATCH].sum(axis=1)
        alive, matches = alive[matches >= needed], matches[matches >= needed]
    return alive[np.argsort(-matches, kind="stable")]


def may_link(n: int, m: int, x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sets can overlap enough, by a lower bound of their difference."""
    most = (n + m - least_difference(x, y)) // 2
    return 100 * most >= percent * (n + m - most)


def _matrix(signatures) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint32).reshape(-1, HASHES)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, n, d1, d2, signature)``: size, digests of the set and its signature."""

    def sign(batches):
        for part, texts in slices(batches):
            sets = gram_sets(texts, width)
            digests = [(np.bitwise_xor.reduce(mix(g)), np.bitwise_xor.reduce(mix(g ^ np.uint64(0x5BD1E995)))) if len(g) else (0, 0) for g in sets]
            d1, d2 = (np.array(d, np.uint64).view(np.int64) for d in zip(*digests, strict=True))
            yield batch(SIGNED, part.column(0), [len(g) for g in sets], d1, d2, [signature(g).tobytes() for g in sets], [sketch(g) for g in sets])

    return map_arrow(docs, sign, SIGNED)


def banded(sets: DataFrame) -> DataFrame:
    def bands(batches):
        for b in batches:
            if b.num_rows:
                keys = band_keys(_matrix(b.column(2).to_pylist())).view(np.int64)
                doc, n = (np.repeat(b.column(k).to_numpy(), BANDS) for k in (0, 1))
                yield batch(BANDED, keys.ravel(), np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows), doc, n)

    return map_arrow(sets.select("doc_id", "n", "signature"), bands, BANDED)


def screened(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of fitting sizes whose signatures come through all batches."""
    least = least_matches(percent)

    def screen(batches):
        for b in batches:
            if b.num_rows:
                x, y = (_matrix(b.column(k).to_pylist()) for k in (2, 3))
                alive = passes(x == y, least)
                yield batch(PAIRS, b.column(0).take(pa.array(alive)), b.column(1).take(pa.array(alive)))

    sets = sets.select("doc_id", "n", "signature")
    both = pairs.join(sets.toDF("b", "n_b", "y"), "b").join(sets.toDF("a", "n_a", "x"), "a")
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return map_arrow(both.select("a", "b", "x", "y"), screen, PAIRS)


def exact_links(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose whole sets overlap enough. Sets are made of the texts of these pairs only
    and stored, so that a join can split those of a set that many are compared with."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def emit(batches):
        for part, texts in slices(batches):
            own = part.column(0).to_numpy()
            take = np.flatnonzero(in_filter(wanted.value, own))
            if len(take):
                grams = gram_sets([texts[i] for i in take], width)
                digests = [int(np.bitwise_xor.reduce(mix(g)).view(np.int64)) if len(g) else 0 for g in grams]
                yield batch(SETS, own[take], digests, [g.tobytes() for g in grams])

    def linked(batches):
        for b in batches:
            take = []
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * shared >= percent * (len(p) + len(q) - shared):
                    take.append(k)
            yield batch(PAIRS, b.column(0).take(pa.array(take, pa.int64())), b.column(1).take(pa.array(take, pa.int64())))

    sets = map_arrow(docs, emit, SETS).repartition("doc_id").dropDuplicates(["doc_id", "digest"]).select("doc_id", "set")
    sets = stored(sets, "sets")
    wanted.destroy()
    both = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    return map_arrow(both.select("a", "b", "x", "y"), linked, PAIRS).distinct()


def star_pairs(buckets: DataFrame) -> DataFrame:
    """Each set with the first set of the bucket that it shares most bands with."""
    shared = buckets.where("doc <> hub").groupBy("doc", "hub").agg(F.count("*").alias("shared"))
    return shared.groupBy(F.col("doc").alias("b")).agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("a")).select("a", "b")


def cross_pairs(buckets: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """The pairs of different groups in one bucket that pass the screen, each once; with
    ``nearest`` only the best one of each set outside a bucket's largest group."""
    least = least_matches(percent)
    rows = buckets.select("key", "band", "doc").join(groups, "doc", "left").withColumn("group", F.coalesce("group", "doc"))
    per_group = rows.groupBy("key", "group").agg(F.count("*").alias("c"))
    mixed = per_group.groupBy("key").agg(
        F.max_by("group", F.struct("c", "group")).alias("top"), F.sum("c").alias("m"), F.max("c").alias("most"), F.count("*").alias("kinds")
    )
    mixed = stored(mixed.where("kinds > 1").drop("kinds"), "mixed-buckets")
    small = F.col("m") <= BLOCK
    rows = rows.join(mixed, "key").withColumns({
        "lot": F.when(small, F.pmod("key", F.lit(LOTS))).otherwise(F.col("key")),
        "members": F.ceil(F.col("m") / BLOCK),
        "outsiders": F.ceil((F.col("m") - F.col("most")) / BLOCK),
        "out": F.col("group") != F.col("top"),
    })
    spread = F.xxhash64("doc", "key")

    def upto(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    common = ["lot", "key", "band", "doc", "group", "out"]
    inside = rows.select(*common, upto("outsiders").alias("i"), F.pmod(spread, F.col("members")).alias("j"), F.lit(False).alias("asks"))
    outside = rows.where("out").select(*common, F.pmod(spread, F.col("outsiders")).alias("i"), upto("members").alias("j"), F.lit(True).alias("asks"))
    dealt = inside.union(outside).join(sets.toDF("doc", "n", "signature", "sketch"), "doc")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "asks", "doc"], kind="stable")
        key, doc, n, group, out, asks, band = (rows[c].to_numpy() for c in ("key", "doc", "n", "group", "out", "asks", "band"))
        marks, sketches, found = _matrix(rows["signature"]), rows["sketch"].to_numpy(), []
        bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            middle = lo + int((~asks[lo:hi]).sum())
            for o in range(middle, hi):
                m = np.arange(lo, middle)
                m = m[(group[m] != group[o]) & (doc[m] != doc[o]) & (~out[m] | (doc[m] > doc[o]))]
                m = m[100 * np.minimum(n[m], n[o]) >= percent * np.maximum(n[m], n[o])]
                if len(m):
                    equal = marks[m] == marks[o]
                    alike = equal.reshape(len(m), BANDS, ROWS).all(axis=2)
                    first = np.flatnonzero(alike.any(axis=1) & (alike.argmax(axis=1) == band[o]))
                    close = (k for k in m[first[passes(equal[first], least)]] if may_link(n[o], n[k], sketches[o], sketches[k], percent))
                    found += [(min(doc[o], doc[k]), max(doc[o], doc[k])) for k in (islice(close, 1) if nearest else close)]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return dealt.groupBy("lot", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def similar_groups(docs: DataFrame, percent: int = 80, width: int = 4) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs`` (doc_id, text, and
    any other columns, which are ignored).

    Two documents are linked when ``100 * overlap >= percent * union`` of their sets of
    distinct ``width``-word shingles; words are parted by ASCII white space, A-Z lowered.
    ``component_id`` is the smallest doc_id that links reach, the document included, and
    ``kept`` says whether it is the document itself.

    A null or empty text, or one without words, has the empty set and no link. Rows that
    repeat a doc_id are one document with the links of each of them, and all are returned. A
    row without doc_id is returned with null component and kept. An empty table gives no
    rows.
    """
    with tidy_shuffles(docs.sparkSession):
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        known = docs.where("doc_id IS NOT NULL")
        own = stored(signed(known, width), "signatures")
        equal = ["d1", "d2", "n"]
        firsts = stored(own.where("n > 0").groupBy(*equal).agg(F.min("doc_id").alias("first")), "first-of-sets")
        of_first = firsts.withColumnRenamed("first", "doc_id")
        sets = own.join(of_first, ["doc_id", *equal], "left_semi").dropDuplicates(["doc_id", *equal]).select("doc_id", "n", "signature", "sketch")
        sets = stored(sets, "distinct-sets")
        bands = stored(banded(sets), "bands")
        shared = bands.groupBy("key").agg(F.count("*").alias("_m"), F.min("doc").alias("hub")).where("_m > 1").drop("_m")
        buckets = stored(bands.join(shared, "key"), "buckets")
        near = stored(screened(star_pairs(buckets), sets, percent), "star-pairs")
        links = stored(exact_links(known, near, width, percent), "star-links")
        for nearest in (True, False):
            groups = stored(_groups(docs.sparkSession, links), "groups")
            more = stored(cross_pairs(buckets, groups, sets, percent, nearest), "cross-pairs")
            links = links.union(stored(exact_links(known, more, width, percent), "cross-links"))
        # Every document belongs to the first one with its set; a repeated doc_id with several
        # sets ties them together.
        members = own.select("doc_id", *equal).join(firsts, equal, "left")
        members = stored(members.select("doc_id", "n", F.coalesce("first", "doc_id").alias("first")), "members")
        several = members.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("_hi")).where("a <> _hi").select("doc_id", "a")
        links = links.union(members.join(several, "doc_id").where("first <> a").select("a", F.col("first").alias("b")).distinct())
        groups = _groups(docs.sparkSession, links)
        found = members.join(groups.toDF("first", "group"), "first", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("group", "first").alias("component_id")
        )
        return found.union(without_id(docs, width)).withColumn("kept", F.col("doc_id") == F.col("component_id"))
