"""N-gram Jaccard join: links of documents whose word shingles overlap enough, exactly.

Documents and n-grams form a sparse incidence matrix A; the overlaps are A times its
transpose. The product runs by blocks of columns (n-grams): each task multiplies one
block and accumulates overlap counts of pairs, and pairs whose sizes leave no room for
the similarity are discarded.

* Sizes alone bound the columns that matter: if a set of n n-grams reaches similarity s
  with another, they share one of its first ``n - ceil(s n) + 1`` n-grams in any fixed
  order of all columns. Columns of many documents come last, else the order is by hash, so
  that a passage shared by many documents does not bring them together.
* A first product links documents only with the first document of each column; the
  groups of copies found in this way count as one afterwards, so that a group's pairs
  are never listed. A second product takes the columns that still hold several groups
  and accumulates, for pairs of different groups, overlaps within the leading columns:
  count plus what can follow must reach the bound that the sizes give.
* Pairs that remain get their exact overlap from the whole sets, after sketches of the
  sets have ruled out most. Long columns are multiplied in blocks of whole sets instead.

Every text, column and pair is covered. Counting columns only decides their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake.llm.common import batch, give_back, group_count, id_filter, in_filter, map_arrow, mix, slices, tidy_shuffles, windows, word_hashes
from seawake.operators.scenarios import connected_components
from seawake.session import release_stored, stored, stored_count

#: Columns of so many documents are moved to the end of the order, those of most documents
#: last: ``MAX_FREQUENT`` at most, 10 MB with the logarithms of their counts.
FREQUENT_FROM = 4
MAX_FREQUENT = 1 << 21
#: Columns of more than two to this power documents are parted, so that a part has about as many.
COLUMN_POWER = 17
RECORD = 24
BLOBS = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])
SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.binary())])
#: Columns of so many documents are multiplied family by family, see ``family_links``.
LONG_COLUMN = 32
#: N-grams in a block of a family's rows; a task multiplies two blocks, of 8 MB each.
BLOCK_GRAMS = 1_000_000


def gram_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text. With fewer words than ``width``, all
    words together are the only n-gram; without words the set is empty."""
    hashes, bounds = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        words = hashes[lo:hi]
        if 0 < len(words) < width:
            out.append(mix(windows(words, len(words)) + np.uint64(len(words))))
        else:
            out.append(np.unique(windows(words, width)))
    return out


def lead(n, percent: int):
    """Number of leading n-grams among which a similar set must share one."""
    return n - (n * percent + 99) // 100 + 1


def _scatter(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket with its part of the columns, one after the other."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    keys, first = np.unique(bucket[order], return_index=True)
    sorted_columns = [c[order] for c in columns]
    blobs = [b"".join(c[lo:hi].tobytes() for c in sorted_columns) for lo, hi in zip(first, [*first[1:], len(order)], strict=True)]
    yield batch(BLOBS, keys, blobs)


def _gather(blobs) -> list[np.ndarray]:
    """The columns ``gram, doc, n, place`` of all blobs of a bucket."""
    kinds = (np.uint64, np.int64, np.int32, np.int32)
    parts = [[] for _ in kinds]
    for blob in blobs:
        k, at = len(blob) // RECORD, 0
        for out, kind in zip(parts, kinds, strict=True):
            out.append(np.frombuffer(blob, kind, k, at))
            at += k * np.dtype(kind).itemsize
    return [np.concatenate(p) for p in parts]


def frequent_grams(docs: DataFrame, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper halves of the hashes of the n-grams of most documents, ``MAX_FREQUENT`` at most,
    and the logarithms of their counts. Counted are the first half of each set in hash order:
    the others get into the leading part only of sets most of which is frequent."""

    def emit(batches):
        held, size = [], 0

        def flush():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            yield from _scatter((grams % np.uint32(buckets)).astype(np.int64), grams, n.astype(np.uint32))

        for _, texts in slices(batches):
            for grams in gram_sets(texts, width):
                held.append((grams[: (len(grams) + 1) // 2] >> np.uint64(32)).astype(np.uint32))
                size += len(held[-1])
            if size > 1_000_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b, np.uint32).reshape(2, -1) for b in group["blob"]]
        every, n = np.concatenate(parts, axis=1)
        order = np.argsort(every, kind="stable")
        every, n = every[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        total = np.add.reduceat(n, first)
        many = total >= FREQUENT_FROM
        give_back()
        return pd.DataFrame({"gram": every[first][many].astype(np.int64), "documents": total[many]})

    counts = stored(
        map_arrow(docs.select("text"), emit, BLOBS).groupBy("bucket").applyInPandas(count, "gram long, documents long"), "gram-counts"
    )
    sizes = counts.groupBy(F.floor(F.log2("documents")).alias("power")).count().orderBy(F.desc("power")).collect()
    total, power = 0, None
    for row in sizes:
        if (total := total + row["count"]) > MAX_FREQUENT:
            break
        power = row["power"]
    if power is None:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    found = counts.where(F.col("documents") >= 2**power).select("gram", F.floor(F.log2("documents")).cast("byte").alias("power")).toArrow().to_pandas()
    grams, powers = found["gram"].to_numpy().astype(np.uint32), found["power"].to_numpy().astype(np.uint8)
    order = np.argsort(grams)
    return grams[order], powers[order]


def columns_of(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int, width: int, percent: int) -> DataFrame:
    """The leading columns that hold documents of fitting sizes, one row per such document in
    them (``kind`` 0: gram, doc, n, place, the column's first document as hub, and its
    size m); and one row per document (``kind`` 1: doc, n, a hash of its set as gram). Columns of
    very many documents are dealt to several tasks by document (``kind`` 2: hub and m are
    those of a part, see ``whole_columns``)."""
    late = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches):
        rows, sets, size = [], [], 0

        def flush():
            if rows:
                gram, doc, n, place, power = (np.concatenate(c) for c in zip(*rows, strict=True))
                part = mix(doc.view(np.uint64)) & (np.uint64(1) << np.maximum(power.astype(np.int64) - COLUMN_POWER, 0).astype(np.uint64)) - np.uint64(1)
                yield from _scatter((((gram >> np.uint64(20)) + mix(part)) % np.uint64(buckets)).astype(np.int64), gram, doc, n, place)
            if sets:
                digest, doc, n = (np.array(c, k) for c, k in zip(zip(*sets, strict=True), (np.uint64, np.int64, np.int32), strict=True))
                yield from _scatter(-1 - (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), digest, doc, n, np.zeros(len(n), np.int32))

        for part, texts in slices(batches):
            for doc, grams in zip(part.column(0).to_pylist(), gram_sets(texts, width), strict=True):
                n = len(grams)
                sets.append((int(mix(np.array([np.bitwise_xor.reduce(mix(grams + np.uint64(n))) if n else 0], np.uint64))[0]), doc, n))
                if n:
                    power = powers_of(grams, late.value)
                    order, k = np.argsort(power, kind="stable"), lead(n, percent)
                    order = order[:k]
                    rows.append((grams[order], np.full(k, doc, np.int64), np.full(k, n, np.int32), np.arange(k, dtype=np.int32), power[order]))
                    size += k
            if size > 200_000 or len(sets) > 50_000:
                yield from flush()
                rows, sets, size = [], [], 0
        yield from flush()

    def multiply(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        gram, doc, n, place = _gather(group["blob"])
        if key[0] < 0:
            zero = np.zeros(len(doc), np.int64)
            out = (zero + 1, gram.view(np.int64), doc, n, place, doc, n, place, zero)
        else:
            # Of a column only documents that some other one fits in size; in the order of sizes
            # that is a neighbour.
            order = np.lexsort((n, gram))
            gram, doc, n, place = gram[order], doc[order], n[order], place[order]
            close = (gram[1:] == gram[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            parted = powers_of(gram, late.value) > COLUMN_POWER
            kept = np.flatnonzero(np.append(close, False) | np.append(False, close)[: len(gram)] | parted)
            kept = kept[np.lexsort((doc[kept], gram[kept]))]
            gram, doc, n, place, parted = gram[kept], doc[kept], n[kept], place[kept], parted[kept]
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
            size = np.diff(np.append(first, len(gram)))
            hub, m = np.repeat(first, size), np.repeat(size, size)
            out = (2 * parted.astype(np.int64), gram.view(np.int64), doc, n, place, doc[hub], n[hub], place[hub], m)
        give_back()
        return pd.DataFrame(dict(zip(COLUMNS, out, strict=True)))

    blobs = map_arrow(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), emit, BLOBS)
    return blobs.groupBy("bucket").applyInPandas(multiply, COLUMNS_DDL)


def powers_of(grams: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Logarithms of the n-grams' counts; 0 for those not known as frequent."""
    known, powers = frequent
    if not len(known):
        return np.zeros(len(grams), np.uint8)
    top = (grams >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(known, top), len(known) - 1)
    return np.where(known[at] == top, powers[at], 0).astype(np.uint8)


def whole_columns(table: DataFrame) -> DataFrame:
    """The columns, parted ones with the hub and size of all their parts."""
    parted = table.where("kind = 2")
    whole = parted.groupBy("gram").agg(F.min(F.struct("hub", "hub_n", "hub_place")).alias("first"), F.count("*").alias("m")).where("m > 1")
    parted = parted.drop("hub", "hub_n", "hub_place", "m").join(whole.select("gram", "first.*", "m"), "gram").select(table.columns)
    return table.where("kind = 0").union(parted).drop("kind")


COLUMNS = ("kind", "gram", "doc", "n", "place", "hub", "hub_n", "hub_place", "m")
COLUMNS_DDL = "kind long, gram long, doc long, n int, place int, hub long, hub_n int, hub_place int, m long"


def size_bound(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of sets of these sizes at the similarity."""
    return F.ceil(percent * (a + b) / F.lit(100 + percent))


def fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the set's counts in power-of-two many cells, at least four per n-gram: half
    a byte per n-gram."""
    cells = 1 << max(6, int(4 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of n-grams in one of two sets only, from their sketches:
    cells whose parities differ. The longer sketch is folded to the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) != len(y):
        x, y = (x, y) if len(x) < len(y) else (y, x)
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _sets(docs: DataFrame, ids: DataFrame, width: int, of_set, name: str) -> DataFrame:
    """``(doc_id, n, set)`` with what ``of_set`` makes of the sets of the documents in ``ids``.
    The filter keeps other texts from being written; what it lets through joins drop."""
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(ids.distinct()))

    def emit(batches):
        for part, texts in slices(batches):
            ids = part.column(0).to_numpy()
            take = np.flatnonzero(in_filter(wanted.value, ids))
            if len(take):
                grams = gram_sets([texts[i] for i in take], width)
                yield batch(SETS, ids[take], [len(g) for g in grams], [of_set(g) for g in grams])

    out = stored(map_arrow(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), emit, SETS), name)
    wanted.destroy()
    return out


def _with_sets(docs: DataFrame, pairs: DataFrame, width: int, of_set, name: str) -> DataFrame:
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    sets = _sets(docs, ids, width, of_set, name)
    return pairs.join(sets.toDF("b", "n_b", "set_b"), "b").join(sets.toDF("a", "n_a", "set_a"), "a")


def family_links(docs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between different groups among documents that share a long column.

    Documents of the columns with the same hub are a family; two that share a column share
    its hub. A family's rows of the matrix are dealt to blocks by size, those outside its
    largest group to blocks of their own, and a task multiplies one of these with one of
    all: overlaps are accumulated n-gram by n-gram. Only links leave the task.
    """
    members = rows.groupBy("hub", "doc").agg(F.max("n").alias("n"), F.max("group").alias("group"))
    grams = members.groupBy("hub", "group").agg(F.sum("n").alias("grams"))
    sizes = grams.groupBy("hub").agg(
        F.max_by("group", F.struct("grams", "group")).alias("top"), F.sum("grams").alias("all"), F.max("grams").alias("most"), F.count("*").alias("kinds")
    )
    sizes = sizes.where("kinds > 1").select(
        "hub", "top", F.ceil(F.col("all") / BLOCK_GRAMS).alias("blocks"), F.ceil((F.col("all") - F.col("most")) / BLOCK_GRAMS).alias("outside")
    )
    members = stored(members.join(sizes, "hub").withColumn("out", F.col("group") != F.col("top")), "families")
    sets = _sets(docs, members.select(F.col("doc").alias("id")), width, np.ndarray.tobytes, "family-sets").toDF("doc", "n", "set")

    def upto(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    spread, common = F.xxhash64("doc"), ["hub", "doc", "group", "out"]
    inside = members.select(*common, upto("outside").alias("i"), F.pmod(spread, F.col("blocks")).alias("j"), F.lit(False).alias("asks"))
    outside = members.where("out").select(*common, F.pmod(spread, F.col("outside")).alias("i"), upto("blocks").alias("j"), F.lit(True).alias("asks"))

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        asking, group = group[group["asks"]], group[~group["asks"]]
        doc, label, out = (group[c].to_numpy() for c in ("doc", "group", "out"))
        grams = [np.frombuffer(b, np.uint64) for b in group["set"]]
        n = np.array([len(g) for g in grams], np.int64)
        every, row = np.concatenate([*grams, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(n)), n)
        order = np.argsort(every, kind="stable")
        every, row = every[order], row[order]
        found = []
        for own, of, raw in zip(asking["doc"], asking["group"], asking["set"], strict=True):
            mine = np.frombuffer(raw, np.uint64)
            lo, hi = np.searchsorted(every, mine, "left"), np.searchsorted(every, mine, "right")
            size = hi - lo
            at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
            shared = np.bincount(row[at], minlength=len(n))
            linked = (100 * shared >= percent * (n + len(mine) - shared)) & (label != of) & (~out | (doc > own))
            found += [(min(own, d), max(own, d)) for d in doc[linked].tolist()]
        give_back()
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    dealt = inside.union(outside).join(sets.drop("n"), "doc")
    return dealt.groupBy("hub", "i", "j").applyInPandas(multiply, "a long, b long")


def _counted(pairs: DataFrame, count) -> DataFrame:
    def each(batches):
        for b in batches:
            values = [count(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(4), b.column(5), strict=True)]
            yield batch(COUNTED, *b.columns[:4], values)

    return map_arrow(pairs.select("a", "b", "n_a", "n_b", "set_a", "set_b"), each, COUNTED)


def overlaps(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """``pairs`` of (a, b) with the exact overlap of their sets, less those that sketches
    show to differ too much."""

    def common(x: bytes, y: bytes) -> int:
        return len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))

    both = F.col("n_a") + F.col("n_b")
    first = stored_count()
    near = _counted(_with_sets(docs, pairs, width, sketch, "sketches"), least_difference)
    near = stored(near.where((both - F.col("count")) / 2 >= size_bound(F.col("n_a"), F.col("n_b"), percent)).select("a", "b"), "near-pairs")
    release_stored(docs.sparkSession, first, keep_last=1)
    return _counted(_with_sets(docs, near, width, np.ndarray.tobytes, "sets"), common).withColumnRenamed("count", "overlap")


COUNTED = pa.schema([(c, pa.int64()) for c in ("a", "b", "n_a", "n_b", "count")])


def similar(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


def _groups(spark: SparkSession, links: DataFrame) -> DataFrame:
    out = connected_components(links.select(F.col("a").alias("mmsi_a"), F.col("b").alias("mmsi_b")))
    return out.select(F.col("mmsi").alias("doc"), F.col("component").alias("group"))


PAIR_COLUMNS = ("a", "b", "n_a", "n_b", "shared", "place_a", "place_b")
PAIRS_DDL = "a long, b long, n_a int, n_b int, shared long, place_a int, place_b int"


def mixed_columns(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of columns that hold several groups, with each document's ``group``."""
    rows = columns.drop("hub_n", "hub_place").join(groups, "doc", "left").withColumn("group", F.coalesce("group", "doc"))
    mixed = rows.groupBy("gram").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("gram")
    return rows.join(mixed, "gram", "left_semi")


def cross_pairs(rows: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Pairs of different groups that share one of these columns, with the overlap counted in
    leading columns and the last places where they meet. The columns are short."""
    rows = rows.select("gram", "doc", "n", "place", "group", F.pmod(F.col("gram"), F.lit(buckets)).alias("bucket"))

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((group["doc"].to_numpy(), group["n"].to_numpy(), group["gram"].to_numpy()))
        gram, doc, n, place, label = (group[c].to_numpy()[order] for c in ("gram", "doc", "n", "place", "group"))
        n, place = n.astype(np.int64), place.astype(np.int64)
        found, i, step = [], np.arange(len(gram)), 1
        while len(i := i[i + step < len(gram)]):
            j = i + step
            i = i[(gram[i] == gram[j]) & (100 * n[i] >= percent * n[j])]
            j = i + step
            need = -(-percent * (n[i] + n[j]) // (100 + percent))
            ok = (label[i] != label[j]) & (place[i] <= n[i] - need) & (place[j] <= n[j] - need)
            found.append(np.stack([i[ok], j[ok]]))
            step += 1
        i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        swap = doc[i] > doc[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        order = np.lexsort((doc[j], doc[i]))
        i, j = i[order], j[order]
        if not len(i):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in PAIR_COLUMNS})
        first = np.flatnonzero(np.concatenate([[True], (doc[i][1:] != doc[i][:-1]) | (doc[j][1:] != doc[j][:-1])]))
        out = (
            doc[i][first], doc[j][first], n[i][first], n[j][first], np.diff(np.append(first, len(i))),
            np.maximum.reduceat(place[i], first), np.maximum.reduceat(place[j], first),
        )
        give_back()
        return pd.DataFrame(dict(zip(PAIR_COLUMNS, out, strict=True)))

    found = rows.groupBy("bucket").applyInPandas(pair, PAIRS_DDL)
    found = found.groupBy("a", "b").agg(
        *[F.max(c).alias(c) for c in ("n_a", "n_b", "place_a", "place_b")], F.sum("shared").alias("shared")
    )
    room = F.col("shared") + F.least(F.col("n_a") - F.col("place_a") - 1, F.col("n_b") - F.col("place_b") - 1)
    return found.where(room >= size_bound(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def similar_groups(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs`` (doc_id, text, and any
    other columns, which are ignored).

    Two documents are linked when ``100 * overlap >= percent * union`` of their sets of
    distinct ``width``-word shingles; words are parted by ASCII white space, A-Z lowered.
    ``component_id`` is the smallest doc_id that links reach, the document included.

    A null or empty text, or one without words, has the empty set and no link. Rows that
    repeat a doc_id are one document with the links of each of them, and all are
    returned. A row without doc_id is returned with a null component. An empty table
    gives no rows.
    """
    with tidy_shuffles(docs.sparkSession):
        return _similar_groups(docs, percent, width)


def _similar_groups(docs: DataFrame, percent: int, width: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = group_count(docs, 200_000, 25)
    first = stored_count()
    frequent = frequent_grams(docs, buckets, width)
    table = stored(columns_of(docs, frequent, buckets, width, percent), "gram-columns")
    release_stored(spark, first, keep_last=1)
    columns, sets = whole_columns(table), table.where("kind = 1").select("doc", "n", F.col("gram").alias("digest"))
    first = stored_count()
    # First product: each document with the first documents of its columns.
    stars = (
        columns.where(F.col("doc") != F.col("hub"))
        .where(fits(F.col("n"), F.col("hub_n"), percent))
        .groupBy("doc", "hub")
        .agg(F.count("*").alias("shared"))
        .groupBy("doc")
        .agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("hub"))
    )
    digests = sets.select("doc", "digest").distinct()
    # Stored, so that a join with a large group of equal sets can be split.
    firsts = stored(sets.where("n > 0").groupBy("digest", "n").agg(F.min("doc").alias("a")), "first-of-sets")
    same = (
        firsts.join(sets.where("n > 0").select("digest", "n", F.col("doc").alias("b")), ["digest", "n"]).where("a <> b").select("a", "b").distinct()
    )
    same = stored(same, "same-sets")
    stars = (
        stars.select(F.col("hub").alias("a"), F.col("doc").alias("b"))
        .join(digests.toDF("a", "digest_a"), "a").join(digests.toDF("b", "digest_b"), "b")
        .where("digest_a <> digest_b").select("a", "b").distinct()
    )
    links = stored(same.union(similar(overlaps(docs, stored(stars, "star-pairs"), width, percent), percent)), "star-links")
    release_stored(spark, first, keep_last=1)
    groups = stored(_groups(spark, links), "star-groups")
    # Second product: pairs of different groups.
    first = stored_count()
    mixed = stored(mixed_columns(columns, groups), "mixed-columns")
    pairs = stored(cross_pairs(mixed.where(F.col("m") < LONG_COLUMN), buckets, percent), "cross-pairs")
    more = similar(overlaps(docs, pairs, width, percent), percent)
    more = stored(more.union(family_links(docs, mixed.where(F.col("m") >= LONG_COLUMN), width, percent)).distinct(), "cross-links")
    release_stored(spark, first, keep_last=1)
    groups = _groups(spark, links.union(more))
    return sets.join(groups, "doc", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("group", "doc").alias("component_id")
    ).union(without_id(docs, width))


def without_id(docs: DataFrame, width: int) -> DataFrame:
    def sizes(batches):
        for _, texts in slices(batches):
            found = [len(g) for g in gram_sets(texts, width)]
            yield batch(SIZES, [None] * len(found), found, [None] * len(found))

    return map_arrow(docs.where("doc_id IS NULL"), sizes, SIZES)


SIZES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("component_id", pa.int64())])
