"""Benchmark decontamination: word-pair seeds without loss and Smith-Waterman alignment.

An alignment with the least score must hold a number of word pairs that lie at most two
words apart on both sides, however its edits are spread (``least_pairs``). The rarer of
each test item's pairs, by the documents that have them, are its seeds, so many that each
such alignment holds some. A document's passages with enough seeds are joined with their
items and aligned word by word; the score of the best local alignment against a perfect
one tells whether the passage is a copy, also an edited or paraphrased one.

Items are held in blocks of bounded size: a larger benchmark takes more passes over the
documents, with the same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake.llm.common import NOT_ALNUM, batch, map_arrow, pair_hashes, slices, tidy_shuffles, word_hashes
from seawake.session import stored

#: Items with fewer words cannot be told from chance and match nothing.
ITEM_WORDS = 3
#: Words from the first to the second of a seed pair, in items and in documents.
APART = (1, 2)
#: A passage must hold this share of the pairs that an alignment of the least score holds;
#: it decides only how much work there is.
DEMANDED = 0.25
#: Characters of item texts in a block.
BLOCK_CHARS = 16_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of a perfect alignment's score.
LEAST_SCORE = 0.5
#: Candidates aligned together.
ALIGNED_AT_ONCE = 512
#: Bytes of text hashed at a time.
TEXT_BYTES = 1 << 18

ITEMS_DDL = "item_id long, words binary"
COUNTS = pa.schema([("seed", pa.int64()), ("documents", pa.int64())])
PASSAGES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("passage", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def hashed_words(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text: letters and digits in lower case, anything else parts words."""
    hashes, bounds = word_hashes([t.lower().encode("utf-8", "surrogatepass") for t in texts], NOT_ALNUM)
    return [hashes[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def least_pairs(n_words: np.ndarray, least_score: float) -> np.ndarray:
    """Words of an item after which, in any alignment of the least score, the next matched
    word comes with at most one word edited, added or left out between.

    With m matches and p edits, 2m - p >= 2 * n * least_score, and at most p / 2 of the
    m - 1 steps from match to match hold two edits or more: n * least_score - 1 steps or
    more hold fewer. One edit between makes the words two apart in the item, in the
    document or in both.
    """
    return np.ceil(n_words * least_score - 1e-9).astype(np.int64) - 1


class Seeds:
    """Word pairs of a block of items: distinct ones in order, and the items' words that start each."""

    def __init__(self, item_ids: np.ndarray, words: list[np.ndarray], least_score: float) -> None:
        words = [w if len(w) >= ITEM_WORDS else w[:0] for w in words]
        keys = [pair_hashes(w, apart) for w in words for apart in APART]
        sizes = [len(k) for k in keys]
        place = np.concatenate([*[np.arange(n) for n in sizes], np.zeros(0, np.int64)]).astype(np.int64)
        self.item_ids, self.lengths = item_ids, np.array([len(w) for w in words], np.int64)
        #: Of each item: the pairs that a passage must hold, and the words that an alignment of the least score may span.
        self.demanded = np.maximum(1, (DEMANDED * least_pairs(self.lengths, least_score)).astype(np.int64))
        self.span = np.ceil(self.lengths * (3 - 2 * least_score)).astype(np.int64)
        self.least_score = least_score
        self._order(np.concatenate([*keys, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(keys)) // len(APART), sizes), place)

    def _order(self, keys: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.number = np.unique(keys[order], return_index=True, return_inverse=True)
        #: A bit for the low bits of each key tells most pairs of a document apart.
        self.mask = np.uint64((1 << min(25, max(16, (16 * len(self.keys)).bit_length()))) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[self.keys & self.mask] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of a document's pairs that are seeds, and the words that start them."""
        number, at = [], []
        for apart in APART:
            keys = pair_hashes(words, apart)
            some = np.flatnonzero(self.bits[keys & self.mask])
            keys = keys[some]
            n = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            known = self.keys[n] == keys if len(self.keys) else np.zeros(len(keys), bool)
            number.append(n[known])
            at.append(some[known])
        return np.concatenate(number), np.concatenate(at)

    def keep_rare(self, documents: np.ndarray) -> Seeds:
        """With the rarer pairs of each item alone. Of the words whose pairs occur in any
        document, so many stay that every alignment of the least score starts the demanded
        number of pairs at words that stay."""
        rows = pd.DataFrame({"item": self.item, "place": self.place, "documents": documents[self.number]})
        starts = rows.groupby(["item", "place"], as_index=False)["documents"].sum()
        starts = starts[starts["documents"] > 0].sort_values(["item", "documents", "place"])
        item = starts["item"].to_numpy()
        occurring = np.bincount(item, minlength=len(self.lengths))
        least = np.maximum(1, least_pairs(self.lengths, self.least_score))
        limit = np.where(occurring >= least, occurring - least + self.demanded, 0)
        starts = starts[starts.groupby("item").cumcount().to_numpy() < limit[item]]
        width = int(self.lengths.max(initial=0)) + 1
        keep = np.isin(self.item * width + self.place, starts["item"].to_numpy() * width + starts["place"].to_numpy())
        keep &= documents[self.number] > 0
        rare = object.__new__(Seeds)
        rare.item_ids, rare.lengths, rare.demanded, rare.span, rare.least_score = self.item_ids, self.lengths, self.demanded, self.span, self.least_score
        rare._order(self.keys[self.number[keep]], self.item[keep], self.place[keep])
        return rare

    def passages(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item, first word, end)`` of the stretches of a document that can hold an alignment
        of the least score: the demanded number of seeds within the span of one, and all
        that an alignment with these may reach."""
        number, at = self.find(words)
        if not len(at):
            return []
        lo = self.first[number]
        size = np.append(self.first, len(self.item))[number + 1] - lo
        row = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        hits = np.unique(self.item[row] * np.int64(len(words)) + np.repeat(at, size))
        item, word = hits // len(words), hits % len(words)
        last = np.arange(len(hits)) + self.demanded[item] - 1
        within = np.minimum(last, len(hits) - 1)
        dense = np.flatnonzero((last < len(hits)) & (item[within] == item) & (word[within] - word < self.span[item]))
        if not len(dense):
            return []
        item, span = item[dense], self.span[item[dense]]
        start, end = np.maximum(0, word[within[dense]] + 1 - span), np.minimum(len(words), word[dense] + span)
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (start[1:] > end[:-1])])
        first = np.flatnonzero(new)
        return list(zip(item[first].tolist(), start[first].tolist(), np.maximum.reduceat(end, first).tolist(), strict=True))


def alignment_scores(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair, all pairs at once along the anti-diagonals."""
    k, n, m = len(items), max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((k, n), np.uint64), np.zeros((k, m + 2 * n), np.uint64)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)] = x | np.uint64(1)  # the lowest bit tells words from the padding
        b[i, n : n + len(y)] = y | np.uint64(1)
    b = b[:, ::-1]
    before, last = np.zeros((k, n + 1), np.int32), np.zeros((k, n + 1), np.int32)
    best = np.zeros(k, np.int32)
    for d in range(n + m - 1):
        # Cells (i, d - i): the passage, reversed, lies against the item.
        from_ = m + n - 1 - d
        other = b[:, from_ : from_ + n]
        cell = before[:, :-1] + np.where((a == other) & (a != 0), MATCH, MISMATCH)
        cell = np.maximum(np.maximum(cell, 0), np.maximum(last[:, :-1], last[:, 1:]) + GAP)
        before, last = last, np.concatenate([np.zeros((k, 1), np.int32), cell.astype(np.int32)], axis=1)
        np.maximum(best, cell.max(axis=1), out=best)
    return best


def _item_blocks(spark: SparkSession, items: DataFrame) -> list[DataFrame]:
    """Distinct items by id in blocks of about ``BLOCK_CHARS`` characters."""
    items = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _matches(docs: DataFrame, block: DataFrame, least_score: float) -> DataFrame:
    spark = docs.sparkSession
    found = block.distinct().toArrow().to_pandas()  # BLOCK_CHARS at most
    seeds = Seeds(found["item_id"].to_numpy(), hashed_words(found["text"].tolist()), least_score)
    all_seeds = spark.sparkContext.broadcast(seeds)

    def count(batches):
        total = np.zeros(len(all_seeds.value.keys), np.int64)
        for _, texts in slices(batches, max_bytes=TEXT_BYTES):
            for words in hashed_words(texts):
                total[np.unique(all_seeds.value.find(words)[0])] += 1
        some = np.flatnonzero(total)
        yield batch(COUNTS, some, total[some])

    counts = map_arrow(docs.select("text"), count, COUNTS).groupBy("seed").agg(F.sum("documents").alias("documents")).toArrow().to_pandas()
    all_seeds.destroy()
    documents = np.zeros(len(seeds.keys), np.int64)
    documents[counts["seed"].to_numpy(np.int64)] = counts["documents"].to_numpy(np.int64)
    rare_seeds = spark.sparkContext.broadcast(seeds.keep_rare(documents))

    def look(batches):
        rare = rare_seeds.value
        for part, texts in slices(batches, max_bytes=TEXT_BYTES):
            rows = []
            for doc_id, words in zip(part.column(0).to_pylist(), hashed_words(texts), strict=True):
                for item, lo, hi in rare.passages(words):
                    rows.append((doc_id, rare.item_ids[item], lo, words[lo:hi].tobytes()))
            if rows:
                yield batch(PASSAGES, *map(list, zip(*rows, strict=True)))

    def align(batches):
        for b in batches:
            for at in range(0, b.num_rows, ALIGNED_AT_ONCE):
                part = b.slice(at, ALIGNED_AT_ONCE)
                passages = [np.frombuffer(x, np.uint64) for x in part.column(3).to_pylist()]
                items = [np.frombuffer(x, np.uint64) for x in part.column(4).to_pylist()]
                perfect = MATCH * np.array([len(x) for x in items])
                scores = _by_size(items, passages) / perfect
                yield batch(SCORES, part.column(0), part.column(1), scores, part.column(2), [len(p) for p in passages])

    words = [w.tobytes() for w in hashed_words(found["text"].tolist())]
    texts = spark.createDataFrame(pd.DataFrame({"item_id": found["item_id"], "words": words}), ITEMS_DDL)
    # A table between the two steps: a task that looked and aligned at once would hold two Python workers.
    passages = stored(map_arrow(docs.select("doc_id", "text"), look, PASSAGES), "passages")
    rare_seeds.destroy()
    pairs = passages.join(F.broadcast(texts), "item_id").select("doc_id", "item_id", "first_word", "passage", "words")
    best = map_arrow(pairs, align, SCORES).where(F.col("score") >= least_score)
    return best.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", -F.col("first_word"), "n_words")).alias("best")).select(
        "doc_id", "item_id", "best.score", (-F.col("best.col2")).alias("first_word"), "best.n_words"
    )


def _by_size(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Scores with pairs of like size aligned together, so that little is padding."""
    order = np.argsort([len(x) + len(y) for x, y in zip(items, passages, strict=True)], kind="stable")
    out = np.zeros(len(items), np.int32)
    for some in np.array_split(order, max(1, len(order) // 64)):
        if len(some):
            out[some] = alignment_scores([items[k] for k in some], [passages[k] for k in some])
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``(doc_id, item_id, score, first_word, n_words)``: the documents (doc_id, text) that hold a copy
    of a test item (item_id, text), with the best score of an alignment and the stretch of
    words that was aligned. Other columns are ignored. No alignment of ``least_score``,
    which is to be above 1 / ``ITEM_WORDS``, is missed.

    A null or empty text matches nothing, nor does an item of fewer than ``ITEM_WORDS``
    words or without id. Repeated doc_ids or item_ids give one row with the best score;
    documents without doc_id are one such group. Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    with tidy_shuffles(spark):
        parts = [stored(_matches(docs, block, least_score), "contaminated") for block in _item_blocks(spark, benchmark)]
    if not parts:
        return docs.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("score", "double"), ("first_word", "long"), ("n_words", "long"))])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    best = F.max(F.struct("score", "first_word", "n_words")).alias("best")
    return out if len(parts) == 1 else out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
