"""Phrase collocation mining: the best phrases of each language by best-first growth.

A phrase grows word by word from its prefix, and the prefix's count bounds what it can
still reach: with a = f(phrase), the cut after the first word scores a² / (f(w1) f(rest)) and
a <= f(rest), so no phrase that starts with w1 w2 scores above f(w1 w2) / f(w1). From the
other end none that ends with w2 w3 scores above f(w2 w3) / f(w3).

* Level 1 to 2: a word's own count bounds nothing below the highest score, so all words of
  ``LEAST`` occurrences are expanded first: pairs are counted where both words are.
* Level 2 to 3 goes in waves, best bounds first. A wave has a score per language down to which
  all is to be settled: that of the language's ``k``-th best pair. It counts the triples both
  of whose ends are bounded by it or more, and those around pairs that score so much, as
  these may make the pair redundant. What scores less cannot come before.
* A language is settled when ``top`` surviving phrases score that much or more, or when nothing
  is left; else it takes part in the next, wider wave.

The counting passes know words by 64-bit hashes and count per task first. The filters that
they carry only save work: what a false hit adds is counted rightly or too rare.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seawake.llm.common import batch, map_arrow, slices, tidy_shuffles, windows, word_hashes
from seawake.session import stored

LEAST = 10
TOP = 2000
#: Pairs per language that the first wave settles, and how much further each next one goes.
FIRST_WAVE, WIDER = 6000, 8
#: Cells of a filter: eight per key at least, 32 MB at most; a full one only saves less.
MAX_CELLS = 1 << 25
#: Occurrences that a task holds before it counts them.
HELD = 2_000_000

SPACE = np.isin(np.arange(256), [32, 9])
STOP = np.isin(np.arange(256), [10, 11, 12, 13, *b".,;:!?"])
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
KEYS = ("w1", "w2", "w3")
#: What the filter of a wave says of a pair: phrases that start, or end, with it may score high
#: enough; all triples around it are wanted.
STARTS, ENDS, AROUND = 1, 2, 4


def counted(width: int) -> pa.Schema:
    """Rows of phrases of ``width`` words: word hashes and a count; single words with their text."""
    fields = [("lang", pa.string()), *((k, pa.int64()) for k in KEYS[:width]), ("n", pa.int64())]
    return pa.schema(fields + ([("word", pa.string())] if width == 1 else []))


def word_texts(data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    return [data[lo:hi].translate(LOWER).decode("utf-8", "surrogatepass") for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]


def occurrences(docs: DataFrame, width: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Counts per task and language of the phrases of ``width`` words. ``wanted`` takes all
    word hashes and whether each word and the next lie in one piece, and says at which
    words a phrase is to be counted."""
    schema = counted(width)

    def count(lang, held):
        keys = np.concatenate([h[0] for h in held])
        _, first, n = np.unique(keys, return_index=True, return_counts=True)
        words = [np.concatenate([h[1][k] for h in held])[first].view(np.int64) for k in range(width)]
        text = []
        if width == 1:
            text, base = [[] for _ in first], np.cumsum([0, *(len(h[0]) for h in held)])
            of = np.searchsorted(base, first, "right") - 1
            for k, (_, _, data, starts, ends) in enumerate(held):
                mine = np.flatnonzero(of == k)
                at = first[mine] - base[k]
                for i, word in zip(mine, word_texts(data, starts[at], ends[at]), strict=True):
                    text[i] = word
            text = [text]
        return batch(schema, [lang] * len(first), *words, n, *text)

    def emit(batches):
        held, size = {}, 0
        for part, texts in slices(batches):
            langs = part.column(part.schema.get_field_index("lang")).to_pylist()
            for lang in dict.fromkeys(langs):
                some = [t.encode("utf-8", "surrogatepass") for t, own in zip(texts, langs, strict=True) if own == lang]
                hashes, bounds, starts, ends = word_hashes(some, SPACE | STOP, spans=True)
                if len(hashes) < width:
                    continue
                lengths = np.array([len(t) + 1 for t in some])
                base = np.repeat(np.cumsum(lengths) - lengths, np.diff(bounds))
                starts, ends = starts + base, ends + base
                data = b"\n".join(some) + b"\n"
                stops = np.concatenate([[0], np.cumsum(STOP[np.frombuffer(data, np.uint8)])])
                at = np.flatnonzero(wanted(hashes, stops[starts[1:]] == stops[ends[:-1]]))
                keys = (hashes if width == 1 else windows(hashes, width))[at]
                more = (data, starts[at], ends[at]) if width == 1 else ()
                held.setdefault(lang, []).append((keys, [hashes[at + k] for k in range(width)], *more))
                size += len(at)
            if size > HELD:
                for item in held.items():
                    yield count(*item)
                held, size = {}, 0
        for item in held.items():
            yield count(*item)

    found = map_arrow(docs.select("lang", "text"), emit, schema)
    return found.groupBy("lang", *KEYS[:width], *(["word"] if width == 1 else [])).agg(F.sum("n").alias("n"))


def cell_filter(keys: DataFrame, flags: Column) -> np.ndarray:
    """A byte of flags per cell for the ``w1, w2`` of all rows; words alone have no w2."""
    cells = 1 << max(10, (8 * keys.count() - 1).bit_length())
    cells = min(cells, MAX_CELLS)
    cell = F.col("w1").bitwiseXOR(F.shiftleft("w2", 1)) if "w2" in keys.columns else F.col("w1")
    cell = cell.bitwiseAND(F.lit(cells - 1))
    rows = keys.select(cell.alias("cell"), flags.cast("long").alias("flags"))
    lines = rows.groupBy(F.shiftright("cell", 3).alias("line")).agg(
        F.expr("bit_or(shiftleft(flags, CAST(8 * (cell & 7) AS INT)))").alias("bits")
    )
    out, found = np.zeros(cells // 8, np.int64), lines.toArrow().to_pandas()
    out[found["line"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def flags_of(table: np.ndarray, w1: np.ndarray, w2: np.ndarray | None = None) -> np.ndarray:
    key = w1 if w2 is None else w1 ^ (w2 << np.uint64(1))
    return table[(key & np.uint64(len(table) - 1)).astype(np.int64)]


def cut_score(left: str, right: str) -> Column:
    """``floor(1000000 a² / (left right))`` exactly, with products of up to 38 digits."""
    exact = "CAST({} AS DECIMAL(18, 0))".format
    return F.expr(f"({exact('a')} * {exact('a')} * 1000000) DIV ({exact(left)} * {exact(right)})")


def frequent_words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lang, w1, word, f)`` of the words of ``LEAST`` occurrences, and ``(lang, total)`` of all."""
    words = stored(occurrences(docs, 1, lambda h, joined: np.ones(len(h), bool)), "words")
    frequent = words.where(F.col("n") >= LEAST).select("lang", "w1", "word", F.col("n").alias("f"))
    return frequent, words.groupBy("lang").agg(F.sum("n").alias("total"))


def scored_pairs(docs: DataFrame, words: DataFrame) -> DataFrame:
    """All pairs of ``LEAST`` occurrences: ``lang, w1, w2, a, l, r, score`` and the bounds of
    longer phrases that begin or end with them."""
    wanted = docs.sparkSession.sparkContext.broadcast(cell_filter(words, F.lit(1)))

    def both_frequent(h, joined):
        known = flags_of(wanted.value, h) != 0
        return joined & known[:-1] & known[1:]

    pairs = occurrences(docs, 2, both_frequent).where(F.col("n") >= LEAST).withColumnRenamed("n", "a")
    pairs = _with_count(_with_count(pairs, words, ["w1"], "l"), words, ["w2"], "r")
    ahead = [F.expr(f"1000000 * a DIV {c}").alias(name) for c, name in (("l", "starts"), ("r", "ends"))]
    out = stored(pairs.select("lang", "w1", "w2", "a", "l", "r", cut_score("l", "r").alias("score"), *ahead), "pairs")
    wanted.destroy()
    return out


def _with_count(rows: DataFrame, counts: DataFrame, on: list[str], name: str) -> DataFrame:
    """``rows`` with the count of the phrase made of their words ``on``."""
    keys = list(KEYS[: len(on)])
    value = "f" if "f" in counts.columns else "a"
    side = counts.select("lang", *[F.col(k).alias(o) for k, o in zip(keys, on, strict=True)], F.col(value).alias(name))
    return rows.join(side, ["lang", *on])


def wave_levels(pairs: DataFrame, pairs_per_lang: int) -> DataFrame:
    """``(lang, level)``: the score of the language's pair of this rank, 0 if it has fewer. Pairs
    are counted by score first, which has a million values at most."""
    by_score = pairs.groupBy("lang", "score").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    reached = F.when(upto >= pairs_per_lang, F.col("score"))
    return by_score.select("lang", reached.alias("level")).groupBy("lang").agg(F.coalesce(F.max("level"), F.lit(0)).alias("level"))


def scored_triples(docs: DataFrame, words: DataFrame, pairs: DataFrame, levels: DataFrame) -> DataFrame:
    """The triples of ``LEAST`` occurrences that a wave counts, like ``scored_pairs`` with w3."""
    near = pairs.join(levels, "lang")
    flag = F.lit(0)
    for column, bit in (("starts", STARTS), ("ends", ENDS), ("score", AROUND)):
        flag = flag + F.when(F.col(column) >= F.col("level"), bit).otherwise(0)
    near = stored(near.select("lang", "w1", "w2", flag.alias("flags")).where("flags > 0"), "frontier")
    table = docs.sparkSession.sparkContext.broadcast(cell_filter(near, F.col("flags")))

    def hopeful(h, joined):
        flags = np.where(joined, flags_of(table.value, h[:-1], h[1:]), 0).astype(np.uint8)
        first, second = flags[:-1], flags[1:]
        good = ((first & STARTS) != 0) & ((second & ENDS) != 0) | ((first & AROUND) != 0) | ((second & AROUND) != 0)
        return joined[:-1] & joined[1:] & good

    found = occurrences(docs, 3, hopeful).where(F.col("n") >= LEAST).withColumnRenamed("n", "a").join(levels.select("lang"), "lang", "left_semi")
    for on, counts, name in ((["w1"], words, "l1"), (["w2", "w3"], pairs, "r1"), (["w1", "w2"], pairs, "l2"), (["w3"], words, "r2")):
        found = _with_count(found, counts, on, name)
    found = found.withColumns({"s1": cut_score("l1", "r1"), "s2": cut_score("l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    out = stored(
        found.select("lang", *KEYS, "a", *[F.when(first, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(c) for c in ("l", "r")], F.least("s1", "s2").alias("score")),
        "triples",
    )
    table.destroy()
    return out


def survivors(pairs: DataFrame, triples: DataFrame, levels: DataFrame) -> DataFrame:
    """Phrases that score their language's level or more, less pairs that a triple makes redundant."""
    parts = triples.select("lang", "w1", "w2", "a").union(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longest = parts.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    high = pairs.join(levels, "lang").where("score >= level").join(longest, ["lang", "w1", "w2"], "left")
    kept = high.where("longer IS NULL OR 100 * longer < 50 * a").select("lang", "w1", "w2", F.lit(None).cast("long").alias("w3"), "a", "l", "r", "score")
    return kept.unionByName(triples.join(levels, "lang").where("score >= level").select("lang", *KEYS, "a", "l", "r", "score"))


def best_phrases(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases of ``docs``
    (text, lang; other columns are ignored).

    A-Z are lowered, pieces end at ``[.,;:!?\\x0A-\\x0D]``, words are parted by blanks and tabs.
    Phrases have 2 or 3 words and occur ``LEAST`` times or more within pieces of their
    language; ``n`` is the number of all its words. Order: score, then count, both
    descending, then the phrase's bytes.

    A null or empty text has no words, a null lang is ``und`` (one with texts that say so),
    repeated rows count again, an empty table or a language without phrases gives no rows.
    """
    with tidy_shuffles(docs.sparkSession):
        docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
        words, totals = frequent_words(docs)
        pairs = scored_pairs(docs, words)
        settled, closed, wave = [], None, FIRST_WAVE
        while True:
            levels = wave_levels(pairs, wave)
            levels = stored(levels if closed is None else levels.join(closed, "lang", "left_anti"), "levels")
            found = stored(survivors(pairs, scored_triples(docs, words, pairs, levels), levels), "survivors")
            enough = levels.join(found.groupBy("lang").agg(F.count("*").alias("n")), "lang", "left").where(f"level = 0 OR n >= {top}")
            enough = stored(enough.select("lang"), "settled")
            settled.append(found.join(enough, "lang", "left_semi"))
            closed = enough if closed is None else closed.union(enough)
            if levels.join(enough, "lang", "left_anti").isEmpty():
                break
            wave *= WIDER
        best = settled[0]
        for more in settled[1:]:
            best = best.union(more)
        return _ranked(best, words, totals, top)


def _ranked(best: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Texts are looked up for those that may be among the first, ties at the end included."""
    order = [F.desc("score"), F.desc("a")]
    close = best.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)
    for k in KEYS:
        close = close.join(words.select("lang", F.col("w1").alias(k), F.col("word").alias(f"{k}_text")), ["lang", k], "left")
    named = close.withColumn("phrase", F.concat_ws(" ", *[f"{k}_text" for k in KEYS]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    first = named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
