"""Phrases against a plain count of all of them."""

import random
import re
from collections import Counter, defaultdict

import pytest

from seawake.llm import collocations as C
from tests.llm.helpers import LOWER, documents, prose

DDL = "doc_id long, text string, lang string"


def plain(rows, top):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {}
        for p, a in f.items():
            if len(p) > 1 and a >= 10:
                cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                candidates[p] = (score, a, f[p[:k]], f[p[k:]])
        longer = Counter()
        for p, (_, a, _, _) in candidates.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        kept = [(-s, -a, " ".join(p).encode(), l, r) for p, (s, a, l, r) in candidates.items() if len(p) == 3 or 100 * longer[p] < 50 * a]
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def corpus(seed=1, texts=150):
    rng = random.Random(seed)
    common, rare = prose(rng, 25).split(), prose(rng, 60).split()
    fixed = [" ".join(rng.choices(rare, k=rng.choice([2, 3, 3, 4]))) for _ in range(30)]
    rows = []
    for i in range(texts):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(common) for _ in range(rng.randint(5, 90))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for p in parts)
        rows.append((i, text.upper() if i % 7 == 0 else text, ["en", "de", None, "und"][i % 4]))
    return rows


@pytest.mark.parametrize("wave, top", [(6000, 2000), (3, 8)])
def test_same_as_counting_all(spark, monkeypatch, wave, top):
    monkeypatch.setattr(C, "FIRST_WAVE", wave)
    monkeypatch.setattr(C, "WIDER", 3)
    rows = corpus()
    got = sorted(map(tuple, C.best_phrases(spark.createDataFrame(rows, DDL), top).collect()))
    want = plain(rows, top)
    assert got == want and len(want) > 20
    assert {len(r[2].split()) for r in want} == {2, 3}


def test_filters_only_save_work(spark, monkeypatch):
    monkeypatch.setattr(C, "FIRST_WAVE", 4)
    monkeypatch.setattr(C, "MAX_CELLS", 1 << 10)
    monkeypatch.setattr(C, "HELD", 500)
    rows = corpus(5, 60)
    assert sorted(map(tuple, C.best_phrases(spark.createDataFrame(rows, DDL), 10).collect())) == plain(rows, 10)


def test_odd_texts(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, "en"), (2, "", "en"), (3, " \t ", None), (4, "é è. " * 12, None), (5, "a b c " * 9, "en"), (6, "a b c", "en"), (6, "a b c", "en")]
    rows += [(7, "Long word " * 60_000, "fr"), (8, "x" * 300_000, "fr")]
    df = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("clash") for c in "w1 w2 n key word f score level rank phrase a".split()})
    assert sorted(map(tuple, C.best_phrases(df).collect())) == plain(rows, 2000)


def test_large_counts_are_exact(spark):
    a, l, r = 3_000_000_000_007, 4_000_000_000_001, 5_000_000_000_003
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(C.cut_score("l", "r").alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (l * r)


def test_empty_table(spark):
    assert C.best_phrases(documents(spark, [])).count() == 0
