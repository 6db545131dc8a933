import random

import pytest

from seawake.llm import ngram_join as N
from tests.llm.helpers import components, documents, edited, prose, shingles, with_clashes


def corpus():
    rng = random.Random(3)
    originals = [prose(rng, rng.randint(20, 120)) for _ in range(25)]
    texts = [*originals]
    for text in originals[:8]:
        texts += [text] * 3 + [edited(rng, text, k) for k in (1, 1, 2, 3, 4)]
    # a large group whose members differ by enough to be linked only in part
    texts += [edited(rng, originals[9], rng.randint(1, 5)) for _ in range(60)]
    passage = prose(rng, 40)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 15) for _ in range(40)]
    return [*texts, None, "", " \t\n", "one", "One", "one two three four", "ONE two\tthree four", "one two three four five", "É é à la", texts[0].upper()]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_same_as_all_pairs(spark, monkeypatch, small_blocks):
    if small_blocks:
        for name, value in (("MAX_FREQUENT", 300), ("LONG_COLUMN", 6), ("BLOCK_GRAMS", 400), ("COLUMN_POWER", 2)):
            monkeypatch.setattr(N, name, value)
    texts = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.similar_groups(with_clashes(documents(spark, texts))).collect()}
    sets = [(i, shingles(t)) for i, t in enumerate(texts)]
    want = components(sets)
    assert got == {i: (len(s), want[i]) for i, s in sets}
    assert len(set(want.values())) < len(texts) - 30


def test_repeated_and_missing_ids(spark):
    rng = random.Random(1)
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(7, a), (7, a), (3, a), (5, b), (5, edited(rng, a, 1)), (None, a), (None, None)]
    got = N.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, -1), (3, 3), (5, 3), (5, 3), (7, 3), (7, 3)]


def test_empty_table_and_one_long_text(spark):
    assert N.similar_groups(documents(spark, [])).count() == 0
    long = prose(random.Random(5), 60_000)
    got = N.similar_groups(documents(spark, [long, long + " end", "x" * 300_000])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(0, 0), (1, 0), (2, 2)]


def test_sketch_never_overstates_the_difference():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 500):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n).astype(np.uint64)]))
        assert N.least_difference(N.sketch(a), N.sketch(b)) <= len(np.setxor1d(a, b))
        assert N.least_difference(N.sketch(a), N.sketch(a)) == 0
