"""Groups of near copies against all pairs; the screen against its own promise."""

import random

import numpy as np
import pytest

from seawake.llm import minhash as M
from tests.llm.helpers import components, documents, edited, prose, shingles, with_clashes
from tests.llm.test_ngram_join import corpus


@pytest.mark.parametrize("block", [1000, 3])
def test_same_as_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    texts = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in M.similar_groups(with_clashes(documents(spark, texts))).collect()}
    sets = [(i, shingles(t, 4)) for i, t in enumerate(texts)]
    want = components(sets, 80)
    assert got == {i: (len(s), want[i], want[i] == i) for i, s in sets}
    assert len(set(want.values())) < len(texts) - 30


def test_second_round_finds_links_between_groups(spark, monkeypatch):
    """A chain of edits: neighbours are linked, others are not, and no star holds it all."""
    rng, texts = random.Random(9), [prose(random.Random(8), 60)]
    for _ in range(40):
        texts.append(edited(rng, texts[-1], 1))
    rng.shuffle(texts)
    for block in (1000, 4):
        monkeypatch.setattr(M, "BLOCK", block)
        got = {r["doc_id"]: r["component_id"] for r in M.similar_groups(documents(spark, texts)).collect()}
        assert got == components([(i, shingles(t, 4)) for i, t in enumerate(texts)], 80)


def test_repeated_and_missing_ids(spark):
    rng = random.Random(1)
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(7, a), (7, a), (3, a), (5, b), (5, edited(rng, a, 1)), (9, b), (None, a), (None, None), (8, ""), (8, b)]
    got = M.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1)] * 2 + [(3, 3), (5, 3), (5, 3), (7, 3), (7, 3), (8, 3), (8, 3), (9, 3)]
    assert {r["kept"] for r in got if r["doc_id"] is None} == {None}


def test_empty_table_and_long_texts(spark):
    assert M.similar_groups(documents(spark, [])).count() == 0
    long = prose(random.Random(5), 60_000)
    got = M.similar_groups(documents(spark, [long, long + " end", "x" * 300_000, None, "", " \t"])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_screen_keeps_pairs_at_the_threshold():
    """Signatures of pairs right at 0.8 share a band and pass the screen; far ones do not."""
    rng, least = np.random.default_rng(3), M.least_matches(80)
    kept = far = 0
    for _ in range(300):
        common = rng.integers(0, 2**63, 80).astype(np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, 10).astype(np.uint64)]) for _ in "ab")
        x, y = M.signature(a), M.signature(b)
        shares = (M.band_keys(x[None]) == M.band_keys(y[None])).any()
        kept += bool(shares and len(M.passes((x == y)[None], least)))
        z = M.signature(rng.integers(0, 2**63, 90).astype(np.uint64))
        far += len(M.passes((x == z)[None], least))
    assert kept == 300 and far == 0


def test_estimate_of_similarity():
    rng, off = np.random.default_rng(4), []
    for _ in range(100):
        common = rng.integers(0, 2**63, 50).astype(np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, 25).astype(np.uint64)]) for _ in "ab")
        off.append((M.signature(a) == M.signature(b)).mean() - 0.5)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.08
