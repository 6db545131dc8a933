"""Compression bands, importance resampling, toxicity and decontamination."""

import base64
import collections
import math
import random
import re

import numpy as np
import pytest

from seawake.llm import compression, decontamination, importance, toxicity
from tests.llm.helpers import WORD, documents, edited, prose, with_clashes


# --- compression bands -------------------------------------------------------
def plain_counts(text):
    words = WORD.findall(text)
    seen = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + d for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_and_bands(spark):
    rng = random.Random(1)
    long = prose(rng, 3000)
    noise = " ".join(base64.b64encode(rng.randbytes(60)).decode() for _ in range(120))
    half = prose(rng, 1200) + "\n" + noise * 2
    texts = [None, "", "a b a b a b", prose(rng, 80), "a\n\na\n b\nA|*<\n" * 3, long, noise, half, "one two three " * 60, "é " * 70, prose(rng, 60) + "\n" + prose(rng, 60)]
    got = {r["doc_id"]: r for r in compression.quality_rules(with_clashes(documents(spark, texts))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_counts(t or "")
    assert [i for i in got if got[i]["kept"]] == [3, 5, 10]
    assert not got[6]["base_failed"] and not got[7]["base_failed"]  # only the bands reject these
    assert compression.quality_rules(documents(spark, [])).count() == 0


def test_chunks_cover_the_text():
    for n in (0, 1, 4096, 4097, 5200, 9000):
        assert b"".join(compression.chunks(b"x" * n)) == b"x" * n


# --- importance resampling ---------------------------------------------------
@pytest.mark.parametrize("k", [0, 1, 2, 7, 499, 500, 501])
def test_kth_greatest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([1.5, -2.0, rng.gauss(0, 1), rng.gauss(0, 1e9), 1.5 + 2e-16]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = math.inf if k == 0 else -math.inf if k >= 500 else sorted(values)[-k]
    assert importance.kth_greatest(df, "x", k, parts=8) == want


def test_resampling_prefers_the_target(spark):
    rng = random.Random(2)
    known = prose(rng, 60).split()
    good = [" ".join(rng.choices(known, k=80)) for _ in range(120)]
    bad = [" ".join(w + "%%" for w in rng.choices(known, k=80)) for _ in range(40)]
    texts = [*good, *bad, None, "", good[0]]
    labels = spark.createDataFrame([*[(i, 1, 0) for i in range(80)], *[(120 + i, 0, 0) for i in range(20)], (0, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = importance.resample(with_clashes(documents(spark, texts)), labels, share=0.7).toPandas().set_index("doc_id").sort_index()
    assert len(out) == len(texts) and abs(out.kept.sum() - round(0.7 * len(texts))) <= 1
    assert out.kept[:120].mean() > 0.9 and out.kept[120:160].mean() < 0.1
    assert out.log_weight[160] == 0 and out.n_grams[161] == 0
    # the models, counted plainly
    buckets, rows = importance.buckets_of([t or "" for t in texts])
    raw, target = np.bincount(buckets, minlength=importance.BUCKETS) + 1.0, np.bincount(buckets[rows < 80], minlength=importance.BUCKETS) + 1.0
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(np.bincount(rows, ratio[buckets], len(texts)), out.log_weight.sort_index())
    assert importance.resample(documents(spark, []), labels).count() == 0
    assert importance.resample(documents(spark, ["a b"]), labels.limit(0)).first()["kept"]


# --- toxicity ----------------------------------------------------------------
def toxic_corpus(n, seed):
    rng = random.Random(seed)
    texts, toxic = [], []
    for k in range(n):
        words = prose(rng, rng.randint(30, 120)).split()
        if k % 6 == 0:
            for _ in range(max(2, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(toxicity.INSULTS + toxicity.CONTEMPT + ("Zornwort", "zornworte"))
        texts.append(" ".join(words))
        toxic.append(int(k % 6 == 0))
    return texts, toxic


def test_chain_finds_toxic_texts_it_was_not_fitted_on(spark):
    texts, toxic = toxic_corpus(600, 1)
    labels = spark.createDataFrame([*[(i, 1, toxic[i]) for i in range(400)], (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = with_clashes(documents(spark, [*texts, None, "", texts[0]]))
    out = toxicity.judge(docs, labels).toPandas().set_index("doc_id").sort_index()
    held = out[400:600]
    truth = np.array(toxic[400:], bool)
    assert (held.toxic[truth]).mean() > 0.95 and (held.toxic[~truth]).mean() < 0.01
    assert (out.toxic == ~out.kept).all() and not out.toxic[600] and not out.toxic[601] and out.toxic[602]
    assert ((out[[f"p_{c}" for c in toxicity.CATEGORIES]] >= 0) & (out[[f"p_{c}" for c in toxicity.CATEGORIES]] <= 1)).all().all()
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == out.index[out.kept].tolist()


def test_chain_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["kept"] for r in toxicity.judge(documents(spark, ["idiot moron", None]), labels).collect()] == [True, True]
    assert toxicity.judge(documents(spark, []), labels).count() == 0
    assert toxicity.keep_clean(documents(spark, []), labels).count() == 0


def test_later_models_use_out_of_fold_predictions(monkeypatch):
    rng = np.random.default_rng(0)
    n = 900
    signal = rng.integers(0, 2, n)
    row = np.repeat(np.arange(n), 2)
    column = np.stack([np.where(signal == 1, 0, 1), 2 + rng.integers(0, 300, n)], 1).ravel()
    x = toxicity.Rows(row, column, np.ones(2 * n, np.float32), n, 302)
    seen = []
    fit = toxicity.fit_linear
    monkeypatch.setattr(toxicity, "fit_linear", lambda *a: seen.append((a[1].shape[1], a[3].sum())) or fit(*a))
    fold = np.arange(n) % toxicity.FOLDS
    sparse, dense = toxicity.fit_chain(x, np.stack([signal, signal], 1), fold)
    assert seen == [*[(0, 600)] * 3, (0, 900), *[(1, 600)] * 3, (1, 900)]
    assert sparse.shape == (2, 302) and [len(d) for d in dense] == [1, 2]
    assert dense[1][0] > 0  # the second category leans on the first


# --- decontamination ---------------------------------------------------------
def plain_alignment(a, b):
    best, h = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            s = decontamination.MATCH if x == y else decontamination.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontamination.GAP, h[i, j - 1] + decontamination.GAP)
            best = max(best, h[i, j])
    return best


def test_alignment_is_smith_waterman():
    rng = random.Random(3)
    words = [np.array([rng.randrange(0, 2**63, 2) for _ in range(6)], np.uint64)[[rng.randrange(6) for _ in range(rng.randint(1, 14))]] for _ in range(80)]
    a, b = words[:40], words[40:]
    assert decontamination.alignment_scores(a, b).tolist() == [plain_alignment(x, y) for x, y in zip(a, b, strict=True)]
    assert decontamination._by_size(a, b).tolist() == [plain_alignment(x, y) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("blocks", [False, True])
def test_copies_and_edited_copies_are_found(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", 800)
    rng = random.Random(4)
    items = [prose(rng, 30) for _ in range(12)]
    texts, want = [], set()
    for k in range(90):
        body = prose(rng, 120).split()
        if k % 3 == 0:
            copy = items[k % 12]
            copy = copy.upper() if k % 2 else edited(rng, copy, k % 5).replace(" ", ", ", 3)
            body[40:40] = copy.split()
            want.add((k, k % 12))
        texts.append(" ".join(body))
    texts += [None, "", items[0].split()[0], " ".join(items[1].split()[:6])]
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (50, "two words"), (51, None), (None, items[2])], "item_id long, text string")
    docs = with_clashes(documents(spark, texts).drop("item_id"))
    got = decontamination.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert all(0.5 <= r["score"] <= 1 for r in got)
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("item_id > 40")).count() == 0


def test_spread_edits_are_found_as_by_all_pairs(spark):
    rng = random.Random(5)
    items = [prose(rng, n) for n in (20, 20, 30, 30, 31, 24, 24, 40, 12)]
    texts = []
    for k in range(160):
        body, copy = prose(rng, 60).split(), items[k % len(items)].split()
        edits = 3 + k % 6
        for e in range(edits):  # spread over the item: changed, left out or added words
            at = (e * len(copy) + len(copy) // 2) // edits
            copy[at : at + 1] = ([prose(rng, 1)], [], [copy[at], prose(rng, 1)])[(k // 54 + (e if k % 5 == 0 else 0)) % 3]
        body[30:30] = copy
        texts.append(" ".join(body))
    # every third word edited, and a word added after every other one: no three words in a row are left
    every_third = " ".join("other" if i % 3 == 2 else w for i, w in enumerate(items[5].split()))
    added = " ".join(w + " x" if i % 2 else w for i, w in enumerate(items[7].split()))
    texts += [every_third, added, items[0], items[2]]
    hashed, others = decontamination.hashed_words(texts), decontamination.hashed_words(items)
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(items))]
    scores = decontamination._by_size([others[j] for _, j in pairs], [hashed[i] for i, _ in pairs])
    want = {p: s / (2 * len(others[p[1]])) for p, s in zip(pairs, scores.tolist(), strict=True) if s >= len(others[p[1]])}
    assert (160, 5) in want and (161, 7) in want and 100 < len(want) < len(texts)
    got = decontamination.contaminated(documents(spark, texts), spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == want


def test_no_task_holds_two_python_workers(spark, monkeypatch):
    """Passages are a table before they are aligned: a plan that looks and aligns in one stage needs twice the workers' memory."""
    plans, write = [], decontamination.stored

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(decontamination, "stored", watched)
    rng = random.Random(3)
    items = [prose(rng, 30) for _ in range(3)]
    docs = documents(spark, [prose(rng, 40) + " " + x for x in items])
    got = decontamination.contaminated(docs, spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 0), (1, 1), (2, 2)]
    assert plans and all(p.count("MapInArrow") == 1 for p in plans)
