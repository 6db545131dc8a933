import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from seawake.llm import packing, token_files, tokens
from seawake.llm.queries import tokenizer_file
from tests.llm.helpers import documents, prose, with_clashes

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
ODD = [
    "", " ", "a  b", " a", "a ", "a\n b", "a \n b", "a\n \n b", "x<|endoftext|>y", "<|startoftext|>", " \n ", "a's 's", "é é", "a\tb c", "\x1c a \x1c b", "don't  stop\n\n  ok",
    "a\u00a0 d\u3000\u3000e", "x \t y\x85z", "İstanbul İ.", "É. Émile, ǅ!", "ﬁn n²x ½", "ΌΣΟΣ. Σ", "日本語。 日本語.", "क्ष. ١٢٣ x١", "a_b _", " ...", ".", "a" * 500, "Å Å",
]


def plain(texts, path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, np.uint32) for x in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_those_of_whole_texts(path):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices(["a", " ", "\n", ".", "'s", "É", "9", "\t", "the", " of", "ß", "́"], k=40)) for _ in range(300)]
    assert tokens.encode(texts, path) == [w.tobytes() for w in plain(texts, path)]


def test_memory_of_units_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_UNITS", 50)
    texts = [prose(random.Random(k), 60) for k in range(30)]
    for t, want in zip(texts, plain(texts, BYTE), strict=True):
        assert tokens.encode([t], BYTE)[0] == want.tobytes()
    assert len(tokens._loaded(BYTE)["memo"]) <= 50


def test_units_are_kept_in_sixteen_bytes():
    """Apart from their ids: a worker keeps very many."""
    memo = tokens.Memo()
    memo.add(np.arange(1, 9, dtype=np.uint64), [bytes(4 * k) for k in range(8)])
    assert sum(c.itemsize for c in memo.known) == 16
    at, n = memo.find(np.array([8, 3, 99], np.uint64))
    assert at[:2].tolist() == [21, 1] and n.tolist() == [7, 2, -1]


def test_fullest_is_the_best_sum():
    rng = random.Random(6)
    for _ in range(60):
        supply = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room, sums = rng.randint(0, 90), {0}
        for x, c in supply.items():
            sums = {s + k * x for s in sums for k in range(c + 1)}
        taken = packing.fullest(supply, room)
        assert sum(x * k for x, k in taken.items()) == max(s for s in sums if s <= room)
        assert all(k <= supply[x] for x, k in taken.items())


def test_packing(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([1, 3, 20, 20, 20, 90])) for _ in range(150)] + [None, "", "", prose(rng, 900)]
    got = packing.pack(with_clashes(documents(spark, texts)), BYTE, 0, 64).toPandas().sort_values(["doc_id", "piece"])
    for doc, ids in zip(range(len(texts)), plain(texts, BYTE), strict=True):
        ids, own = np.append(ids, np.uint32(0)), got[got.doc_id == doc]
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids)
        assert (len(own) == 1) == (len(ids) <= 64) and (own.length.iloc[1:] == 64).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 64
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 1
    assert packing.pack(documents(spark, []), BYTE).count() == 0
    twice = packing.pack(documents(spark, ["a b"] * 2).selectExpr("CAST(NULL AS LONG) AS doc_id", "text"), BYTE)
    assert [r["doc_id"] for r in twice.collect()] == [None, None]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bits_and_random_access(bits, tmp_path):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 3 * token_files.BLOCK + 77).astype(np.uint32)
    assert (token_files.unpack_bits(token_files.pack_bits(ids, bits), bits, len(ids)) == ids).all()
    path = str(tmp_path / "x" / "a.tok")
    writer = token_files.Writer(path, bits)
    cuts = [0, 1, 1, 5000, 2 * token_files.BLOCK, len(ids)]
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        writer.add(None if k == 1 else k, ids[lo:hi])
    writer.close()
    reader = token_files.Reader(path)
    assert reader.bits == bits and reader.docs.tolist() == [0, token_files.NO_DOC, 2, 3, 4]
    for lo, hi in ((0, 1), (8190, 8200), (100, 3 * token_files.BLOCK + 3), (len(ids) - 1, len(ids)), (5, 5)):
        assert (reader.ids(lo, hi) == ids[lo:hi]).all()
    assert (reader.document(3) == ids[5000 : 2 * token_files.BLOCK]).all()
    reader.close()


def test_token_files(spark, tmp_path):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(80)] + [None, "", prose(rng, 40_000)]
    docs = with_clashes(documents(spark, texts)).orderBy("text")
    got = token_files.token_table(docs, WORD, 1, 49_408, str(tmp_path / "ids")).toPandas().sort_values("doc_id")
    start = 0
    for r, ids in zip(got.itertuples(), plain(texts, WORD), strict=True):
        ids = np.append(ids, np.uint32(1))
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_table(documents(spark, []), WORD, 1, 49_408, str(tmp_path / "none")).count() == 0
    odd = documents(spark, ["a b", "c", "c"]).selectExpr("IF(doc_id = 0, NULL, 5L) AS doc_id", "text")
    assert [(r["doc_id"], r["start"]) for r in token_files.token_table(odd, WORD, 1, 49_408, str(tmp_path / "odd")).orderBy("start").collect()] == [(None, 0), (5, 3), (5, 5)]
