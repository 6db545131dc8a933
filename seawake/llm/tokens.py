"""Token ids of whole texts, by a tokenizer file of the ``tokenizers`` library.

Both kinds of file used here look at a word and the blank before it, or at a run of white
space, at a time, and at a sign after an ASCII letter and before white space apart from its
word. So a text's ids are those of its units, one after the other. Units are found and
hashed for many texts at once, and their ids gathered from arrays; only units that a worker
process has not met are tokenized. It keeps up to ``MEMO_UNITS`` of them, known by 64-bit
hashes; beyond, the later half goes, as common units come early.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from seawake.llm.common import mix, process_cache, random_words

MEMO_UNITS = 1_500_000
LONG_UNIT = 64
_UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that Python or the tokenizers count as white space, other than ASCII ones, and the
#: separators on which they differ. Texts with them are cut into units one by one.
_DOUBTFUL = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_DIFFERENT = re.compile("[\x1c-\x1f]")
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
_LETTER = np.array([chr(b).isalpha() if b < 128 else False for b in range(256)])
_SIGN = np.isin(np.arange(256), list(b".,;:!?"))


def units(text: str, keeps_blanks: bool) -> list[str]:
    """Parts of a text that are tokenized apart. ``keeps_blanks``: white space gives tokens
    too, and a blank belongs to the word after it."""
    if _DIFFERENT.search(text):
        return [text]
    return _UNIT.findall(text) if keeps_blanks else text.split()


def _loaded(path: str):
    held = process_cache("tokenizers").setdefault(path, {})
    if not held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        tokenizer, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        plain.encode_special_tokens = True  # their strings in a text are ordinary text
        probe = plain.encode("a b", add_special_tokens=False).tokens
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        held.update(tokenizer=tokenizer, plain=plain, special=special, mark_id=tokenizer.token_to_id(special[0]), memo=Memo())
        held["keeps_blanks"] = probe[-1] not in ("b", "b</w>")
        held["visible"] = visible_bytes()
    return held


def visible_bytes() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a visible character: itself where it is one in
    Latin-1, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


def _encode_apart(some: list[str], held: dict) -> dict[str, bytes]:
    """Ids of each unit. All are encoded in one call, parted by a special token, which the
    library takes out before it looks at the rest."""
    whole = held["special"][0].join(some)
    if sum(whole.count(x) for x in held["special"]) >= len(some):
        return {u: array("I", held["plain"].encode(u, add_special_tokens=False).ids).tobytes() for u in some}
    ids = np.array(held["tokenizer"].encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.uint32)
    ends = np.append(np.flatnonzero(ids == held["mark_id"]), len(ids)).tolist()
    data = ids.tobytes()
    return {u: data[4 * lo : 4 * hi] for u, lo, hi in zip(some, [0, *[e + 1 for e in ends[:-1]]], ends, strict=True)}


def _encode_new(new: list[str], held: dict) -> dict[str, bytes]:
    """Ids of units. A unit of letters is one word to either tokenizer, and so is a sign
    after it; these go to the library's merging model itself, which is most of the work
    less its general preparation. All others take the usual way."""
    merge, visible, keeps_blanks = held["tokenizer"].model.tokenize, held["visible"], held["keeps_blanks"]
    normal, blank = held["tokenizer"].normalizer.normalize_str if not keeps_blanks else None, visible[32]
    signs = {c: array("I", [t.id for t in merge(c)]) for c in ".,;:!?"}
    out, others = {}, []
    for u in new:
        after = signs.get(u[-1])
        word = u if after is None else u[:-1]
        first = ""
        if not keeps_blanks:
            word = word.lower() if word.isascii() else normal(word)
        elif word[:1] == " ":
            word, first = word[1:], blank
        if len(u) > LONG_UNIT or not word.isalpha():
            others.append(u)
            continue
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(visible)
        ids = array("I", [t.id for t in merge(first + word)])
        out[u] = (ids if after is None else ids + after).tobytes()
    for at in range(0, len(others), 2048):
        out |= _encode_apart(others[at : at + 2048], held)
    return out


def _spans(data: np.ndarray, bounds: np.ndarray, keeps_blanks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the units of all texts, which ``bounds`` part in ``data``; a
    new line stands after each text and belongs to none."""
    white = _WHITE[data]
    after = np.append(white[1:], True)
    sign = _SIGN[data] & after
    sign[1:] &= _LETTER[data[:-1]]
    sign[0] = False
    inside = ~white & ~sign
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    signs = np.flatnonzero(sign)
    values = random_words(256, 5)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    terms = values[data[inside]] * random_words(int(lengths.max(initial=1)), 6)[place]
    hashes = np.add.reduceat(terms, first) + lengths.astype(np.uint64) if len(starts) else np.zeros(0, np.uint64)
    if not keeps_blanks:
        hashes = mix(hashes)
    else:
        own = np.isin(starts, bounds)
        blank = ~own & (data[starts - 1] == 32)
        hashes = mix(hashes * np.uint64(2) + blank.astype(np.uint64))
        starts = starts - blank
    parts = [(starts, ends, hashes), (signs, signs + 1, mix(values[data[signs]] ^ np.uint64(1)))]
    if keeps_blanks:
        parts.append(_gaps(data, bounds, np.sort(np.concatenate([starts, signs])), np.sort(np.concatenate([ends, signs + 1]))))
    starts, ends, hashes = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], hashes[order]


def _gaps(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The units of white space between words. Before a word without a blank of its own the
    last one stands alone; otherwise a run is one unit."""
    lo = np.sort(np.concatenate([bounds[:-1], ends]))
    hi = np.sort(np.concatenate([starts, bounds[1:] - 1]))
    before_word = np.isin(hi, starts) & (data[np.minimum(hi, len(data) - 1)] != 32)
    some = hi > lo
    lo, hi, before_word = lo[some], hi[some], before_word[some]
    split = before_word & (hi - lo > 1)
    last = hi[split] - 1
    hi = hi.copy()
    hi[split] -= 1
    lo, hi = np.concatenate([lo, last]), np.concatenate([hi, last + 1])
    raw = data.tobytes()
    names = [raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    known = {n: np.uint64(hash_bytes(n)) for n in set(names)}
    return lo, hi, np.array([known[n] for n in names], np.uint64)


def hash_bytes(raw: bytes) -> int:
    """The hash of one unit of white space."""
    codes = np.frombuffer(raw, np.uint8)
    terms = random_words(256, 8)[codes] * random_words(len(codes), 9)
    return int(mix(np.array([terms.sum() + np.uint64(len(codes))], np.uint64))[0])


class Memo:
    """Ids of units in arrays, sorted by the units' hashes. New units wait in arrays of their own,
    which are few and sorted anew, until they are a quarter as many as the others."""

    def __init__(self):
        self.known, self.fresh, self.ids, self.n_ids = _no_units(), _no_units(), np.zeros(1 << 16, np.uint32), 0

    def __len__(self) -> int:
        return len(self.known[0]) + len(self.fresh[0])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the units begin, and their number: -1 for unknown units."""
        at, n = np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        for own, begins, counts in (self.known, self.fresh):
            if len(own):
                k = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[k] == keys
                at[hit], n[hit] = begins[k[hit]], counts[k[hit]]
        return at, n

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        n, more = np.array([len(x) // 4 for x in ids], np.int32), np.frombuffer(b"".join(ids), np.uint32)
        at = (self.n_ids + np.cumsum(n) - n).astype(np.int32)  # ``trim`` keeps them far below 2 ** 31
        if self.n_ids + len(more) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.zeros(len(more) + self.n_ids // 2, np.uint32)])
        self.ids[self.n_ids : self.n_ids + len(more)] = more
        self.n_ids += len(more)
        self.fresh = _by_key(self.fresh, (keys, at, n))
        if 4 * len(self.fresh[0]) > len(self.known[0]):
            self.known, self.fresh = _by_key(self.known, self.fresh), _no_units()

    def trim(self, most: int) -> None:
        """Forgets the later half while there are more units than that, or very long ones."""
        while len(self) and (len(self) > most or self.n_ids > LONG_UNIT * most):
            keys, at, n = _by_key(self.known, self.fresh)
            limit = np.partition(at, len(at) // 2)[len(at) // 2]
            early = at < limit
            self.known, self.fresh = (keys[early], at[early], n[early]), _no_units()
            self.ids, self.n_ids = self.ids[:limit].copy(), int(limit)

    def gather(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these units in a row, and where each begins."""
        begins = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.repeat(at - begins[:-1], n) + np.arange(begins[-1])], begins


def _no_units() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)


def _by_key(some: tuple, more: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, at, n = (np.concatenate(c) for c in zip(some, more, strict=True))
    order = np.argsort(keys, kind="stable")
    return keys[order], at[order], n[order]


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    held = _loaded(path)
    plain = [k for k, t in enumerate(texts) if t.isascii() and not _DIFFERENT.search(t) or not _DOUBTFUL.search(t)]
    out = [b""] * len(texts)
    for k in set(range(len(texts))).difference(plain):
        parts = units(texts[k], held["keeps_blanks"])
        ids = _encode_new(list(set(parts)), held)
        out[k] = b"".join(map(ids.__getitem__, parts))
    if plain:
        for k, ids in zip(plain, _encode_together([texts[k] for k in plain], held), strict=True):
            out[k] = ids
    return out


def _encode_together(texts: list[str], held: dict) -> list[bytes]:
    memo, raw = held["memo"], [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw) + b"\n"
    bounds = np.cumsum([0, *(len(t) + 1 for t in raw)])
    starts, ends, keys = _spans(np.frombuffer(joined, np.uint8), bounds, held["keeps_blanks"])
    unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
    at, n = memo.find(unique)
    new = np.flatnonzero(n < 0)
    if len(new):
        names = [joined[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        ids = _encode_new(names, held)
        memo.add(unique[new], [ids[n] for n in names])
        at, n = memo.find(unique)
    every, begins = memo.gather(at[which], n[which])
    cuts = begins[np.searchsorted(starts, bounds)]
    memo.trim(MEMO_UNITS)
    data = every.astype("<u4", copy=False).tobytes()
    return [data[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
