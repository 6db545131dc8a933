"""Personal data: base patterns, and disguised forms found in a normalised copy of the text.

Transducers rewrite the text: look-alike characters one for one, then spelled digits,
at/dot disguises and invisible characters with an alignment to the source. Identifiers
are detected in the normalised text with the same patterns and checks, and their spans
are mapped back to source characters.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import batch, give_back, map_arrow, process_cache, slices

# --- fixed values ------------------------------------------------------------
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T",
    "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ı": "i", "İ": "I", "ſ": "s", "\u212a": "K", "ɑ": "a", "ɡ": "g", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "\u00a0": " ", "\u202f": " ", "\u2009": " ",
}
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: This many digit words in a row are a spelled number.
LEAST_WORDS = 3

_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_OPEN, _CLOSE = r"[ \t]?[\[({<][ \t]?", r"[ \t]?[\])}>][ \t]?"
_DOT = rf"(?:[ \t]+dot[ \t]+|{_OPEN}(?:dot|\.){_CLOSE})"
_RULES = {
    "hidden": r"[\u200b\u200c\u200d\u2060\ufeff\u00ad]+",
    "at": rf"{_OPEN}(?:at|@){_CLOSE}|(?<=[a-z0-9_%+-])[ \t]+at[ \t]+(?=[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+)",
    "dot": rf"(?<=[\w]){_DOT}(?=\w)",
    "plus": rf"(?:\bplus[ \t]+|\+[ \t]?)(?:{_WORD}\b|(?=[0-9(]))",
    "digits": rf"(?<!\w)(?:{_WORD}|[0-9]+)(?:[ -]|, )(?:(?:{_WORD}|[0-9]+|dot|point)(?:[ -]|, ))*(?:{_WORD}|[0-9]+)(?!\w)",
    "letter": r"(?<![^\W\d])[oil]+(?=[0-9])|(?<=[0-9])[oil]+(?![^\W\d])",
}
REWRITE = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _RULES.items()), re.IGNORECASE)
DOT = re.compile(_RULES["dot"], re.IGNORECASE)
#: What the rules need in a text for a change: every match that changes it holds one of these, or
#: is of rule ``digits`` and holds ``LEAST_WORDS`` digit words between characters of no word.
HINTS = tuple(
    re.compile(x)
    for x in (
        _RULES["hidden"],
        r"[\[({<][ \t]?(?:at|dot|[@.])[ \t]?[\])}>]",
        r"[ \t]dot[ \t]",
        rf"plus[ \t]+(?:{_WORD}|[0-9(])",
        rf"\+[ \t]?{_WORD}|\+[ \t][0-9(]",  # a + right before a digit stays as it is
        r"[oil][0-9]|[0-9][oil]",
    )
)
_TOKENS = re.compile(r"\w+")
_ITEMS = re.compile(rf"{_WORD}|[0-9]+|dot|point", re.IGNORECASE)
_SIGNS = {**DIGIT_WORDS, "dot": ".", "point": "."}
LETTER_DIGITS = {"o": "0", "i": "1", "l": "1"}


def fold_table() -> dict[int, str]:
    """One character for one: look-alikes, digits of all scripts, wide and mathematical forms."""
    table = {ord(k): v for k, v in LOOK_ALIKES.items()}
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) == "Nd":
            table[code] = str(unicodedata.decimal(c))
        elif 0xFF01 <= code <= 0xFF5E or 0x1D400 <= code <= 0x1D7FF or 0x24B6 <= code <= 0x24E9:
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii():
                table[code] = plain
    return table


def fold(text: str) -> str:
    """The text with look-alikes replaced; every character keeps its place."""
    if text.isascii():
        return text
    held = process_cache("pii-fold")
    if not held:
        held["table"] = fold_table()
        held["keys"] = frozenset(map(chr, held["table"]))
    return text if held["keys"].isdisjoint(set(text)) else text.translate(held["table"])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without overlap, found from their @ in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            out.append((start, free))
        at = text.find("@", free)
    return out


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base patterns, in order."""
    out = [(s, 0, e) for s, e in find_emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _digits(text: str) -> str:
    return "".join(_SIGNS.get(x.lower(), x) for x in _ITEMS.findall(text))


def has_hint(lower: str) -> bool:
    """Whether the rules can change a folded text, given in lower case: true for every text
    that they do change, cheap to answer for most others."""
    if any(h.search(lower) for h in HINTS):
        return True
    words = _TOKENS.findall(lower)
    return not DIGIT_WORDS.keys().isdisjoint(words) and sum(w in DIGIT_WORDS for w in words) >= LEAST_WORDS


def _rewritten(m: re.Match) -> str | None:
    """What a disguise stands for; None where it stays as it is."""
    kind, text = m.lastgroup, m.group()
    if kind == "plus":
        return "+" + _digits(text)
    if kind == "digits":
        words = sum(x.lower() in DIGIT_WORDS for x in _ITEMS.findall(text))
        return _digits(text) if words >= LEAST_WORDS else None
    if kind == "letter":
        return "".join(LETTER_DIGITS[c] for c in text.lower())
    return {"hidden": "", "at": "@", "dot": "."}[kind]


def _rewrites(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and meaning of the disguises. In a run of plain numbers that is no spelled one
    the dots between them still are dots."""
    for m in REWRITE.finditer(text):
        new = _rewritten(m)
        if new is not None:
            yield m.start(), m.end(), new
        else:
            yield from ((d.start(), d.end(), ".") for d in DOT.finditer(text, m.start(), m.end()))


def normalise(text: str) -> tuple[str, list[int], list[int], list[int], list[int]]:
    """Normalised text and its alignment: where rewritten parts start and end in the
    normalised text, and where they start and end in the source."""
    parts, at, size = [], 0, 0
    norm_from, norm_to, from_, to = [], [], [], []
    for start, end, new in _rewrites(text):
        parts += [text[at:start], new]
        norm_from.append(size + start - at)
        size = norm_from[-1] + len(new)
        norm_to.append(size)
        from_.append(start)
        to.append(at := end)
    return "".join([*parts, text[at:]]), norm_from, norm_to, from_, to


def _to_source(place: int, is_end: bool, aligned) -> int:
    """The source offset of an edge in the normalised text; an edge within a rewritten
    part moves to that part's edge."""
    norm_from, norm_to, from_, to = aligned
    k = bisect_right(norm_from, place - is_end) - 1
    if k < 0:
        return place
    if place - is_end < norm_to[k]:
        return to[k] if is_end else from_[k]
    return to[k] + place - norm_to[k]


def disguised_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the normalised text shows and that no base span of the kind covers."""
    folded = fold(text)
    hinted = has_hint(folded.lower())
    if folded == text and not hinted:
        return []
    plain, *aligned = normalise(folded) if hinted else (folded, [], [], [], [])
    if plain == text:
        return []
    out = set()
    for start, kind, end in find_spans(plain):
        s, e = _to_source(start, False, aligned), _to_source(end, True, aligned)
        while s < e and text[s].isspace():
            s += 1
        while s < e and text[e - 1].isspace():
            e -= 1
        if text[s:e] != plain[start:end] and not any(k == kind and a <= s and e <= b for a, k, b in base):
            out.add((s, kind, e))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SPANS = pa.schema(
    [("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
)


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` per row of
    ``docs`` (doc_id, text; other columns are ignored).

    The counts and the digest are of the base patterns; ``spans`` also lists the
    ``n_added`` disguised ones, as kind:start:end in code points of the source. A null
    or empty text has no spans, and its digest is that of the empty string. Repeated rows and null
    doc_ids are returned like any other row; an empty table gives no rows.
    """

    def find(batches):
        for part, texts in slices(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                base = find_spans(text)
                added = disguised_spans(text, base)
                counts = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((doc_id, *counts, digest, written(sorted(base + added)), len(added)))
            yield batch(SPANS, *map(list, zip(*rows, strict=True)))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), find, SPANS)


def masked(text: str) -> str:
    """The text with every span, merged where they overlap, replaced by its kind."""
    base = find_spans(text)
    out, at, reach = [], 0, 0
    for s, k, e in sorted(base + disguised_spans(text, base), key=lambda x: (x[0], -x[2])):
        if s >= reach:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = reach = max(reach, e)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars`` counted anew, if it is
    there; all other columns and all rows stay. A null text stays null."""

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else masked(t))
        give_back()

    out = docs.withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
