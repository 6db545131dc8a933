"""Small documents with copies, near copies and odd rows, and plain versions of the operators."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(rng: random.Random, n: int) -> str:
    syllables = ["an", "ter", "mo", "li", "ve", "su", "ra", "den", "qui", "bo", "tar", "es"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


def documents(spark, texts, first_id: int = 0):
    rows = [(first_id + i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df):
    """More columns, with names that operators use inside."""
    from pyspark.sql import functions as F

    names = "doc n bucket kind group gram hub host path target label part rank start toxic kept key a b id formatted loss_mask conflicting all seed item_id"
    return df.withColumns({c: F.lit("x") for c in names.split() if c not in df.columns})


def shingles(text: str | None, width: int = 5) -> set:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def components(sets: list[tuple[int, set]], percent: int = 75) -> dict[int, int]:
    """Smallest id reachable by links of this Jaccard similarity, by comparing all pairs."""
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}
