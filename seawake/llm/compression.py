"""Quality rules: base counts and compression bands.

Text that zstandard compresses far better than prose of its length repeats itself; text that
it hardly compresses is no prose. Both are judged on the whole text, against limits
for its length, and on chunks of fixed size, so that a bad part is not diluted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import batch, map_arrow, slices, windows, word_hashes

# --- fixed values ------------------------------------------------------------
#: Up to so many bytes: least and greatest ratio of plain to compressed size.
BANDS = (
    (512, 1.0, 2.6),
    (1024, 1.15, 3.0),
    (2048, 1.3, 3.4),
    (4096, 1.4, 4.0),
    (8192, 1.5, 4.5),
    (16384, 1.5, 5.0),
    (65536, 1.5, 6.0),
    (float("inf"), 1.5, 7.0),
)
CHUNK_BYTES = 4096
#: A rest shorter than this joins the chunk before it.
LEAST_CHUNK = 1024
#: A text with a greater share of chunks outside their band is rejected.
MAX_BAD_CHUNKS = 0.2
LEVEL = 3
SYMBOLS = "#*$%&|<>"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
LEAST_WORDS = 50
MAX_REPEATED_PERCENT = 50


def in_band(size: int, packed: int) -> bool:
    low, high = next((lo, hi) for top, lo, hi in BANDS if size <= top)
    return low * packed <= size <= high * packed


def chunks(data: bytes) -> list[bytes]:
    cuts = list(range(0, max(1, len(data)), CHUNK_BYTES))
    if len(cuts) > 1 and len(data) - cuts[-1] < LEAST_CHUNK:
        cuts.pop()
    return [data[lo:hi] for lo, hi in zip(cuts, [*cuts[1:], len(data)], strict=True)]


def repeated_words(hashes: np.ndarray) -> int:
    """Words within windows of three that occur more than once."""
    grams = windows(hashes, 3)
    if not len(grams):
        return 0
    _, place, counts = np.unique(grams, return_inverse=True, return_counts=True)
    again = np.concatenate([counts[place] > 1, [False, False]])
    covered = again.copy()
    covered[1:] |= again[:-1]
    covered[2:] |= again[:-2]
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


RULES = pa.schema(
    [
        *[(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunks", pa.int64()), ("n_chunks", pa.int64()),
    ]
)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts, ``base_failed``, ``kept``, and the whole text's ratio and chunks outside
    their band, per row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has no words, fails, and has the ratio 0. Repeated rows and
    rows without doc_id are judged like any other; an empty table gives no rows.
    """

    def judge(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL)
        for part, texts in slices(batches):
            coded = [t.encode("utf-8", "surrogatepass") for t in texts]
            hashes, bounds = word_hashes(coded, lower=False)
            rows = []
            for k, (doc_id, text, data) in enumerate(zip(part.column(0).to_pylist(), texts, coded, strict=True)):
                words = hashes[bounds[k] : bounds[k + 1]]
                repeated = repeated_words(words)
                failed = len(words) < LEAST_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * len(words)
                pieces = chunks(data)
                sizes = [len(packer.compress(c)) for c in pieces]
                packed = sizes[0] if len(pieces) == 1 else len(packer.compress(data))
                bad = sum(not in_band(len(c), s) for c, s in zip(pieces, sizes, strict=True))
                kept = not failed and in_band(len(data), packed) and bad <= MAX_BAD_CHUNKS * len(pieces)
                counts = (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated)
                rows.append((doc_id, *counts, failed, kept, len(data) / packed, bad, len(pieces)))
            yield batch(RULES, *map(list, zip(*rows, strict=True)))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), judge, RULES)
