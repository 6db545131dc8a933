"""The trie against a plain one over dictionaries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from seawake.llm.prefix_trie import prefix_trie
from tests.llm.helpers import prose

DDL = "conv_id long, turn long, role string, text string"


def plain(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).digest(), text or ""))
    turns = {c: [(v[2], v[4]) for v in sorted(vs)] for c, vs in by.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    nodes = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    children = Counter(n[:-1] for n in nodes if n)
    leaves, saved = Counter(), Counter()
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1].encode()) if n else 0
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(n))
        parent = min(nodes[n[:-1]]) if n else None
        out.append((min(members), len(n), parent, len(members), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, more=None):
    df = spark.createDataFrame(rows, DDL)
    got = sorted(map(tuple, prefix_trie(more(df) if more else df).collect()), key=str)
    assert got == plain(rows)
    return got


def test_same_as_dictionaries(spark):
    rng = random.Random(4)
    lines = [prose(rng, 3) for _ in range(4)] + ["", None, "é"]
    rows = []
    for c in [*range(0, 60), *range(-12, -1), 1000, 1003]:
        long = rng.random() < 0.15
        for k in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 40]) if long else rng.randint(1, 6)):
            rows.append((c, k, rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.3 else "user", lines[0] if rng.random() < 0.7 else rng.choice(lines)))
    rng.shuffle(rows)
    check(spark, rows)


def test_copies_of_long_conversations_and_turnless_ones(spark):
    rows = [(c, k, "user", f"line {min(k, 29 + c // 5)}") for c in range(0, 50, 5) for k in range(33)]
    rows += [(7001, 0, "user", "short")]  # of an absent first conversation, shorter than its head
    got = check(spark, rows)
    assert max(r[1] for r in got) == 33 and got[0] is not None


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, "user", "a"), (1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "c"), (1, 0, "user", "c"), (None, 0, "user", "x"), (2, 5, "user", "x" * 200_000)]
    names = "base block level last x y depth head bytes up owned start t1"
    check(spark, rows, lambda df: df.withColumns({c: F.lit("clash") for c in names.split()}))


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], DDL)).count() == 0


def test_many_ends_of_one_node(spark):
    check(spark, [(c, 0, "user", "hello") for c in range(0, 20_000, 5)])
