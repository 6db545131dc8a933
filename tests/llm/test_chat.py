import hashlib
import random

from seawake.llm import chat
from tests.llm.helpers import with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["[INST]", "[/INST]", "[INST*]", "[ANS]", "[ANS*]", "</s>", "<s>", "[ROLE]", "[TEXT]", "[TEXT*]", "[/ROLE]", "\\", "\\\\", "\\(", "\\{", "[", "<", "]", "$1", "\n", "é", "x", " "]


def rows():
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool [TEXT] \\(", "a[TEXT", "x [TEXT y", "[TEXT*", "[ROLE", "[/ROLE]", "[", "", None]
    out = [(c, t, rng.choice(roles), "".join(rng.choices(PIECES, k=rng.randint(0, 9)))) for c in range(60) for t in range(rng.randint(1, 6))]
    return [*out, (60, None, "user", None), (60, 1, "assistant", "b"), (60, 1, "assistant", "a"), (60, 1, "assistant", "a"), (None, 0, "user", "x")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_of_hostile_texts(spark):
    data = rows()
    got = {r["conv_id"]: r for r in chat.conversation_digests(with_clashes(spark.createDataFrame(data, SCHEMA))).collect()}
    want = {}
    for c, t, role, text in sorted(data, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))


def test_texts_hold_no_control_strings_once_formatted(spark):
    df = chat.format_conversations(chat.with_probe(spark.createDataFrame([], SCHEMA)))
    row = df.first()
    assert row["formatted"] == r"<s>[INST*]\{/s>\(INST] ok \(/INST][/INST][ANS*]\{/s>\(INST] ok \(/INST]</s>"
    assert [row["formatted"][m["start"] : m["start"] + m["length"]] for m in row["loss_mask"]] == [r"\{/s>\(INST] ok \(/INST]"]
    assert df.count() == 1 and chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.conversation_digests(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_text(spark):
    text = "[INST] \\ " * 100_000
    got = chat.conversation_digests(spark.createDataFrame([(1, 0, "assistant", text)], SCHEMA)).first()
    assert (got["loss_chars"], got["loss_sha256"]) == (len(text), sha(text))
