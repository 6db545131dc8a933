"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as ``<s>`` and its turns. Each turn has an opening and a
closing control string around its text. A deterministic parser reads the rendered string
back; texts that hold control strings are escaped, and the recovered turns are compared
with the source. If they differ, all texts are escaped; if they still differ, the query
fails rather than return a broken rendering.

=============  ==================================  ==========
role           opening (with an escaped text)      closing
=============  ==================================  ==========
user           ``[INST]`` (``[INST*]``)            ``[/INST]``
assistant      ``[ANS]`` (``[ANS*]``)              ``</s>``
any other      ``[ROLE]`` role ``[TEXT]`` (``*``)  ``[/ROLE]``
=============  ==================================  ==========

In an escaped text a backslash is doubled, and the first character of a control string
becomes a backslash and a round (for ``[``) or curly (for ``<``) opening bracket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
CONTROL = r"\[/?INST\*?\]|\[ANS\*?\]|\[/?ROLE\]|\[TEXT\*?\]|</?s>"
TURN = r"(?s)\[INST\*?\].*?\[/INST\]|\[ANS\*?\].*?</s>|\[ROLE\].*?\[TEXT\*?\].*?\[/ROLE\]"
START = "<s>"
SQUARE, ANGLE = "\\(", "\\{"


def escape(text: Column) -> Column:
    """Without control strings; ``unescape`` gives the text back."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, r"\[(?=/?INST\*?\]|ANS\*?\]|/?ROLE\]|TEXT\*?\])", "\\\\(")
    return F.regexp_replace(text, r"<(?=/?s>)", "\\\\{")


def unescape(text: Column) -> Column:
    """Doubled backslashes part the text from the left; between them every backslash
    starts an escaped bracket."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit(SQUARE), F.lit("[")), F.lit(ANGLE), F.lit("<")))
    return F.array_join(plain, "\\")


def opening(role: Column, escaped: Column) -> Column:
    star = F.when(escaped, "*").otherwise("")
    return (
        F.when(role == "user", F.concat(F.lit("[INST"), star, F.lit("]")))
        .when(role == "assistant", F.concat(F.lit("[ANS"), star, F.lit("]")))
        .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[TEXT"), star, F.lit("]")))
    )


def closing(role: Column) -> Column:
    return F.when(role == "user", "[/INST]").when(role == "assistant", "</s>").otherwise("[/ROLE]")


def rendered(turns: DataFrame, level: str) -> DataFrame:
    """One row per conversation: the string ``formatted``, the loss mask (start, length and
    whether the text is escaped, for each assistant text) and the ``source`` turns.

    ``level`` names a boolean column of ``turns``: which texts are escaped.
    """
    body = F.when(F.col(level), escape(F.col("text"))).otherwise(F.col("text"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pieces = turns.withColumns({"open": opening(F.col("role"), F.col(level)), "body": body, "close": closing(F.col("role"))})
    pieces = pieces.withColumn("size", F.length("open") + F.length("body") + F.length("close"))
    before = F.coalesce(F.sum("size").over(by_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumns({"at": F.row_number().over(by_turn), "start": F.lit(len(START)) + before + F.length("open")})
    whole = pieces.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(F.struct("at", "role", "text", "start", F.length("body").alias("length"), F.col(level).alias("escaped"), "open", "body", "close"))
        ).alias("turns")
    )
    return whole.select(
        "conv_id",
        F.concat(F.lit(START), F.array_join(F.transform("turns", lambda t: F.concat(t["open"], t["body"], t["close"])), "")).alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"], t["length"], t["escaped"])
        ).alias("loss_mask"),
        F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("source"),
    )


def parsed(formatted: Column) -> Column:
    """The turns (role, text) that the grammar finds; null where it does not cover the string."""

    def turn(t: Column) -> Column:
        kind = F.substring(t, 2, 3)
        role = F.when(kind == "INS", "user").when(kind == "ANS", "assistant").otherwise(
            unescape(F.regexp_extract(t, r"(?s)^\[ROLE\](.*?)\[TEXT\*?\]", 1))
        )
        head = (
            F.when(kind == "INS", F.length(F.substring_index(t, "]", 1)) + 1)
            .when(kind == "ANS", F.length(F.substring_index(t, "]", 1)) + 1)
            .otherwise(F.length(F.regexp_extract(t, r"(?s)^\[ROLE\].*?\[TEXT\*?\]", 0)))
        )
        tail = F.when(kind == "INS", len("[/INST]")).when(kind == "ANS", len("</s>")).otherwise(len("[/ROLE]"))
        text = F.substr(t, head + 1, F.length(t) - head - tail)
        starred = F.substr(t, head - 1, F.lit(1)) == "*"
        return F.struct(role.alias("role"), F.when(starred, unescape(text)).otherwise(text).alias("text"))

    found = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    covered = F.concat(F.lit(START), F.array_join(found, "")) == formatted
    return F.when(covered, F.transform(found, turn))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_mask, recovered)`` for each conversation of ``turns``
    (conv_id, turn, role, text; other columns are ignored).

    Turns are in the order of ``turn``, ties by role and text; repeated rows are turns of
    their own. A null text or role is empty; a null ``turn`` comes first; rows with a null
    conv_id form one conversation. ``recovered`` are the turns read back from
    ``formatted``; they are those of the source. An empty table gives no rows.
    """
    turns = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("all")
    ).withColumn("conflicting", F.col("text").rlike(CONTROL))
    first = rendered(turns, "conflicting").withColumn("recovered", parsed(F.col("formatted")))
    same = F.col("recovered").isNotNull() & (F.col("recovered") == F.col("source"))
    again = first.where(~same).select("conv_id", F.posexplode("source")).select(
        "conv_id", F.col("pos").alias("turn"), "col.role", "col.text", F.lit(True).alias("all")
    )
    second = rendered(again, "all").withColumn("recovered", parsed(F.col("formatted")))
    return first.where(same).unionByName(second.where(F.assert_true(same, "a conversation cannot be read back").isNull())).drop("source")


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""

    def one(m: Column) -> Column:
        text = F.substr(formatted, m["start"] + 1, m["length"])
        return F.when(m["escaped"], unescape(text)).otherwise(text)

    return F.array_join(F.transform(mask, one), "")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted conversations."""
    done = format_conversations(turns)
    digest = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("formatted"), F.col("loss_mask"))
    return done.withColumn("loss", loss).select(
        "conv_id",
        F.size("recovered").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and a conversation -1 whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = turns.sparkSession.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
