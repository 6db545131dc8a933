"""Conversation prefix trie: one row per distinct sequence of first turns, by ROLLUP.

A conversation's turns become rows of ``SLOTS`` positional columns, a row per block of
turns. ``GROUP BY block, prefix, ROLLUP(slot 1, ..., slot 8)`` gives all prefixes that end in
a block at once, a level of ``grouping_id()`` each; ``prefix`` is the node where the block
before ended, so long conversations go on in further blocks and no row holds a whole one.

Sums over a subtree need no walk over the tree. They are sums over a node's members:

* every conversation owns the nodes whose smallest member it is: those from the depth
  where it parts from all smaller ones. What is counted once per node is counted at owners.
* bytes of all turns at or below a node, a member at a time, are the suffixes of its
  members; those of the nodes, each once, are what the members own plus the part of the
  smallest member above its own first node.

So one rollup finds owners, a second one sums over members. Prefixes are 128-bit hashes that
are combined by XOR, so that any prefix is a window over block rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seawake.llm.common import batch, map_arrow, tidy_shuffles
from seawake.session import stored

#: Turns of a block: columns of the rollup.
SLOTS = 8
T = [f"t{k}" for k in range(1, SLOTS + 1)]
NODE = ["x", "y"]
PARTS = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
DIGESTS = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def zero() -> Column:
    return F.lit(0).cast("long")


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first of its five."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def rebuilt_blocks(conversations: DataFrame) -> DataFrame:
    """``(conv_id, block, t1..t8)`` of the rebuilt conversations; a slot is a struct of the
    turn's digest and the bytes of its text. A turnless conversation has one empty block.

    All steps share the one shuffle by ``base``, of digests instead of texts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.unhex(F.md5(text.cast("binary"))).alias("body"),
        F.struct(
            F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("id"),
            F.octet_length(text).cast("long").alias("bytes"),
        ).alias("t"),
    )
    turns = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).repartition("base")
    order = Window.partitionBy("base", "conv_id").orderBy(F.asc_nulls_first("turn"), "role", "body")
    turns = turns.withColumn("at", F.row_number().over(order)).select("base", "conv_id", "at", "t")
    heads = (
        turns.where((F.col("conv_id") == F.col("base")) & (F.col("at") <= SLOTS))
        .groupBy("base")
        .agg(F.sort_array(F.collect_list(F.struct("at", "t"))).alias("head"))
    )
    taken = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)))
    firsts = turns.where("at = 1").withColumn("h", head_length(F.col("conv_id"))).join(heads, "base", "left")
    firsts = firsts.withColumn("head", F.when(taken > 0, F.slice("head", F.lit(1), taken)))
    heads_of = firsts.select("base", "conv_id", F.explode_outer("head").alias("_h")).select(
        "base", "conv_id", F.col("_h.at").cast("long").alias("at"), F.col("_h.t").alias("t")
    )
    own = turns.withColumn("h", head_length(F.col("conv_id"))).where("at > h").join(heads, "base", "left")
    own = own.select("base", "conv_id", (F.col("at") - F.col("h") + taken).cast("long").alias("at"), "t")
    rows = heads_of.unionByName(own).withColumn("block", F.coalesce(F.expr("(at - 1) DIV 8"), F.lit(0).cast("long")))
    slot = F.pmod(F.col("at") - 1, F.lit(SLOTS)) + 1
    return rows.groupBy("base", "conv_id", "block").agg(*[F.max(F.when(slot == k, F.col("t"))).alias(T[k - 1]) for k in range(1, SLOTS + 1)])


def _hash(seed: int, depth: Column, turn: Column) -> Column:
    """The hash of a turn at a depth; 0 for none."""
    return F.when(turn.isNull(), zero()).otherwise(F.xxhash64(F.lit(seed), depth, turn["id"]))


def _mark(seed: int) -> Column:
    out = zero()
    for k, t in enumerate(T, 1):
        out = out.bitwiseXOR(_hash(seed, F.col("block") * SLOTS + k, F.col(t)))
    return out


def _bytes() -> Column:
    return sum((F.coalesce(F.col(t)["bytes"], zero()) for t in T), zero())


def with_prefixes(blocks: DataFrame) -> DataFrame:
    """Adds to each block: ``px, py`` the node it continues, ``suffix`` the bytes from here to the
    conversation's end, ``last`` whether it ends here, ``depth`` of its last turn and
    ``turns`` of the conversation."""
    filled = sum((F.col(t).isNotNull().cast("long") for t in T), F.lit(0).cast("long"))
    forward, backward = (Window.partitionBy("base", "conv_id").orderBy(o) for o in (F.asc("block"), F.desc("block")))
    before, rest = forward.rowsBetween(Window.unboundedPreceding, -1), backward.rowsBetween(Window.unboundedPreceding, 0)
    marked = blocks.withColumns({"mx": _mark(1), "my": _mark(2), "bytes": _bytes(), "depth": F.col("block") * SLOTS + filled})
    return marked.select(
        "conv_id", "block", *T, "depth",
        F.coalesce(F.bit_xor("mx").over(before), zero()).alias("px"),
        F.coalesce(F.bit_xor("my").over(before), zero()).alias("py"),
        F.sum("bytes").over(rest).alias("suffix"),
        F.first("depth").over(rest).alias("turns"),
        F.lead("block").over(forward).isNull().alias("last"),
    )


def rolled_up(blocks: DataFrame, **sums: str) -> DataFrame:
    """A row per node: its hash ``x, y`` and its parent's ``up_x, up_y``, ``depth``, the ``bytes`` of
    its last text, those ``above`` it in its block, and the aggregates ``sums``."""
    slots = ", ".join(T)
    rows = blocks.sparkSession.sql(
        f"SELECT block, px, py, {slots}, {SLOTS} - bit_count(grouping_id() & {2**SLOTS - 1}) AS level, "
        f"{', '.join(f'{v} AS {k}' for k, v in sums.items())} FROM {{blocks}} GROUP BY block, px, py, ROLLUP({slots})",
        blocks=blocks,
    )
    # A level that reaches into a conversation's empty slots is no node, and where a
    # further block starts the node is the one that ended the block before.
    last, there = F.lit(None).cast(blocks.schema[T[0]].dataType), F.when(F.col("level") == 0, F.col("block") == 0)
    for k, t in enumerate(T, 1):
        last = F.when(F.col("level") == k, F.col(t)).otherwise(last)
        there = there.when(F.col("level") == k, F.col(t).isNotNull())
    depth, ending = F.col("block") * SLOTS + F.col("level"), F.coalesce(F.col("last")["bytes"], zero())
    rows = rows.where(there).withColumns({"last": last, "depth": depth, "x": F.col("px").bitwiseXOR(_mark(1)), "y": F.col("py").bitwiseXOR(_mark(2))})
    return rows.select(
        "x",
        "y",
        *[F.col(c).bitwiseXOR(_hash(seed, F.col("depth"), F.col("last"))).alias(f"up_{c}") for seed, c in ((1, "x"), (2, "y"))],
        "depth",
        ending.alias("bytes"),
        (_bytes() - ending).alias("above"),
        *sums,
    )


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(x, y, ends_sha256)`` of ``(x, y, conv_id)``. A node where very many end is dealt to many
    tasks by ``conv_id``; each makes texts of parts, and only those go through the one
    hash, as a stream."""

    def parts(batches):
        for b in batches:
            x, y, ids = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if len(x):
                starts = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist()]
                texts = [",".join(map(str, ids[lo:hi].tolist())) for lo, hi in zip(starts, [*starts[1:], len(x)], strict=True)]
                yield batch(PARTS, x[starts], y[starts], ids[starts], texts)

    def whole(batches):
        node, digest = None, None
        for b in batches:
            done = []
            for x, y, _, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if node != (x, y):
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (x, y), hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if done:
                yield batch(DIGESTS, *zip(*done, strict=True))
        if node is not None:
            yield batch(DIGESTS, *([v] for v in (*node, digest.hexdigest())))

    dealt = ends.repartitionByRange("x", "y", "conv_id").sortWithinPartitions("x", "y", "conv_id")
    texts = map_arrow(dealt, parts, PARTS).repartition("x", "y").sortWithinPartitions("x", "y", "first")
    return map_arrow(texts, whole, DIGESTS)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt ``conversations`` (conv_id, turn, role, text; other columns are
    ignored): ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` per node.

    Conversation c is rebuilt from the first h turns of conversation ``c - c % 5``, where
    h = crc32(c) % 9, and its own turns after its first h. Turns are in the order of ``turn``,
    null first; turns of one number by role and by the text's digest, and a repeated row is
    a turn again. Null role or text is empty; an empty text is a turn. Rows without conv_id
    are left out. A conversation that is left without turns is a member of the root alone.
    An empty table gives no rows.
    """
    with tidy_shuffles(conversations.sparkSession):
        blocks = stored(with_prefixes(rebuilt_blocks(conversations)), "trie-blocks")
        nodes = stored(
            rolled_up(blocks, conv_id="min(conv_id)", reach="max(turns)").withColumn("leaf", (F.col("reach") == F.col("depth")).cast("long")), "trie-nodes"
        )
        owners = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "up_x", "up_y")).alias("start"), F.sum("bytes").alias("owned"), F.sum("leaf").alias("leaf"))
        owners = stored(owners.select("conv_id", "start.*", "owned", "leaf"), "trie-owners")
        # The one parent of each conversation that is another's node; stored tables on
        # both sides, so that the join can split a parent of very many.
        parting = owners.where("depth > 0").select("conv_id", "up_x", "up_y")
        parents = parting.join(nodes.select(F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("up")), ["up_x", "up_y"]).select("conv_id", "up")
        starts = owners.select("conv_id", F.col("depth").alias("start")).join(parents, "conv_id", "left")
        weighed = blocks.join(owners.select("conv_id", "owned", "leaf"), "conv_id", "left").fillna(0, ["owned", "leaf"])
        sums = rolled_up(
            weighed, n_convs="count(*)", top="min(struct(conv_id, suffix, owned, turns))", suffixes="sum(suffix)", owned="sum(owned)", n_leaves="sum(leaf)"
        )
        branches = parting.groupBy(F.col("up_x").alias("x"), F.col("up_y").alias("y")).agg(F.count("*").alias("branches"))
        ends = blocks.where("last").select(F.col("px").bitwiseXOR(_mark(1)).alias("x"), F.col("py").bitwiseXOR(_mark(2)).alias("y"), "conv_id")
        whole = sums.withColumn("conv_id", F.col("top.conv_id")).join(branches, NODE, "left").join(ends_digests(ends), NODE, "left").join(starts, "conv_id", "left")
        of_members = F.col("suffixes") - F.col("n_convs") * F.col("above")
        of_nodes = F.col("owned") - F.col("top.owned") + F.col("top.suffix") - F.col("above")
        return whole.select(
            "conv_id",
            "depth",
            F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("start"), F.col("up")).otherwise(F.col("conv_id")).cast("long").alias("parent_conv_id"),
            "n_convs",
            (F.coalesce("branches", zero()) + (F.col("top.turns") > F.col("depth")).cast("long")).alias("n_children"),
            "n_leaves",
            (of_members - of_nodes).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"),
        )
