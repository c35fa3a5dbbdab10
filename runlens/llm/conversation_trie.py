"""Prefix trie of conversations, and totals over all its subtrees by parallel tree contraction.

A prefix is known by its depth and two 64-bit sums of hashes of its turns with their places, so the prefixes of a
conversation are running totals over its turns, and the trie's nodes are one aggregate over all prefixes.

Subtree totals: a round rakes all leaves, whose totals go to their parents, and compresses unary chains: of two nodes of a
chain next to each other at most one goes, and its only child is hung on its parent. So a chain of any length takes a
number of rounds that grows with its logarithm. A node that was compressed keeps what it adds to its child's total;
going back through the rounds, it gets its own total from that of its child.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable, durable_table, pure
from runlens.llm.running import running_totals

#: Conversations share heads within so many neighbouring ids, and a head has fewer turns than the second number.
FAMILY, HEADS = 20, 4

#: Ids of conversations that are joined to one string before the digest of a node's list is taken.
BLOCK = 4096

WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, x, y, words, position): every turn as hashes, with its place in its conversation from 1 on."""
    own = pure(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv is not null")
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    narrow = own.select(
        F.col("conv").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("x"), F.xxhash64(text, role, F.lit(1)).alias("y"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("one"))
    return running_totals(narrow, "conv", [F.asc_nulls_first("turn"), F.asc("x"), F.asc("y")], {"position": "one"}).drop("one", "turn")


def rebuilt(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, n_turns) and their turns (conv, depth, x, y, words, n_turns) after rebuilding.

    A conversation begins with the first h turns of its family's first conversation, and goes on with its own after its first
    h; h comes from a hash of its id.
    """
    convs = found.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    heads = F.crc32(F.col("conv").cast("string")) % HEADS
    base = F.col("conv") - F.col("conv") % FAMILY
    sizes = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = durable(convs.select("conv", "n", heads.alias("h"), base.alias("base")).join(sizes, "base", "left").select(
        "conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    shared = found.where((F.col("conv") % FAMILY == 0) & (F.col("position") < HEADS)).withColumnRenamed("conv", "base").join(
        convs, "base").where("position <= h").select("conv", F.col("position").alias("depth"), "x", "y", "words", "n_turns")
    own = found.join(convs, "conv").where("position > h").select(
        "conv", (F.col("position") - F.col("h") + F.col("taken")).alias("depth"), "x", "y", "words", "n_turns")
    return convs.select("conv", "n_turns"), shared.unionAll(own)


def prefixes(of_turns: DataFrame) -> DataFrame:
    """(conv, depth, a, b, a_before, b_before, words, last) per turn: the key of the prefix that ends with it, and of the one before."""
    hashed = of_turns.select(
        "conv", "depth", "words", (F.col("depth") == F.col("n_turns")).alias("last"),
        F.xxhash64("depth", "x").alias("p"), F.xxhash64("depth", "y").alias("q"))
    return running_totals(hashed, "conv", [F.asc("depth")], {"a": "p", "b": "q"}, "_before").drop("p", "q")


def trie(convs: DataFrame, found: DataFrame) -> DataFrame:
    """(node, depth, a, b, conv_id, n_convs, words, parent, parent_conv_id), from the root on; a conversation is enough for a root."""
    keys = ["depth", "a", "b"]
    below = found.groupBy(*keys).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.max("a_before").alias("a_before"), F.max("b_before").alias("b_before"))
    none, nil = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        none.alias("depth"), none.alias("a"), none.alias("b"), "conv_id", "n_convs", none.alias("words"),
        nil.alias("a_before"), nil.alias("b_before"))
    nodes = durable(below.unionByName(root).withColumn("node", F.monotonically_increasing_id()))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("a_before"), F.col("b").alias("b_before"),
                         F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, ["depth", "a_before", "b_before"], "left").drop("a_before", "b_before")


def _coin(node: str, depth: str, turn: int, bits: int) -> Column:
    """Whether a unary node may go in this round: by the bits of its depth, which halve a chain, then by hash."""
    if turn < bits:
        return F.shiftright(depth, turn) % 2 == 1
    return F.xxhash64(node, F.lit(turn)) % 2 == 0


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(node, one column per value): the totals over each node's subtree.

    `tree`: (node, parent, depth, values); a root has no parent, and depth only spreads the choice of nodes that are
    compressed. The number of rounds grows with the logarithm of the number of nodes. An empty tree gives an empty table.
    Rounds are written as tables: a checkpoint would hand on the constraints of all rounds before to the planner.
    """
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    bits = int(deepest).bit_length()
    zero = F.lit(0).cast("long")
    active = tree.select("node", "parent", "depth", *values, *[zero.alias(f"edge_{v}") for v in values])
    raked, compressed = [], []
    while True:
        turn = len(raked)
        kids = active.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            F.count(F.lit(1)).alias("n"), F.max("node").alias("only"))
        marked = durable_table(active.join(kids, "node", "left"))
        leaves = marked.where("n is null")
        raked.append(leaves.select("node", *values))
        given = leaves.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.col(v) + F.col(f"edge_{v}")).alias(f"more_{v}") for v in values])
        inner = durable_table(marked.where("n is not null").join(given, "node", "left").select(
            "node", "parent", "depth", "n", "only", *[(F.col(v) + F.coalesce(f"more_{v}", zero)).alias(v) for v in values],
            *[f"edge_{v}" for v in values], ((F.col("n") == 1) & _coin("node", "depth", turn, bits)).alias("may")))
        if inner.isEmpty():
            break
        child = inner.where("not may").select(F.col("node").alias("only"), *[F.col(f"edge_{v}").alias(f"low_{v}") for v in values])
        gone = durable_table(inner.where("may and parent is not null").join(child, "only").select(
            F.col("node").alias("gone"), F.col("only").alias("node"), F.col("parent").alias("above"),
            *[(F.col(v) + F.col(f"low_{v}")).alias(f"add_{v}") for v in values],
            *[(F.col(v) + F.col(f"low_{v}") + F.col(f"edge_{v}")).alias(f"long_{v}") for v in values]))
        compressed.append(gone)
        left = inner.join(gone.select(F.col("gone").alias("node")), "node", "left_anti")
        active = left.join(gone, "node", "left").select(
            "node", F.coalesce("above", "parent").alias("parent"), "depth", *values,
            *[F.coalesce(f"long_{v}", f"edge_{v}").alias(f"edge_{v}") for v in values])
    total = raked[-1]
    for leaves, gone in zip(reversed(raked[:-1]), reversed(compressed)):  # what is known grows as the tree did
        back = gone.join(total, "node").select(F.col("gone").alias("node"), *[(F.col(v) + F.col(f"add_{v}")).alias(v) for v in values])
        total = total.unionAll(durable_table(back)).unionAll(leaves)
    return total


def end_digests(convs: DataFrame, found: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): digests of the ids of the conversations that end at a prefix, in rising order.

    Ids are sorted and joined by blocks of neighbours first; the digest of a list, which is one sequence by its
    definition, then runs over a string per block and holds one at a time.
    """
    none = F.lit(0).cast("long")
    ends = found.where("last").select("depth", "a", "b", "conv").unionAll(
        convs.where("n_turns = 0").select(none.alias("depth"), none.alias("a"), none.alias("b"), "conv"))
    keys = ["depth", "a", "b"]
    joined = ends.groupBy(*keys, F.floor(F.col("conv") / BLOCK).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((k, pa.int64()) for k in keys), ("ends_sha256", pa.string())])
        key = code = None
        for batch in batches:
            out = []
            for *mine, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if mine == key:
                    code.update(b"," + ids.encode())
                else:
                    if key is not None:
                        out.append((*key, code.hexdigest()))
                    key, code = mine, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, code.hexdigest())], schema=schema)

    ordered = joined.repartition(*keys).sortWithinPartitions(*keys, "block").select(*keys, "ids")
    return ordered.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def conversation_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per prefix of rebuilt turns.

    Turns of a conversation are in the order of `turn`, null first, ties in the order of their hashes; repeated rows are
    turns of their own. A null role or text is empty. Rows without a conversation's id belong to none and are left out.
    Other columns are ignored. An empty table gives an empty one; else there is a root, even if nobody has a turn.
    """
    convs, of_turns = rebuilt(durable(turns(conversations, conv_col, turn_col, role_col, text_col)))
    found = durable_table(prefixes(of_turns))
    tree = durable(trie(convs, found))
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = durable(tree.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    values = counted.select("node", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                            ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    total = subtree_totals(values, ["n_leaves", "saved_tokens"])
    nobody = hashlib.sha256(b"").hexdigest()
    return counted.join(total, "node").join(end_digests(convs, found), ["depth", "a", "b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))
