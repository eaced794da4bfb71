"""Prefix tries of conversations: which openings they share, and what is saved by keeping each shared turn once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat import chains
from .common import running_total, settle

#: Rows of turns that a subtrie built by one task has at most; a larger one is split by its next turn, again and again.
MOST_ROWS = 200_000
#: Rows of turns that a task gets on average: small subtries share a task.
USUAL_ROWS = 50_000
#: A conversation without an id is one of its own that comes after all others.
NO_ID = 1 << 63
ROOT = "0"


def turns(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> conv, at (from 1), turn (digest of role and text), n_chars of the text.

    Turns are ordered by (turn, role, text), a null turn first; a null role or text is empty; repeated rows are turns of
    their own; rows with a null conv_id are one conversation. Equal digests (SHA-256) stand for equal turns from here on.
    """
    conv = F.coalesce(F.col("tree").cast("decimal(20,0)"), F.lit(str(NO_ID)).cast("decimal(20,0)"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return chains(rows).select(conv.alias("conv"), (F.col("node") + 1).alias("at"), digest.alias("turn"), F.length("text").cast("long").alias("n_chars"))


def with_shared_openings(said: DataFrame, block: int = 100, lengths: int = 6) -> tuple[DataFrame, DataFrame]:
    """(members, turns) of conversations rebuilt upon the first one of their block.

    The first h = crc32(decimal conv) % lengths turns of conversation c come from conversation c - c % block (fewer if it
    has fewer), the rest is what c has after its own first h. A conversation may end up without turns. Only the
    conversation without an id keeps what it has.
    """
    name = F.when(F.col("conv") < F.lit(str(NO_ID)).cast("decimal(20,0)"), F.col("conv").cast("string")).otherwise("")
    said = said.withColumn("_h", F.crc32(name) % lengths).withColumn("_base", F.col("conv") - F.col("conv") % block)
    members = said.select("conv", "_h", "_base").distinct()
    heads = said.where((F.col("conv") == F.col("_base")) & (F.col("at") < lengths)).select(F.col("conv").alias("_base"), "at", "turn", "n_chars")
    have = heads.groupBy("_base").agg(F.count(F.lit(1)).alias("_have"))
    moved = F.col("at") - F.col("_h") + F.least("_h", F.coalesce("_have", F.lit(0)))
    own = said.where("at > _h").join(have, "_base", "left").select("conv", moved.alias("at"), "turn", "n_chars")
    shared = members.join(heads, "_base").where("at <= _h").select("conv", "at", "turn", "n_chars")
    return members.select("conv"), own.unionByName(shared)


def _subtries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of the subtries whose turns one group holds: dictionaries of pointers from a turn to a child, sums in postorder.

    A group comes in batches, and a conversation or a subtrie may lie in several: they are put together first.
    """
    rows = pd.concat(batches, ignore_index=True)
    children: list[dict] = [{}]
    least, parent, ids, depth, chars, convs = [None], [0], [None], [0], [0], [0]
    now, at = None, 0
    for conv, d, name, n_chars, weight in rows.sort_values(["conv", "at"])[["conv", "at", "id", "n_chars", "weight"]].itertuples(index=False, name=None):
        if conv != now:
            now, at = conv, 0
        child = children[at].get(name)
        if child is None:
            child = children[at][name] = len(children)
            children.append({})
            for column, value in ((least, conv), (parent, at), (ids, name), (depth, d), (chars, n_chars), (convs, 0)):
                column.append(value)
        at = child
        convs[at] += weight
    order, stack = [], [0]
    while stack:
        at = stack.pop()
        order.append(at)
        stack.extend(children[at].values())
    leaves, saved = [0] * len(children), [0] * len(children)
    for at in reversed(order[1:]):
        leaves[at] += not children[at]
        saved[at] += (convs[at] - 1) * chars[at]
        leaves[parent[at]] += leaves[at]
        saved[parent[at]] += saved[at]
    nodes = range(1, len(children))
    yield pd.DataFrame({
        "id": ids[1:], "at": depth[1:], "conv": least[1:], "above": [least[parent[i]] for i in nodes], "n_convs": convs[1:],
        "n_children": [len(children[i]) for i in nodes], "n_leaves": leaves[1:], "saved": saved[1:],
    })


def _ends(ended: DataFrame) -> DataFrame:
    """ended (id, at, conv) -> id, at, ends_sha256 of the conversations that end there; ids are hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("id", pa.string()), ("at", pa.int64()), ("ends_sha256", pa.string())])
        now, digest = None, None
        for batch in batches:
            out = []
            for name, at, conv in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (name, at) != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (name, at), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(b"" if conv == NO_ID else str(conv).encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], type=t) for c, t in zip((*now, digest.hexdigest()), kind.types, strict=True)], schema=kind)

    return ended.select("id", "at", "conv").repartition("id", "at").sortWithinPartitions("id", "at", "conv").mapInArrow(run, "id string, at long, ends_sha256 string")


def trie(members: DataFrame, said: DataFrame, most_rows: int = MOST_ROWS, usual_rows: int = USUAL_ROWS) -> DataFrame:
    """Nodes of the prefix trie of conversations: every distinct sequence of a conversation's first turns, from none on.

    members: conv; said: conv, at, turn, n_chars as turns() leaves them. Out: conv_id (the least member of a node), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (code points that needn't be stored or computed again
    below and at the node), ends_sha256 (ids of the members that end there). No members: no nodes.

    A prefix is known by the sum of 90-bit hashes of (place, turn) up to its end, a running total, so that no task needs
    a whole conversation for it. Conversations that are equal as a whole are counted first and go on as one. Subtries of a
    first turn are built by hash partitions of that turn inside tasks, over dictionaries of pointers; if one has more than
    most_rows rows it is split by its next turn, and so on: sizes of crowded subtries are counted at all depths at once, so
    the recursion needs no rounds. What lies above the subtries (the root, and prefixes that a crowd shares, or long
    conversations) is summed by aggregation: each node and each subtrie counts for one conversation, the least that has
    it, and a prefix sums what its members count from there on. Any depth and any crowd end in bounded groups.
    """
    said = said.join(members, "conv", "left_semi").select("conv", "at", "turn", "n_chars")
    half = lambda seed: F.xxhash64(F.lit(seed), "at", "turn").bitwiseAND(F.lit((1 << 45) - 1)).cast("decimal(28,0)")
    hashed = said.withColumn("_v", (half(1) * F.lit(1 << 45).cast("decimal(28,0)") + half(2)).cast("decimal(28,0)"))
    numbered = settle(running_total(hashed, "conv", "at", [], "_v", "_id", shifts=(10, 20)).select("conv", "at", "n_chars", F.col("_id").cast("string").alias("id"), (F.col("_id") - F.col("_v")).cast("string").alias("above")), "prefixes")

    whole = numbered.groupBy("conv").agg(F.max("at").alias("n_turns"), F.max_by("id", "at").alias("id"))
    whole = settle(members.join(whole, "conv", "left").select("conv", F.coalesce("n_turns", F.lit(0)).cast("long").alias("n_turns"), F.coalesce("id", F.lit(ROOT)).alias("id")), "sequences")
    kept = settle(whole.groupBy("n_turns", "id").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight")).select("conv", "n_turns", "weight"), "kept")
    rows = settle(numbered.join(kept, "conv"), "turns")

    crowded = rows.where("at = 1").groupBy("id").agg(F.sum("n_turns").alias("_n")).where(F.col("_n") > most_rows)
    within = rows.where("at = 1").join(crowded, "id", "left_semi").select("conv")
    high = rows.join(within, "conv", "left_semi").groupBy("id", "at").agg(F.sum(F.expr("n_turns - at + 1")).alias("_n")).where(F.col("_n") > most_rows)
    marked = rows.join(settle(high.select("id", "at", F.lit(True).alias("_high")), "crowded"), ["id", "at"], "left")
    tops = marked.groupBy("conv").agg(F.min_by("id", F.when(F.col("_high").isNull(), F.col("at"))).alias("top"))
    placed = settle(marked.join(tops, "conv"), "placed")

    share = max(1, rows.count() // usual_rows)
    lower = placed.where("_high is null").withColumn("_task", F.pmod(F.xxhash64("top"), F.lit(share)))
    built = lower.select("_task", "conv", "at", "id", "n_chars", "weight").groupBy("_task").applyInPandas(_subtries, "id string, at long, conv decimal(20,0), above decimal(20,0), n_convs long, n_children long, n_leaves long, saved long")
    built = settle(built, "subtries")
    parents = placed.where("id = top").groupBy("id").agg(F.first("above").alias("over"))
    top = settle(built.where("above is null").join(parents, "id"), "tops")

    root = kept.select("conv", F.lit(0).cast("long").alias("at"), F.lit(ROOT).alias("id"), F.lit(None).cast("string").alias("over"), F.lit(0).cast("long").alias("n_chars"), "weight")
    upper = root.unionByName(placed.where("_high").select("conv", "at", "id", F.col("above").alias("over"), "n_chars", "weight"))
    known = settle(upper.groupBy("id", "at").agg(F.first("over").alias("over"), F.min("conv").alias("least"), F.sum("weight").alias("n_convs")), "upper")
    counted = upper.join(known.select("id", "at", "least", "n_convs"), ["id", "at"]).withColumn("_gain", F.when(F.col("conv") == F.col("least"), (F.col("n_convs") - 1) * F.col("n_chars")).otherwise(0))
    below = top.select("conv", F.col("n_leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    summed = running_total(counted.select("conv", "at", "id", "_gain"), "conv", "at", [], "_gain", "_sum", shifts=(10, 20)).join(below, "conv", "left")
    sums = summed.groupBy("id", "at").agg(F.sum("_leaves").alias("_leaves"), F.sum(F.expr("_total - _sum + _gain + coalesce(_saved, 0)")).alias("saved"))
    fans = top.select("over").unionByName(known.select("over")).groupBy("over").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("over", "id")
    upper_nodes = known.join(sums, ["id", "at"]).join(fans, "id", "left").join(known.select(F.col("id").alias("over"), F.col("least").alias("above")), "over", "left")
    names = ["id", "at", "conv", "above", "n_convs", "n_children", "n_leaves", "saved"]
    upper_nodes = upper_nodes.select("id", "at", F.col("least").alias("conv"), "above", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.greatest(F.coalesce("_leaves", F.lit(0)), F.lit(1)).alias("n_leaves"), "saved")
    top_nodes = top.drop("above").join(known.select(F.col("id").alias("over"), F.col("least").alias("above")), "over")
    nodes = built.where("above is not null").select(names).unionByName(top_nodes.select(names)).unionByName(upper_nodes.select(names))

    ends = _ends(whole.withColumnRenamed("n_turns", "at"))
    plain = lambda c: F.when(F.col(c) < F.lit(str(NO_ID)).cast("decimal(20,0)"), F.col(c)).cast("long")
    return nodes.join(ends, ["id", "at"], "left").select(
        plain("conv").alias("conv_id"), F.col("at").alias("depth"), plain("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(rows: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """trie() of rows (conv_id, turn, role, text) as they stand; other columns take no part."""
    said = settle(turns(rows), "turns")
    return trie(said.select("conv").distinct(), said, most_rows)
