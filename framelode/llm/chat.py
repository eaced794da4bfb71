"""Chat formatting: reply trees, their best branches, and conversations written with reversible control marks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import running_total, settle

#: Marks of a turn. A text holds none of them: a backslash goes into each "<|", one more where there are some already.
START, END = "<|im_start|>", "<|im_end|>"
#: Characters of formatted text after which a part ends. Parts are the only form of a conversation: in order, they are its text.
PART_CHARS = 4_000_000


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def chains(rows: DataFrame) -> DataFrame:
    """Rows of conversations as reply trees: tree, node, parent, role, text; each turn answers the one before it.

    Turns are ordered by (turn, role, text), a null turn first; rows with an equal turn follow each other. Numbers come
    from running totals over runs of turns, so that no task sees a whole conversation.
    """
    slot = F.when(F.col("turn") >= 0, F.least(F.col("turn").cast("long"), F.lit((1 << 63) - 2)) + 1).otherwise(0)  # the last two share one
    named = rows.select(F.col("conv_id").cast("long").alias("tree"), slot.alias("_slot"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = named.withColumn("_key", F.coalesce(F.col("tree").cast("string"), F.lit(""))).withColumn("_one", F.lit(1).cast("long"))
    numbered = running_total(named, "_key", "_slot", ["turn", "role", "text"], "_one", "_at", shifts=(10, 20))
    node = F.col("_at") - 1
    return numbered.select("tree", F.col("_key").alias("key"), node.alias("node"), F.when(node > 0, node - 1).alias("parent"), "role", "text", F.length("text").cast("double").alias("score"))


def best_paths(nodes: DataFrame, branches: int = 1, most_levels: int = 40) -> DataFrame:
    """(key, leaf, node, depth) of the nodes on the best root-to-leaf paths of each tree.

    nodes: key, node, parent (null at a root), score. Self-joins double the ancestor known of each node, so a path of n
    nodes takes log2(n) rounds; each round is written to the shared folder, and only trees in which a node's root isn't
    reached yet go on to the next. Leaves are ranked by the sum of scores on their path, then by depth, then by node; the
    first `branches` of a tree are chosen and their paths enumerated by the ancestors of the rounds, the longest jump
    first. A parent that doesn't exist makes its child a root.
    """
    known = nodes.select("key", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    plain = nodes.select("key", "node", "parent", "score").join(known, ["key", "parent"], "left")
    now = settle(plain.select("key", "node", F.when(F.col("_there"), F.col("parent")).alias("up"), "score", F.lit(0).cast("long").alias("far")), "jump")
    jumps, ended = [], []
    while True:
        going = settle(now.where("up is not null").select("key").distinct(), "going")
        if going.isEmpty():
            ended.append(now)
            break
        if len(jumps) >= most_levels:
            raise ValueError("a reply tree has a cycle")
        reach = F.lit(1 << len(jumps)).cast("long")
        jumps.append(now.where("up is not null"))
        ended.append(settle(now.join(going, "key", "left_anti"), "ended"))
        above = now.select("key", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("score").alias("_score"), F.col("far").alias("_far"))
        met = now.join(going, "key", "left_semi").join(above, ["key", "up"], "left")
        now = settle(met.select("key", "node", F.col("_up").alias("up"), (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"), F.when(F.col("up").isNull(), F.col("far")).otherwise(reach + F.col("_far")).alias("far")), "jump")
    done = reduce(DataFrame.unionByName, ended)
    leaves = done.join(jumps[0].select("key", F.col("up").alias("node")).distinct(), ["key", "node"], "left_anti") if jumps else done
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.col("score").desc(), F.col("far").desc(), "node"))
    paths = leaves.withColumn("_rank", rank).where(F.col("_rank") <= branches).select("key", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("below"))
    for level in reversed(range(len(jumps))):
        jump = jumps[level].select("key", "node", "up")
        higher = paths.join(jump, ["key", "node"]).select("key", "leaf", F.col("up").alias("node"), (F.col("below") + (1 << level)).alias("below"))
        paths = settle(paths.unionByName(higher), "paths")
    return paths.select("key", "leaf", "node", (-F.col("below")).alias("depth"))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, branch, part, formatted, loss (array of start, end in characters): turns written out in order.

    turns: conv_id, branch, order, role, text. A task holds one part at a time: a conversation whose formatted text is
    longer than PART_CHARS goes on, between turns, in a further part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "branch", "part", "formatted", "loss"]
        kind = pa.schema([("conv_id", pa.int64()), ("branch", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        now, part, pieces, spans, length = None, 0, [], [], 0
        for batch in batches:
            out = []
            for conv, branch, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "branch", "role", "text")), strict=True):
                if (conv, branch) != now or length > PART_CHARS:
                    if now is not None:
                        out.append((*now, part, "".join(pieces), spans))
                    part = part + 1 if (conv, branch) == now else 0
                    now, pieces, spans, length = (conv, branch), [], [], 0
                head, body = f"{START}{escape_role(role)}\n", escape(text)
                if role == "assistant":
                    spans.append({"start": length + len(head), "end": length + len(head) + len(body)})
                pieces += [head, body, f"{END}\n"]
                length += len(head) + len(body) + len(END) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), kind.types, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip((*now, part, "".join(pieces), spans), kind.types, strict=True)], names=names)

    ordered = turns.repartition("conv_id", "branch").sortWithinPartitions("conv_id", "branch", "order").select("conv_id", "branch", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, branch long, part int, formatted string, loss array<struct<start:long,end:long>>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted part."""
    turns = []
    for turn in formatted.split(START)[1:]:
        role, _, rest = turn.partition("\n")
        turns.append((unescape_role(role), unescape(rest[: -len(END) - 1])))
    return turns


def digests(parts: DataFrame) -> DataFrame:
    """What is read back from formatted parts, one row a conversation: parts must be as formatted() leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(now, n, turns, chars, loss, size):
            return {"conv_id": now[0], "branch": now[1], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}

        now = None
        for batch in batches:
            out = []
            for conv, branch, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "branch", "formatted", "loss")), strict=True):
                if (conv, branch) != now:
                    if now is not None:
                        out.append(row(now, n, turns, chars, masked, size))
                    now, n, turns, chars, masked, size = (conv, branch), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    chars += len(said)
                    masked.update(said.encode("utf-8", "surrogatepass"))
                size += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
        if now is not None:
            yield pa.RecordBatch.from_pylist([row(now, n, turns, chars, masked, size)], schema=kind)

    kind = pa.schema([("conv_id", pa.int64()), ("branch", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return parts.mapInArrow(run, "conv_id long, branch long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversations(rows: DataFrame, branches: int = 1) -> DataFrame:
    """rows (conv_id, turn, role, text) as formatted conversations; see formatted() for the columns.

    A null text or role is empty; a null conv_id is a conversation of its own. An empty table gives an empty one.
    """
    nodes = settle(chains(rows), "nodes")
    paths = best_paths(nodes, branches)
    turns = paths.join(nodes.select("key", "node", "tree", "role", "text"), ["key", "node"])
    return formatted(turns.select(F.col("tree").alias("conv_id"), F.col("leaf").alias("branch"), F.col("depth").alias("order"), "role", "text"))
