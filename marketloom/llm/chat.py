"""Chat formatting of reply trees.

Messages form trees by their parent's id. Ids alone go through the joins:
jump pointers are doubled by self-joins (round k finds the ancestor 2^k steps
up, so a thread of n turns takes log2(n) rounds), the same pointers list the
ancestors of every chosen leaf, and only the texts on chosen paths are joined
and gathered, by path.

Branches are the paths from a root to a leaf, ranked in their tree by the sum
of their scores (null: 0), ties by the smaller leaf id. A message whose parent
is null or not in its tree is a root. Messages without a tree or node id, and
those on a cycle (which have no root), are in no branch. Of repeated node ids
in a tree the row with the smallest parent (null first), then by a hash of role
and text, stays. Null roles and texts are empty, very long texts are kept
whole. Trees are told apart by any type that can be compared. Other columns
do not matter, whatever their names; an empty table has an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketloom.llm.common import staged

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text) -> F.Column:
    """Text in which ``<|`` does not occur: the backslashes between ``<`` and ``|`` get one more."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text) -> F.Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role) -> F.Column:
    """As ``escaped``, and on one line."""
    return escaped(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role) -> F.Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def jump_tables(nodes: DataFrame) -> list[DataFrame]:
    """``(tree, node, up)`` for 1, 2, 4, ... steps up, as far as any tree goes.

    ``nodes``: ``tree, node, parent``, parent null at a root. A cycle ends the
    rounds too, once they have gone as many steps as there are messages.
    """
    rows, tables = nodes.count(), []
    now = staged(nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("up")), "jumps")
    while now.limit(1).count() and 1 << len(tables) <= 2 * rows:
        tables.append(now)
        top = now.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"))
        now = staged(now.join(top, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up")), "jumps")
    return tables


def root_to_leaf_paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """``(tree, leaf, rank, score, path)``: the best ``top`` branches of each tree (None: all).

    ``nodes``: ``tree, node, parent, score``, one row a node. ``path`` lists
    the nodes from the root to the leaf.
    """
    nodes = staged(nodes, "nodes")
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    linked = nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))
    linked = staged(linked, "linked")
    jumps = jump_tables(linked)
    parents = linked.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = linked.join(parents, ["tree", "node"], "left_anti")
    # every leaf meets each of its ancestors once: steps up in binary, the largest first
    seen = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        jump = jumps[k].withColumnRenamed("up", "to")
        further = seen.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        seen = staged(seen.union(further), "ancestors")  # else the plan doubles with each round
    scored = seen.join(linked.select("tree", "node", "score"), ["tree", "node"])
    paths = scored.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("up", "node")))), lambda x: x["node"]).alias("path"))
    ranked = paths.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("tree", "leaf", "rank", "score", "path")


def format_trees(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """``(tree, leaf, rank, score, n_turns, formatted)``: each chosen branch as one conversation.

    ``messages``: ``tree, node, parent, role, text, score``; node ids are long.
    """
    tidy = messages.where("tree is not null and node is not null")
    order = F.struct("parent", F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    nodes = tidy.groupBy("tree", "node").agg(F.min_by(F.struct("parent", "score", "role", "text"), order).alias("x"))
    nodes = staged(nodes.select("tree", "node", "x.*"), "messages")
    paths = root_to_leaf_paths(nodes.select("tree", "node", "parent", "score"), top)
    turns = paths.select("tree", "leaf", "rank", "score", F.posexplode("path").alias("at", "node")).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    line = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END + "\n"))
    said = turns.groupBy("tree", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"))
    return said.select("tree", "leaf", "rank", "score", F.size("lines").cast("long").alias("n_turns"), F.concat_ws("", F.transform("lines", lambda x: x["line"])).alias("formatted"))


def parse_formatted(formatted) -> F.Column:
    """``array<struct<role, text>>`` read back from a formatted conversation."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    turn = lambda b: F.struct(unescaped_role(F.substring_index(b, "\n", 1)).alias("role"), unescaped(F.regexp_extract(b, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)).alias("text"))
    return F.transform(blocks, turn)


def loss_spans(turns) -> F.Column:
    """The texts under the loss mask: what assistants say, in order."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"])
