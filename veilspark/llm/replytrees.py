"""Reply trees as conversations, with DataFrame operations only.

Nodes with a parent form trees. Iterative self-joins double each node's jump
towards the root, and with it the sum of the scores on the way, so a path of n
nodes takes log2(n) joins. Branches (leaves) are ranked by their path's score.
The paths of the chosen ones are read back from the jumps, longest first: only
nodes of chosen paths are ever expanded, and only then do texts join.

Template. A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``; turns are joined
by a line break. In roles and texts a backslash is doubled and ``<|`` becomes
``<\\|``, so no text can hold a control string, and the escapes can be undone.
The loss mask is the character spans of the assistant's texts.

Defined cases: null roles and texts are empty; a parent that isn't there makes a
root; nodes on or below a cycle reach no root and are left out; of rows with one
(tree, node) the least by parent, role, text counts; ties of score go to the
smaller leaf; a null tree id is a tree of its own; nulls of score count as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

START, SEP, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def linear(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Rows of a tree, each the reply to the one before it: adds ``node`` and ``parent``."""
    w = Window.partitionBy(tree).orderBy(*order)
    return rows.withColumn("node", F.row_number().over(w).cast("long")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """``nodes``: tree, node, parent, score. Rows tree, leaf, rank, node, back (steps from the leaf) of the ``top`` branches of each tree."""
    found = nodes.groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("own")).select("tree", "node", "own.parent", F.coalesce("own.score", F.lit(0.0)).cast("double").alias("score"))
    found = materialise(found, "tree-nodes")
    here = found.select("tree", F.col("node").alias("anc"))
    linked = found.withColumnRenamed("parent", "anc").join(here.withColumn("there", F.lit(True)), ["tree", "anc"], "left")
    first = materialise(linked.select("tree", "node", F.when(F.col("there"), F.col("anc")).alias("anc"), "score"), "tree-jumps")
    # score: of the nodes from this one up to the jump's end, which is not included
    jumps = [first.where("anc is not null")]
    reached = first.where("anc is null").select("tree", "node", "score")
    largest = found.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while (1 << (len(jumps) - 1)) < largest and not jumps[-1].isEmpty():
        near = jumps[-1]
        far = near.select("tree", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("score").alias("score2"))
        further = materialise(near.join(far, ["tree", "anc"], "left"), "tree-jumps")
        # where there is no further jump, this one ended at a node whose path is summed already
        top_score = reached.select("tree", F.col("node").alias("anc"), F.col("score").alias("rest"))
        ended = further.where("anc2 is null").join(top_score, ["tree", "anc"]).select("tree", "node", (F.col("score") + F.col("rest")).alias("score"))
        reached = reached.unionByName(materialise(ended, "tree-scores"))
        jumps.append(further.where("anc2 is not null").select("tree", "node", F.col("anc2").alias("anc"), (F.col("score") + F.col("score2")).alias("score")))
    parents = jumps[0].select("tree", F.col("anc").alias("node")).distinct()
    leaves = reached.join(parents, ["tree", "node"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node")))
    path = materialise(ranked.where(F.col("rank") <= top).select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("back")), "tree-paths")
    for k in reversed(range(len(jumps))):
        step = jumps[k].select("tree", "node", "anc")
        up = path.join(step, ["tree", "node"]).select("tree", "leaf", "rank", F.col("anc").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        path = materialise(path.unionByName(up), "tree-paths")
    return path


def conversations(rows: DataFrame, tree: str = "conv_id", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: Column | None = None, top: int = 1) -> DataFrame:
    """One row a chosen branch: tree (as ``tree`` is named), leaf, rank, formatted, loss_spans (array of lo, hi in characters)."""
    score = F.lit(0.0) if score is None else score
    lean = rows.select(
        F.coalesce(F.col(tree).cast("string"), F.lit("\0")).alias("tree"), F.col(tree).alias("own_tree"), F.col(node).cast("long").alias("node"), F.col(parent).cast("long").alias("parent"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), score.cast("double").alias("score"),
    ).where("node is not null")
    lean = materialise(lean, "tree-texts")
    path = best_paths(lean.select("tree", "node", "parent", "score"), top)
    content = lean.groupBy("tree", "node").agg(F.min(F.struct("parent", "score", "role", "text", "own_tree")).alias("own")).select("tree", "node", "own.role", "own.text", "own.own_tree")
    turns = path.join(content, ["tree", "node"]).withColumn("prefix", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))).withColumn("body", escape(F.col("text")))
    turns = turns.withColumn("size", F.char_length("prefix") + F.char_length("body") + len(STOP) + 1)
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("back")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("lo", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.char_length("prefix"))
    turn = F.struct((-F.col("back")).alias("at"), F.concat("prefix", "body", F.lit(STOP)).alias("piece"), (F.col("role") == "assistant").alias("loss"), "lo", (F.col("lo") + F.char_length("body")).alias("hi"))
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.first("own_tree").alias("__tree"), F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t.loss), lambda t: F.struct(t.lo.alias("lo"), t.hi.alias("hi")))
    return whole.select(F.col("__tree").alias(tree), "leaf", "rank", F.array_join(F.transform("turns", lambda t: t.piece), "\n").alias("formatted"), spans.alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role, text, as they were before escaping."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, k: k > 0)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, SEP, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, SEP, -1), STOP, 1)).alias("text")))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s.lo + 1, s.hi - s.lo))), "")
