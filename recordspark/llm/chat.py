"""Chat formatting from reply trees, in DataFrame functions only.

Root-to-leaf paths are enumerated by iterative self-joins that double the distance each round: a
tree of depth d needs log2(d) rounds up and as many down, every round being a written table. The
rows made are the messages on the paths, no more. Branches are ranked by the sum of their
messages' scores, and each chosen path becomes one string with a mask of the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspark.llm.common import written

START, END = "<|im_start|>", "<|im_end|>\n"
#: Every control string has one of these characters; `&` comes first so that the escape can be undone.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))


def escape(x: Column, pairs=ESCAPES) -> Column:
    """A text without `<` and `[`: no control string of this or other chat templates survives."""
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape(x: Column, pairs=ESCAPES) -> Column:
    """Undoes escape() exactly."""
    for a, b in reversed(pairs):
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def branch_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, back) for every message on every root-to-leaf path of (tree, node, parent).

    back: steps from the leaf. A parent that is missing makes its child a root. Messages on a
    cycle, or hanging from one, have no root and give no path. node must be unique within a tree.
    Jump table k has the ancestor 2^k steps up, for messages that deep only, so tables shrink.
    """
    base = messages.select("tree", "node", "parent")
    known = base.selectExpr("tree t2", "node n2")
    jumps = [written(base.join(known, (F.col("tree") == F.col("t2")) & (F.col("parent") == F.col("n2"))).select("tree", "node", F.col("n2").alias("up")), "chat-jump")]
    size = messages.count()
    while jumps[-1].limit(1).count() and 1 << (len(jumps) - 1) <= size:
        last = jumps[-1]
        over = last.selectExpr("tree t2", "node n2", "up up2")
        jumps.append(written(last.join(over, (F.col("tree") == F.col("t2")) & (F.col("up") == F.col("n2"))).select("tree", "node", F.col("up2").alias("up")), "chat-jump"))
    parents = jumps[0].select("tree", F.col("up").alias("node")).distinct()
    rootless = jumps.pop().select("tree", "node")  # deeper than there are messages
    leaves = base.select("tree", "node").join(parents, ["tree", "node"], "left_anti").join(rootless, ["tree", "node"], "left_anti")
    path = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(jumps))):
        jump = jumps[k].selectExpr("tree t2", "node n2", "up")
        more = path.join(jump, (F.col("tree") == F.col("t2")) & (F.col("node") == F.col("n2")))
        path = written(path.unionAll(more.select("tree", "leaf", F.col("up").alias("node"), F.col("back") + (1 << k))), "chat-path")
    return path


def format_trees(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """One row per chosen root-to-leaf path: tree_id, leaf_id, branch_rank, path_score, n_turns, formatted, loss_spans.

    messages: tree_id, node_id, parent_id, role, text, score. Within a tree, branches are ranked
    by the sum of scores (null: 0), then by leaf id; keep: how many of each tree (None: all). Ranks come
    from narrow rows; only the chosen branches are joined with their texts.
    Null roles and texts are empty; null tree ids form one tree; messages without node id are left out; of messages with
    the same node id in a tree one stays (least parent, role, text and score). loss_spans are (start, length) in
    code points of formatted, one for each assistant message. An empty table gives no rows.
    """
    tree = F.concat(F.when(F.col("tree_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("tree_id").cast("string"), F.lit("")))
    m = messages.where("node_id is not null").select(tree.alias("tree"), F.col("node_id").alias("node"), F.struct(F.col("parent_id").alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "tree_id").alias("m"))
    m = m.groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.*")
    path = branch_paths(m)
    scored = path.join(m.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"))
    ranked = scored.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    if keep is not None:
        ranked = ranked.where(F.col("branch_rank") <= keep)
        path = path.join(ranked.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    turns = path.join(m, ["tree", "node"])
    head = F.concat(F.lit(START), escape(F.col("role"), ROLE_ESCAPES), F.lit("\n"))
    turns = turns.withColumn("head", head).withColumn("body", escape(F.col("text")))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("back")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    one = turns.groupBy("tree", "leaf").agg(
        F.first("tree_id").alias("tree_id"), F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("place"), "piece", "start", F.length("body").cast("long").alias("size"), (F.col("role") == "assistant").alias("loss")))).alias("t"),
    )
    one = one.join(ranked, ["tree", "leaf"])
    return one.select(
        "tree_id", F.col("leaf").alias("leaf_id"), "branch_rank", "path_score", "n_turns",
        F.array_join(F.transform("t", lambda x: x.piece), "").alias("formatted"),
        F.expr("transform(filter(t, x -> x.loss), x -> struct(x.start as start, x.size as length))").alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """turns array<struct<role, text>> parsed from formatted, and loss_text read under the mask."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(START) + 1, 1 << 30), "\n", 1), ROLE_ESCAPES).alias("role"),
        unescape(F.substring(p, F.locate("\n", p) + 1, F.lit(1 << 30))).alias("text"),
    )
    spans = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int"))))
    body = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return formatted.withColumn("p", body).withColumn("turns", F.transform("p", turn)).withColumn("loss_text", F.array_join(spans, "")).drop("p")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a tree without branches: each row replies to the one before (ties: role, then text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    rows = conversations.select("conv_id", "role", "text", n.alias("node_id"))
    return rows.select(F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
