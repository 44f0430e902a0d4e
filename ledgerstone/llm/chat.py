"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees by their parents. Pointers are doubled by self-joins (a node's pointer becomes its pointer's pointer), so
that a tree of depth d takes log2(d) joins of n rows; sums of scores go along and rank the leaves, that is the branches. The
nodes of the chosen branches are marked from the leaves up by the same pointers, largest first. Each branch is formatted as one
conversation: <turn role=R>TEXT</turn>, a line each. Within roles and texts \\, < and > are written \\b, \\l and \\g; so no text
can hold a control string, and the form can be read back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole, written

OPEN, SHUT, END = "<turn role=", ">", "</turn>\n"
#: Fixed values of the template, in this order; undone in the opposite one.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escaped(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescaped(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), ESCAPES[::-1], text)


def branches(nodes: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, branch_rank, branch_score, node, depth (from 0) of the nodes on each tree's `best` branches of highest score.

    nodes: tree, node (unique within a tree), parent (null at a root), score (null counts as 0). A parent that isn't there makes
    a root. Nodes on a cycle have no root and are on no branch. A branch's score is the sum along it; ties: the smaller leaf.
    """
    base = written(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0)).alias("score")))
    there = base.select("tree", F.col("node").alias("parent"))
    jump = base.join(there.withColumn("known", F.lit(True)), ["tree", "parent"], "left")
    jump = written(jump.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "score", F.lit(0).alias("depth")))
    most = base.groupBy("tree").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    jumps, settled, moving = [], jump.where(F.col("up").isNull()), jump.where(F.col("up").isNotNull())
    for _ in range(int(most).bit_length()):  # nodes that have reached their root aren't joined again
        if moving.isEmpty():
            break
        jumps.append(moving.select("tree", "node", "up"))
        above = settled.unionByName(moving).select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("depth").alias("further"))
        far = F.lit(1 << (len(jumps) - 1))
        step = moving.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"), (far + F.col("further")).cast("int").alias("depth"))
        step = written(step)
        settled, moving = settled.unionByName(step.where(F.col("up").isNull())), step.where(F.col("up").isNotNull())
    ends = settled.join(base.select("tree", F.col("parent").alias("node")).where("node is not null").distinct(), ["tree", "node"], "left_anti")
    if best == 1:
        leaves = ends.groupBy("tree").agg(F.min_by(F.struct("node", "score", "depth"), F.struct(F.negative("score"), "node")).alias("l"))
        leaves = leaves.select("tree", F.col("l.node").alias("leaf"), F.lit(1).alias("branch_rank"), F.col("l.score").alias("branch_score"), F.col("l.depth").alias("at"))
    else:
        order = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))
        leaves = ends.select("tree", F.col("node").alias("leaf"), order.alias("branch_rank"), F.col("score").alias("branch_score"), F.col("depth").alias("at")).where(F.col("branch_rank") <= best)
    found = leaves.withColumn("node", F.col("leaf")).withColumn("depth", F.col("at"))
    for k in reversed(range(len(jumps))):
        step = found.join(jumps[k], ["tree", "node"]).drop("node").withColumnRenamed("up", "node").withColumn("depth", F.col("depth") - (1 << k))
        found = written(found.unionByName(step))
    return found.select("tree", "leaf", "branch_rank", "branch_score", "node", "depth")


def format_branches(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, branch_rank, branch_score, formatted (one text), loss_spans (start, end of assistants' texts in it, in code points).

    messages: tree, node, parent, score, role, text; other columns aren't looked at. Null roles and texts count as empty; a null tree
    has no branches; very long texts are formatted whole; equal scores go to the smaller leaf; repeated rows need nodes of their
    own; an empty table gives an empty one.
    """
    return _formatted(branches(messages, best), messages)


def _formatted(found: DataFrame, messages: DataFrame) -> DataFrame:
    said = messages.select("tree", "node", escaped(whole("role")).alias("role"), escaped(whole("text")).alias("text"))
    turns = found.join(said, ["tree", "node"])
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit(SHUT))
    turns = turns.withColumn("piece", F.concat(head, F.col("text"), F.lit(END))).withColumn("begin", F.char_length(head)).withColumn("long", F.char_length("text"))
    before = F.coalesce(F.sum(F.char_length("piece")).over(Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("start", (before + F.col("begin")).cast("long"))
    rows = turns.groupBy("tree", "leaf", "branch_rank", "branch_score").agg(F.sort_array(F.collect_list(F.struct("depth", "piece", "role", "start", (F.col("start") + F.col("long")).alias("end")))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return rows.select("tree", "leaf", "branch_rank", "branch_score", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs that a formatted conversation holds."""
    parts = F.split(formatted, END, -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda t: F.struct(unescaped(F.substr(F.substring_index(t, SHUT, 1), F.lit(len(OPEN) + 1))).alias("role"), unescaped(F.substr(t, F.instr(t, SHUT) + 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


def as_trees(conversations: DataFrame) -> DataFrame:
    """Flat conversations as trees of one branch: rows by turn (ties: by role and text; null first) reply to the row before."""
    own = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(own))
    return rows.select("tree", "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.char_length(whole("text")).cast("long").alias("score"), "role", "text")


def reply_branches(conversations: DataFrame, best: int = 2) -> DataFrame:
    """The two best branches of each conversation read as a reply tree in which row n replies to row n // 2, counted from 1.

    tree, leaf, branch_rank, branch_score, n_turns, path (node numbers from the root), formatted_sha256, loss_chars. Rows by turn
    (ties: by role and text; null first). Null texts and roles count as empty; rows without a conv_id are one tree; repeated rows
    are nodes of their own; other columns aren't looked at; an empty table gives an empty one.
    """
    trees = as_trees(conversations.select("conv_id", "turn", "role", "text"))
    trees = written(trees.withColumn("parent", F.when(F.col("node") > 1, F.floor(F.col("node") / 2).cast("int"))))
    found = written(branches(trees, best))
    out = _formatted(found, trees)
    paths = found.groupBy("tree", "leaf").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"].cast("string")), ">").alias("path"))
    loss = F.char_length(loss_text(F.col("formatted"), F.col("loss_spans"))).cast("long").alias("loss_chars")
    return out.join(paths, ["tree", "leaf"]).select("tree", "leaf", "branch_rank", "branch_score", "n_turns", "path", F.sha2("formatted", 256).alias("formatted_sha256"), loss)


def chat_digest(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    trees = written(as_trees(conversations.select("conv_id", "turn", "role", "text").unionByName(more)))
    out = format_branches(trees).withColumn("read", read_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    names = trees.where("node = 1").select("tree", "conv_id")
    return out.join(names, "tree").select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "branch_score")
