"""Reply trees to conversations, in DataFrame expressions only.

A tree is rows (tree, node, parent, role, text, score).  Root-to-leaf paths come
from iterative self-joins with doubling steps: the set of nodes up to 2**k above
each leaf is joined with the 2**k-th ancestors, so a path of n turns takes log2(n)
joins.  Branches are ranked by their summed score, ties by leaf; each chosen path
is formatted as one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Inside texts and
roles ``&`` is written ``&amp;`` and ``<|`` is written ``&lt;|`` (and a line break
in a role ``&#10;``), so no text can forge a control string and reading back is
exact.  ``loss_spans`` mark the assistants' texts in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, written

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def chain(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees without branches: each row
    replies to the one before it by turn (ties by role, then text; nulls first).
    Null roles and texts count as empty; repeated rows are turns of their own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return turns.select(
        F.col("conv_id").alias("tree"), node.alias("node"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.char_length("text").cast("double"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, above): the nodes of every root-to-leaf path; ``above`` is the
    distance from the leaf.  A node whose parent is missing is a root; branches that
    run into a cycle have no root and are left out."""
    up = nodes.select("tree", "node", "parent")
    p, c = up.alias("p"), up.alias("c")
    parent_of = (F.col("c.tree").eqNullSafe(F.col("p.tree"))) & (F.col("c.parent") == F.col("p.node"))
    jump = written(c.join(p, parent_of, "left_semi").select("tree", "node", F.col("parent").alias("up")), "jump")
    leaves = up.alias("p").join(up.alias("c"), parent_of, "left_anti")
    member = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < most and not jump.isEmpty():
        m, j = member.alias("m"), jump.alias("j")
        further = m.join(j, F.col("m.tree").eqNullSafe(F.col("j.tree")) & (F.col("m.node") == F.col("j.node"))).select(
            "m.tree", "leaf", F.col("j.up").alias("node"), (F.col("above") + step).alias("above"))
        member = written(member.unionByName(further), "paths")
        a, b = jump.alias("a"), jump.alias("b")
        jump = written(a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node"))).select(
            "a.tree", "a.node", F.col("b.up").alias("up")), "jump")
        step *= 2
    return member


def conversations(nodes: DataFrame, max_branches: int | None = None) -> DataFrame:
    """(tree, leaf, branch, score, n_turns, formatted, loss_spans), one row per chosen
    branch; ``branch`` 1 has the highest score.  Node ids must be unique in a tree
    (of repeated ones the least by role and text is taken)."""
    nodes = nodes.groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("s")).select(
        "tree", "node", "s.parent", "s.role", "s.text", "s.score")
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    nodes = written(nodes.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left").select(
        "tree", "node", F.col("n").alias("parent"), F.col("n").isNull().alias("root"), "role", "text", "score"), "nodes")
    member = paths(nodes)
    m, n = member.alias("m"), nodes.alias("n")
    turns = m.join(n, F.col("m.tree").eqNullSafe(F.col("n.tree")) & (F.col("m.node") == F.col("n.node"))).select(
        "m.tree", "leaf", "above", "role", "root", "score",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    size = F.char_length("head") + F.char_length("body") + len(END) + 1
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int"))
    span = F.when(F.col("role") == ASSISTANT, F.struct(
        (F.col("at") + F.char_length("head")).alias("start"), F.char_length("body").alias("length")))
    whole = turns.groupBy("tree", "leaf").agg(
        F.sum("score").alias("score"), F.count("*").alias("n_turns"), F.max("root").alias("rooted"),
        F.array_sort(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(END + "\n")).alias("turn")))).alias("turns"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"))
    out = whole.where("rooted").select("tree", "leaf", "score", "n_turns", F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss_spans")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    out = out.withColumn("branch", rank)
    return out if max_branches is None else out.where(F.col("branch") <= max_branches)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    parts = F.split(formatted, r"<\|im_end\|>\n")

    def turn(body):
        return bound(F.substring_index(body, "\n", 1), lambda role: F.struct(
            unescape_role(role).alias("role"), unescape(F.substr(body, F.char_length(role) + 2)).alias("text")))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: turn(F.substr(x, F.lit(len(START) + 1))))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return bound(formatted, lambda f: F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(f, s["start"] + 1, s["length"]))), ""))


def report(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted output."""
    done = conversations(chain(turns))
    back = done.select(
        F.col("tree").alias("conv_id"), read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")
