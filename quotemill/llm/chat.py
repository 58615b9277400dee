"""Reply trees: root-to-leaf paths, ranked branches, and their chat format, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.common import null_safe
from quotemill.session import settle

# The marks of a turn. Inside texts every "<|" is escaped, so a mark is never text.
START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Backslashes doubled, then ``<|`` as ``<\\|``: the marks can't occur in the result."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """As :func:`escape`; a line break, which ends the role, is written as ``\\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def unescape_role(role: Column) -> Column:
    # left to right: a pair of backslashes is taken before a backslash and n can be
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def linear_tree(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Messages of conversations in which each turn answers the one before: the shape ``best_paths`` takes.

    Equal turns are ordered by role and text, and all of them stay.
    """
    rows = conversations.select(
        F.col(conv_id).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    at = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return rows.select("tree", at.alias("node"), F.nullif(at - 1, F.lit(0)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of each tree: tree, leaf, branch (from 1), score, node, up.

    ``messages``: tree, node (unique in its tree), parent (null, or not in the tree: a root), score.
    Each step of the self-join doubles the reach of every node's pointer, so a thread of a thousand
    replies takes ten steps; the pointers of each step are kept, and walk back from the chosen leaves
    by halves. ``up`` counts the replies between a node and the leaf. A path's score is the mean of
    its nodes' (null: 0), ties go to the smaller leaf. Nodes on a cycle, or below one, have no root
    and are in no path.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    own = nodes.select("tree", F.col("node").alias("parent"))
    rooted = null_safe(nodes, own.withColumn("known", F.lit(True)), ["tree", "parent"])
    # far: the node that the pointer shows; total, length: of the nodes from this one to before far
    pointer = settle(
        rooted.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("far"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length"))
    )
    inner = pointer.where("far IS NOT NULL").select("tree", F.col("far").alias("node")).distinct()
    leaves = null_safe(pointer, inner, ["tree", "node"], "left_anti").select("tree", "node")
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    # a node that has reached its root is done; only the others take the next step
    done, steps = pointer.where("far IS NULL"), [pointer.where("far IS NOT NULL")]
    # after so many doublings only pointers that circle are left
    while 2 ** (len(steps) - 1) < largest and not steps[-1].isEmpty():
        last = steps[-1]
        onward = done.unionByName(last).select(
            "tree", F.col("node").alias("far"), F.col("far").alias("farther"), F.col("total").alias("more"), F.col("length").alias("longer")
        )
        moved = settle(
            null_safe(last, onward, ["tree", "far"], "inner").select(
                "tree",
                "node",
                F.col("farther").alias("far"),
                (F.col("total") + F.col("more")).alias("total"),
                (F.col("length") + F.col("longer")).alias("length"),
            )
        )
        done = done.unionByName(moved.where("far IS NULL"))
        steps.append(moved.where("far IS NOT NULL"))
    whole = null_safe(leaves, done, ["tree", "node"], "inner")
    best = Window.partitionBy("tree").orderBy(F.desc("mean"), "node")
    chosen = (
        whole.select("tree", "node", (F.col("total") / F.col("length")).alias("mean"))
        .withColumn("branch", F.row_number().over(best))
        .where(F.col("branch") <= branches)
    )
    walk = chosen.select("tree", F.col("node").alias("leaf"), "branch", F.col("mean").alias("score"), "node", F.lit(0).cast("long").alias("up"))
    for level in reversed(range(len(steps) - 1)):
        jump = steps[level].select("tree", "node", "far")
        further = null_safe(walk, jump, ["tree", "node"], "inner").withColumn("node", F.col("far")).withColumn("up", F.col("up") + 2**level)
        walk = settle(walk.unionByName(further.drop("far")))
    return walk


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """One conversation per path: tree, leaf, branch, score, n_turns, formatted, loss_spans.

    A turn is its start mark, role, line break, text and end mark. ``loss_spans`` are the start and
    end (in code points of ``formatted``, end excluded) of each assistant text. Null roles and texts
    are empty.
    """
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turns = null_safe(paths, messages.select("tree", "node", "role", "text"), ["tree", "node"], "inner").select(
        "tree", "leaf", "branch", "score", "up", head.alias("head"), text.alias("body"), F.coalesce(F.col("role") == LOSS_ROLE, F.lit(False)).alias("loss")
    )
    path = ["tree", "leaf", "branch", "score"]
    before = Window.partitionBy(*path).orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    placed = turns.withColumn("start", start)
    piece = F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(END)).alias("piece"))
    span = F.when(F.col("loss"), F.struct(F.col("start").alias("start"), (F.col("start") + F.length("body")).alias("end")))
    return placed.groupBy(*path).agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.array_sort(F.collect_list(piece))["piece"], "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        return F.struct(
            unescape_role(F.substring(piece, F.lit(len(START) + 1), at - len(START) - 1)).alias("role"),
            unescape(F.substring(piece, at + 1, F.length(piece))).alias("text"),
        )

    return F.transform(pieces, turn)


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
