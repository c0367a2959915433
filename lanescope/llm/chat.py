"""Chat formatting of reply trees, with DataFrame functions only.

A tree's nodes are rows (tree, node, parent, role, text, score).  Paths from root to leaf are
found by iterative self-joins that double: after round k every node knows its ancestor 2^k steps up
and the score of the way there, so a tree of depth D takes log2(D) rounds, and a round moves one
narrow row per node that isn't done.  Branches are ranked by their leaf's total score.  For the chosen leaves the
same tables, largest step first, list each path's nodes exactly once; texts are joined last.

A conversation is written between markers.  In texts a backslash and a letter stand for each sign
that could begin a marker and for the backslash itself, so no marker occurs inside a text, and
plain replacement restores it.  The loss mask lists the code-point spans of assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanescope.llm.shared import written

# Fixed values of the template.
HEAD, COLON, SPACE, CLOSE = "### ", ":", " ", "</turn>\n"
#: The backslash is first to be replaced, and last to be restored.
IN_TEXTS = {"\\": r"\b", "#": r"\h", "<": r"\l"}
IN_ROLES = {**IN_TEXTS, COLON: r"\c"}
LEARNED_ROLE = "assistant"


def escape(text: Column, signs: dict[str, str] = IN_TEXTS) -> Column:
    """``text`` with every sign that markers are made of replaced."""
    for sign, code in signs.items():
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column, signs: dict[str, str] = IN_TEXTS) -> Column:
    for sign, code in reversed(signs.items()):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def _steps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Hops and totals: [(tree, node, up) for k = 0, 1, ...] and (tree, node, far, total).

    The k-th hops lead from each node to its ancestor 2^k up, where it has one; only such nodes go
    on to the next round.  ``far`` counts the nodes from the root to a node, ``total`` their scores.
    """
    own = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    step = written(nodes.select(
        "tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("far"),
        own.alias("total"),
    ))
    hops: list[DataFrame] = []
    ended = step.where(F.col("up").isNull())
    while step.where(F.col("up").isNotNull()).limit(1).count():
        going = step.where(F.col("up").isNotNull())
        hops.append(going.select("tree", "node", "up"))
        if len(hops) > 62:
            raise ValueError("the parents of some nodes form a cycle")
        above = going.unionByName(ended).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("higher"),
            F.col("far").alias("more"), F.col("total").alias("rest"),
        )
        step = written(going.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("higher").alias("up"),
            (F.col("far") + F.col("more")).alias("far"),
            (F.col("total") + F.col("rest")).alias("total"),
        ))
        ended = ended.unionByName(step.where(F.col("up").isNull()))
    return hops, ended.select("tree", "node", "far", "total")


def ranked_leaves(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """(tree, leaf, n_turns, total, branch): branches from the best total score on, from 1."""
    parents = nodes.select("tree", F.col("parent").alias("node")).where(F.col("node").isNotNull())
    leaves = totals.join(parents.distinct(), ["tree", "node"], "left_anti")
    best_first = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    return leaves.select(
        "tree", F.col("node").alias("leaf"), F.col("far").alias("n_turns"), "total",
        F.row_number().over(best_first).alias("branch"),
    )


def path_nodes(leaves: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """(tree, leaf, node, up_to_leaf): every node on the path to each leaf, counted from the leaf."""
    paths = leaves.select(
        "tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up_to_leaf")
    )
    for k in range(len(hops) - 1, -1, -1):
        further = paths.join(hops[k], ["tree", "node"]).select(
            "tree", "leaf", F.col("up").alias("node"),
            (F.col("up_to_leaf") + (1 << k)).alias("up_to_leaf"),
        )
        paths = written(paths.unionByName(further))
    return paths


def _pieces(role: Column, text: Column) -> tuple[Column, Column, Column]:
    opening = F.concat(F.lit(HEAD), escape(role, IN_ROLES), F.lit(COLON + SPACE))
    return opening, escape(text), F.lit(CLOSE)


def formatted(turns: DataFrame) -> DataFrame:
    """Turns (conv, at, role, text) to (conv, n_turns, formatted, loss_mask), one row per ``conv``.

    ``loss_mask`` is a list of (start, end) in code points of ``formatted``.
    """
    opening, body, closing = _pieces(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    turns = turns.select("conv", "at", "role", opening.alias("opening"), body.alias("body"))
    turns = turns.withColumns({
        "piece": F.concat("opening", "body", closing),
        "head": F.length("opening"), "size": F.length("body"),
    })
    before = F.sum(F.length("piece")).over(
        Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    )
    turns = turns.withColumn("start", F.coalesce(before, F.lit(0)) + F.col("head"))
    span = F.when(
        F.col("role") == LEARNED_ROLE,
        F.struct(F.col("start").alias("start"), (F.col("start") + F.col("size")).alias("end")),
    )
    whole = turns.groupBy("conv").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(span)).alias("loss_mask"),
    )
    joined = F.array_join(F.transform("pieces", lambda p: p.piece), "")
    return whole.select("conv", "n_turns", joined.alias("formatted"), "loss_mask")


def conversations(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """The best ``branches`` (None: all) of each tree: (tree, branch, n_turns, formatted, loss_mask).

    ``nodes``: tree, node, parent (null at roots), role, text, score (null counts 0).  Node ids are
    unique in a tree and not null.  Ties go to the smaller leaf.  A parent that isn't there ends the
    path like a root.  Null texts and roles count as empty; the rows whose tree is null are one
    tree; an empty table gives an empty table; parents that form a cycle are an error.  Other
    columns are ignored.
    """
    kind = nodes.schema["tree"].dataType
    nodes = nodes.select(
        # A key that joins treat as equal when the tree is null.
        F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("")).alias("tree"),
        "node", "parent", "role", "text", "score",
    )
    known = nodes.select("tree", F.col("node").alias("parent")).withColumn("there", F.lit(True))
    placed = nodes.drop("role", "text").join(known, ["tree", "parent"], "left")
    narrow = written(placed.select(
        "tree", "node", F.when(F.col("there"), F.col("parent")).alias("parent"), "score"
    ))
    hops, totals = _steps(narrow)
    leaves = ranked_leaves(narrow, totals)
    if branches is not None:
        leaves = leaves.where(F.col("branch") <= branches)
    leaves = written(leaves)
    turns = (
        path_nodes(leaves, hops)
        .join(leaves, ["tree", "leaf"])
        .join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
        .select(
            F.struct("tree", "branch").alias("conv"), (-F.col("up_to_leaf")).alias("at"),
            "role", "text",
        )
    )
    tree = F.when(F.col("conv.tree") != "", F.substring(F.col("conv.tree"), 2, 1 << 30).cast(kind))
    return formatted(turns).select(
        tree.alias("tree"), F.col("conv.branch").alias("branch"),
        "n_turns", "formatted", "loss_mask",
    )


def parsed(formatted_column: Column) -> Column:
    """List of (role, text) read back from a formatted conversation."""
    turns = F.filter(F.split(formatted_column, CLOSE, -1), lambda t: t != "")

    def turn(piece: Column) -> Column:
        colon = F.instr(piece, COLON)
        role = F.substring(piece, F.lit(len(HEAD) + 1), colon - (len(HEAD) + 1))
        text = F.substring(piece, colon + 2, F.length(piece))
        return F.struct(unescape(role, IN_ROLES).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def masked_text(formatted_column: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped span by span, nothing between."""
    return F.array_join(F.transform(loss_mask, lambda span: unescape(F.substring(
        formatted_column, span["start"].cast("int") + 1, (span["end"] - span["start"]).cast("int")
    ))), "")


def digests(chats: DataFrame) -> DataFrame:
    """Figures of each conversation, all read back from its formatted text and mask."""
    turns = F.array_join(F.transform(
        parsed(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))
    ), "")
    return chats.withColumn("__loss", masked_text(F.col("formatted"), F.col("loss_mask"))).select(
        F.col("tree").alias("conv_id"),
        F.size(parsed(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def linear_trees(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees: each turn answers the one before.

    Repeated turns keep one order: by role, then text.  A null id is a conversation of its own kind.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    numbered = rows.select("conv_id", "role", "text", node.alias("node"))
    return numbered.select(
        F.col("conv_id").alias("tree"), "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"),
    )
