"""Chat formatting of reply trees; only DataFrame functions.

Nodes name their parent. Iterative self-joins enumerate all root-to-leaf paths: a table of jumps knows every node's ancestor
2^k steps up and is joined with itself to double k, while the paths, which begin at the leaves, are joined with it to reach
twice as far. The number of rounds is the logarithm of the deepest tree; every round is checkpointed. The branches of a tree
are ranked by the sum of their nodes' scores, and each chosen one becomes one conversation.

The template marks every turn. Backslashes in roles and texts are doubled, and a backslash is set behind the first
character of every control string, so no control string of this or the other listed templates is left in a text, and
``unescape`` gives the text back.

Defined results: a null or empty text or role is an empty one; a node whose parent is missing, null or itself is a root;
nodes on a cycle, and the nodes below it, have no root and are on no path; of rows that repeat a node one stays, the least
by parent, role, text. Trees with a null key are one tree. Ties in the score go to the smaller leaf. Extra columns are not
used. A tree of any size is enumerated whole; a conversation has to fit one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.shared import checkpointed, require

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: What begins the marks above, and control strings of other common templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in CONTROLS:
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def paths(nodes: DataFrame) -> DataFrame:
    """``tree, leaf, node, up`` for ``nodes`` (tree, node, parent): every node of every path, ``up`` steps above the leaf."""
    own = nodes.select("tree", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"))
    there = own.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    met = own.join(there, own["tree"].eqNullSafe(there["t"]) & (own["parent"] == there["n"]), "left")
    own = checkpointed(met.select("tree", "node", F.col("n").alias("parent")))
    most = own.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0

    jump = own.filter("parent is not null").select("tree", "node", F.col("parent").alias("to"))
    parents = jump.select(F.col("tree").alias("t"), F.col("to").alias("n")).distinct()
    ends = own.join(parents, own["tree"].eqNullSafe(parents["t"]) & (own["node"] == parents["n"]), "left_anti")
    reached = ends.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    step = 1
    while step <= most and not jump.isEmpty():
        far = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "to")
        up = reached.join(far, reached["tree"].eqNullSafe(far["t"]) & (reached["node"] == far["n"]))
        reached = checkpointed(reached.unionAll(up.select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))))
        twice = jump.select("tree", "node", F.col("to").alias("via")).join(far, F.col("tree").eqNullSafe(far["t"]) & (F.col("via") == far["n"]))
        jump = checkpointed(twice.select("tree", "node", "to"))
        step *= 2
    roots = own.filter("parent is null").select(F.col("tree").alias("t"), F.col("node").alias("n"))
    rooted = reached.join(roots, reached["tree"].eqNullSafe(roots["t"]) & (reached["node"] == roots["n"]), "left_semi")
    rooted = rooted.select(F.col("tree").alias("t"), F.col("leaf").alias("l"))
    return reached.join(rooted, reached["tree"].eqNullSafe(rooted["t"]) & (reached["leaf"] == rooted["l"]), "left_semi")


def format_trees(
    nodes: DataFrame,
    tree: str = "tree",
    node: str = "node",
    parent: str = "parent",
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    *,
    branches: int | None = None,
    learned: str = "assistant",
) -> DataFrame:
    """One row for each chosen path: ``tree, leaf, score, rank, n_turns, formatted, loss``.

    loss lists the spans (start, length; code points) of the texts of role ``learned``. ``branches`` keeps the best paths of
    each tree; None keeps all.
    """
    require(nodes, (tree, node, parent, role, text, *([score] if score else [])))
    content = F.struct(
        nodes[parent].cast("long").alias("parent"),
        F.coalesce(nodes[role], F.lit("")).alias("role"),
        F.coalesce(nodes[text], F.lit("")).alias("text"),
        (F.coalesce(nodes[score].cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"),
    )
    rows = nodes.select(nodes[tree].alias("tree"), nodes[node].cast("long").alias("node"), content.alias("c")).filter("node is not null")
    single = checkpointed(rows.groupBy("tree", "node").agg(F.min("c").alias("c")).select("tree", "node", "c.*"))
    found = paths(single.select("tree", "node", "parent"))

    ranked = None
    if score or branches is not None:
        worth = single.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score")
        scored = found.join(worth, found["tree"].eqNullSafe(worth["t"]) & (found["node"] == worth["n"]))
        total = scored.groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
        rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
        ranked = total.withColumn("rank", rank)
        if branches is not None:
            ranked = ranked.filter(F.col("rank") <= branches)
        ranked = ranked.select(F.col("tree").alias("rt"), F.col("leaf").alias("rl"), "score", "rank")
        found = found.join(ranked, found["tree"].eqNullSafe(ranked["rt"]) & (found["leaf"] == ranked["rl"])).drop("rt", "rl")
    else:
        found = found.withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(None).cast("int"))

    said = single.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = found.join(said, found["tree"].eqNullSafe(said["t"]) & (found["node"] == said["n"]))
    head = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    turns = turns.select("tree", "leaf", "score", "rank", "up", "role", head.alias("head"), body.alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = W.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == learned, F.struct(start.alias("start"), F.length("body").cast("long").alias("length")))
    turns = turns.select("tree", "leaf", "score", "rank", F.struct((-F.col("up")).alias("at"), "piece", span.alias("span")).alias("turn"))
    whole = turns.groupBy("tree", "leaf").agg(
        F.first("score").alias("score"), F.first("rank").alias("rank"), F.sort_array(F.collect_list("turn")).alias("turns")
    )
    return whole.select(
        "tree",
        "leaf",
        "score",
        "rank",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of ``role, text``, unescaped."""
    parts = F.split(formatted, r"<\|end\|>")
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))  # behind the last end mark there is nothing
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.replace(F.substring_index(p, TEXT, 1), F.lit(ROLE), F.lit(""))).alias("role"),
            unescape(p.substr(F.instr(p, TEXT) + len(TEXT), F.length(p))).alias("text"),
        ),
    )


def under_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, all spans in order."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
