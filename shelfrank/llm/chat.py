"""Conversations out of reply trees, as training texts with a loss mask. DataFrame expressions only.

A message names the message that it replies to. Self-joins give every message the one two,
four, eight ... replies up, until none is left. From each leaf the same tables, widest
first, then give all messages on the way to its root: each join doubles what a path holds,
so the number of joins is the logarithm of the longest path and no row holds a whole path.
Branches of a tree are ranked by the sum of their messages' scores; the chosen ones fetch
their texts and become one conversation each.

The template of a turn is ``<s>[INST]role[/INST]text</s>``. Inside roles and texts every
backslash is doubled and a backslash is set after the first character of each control
string, so no control string is left and reading back takes the backslashes out again.
Assistants' texts (without their marks) are under the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.llm.storage import keep

OPEN, HEAD, TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """The text with no control string in it."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, HEAD, TEXT, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables (node, up): the message 1, 2, 4, ... replies up, for messages that have one.

    ``nodes``: stored (node, parent). A message whose way up never ends has a circle above
    it; it keeps an ancestor after more steps than there are messages.
    """
    tables = [keep(nodes.where("parent is not null").select("node", F.col("parent").alias("up")), "chat-up-0")]
    total = nodes.count()
    while tables[-1].limit(1).count() and 1 << (len(tables) - 1) <= total:
        onward = tables[-1].select(F.col("node").alias("up"), F.col("up").alias("_next"))
        tables.append(keep(tables[-1].join(onward, "up").select("node", F.col("_next").alias("up")), f"chat-up-{len(tables)}"))
    return tables


def paths(nodes: DataFrame) -> DataFrame:
    """leaf, node, back: every message on the way from each leaf to its root, ``back`` replies above the leaf.

    ``nodes``: (node, parent) with unique longs; a parent that isn't a node, or is the node
    itself, counts as none. A leaf is a message without replies. Messages whose replies
    run in a circle have no root and are on no path.
    """
    nodes = nodes.select("node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"))
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("_known"))
    nodes = nodes.join(known, "parent", "left").select("node", F.when(F.col("_known"), F.col("parent")).alias("parent"))
    nodes = keep(nodes, "chat-nodes")
    *tables, last = _ancestors(nodes)  # the last one is empty, or holds those below a circle
    replied = nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    found = nodes.select("node").join(replied, "node", "left_anti").join(last.select("node"), "node", "left_anti")
    found = found.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(tables))):
        further = found.join(tables[k], "node").select("leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        found = keep(found.unionByName(further), f"chat-paths-{k}")
    return found


def branches(messages: DataFrame, best: int | None = None) -> DataFrame:
    """tree, leaf, rank, score, node, back of the ``best`` branches of each tree (None: all).

    ``messages``: (tree, node, parent, score). A branch's score is the sum of its messages'
    scores, null ones as 0; ties go to the smaller leaf. Messages of other trees are no parents.
    """
    owner = messages.select(F.col("node").alias("parent"), F.col("tree").alias("_tree"))
    nodes = messages.join(owner, "parent", "left")
    nodes = nodes.select("node", F.when(F.col("tree").eqNullSafe(F.col("_tree")), F.col("parent")).alias("parent"))
    found = paths(nodes)
    scored = found.join(messages.select("node", "tree", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "node")
    totals = scored.groupBy("leaf").agg(F.first("tree").alias("tree"), F.sum("score").alias("score"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    chosen = ranked if best is None else ranked.where(F.col("rank") <= best)
    return found.join(chosen, "leaf").select("tree", "leaf", "rank", "score", "node", "back")


def number_rows(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``node``, a unique number that rises with the order inside each tree, and ``parent``: the row before it there.

    Rows are sorted by ranges of (tree, order), and the numbers of a range begin where the
    one before it ends, so a tree of very many rows is sorted by many tasks.
    """
    by = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = keep(placed, "chat-rows")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each task
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("node", F.col("_from") + at)
    first = numbered.groupBy(tree).agg(F.min("node").alias("_first")).withColumnRenamed(tree, "_tree")
    numbered = numbered.join(first, F.col(tree).eqNullSafe(F.col("_tree")))
    return numbered.withColumn("parent", F.when(F.col("node") > F.col("_first"), F.col("node") - 1)).drop("_at", "_part", "_from", "_first", "_tree")


def format_branches(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """tree, leaf, rank, score, formatted, loss: one row a branch.

    ``chosen``: rows of ``branches``; ``messages``: (node, role, text), null ones as empty
    texts. ``loss`` holds the places (from 0) and lengths, in characters of ``formatted``,
    of the assistants' texts, in order.
    """
    body = messages.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN + HEAD), escape(F.col("role")), F.lit(TEXT))
    body = body.select("node", (F.col("role") == ASSISTANT).alias("_learn"), head.alias("_head"), escape(F.col("text")).alias("_body"))
    turns = chosen.join(body, "node")
    size = F.char_length("_head") + F.char_length("_body") + len(CLOSE)
    onward = Window.partitionBy("leaf").orderBy(F.desc("back"))
    before = F.coalesce(F.sum(size.cast("long")).over(onward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("_learn"), F.struct((before + F.char_length("_head")).alias("start"), F.char_length("_body").cast("long").alias("length")))
    turn = F.struct((-F.col("back")).alias("at"), F.concat("_head", "_body", F.lit(CLOSE)).alias("text"), F.col("_span").alias("span"))
    rows = turns.withColumn("_span", span).groupBy("leaf").agg(
        F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.first("score").alias("score"), F.sort_array(F.collect_list(turn)).alias("_turns")
    )
    return rows.select(
        "tree", "leaf", "rank", "score", F.array_join(F.transform("_turns", lambda t: t["text"]), "").alias("formatted"),
        F.filter(F.transform("_turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role and text of each) and ``loss_text`` (all text under the loss mask), out of formatted and loss."""
    parts = F.split("formatted", CLOSE, -1)
    parts = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.split(F.substr(p, F.lit(len(OPEN + HEAD) + 1)), r"\Q" + TEXT + r"\E", 2))
    turns = F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    learned = F.transform("loss", lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return formatted.withColumns({"turns": turns, "loss_text": unescape(F.array_join(learned, ""))})


def conversations(rows: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", score: str | None = None) -> DataFrame:
    """Formatted conversations of a table that holds plain ones: each row replies to the one before it.

    Rows are ordered by ``order``, null first, then role and text; repeated rows are turns of
    their own. Rows whose tree is null are one conversation. Other columns are not read.
    """
    score = F.lit(0.0) if score is None else F.col(score)
    rows = rows.select(F.col(tree).alias("tree"), F.col(order).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), score.alias("score"))
    messages = keep(number_rows(rows, "tree", ["turn", "role", "text"]), "chat-messages")
    chosen = branches(messages.select("tree", "node", "parent", "score"), best=1)
    return format_branches(chosen, messages.select("node", "role", "text")).withColumnRenamed("tree", tree)


def digest(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Counts and hashes of what formatted conversations give when they are read back."""
    rows = read_back(formatted)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        key, F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
