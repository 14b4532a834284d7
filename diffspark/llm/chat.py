"""Reply trees to conversations: root-to-leaf paths by doubling self-joins, ranked by score, formatted with a loss mask.

Only DataFrame functions are used.  The template of a turn is ``### `` role newline text ``</turn>`` newline.  Inside roles and texts
a backslash is written ``\\\\``, ``#`` is ``\\h`` and ``<`` is ``\\l`` (in roles a line end is ``\\n``), so neither control string can come
from a text, and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffspark.llm import storage

OPEN, CLOSE = "### ", "</turn>\n"


def escaped(text: Column) -> Column:
    """``text`` without control strings; a NULL text is empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, code in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`: cut at escaped backslashes first, so that each code is read where it stands."""

    def codes(part: Column) -> Column:
        for plain, code in (("#", "\\h"), ("<", "\\l"), ("\n", "\\n")):
            part = F.replace(part, F.lit(code), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), codes), "\\")


def turn_text(role: Column, text: Column) -> Column:
    """One formatted turn."""
    return F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escaped(text), F.lit(CLOSE))


def chain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as a reply tree in which every row answers the one before it: ``conv, node, parent, role, text, score``.

    Equal turns keep a row each, ordered by role and text.  A NULL turn comes first; NULL conversations are one conversation.
    Numbering sorts the rows of a conversation, which become one output row.
    """
    order = Window.partitionBy(conv_col).orderBy(turn_col, role_col, text_col)
    place = F.row_number().over(order).cast("long")
    return turns.select(
        F.col(conv_col).alias("conv"), place.alias("node"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    ).select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(tree: DataFrame) -> DataFrame:
    """``(conv, leaf, node, height)`` of every node on every root-to-leaf path; the leaf has height 0.

    Each round joins the paths so far with the ancestors 1, 2, 4, 8 ... steps up, so a path of n nodes takes log2 n rounds; every
    join key is a node, which is unique in its conversation, so no key is hot.  A parent that is absent counts as
    none.  A cycle of parents has no root and fails the job.
    """
    known = tree.select("conv", F.col("node").alias("parent"))
    on_parent = [known["conv"].eqNullSafe(tree["conv"]), known["parent"] == tree["parent"]]
    jump = storage.kept(tree.join(known, on_parent, "left_semi").select("conv", "node", F.col("parent").alias("up")), "jump")
    inner = jump.select("conv", F.col("up").alias("node")).distinct()
    leaves = tree.join(inner, [tree["conv"].eqNullSafe(inner["conv"]), tree["node"] == inner["node"]], "left_anti")
    found = storage.kept(leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height")), "paths")
    total, step = None, 1
    while jump.head(1):
        if total is None:
            total = tree.count()
        if step > 2 * total:
            raise ValueError("the replies of a conversation form a cycle")
        up = jump.select(F.col("conv").alias("c"), F.col("node").alias("from"), "up")
        reach = [found["conv"].eqNullSafe(up["c"]), found["node"] == up["from"]]
        more = found.join(up, reach).select("conv", "leaf", F.col("up").alias("node"), (F.col("height") + step).alias("height"))
        wider = storage.kept(found.union(more), "paths")
        twice = jump.join(up.withColumnRenamed("up", "upper"), [jump["conv"].eqNullSafe(up["c"]), jump["up"] == up["from"]])
        higher = storage.kept(twice.select("conv", "node", F.col("upper").alias("up")), "jump")
        storage.delete(found, jump)
        found, jump, step = wider, higher, 2 * step
    return found


def conversations(tree: DataFrame, branches: int | None = None, train_role: str = "assistant") -> DataFrame:
    """One formatted conversation per root-to-leaf path: ``conv, leaf, rank, score, n_turns, formatted, mask``.

    ``tree`` has ``conv, node, parent, role, text, score``, nodes unique in a conversation; other columns are ignored.  Paths are ranked in
    their conversation by mean score (NULL counts as 0), then by leaf; ``branches`` keeps the best ones only.  ``mask`` holds
    ``(start, length)`` in code points of each text of ``train_role`` in ``formatted``.  NULL text is empty.  No rows give no rows.
    """
    steps = paths(tree)
    rows = tree.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    said = steps.join(rows, [steps["conv"].eqNullSafe(rows["c"]), steps["node"] == rows["n"]])
    turn = turn_text(F.col("role"), F.col("text"))
    down = Window.partitionBy("conv", "leaf").orderBy(F.desc("height")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    trained = F.when(F.col("role") == train_role, F.char_length(escaped(F.col("text"))).cast("long"))
    parts = said.withColumns({"turn": turn, "trained": trained}).withColumn("end", F.sum(F.char_length("turn")).over(down))
    part = F.struct((-F.col("height")).alias("place"), "turn", "trained", "end")
    joined = parts.groupBy("conv", "leaf").agg(F.avg("score").alias("score"), F.sort_array(F.collect_list(part)).alias("parts"))
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "leaf"))
    ranked = joined.withColumn("rank", rank)
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    trained = F.filter("parts", lambda p: p["trained"].isNotNull())
    span = lambda p: F.struct((p["end"] - len(CLOSE) - p["trained"]).alias("start"), p["trained"].alias("length"))
    return ranked.select(
        "conv",
        "leaf",
        "rank",
        "score",
        F.size("parts").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: p["turn"]), "").alias("formatted"),
        F.transform(trained, span).alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted conversation."""
    whole = F.split(formatted, "</turn>\\n", -1)
    turns = F.slice(whole, 1, F.size(whole) - 1)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        return F.struct(
            unescaped(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
            unescaped(F.substr(part, F.char_length(head) + 2)).alias("text"),
        )

    return F.transform(turns, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
