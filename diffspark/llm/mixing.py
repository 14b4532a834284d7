"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share a budget by weight; none gets more than ``max_epochs`` times its own size, and what it leaves is shared again by the
others.  A source's target is then so many complete epochs and a rest.  Every document is taken once for each complete epoch.  For the
rest each document draws the key ``-ln(u) / quality``: in order of these keys, the first documents are a sample without
replacement whose chances follow the quality weights.  A running sum of sizes along that order, inside the source, says which are taken
once more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.llm import storage
from diffspark.operators.ordered import cut_blocks, number_rows, running

#: Fixed value: a word is a run without space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
_SOURCE = ("_null", "_name")


def sampling_key(row_id: str | Column, quality: Column, seed: int) -> Column:
    """``-ln(u) / quality`` with ``u`` in (0, 1) from the first 52 bits of a digest of seed and id: reruns draw the same."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row_id) if isinstance(row_id, str) else row_id, F.lit(0)).cast("string")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / quality


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``(_null, _name, source_size, target)`` from ``(_null, _name, source_size)``, one row per source.

    Sources in order of their name by code point, NULL last, have the weights in turn.  In order of ``max_epochs * size / weight``, a
    source is capped if its share of what the sources before it leave is above its cap; so one running sum finds all that are capped.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    numbered = number_rows(sizes.withColumn("_one", F.lit(1)), ["_one"], [F.col("_null").asc(), F.col("_name").asc()], "_place")
    weighted = numbered.withColumn("_weight", F.get(cycle, F.pmod(F.col("_place") - 1, F.lit(len(weights))).cast("int")))
    weighted = weighted.withColumn("_cap", max_epochs * F.col("source_size"))
    order = [(F.col("_cap") / F.col("_weight")).asc(), F.col("_null").asc(), F.col("_name").asc()]
    blocked = cut_blocks(weighted, ["_one"], order)
    sums = {"_caps": ("sum", F.col("_cap")), "_weights": ("sum", F.col("_weight"))}
    totals = {"_all": ("sum", F.col("source_size")), "_all_weights": ("sum", F.col("_weight"))}
    placed = running(blocked, ["_one"], order, sums, inclusive=False, totals=totals)
    left = F.col("_all") - F.coalesce("_caps", F.lit(0))
    left_weights = F.col("_all_weights") - F.coalesce("_weights", F.lit(0.0))
    capped = storage.kept(placed.withColumn("_capped", left * F.col("_weight") > F.col("_cap") * left_weights), "sources")
    rest = capped.agg(
        F.sum("source_size").alias("_t"),
        F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))), F.lit(0)).alias("_c"),
        F.coalesce(F.sum(F.when(~F.col("_capped"), F.col("_weight"))), F.lit(0.0)).alias("_w"),
    )
    share = (F.col("_t") - F.col("_c")) * F.col("_weight") / F.col("_w")
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.least(share, F.col("_cap").cast("double")))
    # One row on the other side.
    return capped.join(F.broadcast(rest)).select(*_SOURCE, "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality_col: str | None = None,
    quality: DataFrame | None = None,
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 42,
) -> DataFrame:
    """``(id, source, size, source_size, target, epochs, taken)`` of every document.

    ``size`` is the number of words, ``taken`` the words the mix takes of the document, ``epochs`` how often it takes it.  The last
    document of a source's rest is taken if at least half of it fits, so a source misses its target by half a document at most.  A
    NULL text has no words and is never taken.  A NULL source is a source of its own.  A quality weight that is NULL counts as 1; one
    that is NaN or not above 0 is drawn after all others.  Rows that repeat an id draw the same key and follow each other by size; NULL ids are
    id 0 in the draw.  No rows give no rows.  Other columns are not read.
    Weights stand in ``quality_col`` or come as a table ``quality (id, weight)`` of distinct ids, which meets the documents when their
    texts have become sizes; a document that it does not name has weight 1.
    """
    own = F.lit(None) if quality_col is None else F.col(quality_col)
    told = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).isNull().cast("int").alias("_null"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_name"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        own.cast("double").alias("_quality"),
    )
    # Texts are read once; from here on a document is a few numbers.
    told = storage.kept(told, "sizes")
    if quality is not None:
        judged = quality.select(F.col("id").alias("_judged"), F.col("weight").cast("double").alias("_weight"))
        told = told.join(judged, F.col("_id") == F.col("_judged"), "left").withColumn("_quality", F.coalesce("_weight", "_quality"))
    chance = F.coalesce("_quality", F.lit(1.0))
    drawn = F.when((chance > 0) & ~F.isnan(chance), sampling_key("_id", chance, seed)).otherwise(F.lit(float("inf")))
    told = told.select("_id", *_SOURCE, "_size", drawn.alias("_key"))
    sizes = told.groupBy(*_SOURCE).agg(F.sum("_size").alias("source_size"))
    targets = storage.kept(source_targets(sizes, weights, max_epochs), "targets")
    order = [F.col("_key").asc(), F.col("_id").asc(), F.col("_size").asc()]
    placed = running(cut_blocks(told, _SOURCE, order), _SOURCE, order, {"_before": ("sum", F.col("_size"))}, inclusive=False)
    both = placed.withColumnsRenamed({k: f"{k}2" for k in _SOURCE}).join(
        targets, (F.col("_null2") == F.col("_null")) & (F.col("_name2") == F.col("_name"))
    )
    whole = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(max_epochs)).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    more = (2 * F.coalesce("_before", F.lit(0)) + F.col("_size") <= 2 * rest) & (F.col("_size") > 0) & (whole < max_epochs)
    epochs = whole + more.cast("long")
    return both.select(
        F.col("_id").alias("id"),
        F.when(F.col("_null") == 0, F.col("_name")).alias("source"),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        epochs.alias("epochs"),
        (epochs * F.col("_size")).alias("taken"),
    )
