"""One JSON document read by many tasks.

A file that is one object or one array is cut at its commas by Spark's text reader, wherever its splits fall.  Whether a comma stands
inside a string, and how deep, is known only from what comes before; so the quotes and the brackets of the pieces are summed along
the file, and pieces that belong to one element are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.operators.ordered import BLOCK, cut_blocks, require, running
from diffspark.session import checkpointed

_BRACKETS = {"object": ("{", "}"), "array": ("[", "]")}
# One character or escape of a string, and a string.
_INSIDE = r'(?:[^"\\]|\\.)*'


def _without_strings(text: Column, inside: Column) -> Column:
    """What of a piece lies outside strings; ``inside`` tells that it starts in one."""
    rest = F.when(inside, F.regexp_replace(text, rf'(?s)^{_INSIDE}("|$)', "")).otherwise(text)
    return F.regexp_replace(rest, rf'(?s)"{_INSIDE}("|$)', "")


def json_elements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(file, ordinal, text)`` of the elements of every file below ``path``, each one JSON ``kind``: ``object`` or ``array``.

    ``text`` is an element as it stands: ``"key": value`` of an object, a value of an array; ``ordinal`` is from 0.  A file without elements gives no
    row.  A document that does not open and close as it should, or has an empty element, fails the job; the elements themselves are not
    parsed here.  An element is held by one task, a document never is.
    """
    start, end = _BRACKETS[kind]
    pieces = spark.read.option("lineSep", ",").text(path)
    # Trimmed at both ends of the document only, so that a trailing line end is no piece of its own.
    told = pieces.select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_line"),
    )
    order = [F.col("_from").asc(), F.col("_line").asc()]
    quotes = F.char_length(F.regexp_replace("value", r'(?s)\\.|[^"\\]|\\$', ""))
    one = F.lit(1).cast("long")
    counted = running(
        cut_blocks(told, ["file"], order),
        ["file"],
        order,
        {"_before": ("sum", quotes), "_at": ("sum", one)},
        inclusive=False,
        totals={"_quotes": ("sum", quotes), "_pieces": ("sum", one)},
    )
    inside = F.col("_before") % 2 == 1
    outside = _without_strings(F.col("value"), inside)
    depth = F.regexp_count(outside, F.lit(r"[\[{]")) - F.regexp_count(outside, F.lit(r"[\]}]"))
    # Frozen here, so that the pieces are cut and looked through once.
    placed = checkpointed(counted.withColumns({"_inside": inside, "_change": depth.cast("long")}))
    deep = running(placed, ["file"], order, {"_depth": ("sum", F.col("_change"))}, inclusive=False, totals={"_open": ("sum", F.col("_change"))})
    first, last = F.col("_at") == 0, F.col("_at") == F.col("_pieces") - 1
    after = F.col("_depth") + F.col("_change")
    sound = (
        (F.col("_quotes") % 2 == 0)
        & (F.col("_open") == 0)
        & (last == (after == 0))
        & (first | (F.col("_depth") >= 1))
        & (~first | F.col("value").rlike(rf"^\s*\{start}"))
        & (~last | F.col("value").rlike(rf"\{end}\s*$"))
    )
    text = F.col("value")
    text = F.when(first, F.regexp_replace(text, rf"^\s*\{start}", "")).otherwise(text)
    text = F.when(last, F.regexp_replace(text, rf"\{end}\s*$", "")).otherwise(text)
    checked = require(F.when(sound, text), F.concat(F.lit(f"not one JSON {kind}: "), F.col("file")))
    begins = first | (~F.col("_inside") & (F.col("_depth") == 1))
    cut = deep.select("file", BLOCK, "_from", "_line", "_pieces", checked.alias("_text"), begins.cast("long").alias("_begins"))
    numbered = running(cut, ["file"], order, {"_element": ("sum", F.col("_begins"))}, totals={"_elements": ("sum", F.col("_begins"))})
    parts = F.array_sort(F.collect_list(F.struct("_from", "_line", "_text")))
    whole = numbered.groupBy("file", "_element").agg(parts.alias("_parts"), F.max("_elements").alias("_elements"))
    joined = F.array_join(F.transform("_parts", lambda p: p["_text"]), ",")
    found = whole.select("file", (F.col("_element") - 1).alias("ordinal"), F.trim(F.regexp_replace(joined, r"^\s+|\s+$", "")).alias("text"), "_elements")
    found = found.where("text != '' or _elements > 1")
    return found.withColumn("text", require(F.when(F.col("text") != "", F.col("text")), "an empty element in a JSON document")).drop("_elements")
