"""Files of frames, text lists and label maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.operators.ordered import number_rows
from diffspark.sources.json_elements import json_elements


def discover(spark: SparkSession, folder: str, pattern: str, on_empty: str = "error") -> DataFrame:
    """Files of a folder matching a glob, sorted by path: ``(path, length)``.

    Only the listing is used; the content column of the binary source is pruned away.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "length")
        .orderBy("path")
    )
    if on_empty == "error" and files.isEmpty():
        raise FileNotFoundError(f"no {pattern} files found in {folder}")
    return files


def discover_detectors(spark: SparkSession, folders: dict[str, str], pattern: str) -> DataFrame:
    """Files of every detector's folder: ``(detector, path, length)``; an empty folder adds nothing."""
    parts = [
        discover(spark, folder, pattern, on_empty="empty").select(F.lit(name).alias("detector"), "path", "length")
        for name, folder in folders.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def list_entries(texts: DataFrame, keys: Sequence[str], text: str = "value") -> DataFrame:
    """Lines of a text column, trimmed, blank ones dropped: ``(keys..., ordinal, path)``."""
    lines = texts.select(*keys, F.posexplode(F.split(text, "\n")).alias("ordinal", "_line"))
    trimmed = F.regexp_replace("_line", r"^\s+|\s+$", "")
    return lines.select(*keys, "ordinal", trimmed.alias("path")).where(F.col("path") != "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with a total order ``(file, block_start, line_in_task)``.

    A file may be read by many tasks.  The start of the file block and the running id inside the
    task give the order of the lines without bringing a file into one task.
    """
    return spark.read.text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_in_task"),
    )


def read_split_list(spark: SparkSession, path: str) -> DataFrame:
    """A list file, one path per line: ``(ordinal, path)`` from 0, blank lines ignored."""
    lines = read_lines(spark, path).withColumn("path", F.regexp_replace("value", r"^\s+|\s+$", ""))
    order = [F.col("file"), F.col("block_start"), F.col("line_in_task")]
    numbered = number_rows(lines.where(F.col("path") != ""), [], order, "ordinal")
    return numbered.select((F.col("ordinal") - 1).alias("ordinal"), "path")


def label_map_entries(texts: DataFrame, text: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """JSON objects ``{path: label}`` to rows ``(keys..., path, label)``; a malformed object or label fails the job."""
    parsed = F.from_json(text, "map<string,int>", {"mode": "FAILFAST"})
    return texts.select(*keys, F.explode(parsed).alias("path", "label"))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """A label file holding one JSON object, however it is laid out, read by as many tasks as it has splits."""
    entries = json_elements(spark, path, "object")
    return label_map_entries(entries.select(F.concat(F.lit("{"), "text", F.lit("}")).alias("value")))


def split_sets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Several list files as one table ``(bucket, ordinal, path)``."""
    parts = [read_split_list(spark, p).select(F.lit(name).alias("bucket"), "ordinal", "path") for name, p in paths.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
