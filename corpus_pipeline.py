"""Cleaning of a training corpus: line-first quality rules, line dedup, near-duplicate documents, benchmark decontamination, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes it as Parquet to the shared folder and gives what
it reads back to the next one.  All stages but the last return the columns of ``documents``.

Whatever the stage, a NULL text counts as empty, a NULL or repeated ``doc_id`` stays a row of its own unless a stage says otherwise, other
columns (NULL or not, whatever their names) pass through, no rows give no rows, and a text is read as a whole by one task however long
it is.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.llm import bpe, decontaminate, line_dedup, ngram_join, quality, storage

VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail.  A text without words fails."""
    return quality.keep_clean(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in an earlier one or earlier in the same; those left without words go.

    Earlier is by id, NULL first, then by line; ids must be unique, because lines are cut by id.  A document that had no line with words stays."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest id; of rows that repeat its id, all.

    A text without words is like no other and stays, and so does every row with a NULL id."""
    components = ngram_join.jaccard_components(docs).where("id = component_id or id is null").select("id").distinct()
    kept = components.select(F.col("id").alias(line_dedup.fresh(docs, "_kept")))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[kept.columns[0]]), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold half of a test item.  Rows with the id of one that does go with it, also where that id is NULL."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(docs, benchmark).select(F.col("doc_id").alias(line_dedup.fresh(docs, "_found"))).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found[found.columns[0]]), "left_anti")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of each row; a text without words has no ids and decodes to nothing."""
    coded = bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe_tokens),
]

#: Banded MinHash, string tiling and BPE are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = storage.kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
