"""Sinks and scans of frames, splits, fold results and epoch logs."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.functions.paths import run_parts
from diffspark.schemas import EPOCH_LOG, FOLD_RESULT, SPLIT, SPLIT_ARTIFACT


def write_frames(frames: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, one row per frame, partitioned by detector, cut into ranges of ``(path, frame_idx)`` and sorted in them.

    The ranges spread a large detector over many files and do not overlap, so a read of one frame opens one file.
    """
    (
        frames.repartitionByRange("detector", "path", "frame_idx")
        .sortWithinPartitions("detector", "path", "frame_idx")
        .write.mode(mode)
        .option("parquet.block.size", str(64 * 1024 * 1024))
        .option("compression", "gzip")
        .partitionBy("detector")
        .parquet(path)
    )


def read_frame_table(spark: SparkSession, path: str) -> DataFrame:
    """Frames written by :func:`write_frames`; filters on detector, path and frame_idx are pushed down."""
    return spark.read.parquet(path)


def pack_split(split: DataFrame) -> DataFrame:
    """Splits as artifact rows ``(fold, variant, test_detector, splits map)``, one per fold and variant.

    This is the exchange form of single-machine tools, which read a whole fold as one object; splits are stored as rows.
    """
    packed = split.groupBy("fold_id", "variant", "test_detector").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("session_id", "bucket")))).alias("splits")
    )
    return packed.select(F.col("fold_id").cast("int").alias("fold"), "variant", "test_detector", "splits")


def unpack_split(artifacts: DataFrame) -> DataFrame:
    """Artifact rows to one row per fold and session."""
    return artifacts.select(
        F.col("fold").alias("fold_id"), "variant", "test_detector", F.explode("splits").alias("session_id", "bucket")
    )


def write_split(split: DataFrame, path: str) -> None:
    """Splits as JSON rows ``(fold, variant, test_detector, session_id, bucket)`` below ``path``, at every size."""
    rows = split.select(F.col("fold_id").cast("int").alias("fold"), "variant", "test_detector", "session_id", "bucket")
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Splits written by :func:`write_split`, or a single ``.json`` file of one artifact object."""
    if path.endswith(".json"):
        return unpack_split(spark.read.schema(SPLIT_ARTIFACT).option("multiLine", "true").option("mode", "FAILFAST").json(path))
    return spark.read.schema(SPLIT).option("mode", "FAILFAST").json(path).withColumnRenamed("fold", "fold_id")


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fold results as JSON; NaN metrics are written as NaN."""
    results.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_results(spark: SparkSession, path: str, run_from_folder: bool = True) -> DataFrame:
    """Fold results from files of one JSON object each, with the run name taken from the folder.

    Files named ``.../<run>/results.json`` give ``run, backbone, seed``; the fold id is in the file.
    """
    rows = (
        spark.read.schema(FOLD_RESULT)
        .option("multiLine", "true")
        .option("allowNonNumericNumbers", "true")
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    if not run_from_folder:
        return rows
    run = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    parts = run_parts(run)
    return rows.withColumns({"run": run, "backbone": parts["backbone"], "seed": parts["seed"]})


def flat_results(results: DataFrame) -> DataFrame:
    """Nested fold results to columns ``ap, auc_roc, f1, threshold, in_domain_ap``."""
    others = [c for c in results.columns if c not in ("cross", "in_domain")]
    return results.select(
        *others,
        *[F.col(f"cross.{m}").alias(m) for m in ("ap", "auc_roc", "f1", "threshold")],
        F.col("in_domain.ap").alias("in_domain_ap"),
    )


def nested_results(flat: DataFrame) -> DataFrame:
    """Rows ``(fold_id, test_detector, bucket metrics...)`` to the nested result layout."""
    metrics = ("ap", "auc_roc", "f1", "threshold")
    block = lambda prefix: F.struct(*[F.col(f"{prefix}_{m}").alias(m) for m in metrics])
    return flat.select("fold_id", "test_detector", block("cross").alias("cross"), block("in_domain").alias("in_domain"))


def append_epochs(rows: DataFrame, path: str, attempt: str | None = None) -> None:
    """Append epoch rows to a log, once however often the write is repeated.

    An append has a name, ``attempt``; without one it is named by its rows, so that the same rows are never added twice.  The
    rows are written to a folder of their own, and a marker that names the folder is put in place in one step at the
    end; rows without a marker are not read.  An append whose name has a marker already adds nothing.
    """
    spark = rows.sparkSession
    told = rows.select([F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in EPOCH_LOG.split(", ")])
    if attempt is None:
        whole = told.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*told.columns)).alias("x"), F.sum(F.hash(*told.columns)).alias("s")).first()
        attempt = "-".join(str(v) for v in whole)
    name = hashlib.sha256(attempt.encode()).hexdigest()
    fs, at = _filesystem(spark, path)
    marker = at(f"{_COMMITS}/{name}")
    if fs.exists(marker):
        return
    folder = f"{name}-{uuid.uuid4().hex}"
    told.write.parquet(f"{path}/{_ROWS}/{folder}")
    staged = at(f"{_STAGED}/{folder}")
    out = fs.create(staged, False)
    out.write(bytearray(folder.encode()))
    out.close()
    fs.mkdirs(at(_COMMITS))
    if fs.exists(marker) or not fs.rename(staged, marker):
        # Another write of the same append was faster; its rows count.
        fs.delete(staged, False)
        fs.delete(at(f"{_ROWS}/{folder}"), True)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """An epoch log: the rows of all appends that were completed."""
    fs, at = _filesystem(spark, path)
    folders = []
    if fs.exists(at(_COMMITS)) and fs.listStatus(at(_COMMITS)):
        # One short line for each append.
        folders = [r["value"] for r in spark.read.text(f"{path}/{_COMMITS}").collect()]
    if not folders:
        return spark.createDataFrame([], EPOCH_LOG)
    return spark.read.schema(EPOCH_LOG).parquet(*[f"{path}/{_ROWS}/{f}" for f in sorted(folders)])


# Folders of a log; Spark leaves out what begins with an underscore when it reads the folder above.
_ROWS, _COMMITS, _STAGED = "appends", "commits", "_staged"


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: jvm.Path(root, name)
