"""Fold results: summary, oracle gap, text table, pass rule and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.constants import CROSS_DETECTOR, DETECTORS, IN_DOMAIN_TEST
from diffspark.operators.metrics import evaluate, nan
from diffspark.operators.ordered import require
from diffspark.operators.splits import fold_table


def evaluate_folds(
    scored: DataFrame,
    detectors: Sequence[str] = DETECTORS,
    bucket: str | None = CROSS_DETECTOR,
    blocks: int | None = None,
    fold_ids: Sequence[int] | None = None,
) -> DataFrame:
    """Metrics per fold over the rows of one bucket (``bucket=None``: per fold and evaluation bucket).

    Every fold of ``detectors`` has its row; without frames its metrics are NaN.
    """
    keys = ["fold_id", "test_detector"]
    folds = fold_table(scored.sparkSession, detectors, fold_ids).select(*keys)
    if bucket is None:
        both = F.array(F.lit(CROSS_DETECTOR), F.lit(IN_DOMAIN_TEST))
        evals = folds.withColumn("bucket", F.explode(both))
        rows = scored.where(F.col("bucket").isin(CROSS_DETECTOR, IN_DOMAIN_TEST))
        return evaluate(rows, [*keys, "bucket"], evals=evals, blocks=blocks)
    return evaluate(scored.where(F.col("bucket") == bucket), keys, evals=folds, blocks=blocks)


def fold_results(
    scored: DataFrame, detectors: Sequence[str] = DETECTORS, blocks: int | None = None, fold_ids: Sequence[int] | None = None
) -> DataFrame:
    """Per fold the metrics on held-out frames (``cross_*``) and on in-domain test frames (``in_domain_*``).

    Both buckets are ranked in one pass; a bucket without frames has NaN metrics, and every fold of ``detectors`` has its row.
    """
    metrics = evaluate_folds(scored, detectors, None, blocks, fold_ids)
    names = ("ap", "auc_roc", "f1", "threshold")
    sides = (("cross", CROSS_DETECTOR), ("in_domain", IN_DOMAIN_TEST))
    return metrics.groupBy("fold_id", "test_detector").agg(
        *[
            F.coalesce(F.max(F.when(F.col("bucket") == b, F.col(m))), nan()).alias(f"{side}_{m}")
            for side, b in sides
            for m in names
        ]
    )


def summarise_folds(results: DataFrame, by: Sequence[str] = (), ap: str = "ap") -> DataFrame:
    """Mean and sample standard deviation of the average precision (NaN for one fold); a NULL fold fails."""
    checked = results.where(require(F.col("fold_id"), "a result has no fold id").isNotNull())
    return checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg(ap).alias("mean_ap"),
        F.coalesce(F.stddev_samp(ap), nan()).alias("std_ap"),
    )


def one_result_per_fold(results: DataFrame, run: Sequence[str] = ("backbone", "seed"), latest: str = "file") -> DataFrame:
    """One result per run and fold, the last by ``latest``."""
    keys = [*run, "fold_id"]
    others = [c for c in results.columns if c not in keys]
    best = results.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(latest)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def missing_folds(results: DataFrame, detectors: Sequence[str] = DETECTORS) -> DataFrame:
    """Fold ids without a result."""
    folds = fold_table(results.sparkSession, detectors)
    return folds.join(results.select("fold_id").distinct(), "fold_id", "left_anti").select("fold_id")


def relative_gap(ap: Column, oracle: Column) -> Column:
    """``(oracle - ap) / oracle * 100``; NULL when the oracle is missing, NaN or not positive."""
    usable = oracle.isNotNull() & ~F.isnan(oracle) & (oracle > 0)
    return F.when(usable, (oracle - ap) / F.when(usable, oracle) * 100)


def oracle_gaps(results: DataFrame, oracle: DataFrame, on: str = "test_detector") -> DataFrame:
    """Results with ``oracle_ap`` of their detector and the relative gap in percent."""
    joined = results.join(oracle.select(on, "oracle_ap"), on, "left")
    return joined.withColumn("rel_gap", relative_gap(F.col("ap"), F.col("oracle_ap")))


def pass_rule(gaps: DataFrame, largest_gap: float, smallest_ap: float, folds: int = 4) -> DataFrame:
    """Whether every fold has a gap and an AP within bounds; passing folds are counted either way."""
    good = (
        F.col("rel_gap").isNotNull()
        & ~F.isnan("rel_gap")
        & ~F.isnan("ap")
        & (F.col("rel_gap") <= largest_gap)
        & (F.col("ap") >= smallest_ap)
    )
    good = F.coalesce(good, F.lit(False))
    return gaps.agg(
        F.count(F.lit(1)).alias("folds"),
        F.count_if(good).alias("folds_passing"),
        (F.coalesce(F.bool_and(good), F.lit(False)) & (F.count(F.lit(1)) == folds)).alias("passed"),
    )


def head_to_head(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("strict", "semi")) -> DataFrame:
    """Two variants' AP side by side per fold, with the difference second minus first."""
    a, b = (f"ap_{n}" for n in names)
    left = first.select("fold_id", F.col("ap").alias(a))
    right = second.select("fold_id", F.col("ap").alias(b))
    return left.join(right, "fold_id").withColumn("difference", F.col(b) - F.col(a))


def compare_baselines(scored: DataFrame, baselines: Sequence[str], keys: Sequence[str] = ("fold_id",), blocks=None) -> DataFrame:
    """AP per key with one column per baseline, from the union of the baselines' scored rows."""
    metrics = evaluate(scored, [*keys, "baseline"], blocks=blocks)
    return metrics.groupBy(*keys).pivot("baseline", list(baselines)).agg(F.first("ap"))


def _number(value: Column, width: int, digits: int) -> Column:
    return _right(F.when(F.isnan(value), "nan").otherwise(F.format_string(f"%.{digits}f", value)), width)


def _right(value: Column, width: int) -> Column:
    return F.when(F.length(value) >= width, value).otherwise(F.lpad(value, width, " "))


def _left(value: Column, width: int) -> Column:
    return F.when(F.length(value) >= width, value).otherwise(F.rpad(value, width, " "))


def results_table(
    results: DataFrame,
    summary: DataFrame,
    oracle: DataFrame | None = None,
    detectors: Sequence[str] = DETECTORS,
) -> DataFrame:
    """The printed results table as rows ``(line_no, line)``: header, rule, one line per fold, rule, mean.

    A fold without result shows its default detector and ``nan``.  ``results`` has one row per
    fold, at most one per detector; ``summary`` is one row of :func:`summarise_folds`.
    """
    spark = results.sparkSession
    header = f"{'Fold':<8} {'Detector':<15} {'AP':>8}"
    if oracle is not None:
        header += f"  {'Oracle AP':>10}  {'Rel. Gap':>9}"
    rule = "-" * len(header)
    folds = fold_table(spark, detectors).select("fold_id", F.col("test_detector").alias("detector"))
    folds = folds.join(results.select("fold_id", "test_detector", "ap"), "fold_id", "left")
    folds = folds.select(
        "fold_id", F.coalesce("test_detector", "detector").alias("test_detector"), F.coalesce("ap", nan()).alias("ap")
    )
    line = F.concat(
        _left(F.concat(F.lit("fold_"), F.col("fold_id").cast("string")), 8),
        F.lit(" "),
        _left(F.col("test_detector"), 15),
        F.lit(" "),
        _number(F.col("ap"), 8, 4),
    )
    if oracle is not None:
        folds = oracle_gaps(folds, oracle)
        has = F.col("rel_gap").isNotNull()
        line = F.concat(
            line,
            F.lit("  "),
            F.when(has, _number(F.col("oracle_ap"), 10, 4)).otherwise(F.lpad(F.lit("N/A"), 10, " ")),
            F.lit("  "),
            F.when(has, F.concat(_number(F.col("rel_gap"), 8, 1), F.lit("%"))).otherwise(F.lpad(F.lit("N/A"), 9, " ")),
        )
    body = folds.select((F.col("fold_id") + 2).alias("line_no"), line.alias("line"))
    last = len(detectors) + 3
    mean_part = F.concat(F.lit(f"{'Mean':<8} {'':<15} "), _number(F.col("mean_ap"), 8, 4))
    spread = F.when(F.isnan("std_ap"), "nan").otherwise(F.format_string("%.4f", F.col("std_ap")))
    if oracle is not None:
        mean_line = F.concat(mean_part, F.lit(f"  {'':>10}  "), _right(F.concat(F.lit("+/- "), spread), 9))
    else:
        mean_line = F.concat(mean_part, F.lit("  +/- "), spread)
    fixed = spark.createDataFrame([(1, header), (2, rule), (last, rule)], "line_no int, line string")
    mean = summary.select(F.lit(last + 1).alias("line_no"), mean_line.alias("line"))
    return fixed.unionByName(body).unionByName(mean).orderBy("line_no")
