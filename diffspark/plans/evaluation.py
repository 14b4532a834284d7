"""Leave-one-detector-out evaluation from a table of scored frames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.ml.functions import predict_batch_udf

from diffspark.constants import CROSS_DETECTOR, DETECTORS, IN_DOMAIN_TEST, SPLIT_RATIOS
from diffspark.functions.labels import hit_score
from diffspark.operators import benchmark, catalog, splits


def score_frames(
    tensors: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    input_shape: Sequence[int],
    batch_size: int = 64,
    pixels: str = "pixels",
) -> DataFrame:
    """Run a user's model over frame tensors: adds ``logits`` and ``y_score``.

    ``make_predict`` is called once per Python worker and returns a function from a batch of
    frames to a batch of logits (one or two per frame).
    """
    predict = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[list(input_shape)],
    )
    scored = tensors.withColumn("logits", predict(pixels))
    return scored.withColumn("y_score", hit_score(F.col("logits")))


def session_table(frames: DataFrame, detector: str, run: Sequence[str]) -> DataFrame:
    """Sessions of a frame table: ``detector, session_id, frame_count``."""
    named = frames.select(
        F.col(detector).alias("detector"), F.concat_ws("_", F.col(detector), *[F.col(r) for r in run]).alias("session_id")
    )
    return catalog.sessions(named, "detector", ("session_id",))


def fold_scores(
    scored: DataFrame,
    detectors: Sequence[str] = DETECTORS,
    ratios: Sequence[float] = SPLIT_RATIOS,
    sessions: DataFrame | None = None,
    fold_ids: Sequence[int] | None = None,
) -> DataFrame:
    """Scored frames ``(detector, session_id, ordinal, y_true, y_score)`` joined to the evaluation buckets.

    A frame takes part in its detector's fold and in the few folds where its session is an
    in-domain test session; the split is cut down to these buckets before the join.
    """
    table = sessions if sessions is not None else catalog.sessions(scored, "detector", ("session_id",))
    split = splits.session_split(table, detectors, ratios, fold_ids=fold_ids)
    return splits.frames_of_split(
        scored.drop("detector"), split, ("session_id",), (CROSS_DETECTOR, IN_DOMAIN_TEST)
    )


def lodo_results(
    scored: DataFrame, detectors: Sequence[str] = DETECTORS, ratios: Sequence[float] = SPLIT_RATIOS, **options
) -> DataFrame:
    """Per fold the cross-detector and in-domain metrics, all folds in one job."""
    blocks = options.pop("blocks", None)
    rows = fold_scores(scored, detectors, ratios, **options)
    return benchmark.fold_results(rows, detectors, blocks, options.get("fold_ids"))


def lodo_table(results: DataFrame, detectors: Sequence[str] = DETECTORS, oracle: DataFrame | None = None) -> DataFrame:
    """The printed table of :func:`lodo_results`."""
    flat = results.select("fold_id", "test_detector", F.col("cross_ap").alias("ap"))
    return benchmark.results_table(flat, benchmark.summarise_folds(flat), oracle, detectors)


def stored_table(results: DataFrame, detectors: Sequence[str] = DETECTORS, oracle: DataFrame | None = None) -> DataFrame:
    """The printed table of one run's stored fold results; a fold stored twice counts once."""
    once = benchmark.one_result_per_fold(results)
    return benchmark.results_table(once, benchmark.summarise_folds(once), oracle, detectors)


def aggregate_runs(results: DataFrame, detectors: Sequence[str] = DETECTORS) -> DataFrame:
    """Stored fold results of many runs: one per run and fold, then mean and deviation per run."""
    once = benchmark.one_result_per_fold(results)
    return benchmark.summarise_folds(once, ("backbone", "seed"))


def run_folds(results: DataFrame, detectors: Sequence[str] = DETECTORS) -> DataFrame:
    """Every fold of every stored run, with its metrics, or ``missing`` and NULL metrics.

    ``results`` has ``backbone, seed, fold_id, file`` and metric columns; a fold stored twice counts once, the last by ``file``.
    """
    keys = ["backbone", "seed", "fold_id"]
    once = benchmark.one_result_per_fold(results).drop("file", "test_detector")
    folds = splits.with_folds(once.select("backbone", "seed").distinct(), detectors)
    found = once.withColumn("_found", F.lit(True))
    return folds.join(found, keys, "left").withColumn("missing", F.col("_found").isNull()).drop("_found")


def concat_scores(parts: Iterable[DataFrame]) -> DataFrame:
    """Bag union of scored tables."""
    parts = list(parts)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
