"""Ranking metrics per evaluation: average precision, ROC-AUC, best F1, curves, confusion counts.

Input rows are ``(keys..., ordinal, y_true 0/1, y_score)``.  Rules kept exactly:

* average precision breaks equal scores by *descending* ordinal (``ties="position"``) or takes a
  whole group of equal scores at once (``ties="group"``); no positives give 0.0
* ROC-AUC ranks positives first among equal scores; one class only gives 0.5
* best F1 predicts ``score >= threshold`` and keeps the lowest threshold among equal F1 values;
  no positives give ``(0.0, NaN)``
* a NaN score ranks first for average precision and last for ROC-AUC, and is never predicted
* an evaluation without rows has NaN in every metric (see ``evals``)
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffspark.operators.ordered import BLOCK, cut_blocks, require, running

def nan() -> Column:
    return F.lit(float("nan"))


def _ratio(numerator: Column, denominator: Column) -> Column:
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def _rank_values(count: Column, positives: Column, score: str) -> tuple[dict, dict]:
    values = {"tp": ("sum", positives), "seen": ("sum", count)}
    is_nan = F.isnan(score)
    totals = {
        "n_pos": ("sum", positives),
        "n_all": ("sum", count),
        "nan_pos": ("sum", F.when(is_nan, positives).otherwise(0)),
        "nan_all": ("sum", F.when(is_nan, count).otherwise(0)),
    }
    return values, totals


def _ranked(scored, keys, y, score, ordinal, blocks, **more) -> DataFrame:
    rows = scored.select(
        *keys,
        F.col(ordinal),
        F.col(y).cast("long").alias(y),
        require(F.col(score).cast("double"), "a score is NULL").alias(score),
    )
    order = [F.col(score).desc(), F.col(ordinal).desc()]
    values, totals = _rank_values(F.lit(1).cast("long"), F.col(y), score)
    return running(cut_blocks(rows, keys, order, blocks), keys, order, values, totals=totals, **more)


def rank_rows(
    scored: DataFrame,
    keys: Sequence[str],
    y: str = "y_true",
    score: str = "y_score",
    ordinal: str = "ordinal",
    blocks: int | None = None,
) -> DataFrame:
    """Per row: ``tp`` and ``seen`` down the ranking (score desc, ordinal desc) and the key totals."""
    return _ranked(scored, keys, y, score, ordinal, blocks).drop(BLOCK)


def score_cells(
    scored: DataFrame, keys: Sequence[str], y: str = "y_true", score: str = "y_score"
) -> DataFrame:
    """Distinct scores with row and positive counts; combined map-side, so heavy ties are cheap."""
    value = require(F.col(score).cast("double"), "a score is NULL")
    return scored.groupBy(*keys, value.alias(score)).agg(
        F.count(F.lit(1)).alias("cell_all"), F.sum(F.col(y).cast("long")).alias("cell_pos")
    )


_TOTALS = ("n_pos", "n_all", "nan_pos", "nan_all")


def _auc_part(score: str) -> Column:
    """Negatives of a cell times the positives at or above it (a NaN cell comes last)."""
    above = F.when(F.isnan(score), F.col("n_pos")).otherwise(F.col("tp") - F.col("nan_pos"))
    return (F.col("cell_all") - F.col("cell_pos")).cast("double") * above.cast("double")


def _f1_candidate(score: str) -> Column:
    """``(f1, -score, tp, predicted)`` of a threshold, NULL when it predicts no positive."""
    hits = F.col("tp") - F.col("nan_pos")
    predicted = F.col("seen") - F.col("nan_all")
    precision, recall = _ratio(hits, predicted), _ratio(hits, F.col("n_pos"))
    f1 = 2 * precision * recall / (precision + recall)
    whole = F.struct(f1.alias("f1"), (-F.col(score)).alias("low"), hits.alias("tp"), predicted.alias("predicted"))
    return F.when(~F.isnan(score) & (hits > 0), whole)


def _summarise_cells(scored, keys, y, score, blocks) -> DataFrame:
    """Metrics with whole groups of equal scores as the unit: cells first, then the ranking."""
    cells = score_cells(scored, keys, y, score)
    order = [F.col(score).desc()]
    values, totals = _rank_values(F.col("cell_all"), F.col("cell_pos"), score)
    ranked = running(cut_blocks(cells, keys, order, blocks), keys, order, values, totals=totals)
    return _finish(
        ranked.groupBy(*keys).agg(
            F.sum(F.col("cell_pos") * _ratio(F.col("tp"), F.col("seen"))).alias("_ap"),
            F.sum(_auc_part(score)).alias("_auc"),
            F.max(_f1_candidate(score)).alias("_best"),
            F.min(F.when(~F.isnan(score), F.col(score))).alias("_lowest"),
            *[F.max(c).alias(c) for c in _TOTALS],
        ),
        keys,
    )


_BEST = ("f1", "low", "best_tp", "predicted")


def _block_sums(keys: Sequence[str], y: str, score: str):
    """What a block adds to the metrics of its keys: one row for the inner runs of a key, one for each run at an edge.

    Rows of equal score are a run, whose last row speaks for all of it.  Only a block's first and last run of a key can go on in
    a neighbouring block; they are passed on with their score.
    """

    def sums(column: dict[str, pa.Array], starts: np.ndarray) -> pa.Table:
        got = {n: column[n].to_numpy(zero_copy_only=False) for n in (y, score, "tp", "seen", "_before_tp", "_before_seen", "_run_end", "_edge", *_TOTALS)}
        n = len(got[score])
        # A key's rows fall into stretches: a run at an edge is one, all its inner runs are another.
        fresh = np.zeros(n, bool)
        fresh[starts] = True
        ends = got["_run_end"].astype(bool)
        edge = got["_edge"].astype(bool)
        fresh[1:] |= (edge[1:] != edge[:-1]) | (edge[1:] & ends[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], n) - 1

        def total(values):
            return np.add.reduceat(values, first)

        with np.errstate(invalid="ignore", divide="ignore"):
            ap = np.where(got[y] == 1, got["tp"] / got["seen"], 0.0)
            nan = np.isnan(got[score])
            hits, predicted = got["tp"] - got["nan_pos"], got["seen"] - got["nan_all"]
            cell_all, cell_pos = (np.where(ends, got[a] - got[b], 0) for a, b in (("seen", "_before_seen"), ("tp", "_before_tp")))
            above = np.where(nan, got["n_pos"], hits).astype(np.float64)
            auc = np.where(ends & ~edge, (cell_all - cell_pos).astype(np.float64) * above, 0.0)
            precision, recall = hits / predicted, hits / got["n_pos"]
            f1 = np.where(ends & ~edge & ~nan & (hits > 0), 2 * precision * recall / (precision + recall), -1.0)
        # The highest F1 of a stretch; of equal ones the lowest threshold, which stands last.
        top = np.maximum.reduceat(f1, first)
        stretch = np.repeat(np.arange(len(first)), last - first + 1)
        best = np.maximum.reduceat(np.where(f1 == top[stretch], np.arange(n), -1), first)
        some = top >= 0
        lowest = np.minimum.reduceat(np.where(nan, np.inf, got[score]), first)
        place = pa.array(first)
        missing = lambda values, there, kind: pa.array(values, kind, mask=~there)
        at_edge = edge[first]
        return pa.Table.from_arrays(
            [
                *[column[k].take(place) for k in keys],
                missing(got[score][last], at_edge, pa.float64()),
                pa.array(total(ap)),
                pa.array(total(auc)),
                missing(top, some, pa.float64()),
                missing(-got[score][best], some, pa.float64()),
                missing(hits[best], some, pa.int64()),
                missing(predicted[best], some, pa.int64()),
                missing(lowest, np.isfinite(lowest) | (lowest < 0), pa.float64()),
                pa.array(total(cell_all)),
                pa.array(total(cell_pos)),
                *[pa.array(got[c][last]) for c in ("tp", "seen", *_TOTALS)],
            ],
            [*keys, "_edge_score", "_ap", "_auc", *_BEST, "_lowest", "cell_all", "cell_pos", "tp", "seen", *_TOTALS],
        )

    return sums


def _summarise_rows(scored, keys, y, score, ordinal, blocks) -> DataFrame:
    """Metrics with the row order inside equal scores.

    A block hands on a few sums for each key; runs of equal scores at the edges of blocks are first put together by score.
    """
    doubles = ("_edge_score", "_ap", "_auc", "f1", "low", "_lowest")
    longs = ("best_tp", "predicted", "cell_all", "cell_pos", "tp", "seen", *_TOTALS)
    order = ["_edge_score", "_ap", "_auc", *_BEST, "_lowest", "cell_all", "cell_pos", "tp", "seen", *_TOTALS]
    kinds = {**dict.fromkeys(doubles, T.DoubleType()), **dict.fromkeys(longs, T.LongType())}
    schema = T.StructType([*[scored.select(k).schema[0] for k in keys], *[T.StructField(c, kinds[c]) for c in order]])
    sums = _ranked(scored, keys, y, score, ordinal, blocks, runs_of=score, reduce=(_block_sums(list(keys), y, score), schema))
    best = F.when(F.col("f1").isNotNull(), F.struct("f1", "low", F.col("best_tp").alias("tp"), "predicted"))
    merged = sums.groupBy(*keys, "_edge_score").agg(
        *[F.sum(c).alias(c) for c in ("_ap", "_auc", "cell_all", "cell_pos")],
        F.max(best).alias("_best"),
        F.min("_lowest").alias("_lowest"),
        *[F.max(c).alias(c) for c in ("tp", "seen", *_TOTALS)],
    )
    edge = F.col("_edge_score").isNotNull()
    return _finish(
        merged.groupBy(*keys).agg(
            F.sum("_ap").alias("_ap"),
            F.sum(F.when(edge, _auc_part("_edge_score")).otherwise(F.col("_auc"))).alias("_auc"),
            F.max(F.when(edge, _f1_candidate("_edge_score")).otherwise(F.col("_best"))).alias("_best"),
            F.min("_lowest").alias("_lowest"),
            *[F.max(c).alias(c) for c in _TOTALS],
        ),
        keys,
    )


def _finish(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key from its sums, with the counts predicted at the chosen threshold."""
    n = F.col("n_all")
    pos, neg = F.col("n_pos").cast("double"), (n - F.col("n_pos")).cast("double")
    none = F.col("n_pos") == 0
    threshold = F.coalesce(-F.col("_best.low") + F.lit(0.0), F.col("_lowest"), nan())
    return raw.select(
        *keys,
        n.alias("n"),
        "n_pos",
        F.when(none, 0.0).otherwise(F.coalesce("_ap", F.lit(0.0)) / F.nullif(pos, F.lit(0.0))).alias("ap"),
        F.when(none | (neg == 0), 0.5).otherwise(F.col("_auc") / F.nullif(pos * neg, F.lit(0.0))).alias("auc_roc"),
        F.when(none, 0.0).otherwise(F.coalesce("_best.f1", F.lit(0.0))).alias("f1"),
        F.when(none, nan()).otherwise(threshold).alias("threshold"),
        F.coalesce("_best.tp", F.lit(0)).alias("tp"),
        F.when(none, 0).otherwise(F.coalesce("_best.predicted", n - F.col("nan_all"))).alias("predicted"),
    )


def evaluate(
    scored: DataFrame,
    keys: Sequence[str],
    y: str = "y_true",
    score: str = "y_score",
    ordinal: str = "ordinal",
    ties: str = "position",
    evals: DataFrame | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """``n, n_pos, ap, auc_roc, f1, threshold`` per key in one ranking pass.

    ``evals`` lists keys that must appear even when they have no rows.
    """
    if ties == "position":
        result = _summarise_rows(scored, keys, y, score, ordinal, blocks)
    elif ties == "group":
        result = _summarise_cells(scored, keys, y, score, blocks)
    else:
        raise ValueError("ties must be 'position' or 'group'")
    result = result.drop("tp", "predicted")
    if evals is None:
        return result
    filled = evals.select(*keys).distinct().join(result, list(keys), "left")
    metrics = ("ap", "auc_roc", "f1", "threshold")
    return filled.select(
        *keys,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_pos")],
        *[F.when(F.col("n").isNull(), nan()).otherwise(F.col(c)).alias(c) for c in metrics],
    )


def average_precision(scored, keys, ties="position", blocks=None, **columns) -> DataFrame:
    """``ap`` per key."""
    return evaluate(scored, keys, ties=ties, blocks=blocks, **columns).select(*keys, "ap")


def auc_roc(scored, keys, y="y_true", score="y_score", blocks=None) -> DataFrame:
    """``auc_roc`` per key; needs no ordinal, so only distinct scores are ranked."""
    return _summarise_cells(scored, keys, y, score, blocks).select(*keys, "auc_roc")


def best_f1(scored, keys, y="y_true", score="y_score", blocks=None) -> DataFrame:
    """``f1`` and ``threshold`` per key; needs no ordinal, so only distinct scores are ranked."""
    return _summarise_cells(scored, keys, y, score, blocks).select(*keys, "f1", "threshold")


def pr_curve(scored, keys, y="y_true", score="y_score", ordinal="ordinal", blocks=None) -> DataFrame:
    """Row by row: rank, tp, precision, recall and the recall step of the row."""
    ranked = rank_rows(scored, keys, y, score, ordinal, blocks)
    recall = F.coalesce(_ratio(F.col("tp"), F.col("n_pos")), F.lit(0.0))
    earlier = F.coalesce(_ratio(F.col("tp") - F.col(y), F.col("n_pos")), F.lit(0.0))
    return ranked.select(
        *keys,
        ordinal,
        F.col("seen").alias("rank"),
        "tp",
        _ratio(F.col("tp"), F.col("seen")).alias("precision"),
        recall.alias("recall"),
        (recall - earlier).alias("recall_step"),
    )


def roc_curve(scored, keys, y="y_true", score="y_score", ordinal="ordinal", blocks=None) -> DataFrame:
    """Row by row ``tpr, fpr`` with positives first among equal scores, plus the (0, 0) start row."""
    rows = scored.select(
        *keys, F.col(ordinal), F.col(y).cast("long").alias(y), F.col(score).cast("double").alias(score)
    )
    order = [F.isnan(score).asc(), F.col(score).desc(), F.col(y).desc(), F.col(ordinal).asc()]
    one = F.lit(1).cast("long")
    totals = {"n_pos": ("sum", F.col(y)), "n_all": ("sum", one)}
    values = {"tp": ("sum", F.col(y)), "step": ("sum", one)}
    ranked = running(cut_blocks(rows, keys, order, blocks), keys, order, values, totals=totals)
    points = ranked.select(
        *keys,
        "step",
        F.coalesce(_ratio(F.col("tp"), F.col("n_pos")), F.lit(0.0)).alias("tpr"),
        F.coalesce(_ratio(F.col("step") - F.col("tp"), F.col("n_all") - F.col("n_pos")), F.lit(0.0)).alias("fpr"),
    )
    start = scored.select(*keys).distinct().select(
        *keys, F.lit(0).cast("long").alias("step"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")
    )
    return points.unionByName(start)


def confusion(scored: DataFrame, keys: Sequence[str], threshold: Column, y="y_true", score="y_score") -> DataFrame:
    """``tp fp fn tn`` at a threshold with precision and recall (0.0 on an empty denominator)."""
    predicted = (F.col(score) >= threshold) & ~F.isnan(score)
    hit = F.col(y) == 1
    counts = scored.groupBy(*keys).agg(
        F.count_if(predicted & hit).alias("tp"),
        F.count_if(predicted & ~hit).alias("fp"),
        F.count_if(~predicted & hit).alias("fn"),
        F.count_if(~predicted & ~hit).alias("tn"),
    )
    return counts.withColumns(
        {
            "precision": F.coalesce(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)),
            "recall": F.coalesce(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)),
        }
    )


def evaluation_report(
    scored: DataFrame, keys: Sequence[str], y="y_true", score="y_score", ordinal="ordinal", blocks=None
) -> DataFrame:
    """Counts, hit rate, metrics, and the confusion counts at the best-F1 threshold, one row per key.

    The confusion counts ride along with the winning F1 candidate, so the scored rows are ranked once.
    """
    metrics = _summarise_rows(scored, keys, y, score, ordinal, blocks)
    fp = F.col("predicted") - F.col("tp")
    return metrics.select(
        *keys,
        "n",
        F.col("n_pos").alias("hits"),
        (F.col("n") - F.col("n_pos")).alias("non_hits"),
        _ratio(F.col("n_pos"), F.col("n")).alias("hit_rate"),
        "ap",
        "auc_roc",
        "f1",
        "threshold",
        "tp",
        fp.alias("fp"),
        (F.col("n_pos") - F.col("tp")).alias("fn"),
        (F.col("n") - F.col("n_pos") - fp).alias("tn"),
        F.coalesce(_ratio(F.col("tp"), F.col("predicted")), F.lit(0.0)).alias("precision"),
        F.coalesce(_ratio(F.col("tp"), F.col("n_pos")), F.lit(0.0)).alias("recall"),
    )
