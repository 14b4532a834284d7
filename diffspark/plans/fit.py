"""Per-fold fitting of a linear hit classifier with model choice on the validation bucket.

The classifier is ridge logistic regression on frame features; the candidates of the regularisation path take the place of
training epochs.  All folds and candidates are fitted in the same scans (see :mod:`diffspark.plans.logistic`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffspark.constants import CROSS_DETECTOR, IN_DOMAIN_TEST, TRAIN, VAL
from diffspark.operators.benchmark import fold_results
from diffspark.operators.metrics import best_f1
from diffspark.operators.splits import buckets_per_session
from diffspark.plans import logistic
from diffspark.session import checkpointed


_RESULT = (
    "fold_id", "test_detector", "cross_ap", "cross_auc_roc", "cross_f1", "cross_threshold", "in_domain_ap", "in_domain_auc_roc",
    "in_domain_f1", "in_domain_threshold", "reg_param", "val_f1", "backbone", "num_classes",
)


def fit_folds(
    frames: DataFrame,
    split: DataFrame,
    folds: Sequence[tuple[int, str]],
    session: Sequence[str] = ("session_id",),
    reg_params: Sequence[float] = (0.0, 0.1),
    max_iter: int = 20,
    features: str = "features",
    done: DataFrame | None = None,
    backbone: str = "logistic",
    num_classes: int = 2,
) -> DataFrame:
    """Fit every fold on ``train``, choose the candidate with the best F1 on ``val``, score both test buckets.

    ``frames`` is ``(session..., ordinal, label, features array)``, ``folds`` lists ``(fold_id,
    test_detector)``.  Folds in ``done`` (stored results of this function) are not fitted again: what comes back holds the
    stored and the new folds in one schema.  Stored results of another ``backbone`` or number of classes fail.  A fold
    without validation frames takes the first candidate, with ``val_f1`` NULL; one without training frames fails.  The frames are
    written once with their bucket in every fold.  The scans of that table are one for the moments, one for each step of the
    slowest candidate, one that scores all validation buckets and one that scores all test buckets, whatever the number of folds
    and candidates.
    """
    finished = set() if done is None else {r["fold_id"] for r in done.select("fold_id").distinct().collect()}
    open_folds = [f for f in folds if f[0] not in finished]
    if done is not None:
        check_same_run(done, backbone, num_classes)
    if not open_folds:
        return done.select(*_RESULT)
    buckets = [F.try_element_at("buckets", F.lit(i)) for i, _ in open_folds]
    rows = frames.select(*session, "ordinal", F.col("label").cast("double").alias("label"), F.col(features).cast("array<double>").alias("features"))
    rows = rows.join(buckets_per_session(split, session), list(session))
    code = F.array(*[_bucket_code(b) for b in buckets])
    rows = checkpointed(rows.select("ordinal", "label", "features", code.alias("buckets")))

    slots = [(i, reg) for i in range(len(open_folds)) for reg in reg_params]
    train = rows.withColumn("masks", F.transform("buckets", lambda b: (b == _CODES.index(TRAIN)).cast("int")))
    models = logistic.fit(train, [logistic.Slot(i, reg) for i, reg in slots], len(open_folds), max_iter)

    val_scores = _scores(rows, models, open_folds, slots, range(len(slots)), (VAL,))
    # At most one row per fold and candidate.
    found = best_f1(val_scores, ["fold_id", "reg_param"]).collect()
    f1 = {(r["fold_id"], r["reg_param"]): r["f1"] for r in found}
    picked = {}
    for i, fold in enumerate(open_folds):
        reg = max(reg_params, key=lambda reg: (f1.get((fold[0], float(reg)), -1.0), -reg_params.index(reg)))
        picked[fold] = slots.index((i, reg))

    scored = _scores(rows, models, open_folds, slots, list(picked.values()), (CROSS_DETECTOR, IN_DOMAIN_TEST))
    detectors = {i: d for i, d in folds}
    named = [detectors.get(i, "") for i in range(1, max(detectors) + 1)]
    results = fold_results(scored, named, fold_ids=[i for i, _ in open_folds])
    # One row for each fold, from the driver's own loop.
    chosen = [(f[0], float(slots[k][1]), f1.get((f[0], float(slots[k][1])))) for f, k in picked.items()]
    validated = results.sparkSession.createDataFrame(chosen, "fold_id int, reg_param double, val_f1 double")
    new = results.join(validated, "fold_id", "left")
    new = new.withColumns({"backbone": F.lit(backbone), "num_classes": F.lit(num_classes)}).select(*_RESULT)
    return new if done is None else done.select(*_RESULT).unionByName(new)


_CODES = ("", TRAIN, VAL, CROSS_DETECTOR, IN_DOMAIN_TEST)


def _bucket_code(bucket):
    code = F.lit(0)
    for i, name in enumerate(_CODES[1:], 1):
        code = F.when(bucket == name, i).otherwise(code)
    return code


def _scores(rows: DataFrame, models, folds, slots, chosen: Sequence[int], wanted: Sequence[str]) -> DataFrame:
    """Scores of the chosen slots for the rows that their fold has in the wanted buckets, in one scan."""
    of = [slots[k][0] for k in chosen]
    regs = [float(slots[k][1]) for k in chosen]
    picked = logistic.Models(models.weights[:, list(chosen)], models.intercepts[list(chosen)], 0)
    codes = [_CODES.index(w) for w in wanted]
    ids, detectors, count = [f[0] for f in folds], [f[1] for f in folds], len(folds)

    def run(batches):
        for x, (ordinal, label, bucket) in logistic.matrices(batches, 2, 0, 1, 3):
            p = picked.probabilities(x)
            own = logistic.flags(bucket, count)[:, of]
            at, slot = np.nonzero(np.isin(own, codes))
            place = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[of[s]] for s in slot], pa.int32()),
                    pa.array([detectors[of[s]] for s in slot], pa.string()),
                    pa.array([_CODES[c] for c in own[at, slot]], pa.string()),
                    ordinal.take(place),
                    label.take(place).cast(pa.int32()),
                    pa.array(p[at, slot]),
                    pa.array([regs[s] for s in slot], pa.float64()),
                ],
                ["fold_id", "test_detector", "bucket", "ordinal", "y_true", "y_score", "reg_param"],
            )

    kind = rows.schema["ordinal"].dataType.simpleString()
    schema = f"fold_id int, test_detector string, bucket string, ordinal {kind}, y_true int, y_score double, reg_param double"
    return rows.select("ordinal", "label", "features", "buckets").mapInArrow(run, schema)


def check_same_run(stored: DataFrame, backbone: str, num_classes: int) -> None:
    """Fail when stored results were made with other parameters (reads one row)."""
    other = stored.where((F.col("backbone") != backbone) | (F.col("num_classes") != num_classes)).first()
    if other is not None:
        raise RuntimeError(
            f"stored results of {other['backbone']} with {other['num_classes']} classes do not match "
            f"{backbone} with {num_classes}"
        )
