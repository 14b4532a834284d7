"""Epoch logs, early stopping and per-fold fitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from diffspark.operators import splits, trainlog
from diffspark.plans import fit, loaders
from registry.common import FRAMES_SQL, images, metric_ctes, q6, rounded, table
from registry.splits import FOLDS_SQL, SPLIT_SQL

QUERIES = {}
ORACLES = {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


ORDER = ("ts", "event_id")


def _log(spark, d):
    """Events as epoch logs: one run per user in time order, the value as validation F1."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("run"), "ts", "event_id", (F.col("value") / 500.0).alias("val_f1")
    )


_EPOCHS = """e AS (
  SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position,
    value / CAST(500 AS DOUBLE) AS v FROM events
)"""

# One run after another would be a loop; SQL walks all runs together, one epoch per step.
_WALK = """WITH RECURSIVE {epochs}, walk AS (
  SELECT run, position, v AS best, position AS best_at, CAST(0 AS BIGINT) AS waited FROM e WHERE position = 1
  UNION ALL
  SELECT e.run, e.position, CASE WHEN e.v > walk.best + {delta} THEN e.v ELSE walk.best END,
    CASE WHEN e.v > walk.best + {delta} THEN e.position ELSE walk.best_at END,
    CASE WHEN e.v > walk.best + {delta} THEN 0 ELSE walk.waited + 1 END
  FROM walk JOIN e ON e.run = walk.run AND e.position = walk.position + 1 WHERE walk.waited < {patience}
), ends AS (SELECT run, max(position) AS position FROM walk GROUP BY run)
SELECT run, position AS last_epoch, waited >= {patience} AS stopped_early, best_at AS best_epoch, {best} AS best_value
FROM walk JOIN ends USING (run, position)"""


def _walk(delta, patience):
    return _WALK.format(epochs=_EPOCHS, delta=f"CAST('{delta}' AS DOUBLE)", patience=patience, best=q6("best"))


def _stop(spark, d, patience, delta=0.0):
    done = trainlog.early_stopping(_log(spark, d), ["run"], [F.col(c) for c in ORDER], "val_f1", patience, delta)
    return rounded(done, "best_value")


@query(_walk(0, 5))
def early_stop(spark, d):
    return _stop(spark, d, 5)


@query(_walk(0, 1000))
def best_epoch(spark, d):
    return _stop(spark, d, 1000)


@query(_walk("0.02", 8))
def early_stop_min_delta(spark, d):
    return _stop(spark, d, 8, 0.02)


@query(
    f"""WITH {_EPOCHS}, b AS (SELECT *, coalesce(max(v) OVER (PARTITION BY run ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM e),
i AS (SELECT *, v > before AS improved FROM b),
w AS (SELECT *, position - coalesce(max(CASE WHEN improved THEN position END) OVER (PARTITION BY run ORDER BY position), 0) AS no_improve FROM i),
s AS (SELECT run, min(position) AS stop FROM w WHERE no_improve >= 5 GROUP BY run)
SELECT w.run, event_id, position, improved, no_improve, stop IS NULL OR position <= stop AS kept FROM w LEFT JOIN s ON w.run = s.run"""
)
def improvement_marks(spark, d):
    marked = trainlog.mark_improvements(_log(spark, d), ["run"], [F.col(c) for c in ORDER], "val_f1", 5)
    return marked.select("run", "event_id", "position", "improved", "no_improve", "kept")


@query(f"SELECT event_type, {q6('sum(value * (event_id % 5)) / greatest(sum(event_id % 5), 1)')} AS loss FROM events GROUP BY event_type")
def weighted_loss(spark, d):
    batches = table(spark, d, "events").select("event_type", F.col("value").alias("loss"), (F.col("event_id") % 5).alias("n"))
    return rounded(trainlog.weighted_loss(batches, ["event_type"]), "loss")


_GROUPS = ("g0", "g1", "g2", "g3")
_FIT_FRAMES = """
p AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
frames AS (
  SELECT 'g' || vec_id % 4 AS detector, 's' || vec_id % 40 AS session_id, vec_id, CAST(label >= 5 AS BIGINT) AS y,
    sum(CAST(v AS DOUBLE) * (i % 3 - 1)) AS x FROM p GROUP BY vec_id, label
)"""
_FIT_FOLDS = "folds AS (SELECT * FROM (VALUES (1, 'g0'), (2, 'g1'), (3, 'g2'), (4, 'g3')) f(fold_id, test_detector))"
_FIT_SPLIT = SPLIT_SQL.replace(FRAMES_SQL, _FIT_FRAMES).replace(FOLDS_SQL, _FIT_FOLDS)
_FIT_METRICS = ("ap", "auc_roc", "f1")


def _fit_columns(bucket, side):
    return ", ".join(q6(f"max(CASE WHEN bucket = '{bucket}' THEN {m} END)") + f" AS {side}_{m}" for m in _FIT_METRICS)


# With one feature the fitted score rises or falls with it, as its covariance with the label on the train bucket says;
# so the metrics are those of the feature itself, turned by that sign.
@query(
    f"""WITH {_FIT_SPLIT}, sided AS (SELECT fold_id, test_detector, bucket, vec_id AS ordinal, y, x FROM frames JOIN split USING (session_id)),
turned AS (SELECT fold_id, sign(covar_pop(x, y)) AS turn FROM sided WHERE bucket = 'train' GROUP BY fold_id),
chosen AS (
  SELECT fold_id, test_detector, bucket, ordinal, y, x * turn AS s FROM sided JOIN turned USING (fold_id)
  WHERE bucket IN ('cross_detector_eval', 'in_domain_test')
), {metric_ctes("fold_id, test_detector, bucket", "chosen")}
SELECT fold_id, test_detector, {_fit_columns("cross_detector_eval", "cross")}, {_fit_columns("in_domain_test", "in_domain")},
  'logistic' AS backbone, 2 AS num_classes FROM metrics GROUP BY fold_id, test_detector"""
)
def fit_lodo(spark, d):
    """Embeddings in four groups; sessions are vectors with equal id modulo 40; one feature, a fixed projection of all values."""
    terms = F.transform("embedding", lambda v, i: v.cast("double") * (i % 3 - 1))
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("ordinal"),
        F.concat(F.lit("g"), F.col("vec_id") % 4).alias("detector"),
        F.concat(F.lit("s"), F.col("vec_id") % 40).alias("session_id"),
        (F.col("label") >= 5).cast("double").alias("label"),
        F.array(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)).alias("features"),
    )
    table_of_sessions = rows.groupBy("detector", "session_id").agg(F.count(F.lit(1)).alias("frame_count"))
    split = splits.session_split(table_of_sessions, _GROUPS)
    fitted = fit.fit_folds(rows, split, tuple(enumerate(_GROUPS, start=1)), reg_params=(0.01,), max_iter=20)
    names = [f"{side}_{m}" for side in ("cross", "in_domain") for m in _FIT_METRICS]
    return rounded(fitted, *names).select("fold_id", "test_detector", *names, "backbone", "num_classes")


def _vector_frames(spark, d):
    return images(spark, d).select(
        F.concat(F.lit("v"), F.col("vec_id")).alias("path"), F.lit(0).alias("frame_idx"), "h", "w", "pixels", (F.col("label") % 2).alias("label")
    )


_TENSOR = "c", "h", "w"


@query("SELECT 'v' || vec_id AS path, CAST(NULL AS INTEGER) AS label, 1 AS c, 8 AS h, 8 AS w, list_sum(embedding) IS NOT NULL AS filled FROM embeddings")
def unlabelled_tensors(spark, d):
    made = loaders.unlabelled_tensors(_vector_frames(spark, d))
    return made.select("path", F.col("label").cast("int").alias("label"), *_TENSOR, (F.size("pixels") == 64).alias("filled"))


@query(
    """SELECT 'v' || e.vec_id AS path, CAST(l.label AS INTEGER) AS label, 1 AS c, 8 AS h, 8 AS w FROM embeddings e
JOIN (SELECT doc_id, quality AS label FROM labels) l ON l.doc_id = e.vec_id"""
)
def listed_tensors(spark, d):
    """The listed vectors are those whose id has a label; each listed path must have its label and its frame."""
    frames = _vector_frames(spark, d).drop("label")
    path = F.concat(F.lit("v"), F.col("doc_id")).alias("path")
    labels = table(spark, d, "labels").select("doc_id", path, F.col("quality").cast("int").alias("label"))
    listed = labels.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    split_list = listed.select(F.col("doc_id").alias("ordinal"), "path")
    return loaders.listed_tensors(frames, split_list, labels.drop("doc_id")).select("path", "label", *_TENSOR)


@query(
    """SELECT 's' || vec_id % 40 AS session_id, 'v' || vec_id AS path, CAST(label % 2 AS INTEGER) AS label, 1 AS c, 8 AS h, 8 AS w
FROM embeddings WHERE vec_id % 40 IN (SELECT user_id FROM events WHERE event_type = 'purchase')"""
)
def session_tensors(spark, d):
    """Sessions are vectors with equal id modulo 40; those with the number of a buying user are chosen."""
    frames = _vector_frames(spark, d)
    labels = frames.select("path", F.array(F.col("label").cast("float")).alias("labels"))
    number = F.regexp_extract("path", "[0-9]+", 0).cast("long") % 40
    sessions = frames.select(F.concat(F.lit("s"), number).alias("session_id"), "path")
    buyers = table(spark, d, "events").where("event_type = 'purchase'").select(F.concat(F.lit("s"), "user_id").alias("session_id"))
    made = loaders.session_tensors(frames.drop("label"), labels, sessions, buyers)
    return made.select("session_id", "path", F.col("label").cast("int").alias("label"), *_TENSOR)
