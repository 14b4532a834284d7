"""Ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from diffspark.functions.labels import cross_entropy, hit_score
from diffspark.operators import metrics as M
from diffspark.plans.evaluation import score_frames
from registry.common import (
    EVENTS_SQL,
    SCORED_SQL,
    TIED_SQL,
    event_scores,
    images,
    metric_ctes,
    q6,
    r6,
    rounded,
    scored,
    table,
    tied,
)

KEY = ["detector"]
ALL = ("ap", "auc_roc", "f1", "threshold")
QUERIES = {}
ORACLES = {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _select(cols, source=SCORED_SQL, keys="detector"):
    items = ", ".join(f"{q6(c)} AS {c}" if c in ALL else c for c in cols)
    return f"WITH {source}, {metric_ctes(keys)} SELECT {keys}, {items} FROM metrics"


@query(_select(["ap"]))
def ap_by_group(spark, d):
    return rounded(M.average_precision(scored(spark, d), KEY), "ap")


@query(_select(["ap"], TIED_SQL))
def ap_ties_position(spark, d):
    return rounded(M.average_precision(tied(spark, d), KEY), "ap")


@query(
    f"WITH {TIED_SQL}, {metric_ctes('detector')} SELECT detector, "
    f"{q6('CASE WHEN max(p) = 0 THEN 0 ELSE sum(pos * tp / seen) / max(p) END')} AS ap FROM cells GROUP BY detector"
)
def ap_ties_group(spark, d):
    return rounded(M.average_precision(tied(spark, d), KEY, ties="group"), "ap")


@query(_select(["auc_roc"]))
def auc_by_group(spark, d):
    return rounded(M.auc_roc(scored(spark, d), KEY), "auc_roc")


@query(_select(["auc_roc"], TIED_SQL))
def auc_ties(spark, d):
    return rounded(M.auc_roc(tied(spark, d), KEY), "auc_roc")


@query(_select(["f1", "threshold"]))
def best_f1_by_group(spark, d):
    return rounded(M.best_f1(scored(spark, d), KEY), "f1", "threshold")


@query(_select(["n", "n_pos", *ALL], TIED_SQL))
def eval_metrics_tied(spark, d):
    return rounded(M.evaluate(tied(spark, d), KEY), *ALL)


@query(_select(["n", "n_pos", *ALL], EVENTS_SQL, "eval_id"))
def metrics_large_two_level(spark, d):
    return rounded(M.evaluate(event_scores(spark, d), ["eval_id"]), *ALL)


@query(
    f"""WITH {SCORED_SQL}, {metric_ctes('detector')},
every AS (SELECT DISTINCT source AS detector FROM documents UNION SELECT DISTINCT lang FROM documents)
SELECT e.detector, coalesce(m.n, 0) AS n, coalesce(m.n_pos, 0) AS n_pos,
  {', '.join(f"CASE WHEN m.n IS NULL THEN CAST('NaN' AS DOUBLE) ELSE {q6('m.' + c)} END AS {c}" for c in ALL)}
FROM every e LEFT JOIN metrics m ON e.detector = m.detector"""
)
def eval_metrics_empty_groups(spark, d):
    docs = table(spark, d, "documents")
    every = docs.select(F.explode(F.array("source", "lang")).alias("detector"))
    return rounded(M.evaluate(scored(spark, d), KEY, evals=every), *ALL)


@query(
    f"""WITH {SCORED_SQL}, {metric_ctes('detector')}
SELECT detector, n, n_pos AS hits, n - n_pos AS non_hits, {q6('n_pos / CAST(n AS DOUBLE)')} AS hit_rate,
  {', '.join(f"{q6(c)} AS {c}" for c in ALL)},
  tp, predicted - tp AS fp, n_pos - tp AS fn, n - n_pos - (predicted - tp) AS tn,
  {q6('CASE WHEN predicted > 0 THEN tp / CAST(predicted AS DOUBLE) ELSE 0 END')} AS "precision",
  {q6('CASE WHEN n_pos > 0 THEN tp / CAST(n_pos AS DOUBLE) ELSE 0 END')} AS recall
FROM metrics"""
)
def eval_report(spark, d):
    return rounded(M.evaluation_report(scored(spark, d), KEY), "hit_rate", *ALL, "precision", "recall")


@query(
    f"""WITH {TIED_SQL}, {metric_ctes('detector')}
SELECT detector, ordinal, rk AS rank, CAST(tp AS BIGINT) AS tp, {q6('tp / rk')} AS "precision",
  {q6('CASE WHEN p = 0 THEN 0 ELSE tp / p END')} AS recall, {q6('CASE WHEN p = 0 THEN 0 ELSE y / p END')} AS recall_step
FROM ranked"""
)
def pr_curve(spark, d):
    return rounded(M.pr_curve(tied(spark, d), KEY), "precision", "recall", "recall_step")


@query(
    f"""WITH {TIED_SQL},
r AS (
  SELECT detector, row_number() OVER w AS step, CAST(sum(y) OVER w AS DOUBLE) AS tp,
         CAST(sum(y) OVER (PARTITION BY detector) AS DOUBLE) AS p, CAST(count(*) OVER (PARTITION BY detector) AS DOUBLE) AS n
  FROM scored WINDOW w AS (PARTITION BY detector ORDER BY s DESC, y DESC, ordinal ASC ROWS UNBOUNDED PRECEDING)
)
SELECT detector, step, {q6('CASE WHEN p = 0 THEN 0 ELSE tp / p END')} AS tpr,
  {q6('CASE WHEN n = p THEN 0 ELSE (step - tp) / (n - p) END')} AS fpr FROM r
UNION ALL SELECT DISTINCT detector, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM scored"""
)
def roc_curve(spark, d):
    return rounded(M.roc_curve(tied(spark, d), KEY), "tpr", "fpr")


@query(
    f"""WITH {SCORED_SQL},
c AS (
  SELECT detector, count(*) FILTER (WHERE s >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE s >= 0.5 AND y = 0) AS fp,
         count(*) FILTER (WHERE s < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE s < 0.5 AND y = 0) AS tn
  FROM scored GROUP BY detector
)
SELECT *, {q6('CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END')} AS "precision",
  {q6('CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END')} AS recall FROM c"""
)
def confusion_at_threshold(spark, d):
    return rounded(M.confusion(scored(spark, d), KEY, F.lit(0.5)), "precision", "recall")


@query(
    f"""WITH p AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
l AS (SELECT vec_id, sum(CAST(v AS DOUBLE) * (i % 3 - 1)) AS a, sum(CAST(v AS DOUBLE) * (i % 5 - 2)) AS b FROM p GROUP BY vec_id)
SELECT vec_id, {q6('1 / (1 + exp(a - b))')} AS softmax_score, {q6('1 / (1 + exp(-a))')} AS sigmoid_score FROM l"""
)
def logit_scores(spark, d):
    def logit(every: int, less: int):
        terms = F.transform("embedding", lambda v, i: v.cast("double") * (i % every - less))
        return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)

    e = table(spark, d, "embeddings").select("vec_id", logit(3, 1).alias("a"), logit(5, 2).alias("b"))
    return e.select(
        "vec_id", r6(hit_score(F.array("a", "b"))).alias("softmax_score"), r6(hit_score(F.array("a"))).alias("sigmoid_score")
    )


@query(
    f"""WITH p AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT vec_id, {q6('ln(sum(exp(CAST(v AS DOUBLE)))) - max(CASE WHEN i = label THEN CAST(v AS DOUBLE) END)')} AS loss FROM p GROUP BY vec_id"""
)
def cross_entropy_rows(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", r6(cross_entropy(F.col("embedding"), F.col("label"))).alias("loss"))


def _linear_model():
    import numpy as np

    weights = np.stack([np.arange(64) % 3 - 1.0, np.arange(64) % 5 - 2.0], axis=1)

    def predict(batch):
        return batch.reshape(len(batch), -1).astype(np.float64) @ weights

    return predict


@query(
    f"""WITH p AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
l AS (SELECT vec_id, sum(CAST(v AS DOUBLE) * (i % 3 - 1)) AS a, sum(CAST(v AS DOUBLE) * (i % 5 - 2)) AS b FROM p GROUP BY vec_id)
SELECT vec_id, {q6('1 / (1 + exp(a - b))')} AS y_score FROM l"""
)
def batch_model_scores(spark, d):
    tensors = images(spark, d).select("vec_id", F.col("pixels").cast("array<double>").alias("pixels"))
    return score_frames(tensors, _linear_model, (64,)).select("vec_id", r6("y_score").alias("y_score"))
