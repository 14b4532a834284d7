"""Leave-one-group-out results, summaries and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from diffspark.constants import CROSS_DETECTOR, IN_DOMAIN_TEST
from diffspark.operators import benchmark as B
from diffspark.operators.metrics import evaluate
from diffspark.plans import evaluation
from diffspark.sources import tables
from registry.common import LANGS, SCORED_SQL, metric_ctes, q6, rounded, scored
from registry.splits import FOLDS_SQL, SPLIT_SQL

QUERIES = {}
ORACLES = {}
ALL = ("ap", "auc_roc", "f1", "threshold")


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


_BUCKETS = f"('{CROSS_DETECTOR}', '{IN_DOMAIN_TEST}')"
# Sessions are counted over all documents, scores exist for the labelled ones.
_FOLD_SCORES = (
    SPLIT_SQL
    + SCORED_SQL[SCORED_SQL.index("scored AS") - 2 :]
    + f""",
chosen AS (
  SELECT fold_id, test_detector, bucket, ordinal, y, s FROM scored JOIN split USING (session_id) WHERE bucket IN {_BUCKETS}
), {metric_ctes('fold_id, test_detector, bucket', 'chosen')}"""
)


def _side(prefix, bucket):
    return ", ".join(
        f"coalesce(max(CASE WHEN bucket = '{bucket}' THEN {m} END), CAST('NaN' AS DOUBLE)) AS {prefix}_{m}" for m in ALL
    )


_RESULTS = (
    _FOLD_SCORES
    + f""",
results AS (
  SELECT fold_id, test_detector, {_side('cross', CROSS_DETECTOR)}, {_side('in_domain', IN_DOMAIN_TEST)}
  FROM metrics GROUP BY fold_id, test_detector
)"""
)

_NAMES = [f"{s}_{m}" for s in ("cross", "in_domain") for m in ALL]


def _sessions(spark, d):
    from registry.splits import _sessions as all_sessions

    return all_sessions(spark, d)


def _fold_scores(spark, d):
    return evaluation.fold_scores(scored(spark, d), LANGS, sessions=_sessions(spark, d))


def _results(spark, d):
    return B.fold_results(_fold_scores(spark, d), LANGS)


def _by_language(spark, d):
    """One result per language as its fold, without a session split."""
    folds = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("detector")).cast("int")
    rows = scored(spark, d).withColumns({"fold_id": folds, "test_detector": F.col("detector")})
    return evaluate(rows, ["fold_id", "test_detector"])


_LANG_SQL = f"""{SCORED_SQL}, {FOLDS_SQL}, {metric_ctes('detector')},
r AS (SELECT f.fold_id, f.test_detector, m.* FROM folds f JOIN metrics m ON m.detector = f.test_detector)"""

# Within-group upper bounds standing in for published ones; one unknown, one not positive.
_ORACLE_ROWS = "(VALUES ('en', CAST(0.95 AS DOUBLE)), ('fr', CAST(0.97 AS DOUBLE)), ('de', CAST('NaN' AS DOUBLE)), ('es', CAST(0 AS DOUBLE))) o(test_detector, oracle_ap)"


def _oracle(spark):
    return spark.createDataFrame(
        [("en", 0.95), ("fr", 0.97), ("de", float("nan")), ("es", 0.0)], "test_detector string, oracle_ap double"
    )


_GAP = "CASE WHEN oracle_ap IS NOT NULL AND NOT isnan(oracle_ap) AND oracle_ap > 0 THEN (oracle_ap - ap) / oracle_ap * 100 END"


@query(f"WITH {_RESULTS} SELECT fold_id, test_detector, {', '.join(f'{q6(c)} AS {c}' for c in _NAMES)} FROM results")
def lodo_report(spark, d):
    return rounded(_results(spark, d), *_NAMES)


@query(
    f"""WITH {_FOLD_SCORES} SELECT fold_id, test_detector, n, n_pos, {', '.join(f'{q6(c)} AS {c}' for c in ALL)} FROM metrics
WHERE bucket = '{CROSS_DETECTOR}'"""
)
def fold_metrics(spark, d):
    return rounded(B.evaluate_folds(_fold_scores(spark, d), LANGS), *ALL)


@query(
    f"""WITH {_FOLD_SCORES} SELECT fold_id, test_detector, n, n_pos, {', '.join(f'{q6(c)} AS {c}' for c in ALL)} FROM metrics
WHERE bucket = '{CROSS_DETECTOR}'
UNION ALL SELECT 5, 'xx', 0, 0, {', '.join(["CAST('NaN' AS DOUBLE)"] * len(ALL))}"""
)
def fold_metrics_without_frames(spark, d):
    """A detector without documents keeps its fold, with NaN metrics."""
    return rounded(B.evaluate_folds(_fold_scores(spark, d), (*LANGS, "xx")), *ALL)


def _table_sql(lines):
    return f"""SELECT CAST(line_no AS INTEGER) AS line_no, line FROM ({lines})"""


@query(
    "WITH "
    + _RESULTS
    + ", "
    + "m AS (SELECT avg(cross_ap) AS mean_ap, stddev_samp(cross_ap) AS std_ap FROM results) "
    + _table_sql(
        """SELECT 1 AS line_no, printf('%-8s %-15s %8s', 'Fold', 'Detector', 'AP') AS line
  UNION ALL SELECT 2, repeat('-', 33) UNION ALL SELECT 7, repeat('-', 33)
  UNION ALL SELECT fold_id + 2, printf('%-8s %-15s %8.4f', 'fold_' || fold_id, test_detector, cross_ap) FROM results
  UNION ALL SELECT 8, printf('%-8s %-15s %8.4f', 'Mean', '', mean_ap) || '  +/- ' || printf('%.4f', std_ap) FROM m"""
    )
)
def lodo_results_table(spark, d):
    results = _results(spark, d)
    return evaluation.lodo_table(results, LANGS)


@query(
    "WITH "
    + _LANG_SQL
    + f", {'o AS (SELECT * FROM ' + _ORACLE_ROWS + ')'}, g AS (SELECT r.*, o.oracle_ap, {_GAP} AS gap FROM r LEFT JOIN o ON o.test_detector = r.test_detector), "
    + "m AS (SELECT avg(ap) AS mean_ap, stddev_samp(ap) AS std_ap FROM r) "
    + _table_sql(
        """SELECT 1 AS line_no, printf('%-8s %-15s %8s  %10s  %9s', 'Fold', 'Detector', 'AP', 'Oracle AP', 'Rel. Gap') AS line
  UNION ALL SELECT 2, repeat('-', 56) UNION ALL SELECT 7, repeat('-', 56)
  UNION ALL SELECT fold_id + 2, printf('%-8s %-15s %8.4f', 'fold_' || fold_id, test_detector, ap)
    || CASE WHEN gap IS NULL THEN printf('  %10s  %9s', 'N/A', 'N/A') ELSE printf('  %10.4f  %8.1f', oracle_ap, gap) || '%' END FROM g
  UNION ALL SELECT 8, printf('%-8s %-15s %8.4f', 'Mean', '', mean_ap) || printf('  %10s  ', '') || '+/- ' || printf('%.4f', std_ap) FROM m"""
    )
)
def oracle_results_table(spark, d):
    r = _by_language(spark, d)
    return B.results_table(r, B.summarise_folds(r), _oracle(spark), LANGS)


@query(
    "WITH "
    + _LANG_SQL
    + ", one AS (SELECT ap, (CAST('0.0001' AS DOUBLE) - ap) / CAST('0.0001' AS DOUBLE) * 100 AS gap FROM r WHERE fold_id = 1) "
    + _table_sql(
        """SELECT 1 AS line_no, printf('%-8s %-15s %8s  %10s  %9s', 'Fold', 'Detector', 'AP', 'Oracle AP', 'Rel. Gap') AS line
  UNION ALL SELECT 2, repeat('-', 56) UNION ALL SELECT 7, repeat('-', 56)
  UNION ALL SELECT 3, printf('%-8s %-15s %8.4f  %10.4f  %8.1f', 'fold_1', 'en', ap, 0.0001, gap) || '%' FROM one
  UNION ALL SELECT k + 2, printf('%-8s %-15s %8s  %10s  %9s', 'fold_' || k, x, 'nan', 'N/A', 'N/A') FROM (VALUES (2, 'fr'), (3, 'de'), (4, 'es')) v(k, x)
  UNION ALL SELECT 8, printf('%-8s %-15s %8.4f  %10s  %9s', 'Mean', '', ap, '', '+/- nan') FROM one"""
    )
)
def oracle_results_table_single(spark, d):
    """One fold only: no deviation, and a gap wider than its field."""
    r = _by_language(spark, d).where("fold_id = 1")
    oracle = spark.createDataFrame([("en", 0.0001)], "test_detector string, oracle_ap double")
    return B.results_table(r, B.summarise_folds(r), oracle, LANGS)


@query(f"WITH {_LANG_SQL} SELECT count(*) AS folds, {q6('avg(ap)')} AS mean_ap, {q6('stddev_samp(ap)')} AS std_ap FROM r")
def fold_summary(spark, d):
    return rounded(B.summarise_folds(_by_language(spark, d)), "mean_ap", "std_ap")


@query(
    f"""WITH {_LANG_SQL}, one AS (SELECT * FROM r WHERE fold_id = 1)
SELECT count(*) AS folds, {q6('avg(ap)')} AS mean_ap, CAST('NaN' AS DOUBLE) AS std_ap FROM one"""
)
def fold_summary_single(spark, d):
    return rounded(B.summarise_folds(_by_language(spark, d).where("fold_id = 1")), "mean_ap", "std_ap")


@query(
    f"""WITH {_LANG_SQL} SELECT fold_id, r.test_detector, {q6('ap')} AS ap, {q6('oracle_ap')} AS oracle_ap, {q6(_GAP)} AS rel_gap
FROM r LEFT JOIN {_ORACLE_ROWS} ON o.test_detector = r.test_detector"""
)
def oracle_gap(spark, d):
    gaps = B.oracle_gaps(_by_language(spark, d).select("fold_id", "test_detector", "ap"), _oracle(spark))
    return rounded(gaps, "ap", "oracle_ap", "rel_gap")


@query(
    f"""WITH {_LANG_SQL}, g AS (SELECT ap, {_GAP} AS gap FROM r LEFT JOIN {_ORACLE_ROWS} ON o.test_detector = r.test_detector)
SELECT count(*) AS folds, count(*) FILTER (WHERE gap <= 20 AND ap >= CAST(0.7 AS DOUBLE)) AS folds_passing,
  bool_and(coalesce(gap <= 20 AND ap >= CAST(0.7 AS DOUBLE), false)) AND count(*) = 4 AS passed FROM g"""
)
def pass_rule(spark, d):
    gaps = B.oracle_gaps(_by_language(spark, d), _oracle(spark))
    return B.pass_rule(gaps, largest_gap=20.0, smallest_ap=0.7)


@query(f"WITH {_LANG_SQL} SELECT fold_id FROM folds WHERE fold_id NOT IN (SELECT fold_id FROM r WHERE n_pos % 2 = 0)")
def missing_folds(spark, d):
    return B.missing_folds(_by_language(spark, d).where(F.col("n_pos") % 2 == 0), LANGS)


_BASELINES = ("length", "inverse", "coarse")


@query(
    f"""WITH {SCORED_SQL}, b AS (
  SELECT detector, 'length' AS baseline, ordinal, y, s FROM scored UNION ALL SELECT detector, 'inverse', ordinal, y, -s FROM scored
  UNION ALL SELECT detector, 'coarse', ordinal, y, floor(s * 4) FROM scored
), {metric_ctes('detector, baseline', 'b')}
SELECT detector, {', '.join(f"{q6(f'''max(CASE WHEN baseline = '{b}' THEN ap END)''')} AS {b}" for b in _BASELINES)}
FROM metrics GROUP BY detector"""
)
def baseline_comparison(spark, d):
    base = scored(spark, d)
    s = F.col("y_score")
    parts = evaluation.concat_scores(
        base.withColumns({"baseline": F.lit(name), "y_score": value})
        for name, value in (("length", s), ("inverse", -s), ("coarse", F.floor(s * 4).cast("double")))
    )
    return rounded(B.compare_baselines(parts, _BASELINES, ("detector",)), *_BASELINES)


@query(
    f"""WITH {SPLIT_SQL}{SCORED_SQL[SCORED_SQL.index("scored AS") - 2 :]},
held AS (SELECT fold_id, ordinal, y, s FROM scored JOIN split USING (session_id) WHERE bucket = '{CROSS_DETECTOR}'),
variants AS (SELECT 'fine' AS variant, * FROM held UNION ALL SELECT 'coarse', fold_id, ordinal, y, floor(s * 4) FROM held),
{metric_ctes('fold_id, variant', 'variants')}
SELECT a.fold_id, {q6('a.ap')} AS ap_fine, {q6('b.ap')} AS ap_coarse, {q6('b.ap - a.ap')} AS difference
FROM metrics a JOIN metrics b ON a.fold_id = b.fold_id WHERE a.variant = 'fine' AND b.variant = 'coarse'"""
)
def head_to_head(spark, d):
    """Two score definitions on the same held-out frames."""
    rows = _fold_scores(spark, d)
    coarse = rows.withColumn("y_score", F.floor(F.col("y_score") * 4).cast("double"))
    both = B.head_to_head(B.evaluate_folds(rows, LANGS), B.evaluate_folds(coarse, LANGS), ("fine", "coarse"))
    return rounded(both, "ap_fine", "ap_coarse", "difference")


@query(
    f"""WITH {_RESULTS} SELECT fold_id, test_detector, {', '.join(f'{q6("cross_" + m)} AS {m}' for m in ALL)}, {q6('in_domain_ap')} AS in_domain_ap
FROM results"""
)
def results_json_round_trip(spark, d):
    nested = tables.nested_results(_results(spark, d))
    text = nested.select(F.to_json(F.struct("*")).alias("value"))
    back = text.select(F.from_json("value", nested.schema, {"allowNonNumericNumbers": "true"}).alias("r")).select("r.*")
    return rounded(tables.flat_results(back), *ALL, "in_domain_ap")


@query(
    f"""WITH {SPLIT_SQL} SELECT fold_id, bucket, count(*) AS frames, count(quality) AS labelled, count(*) FILTER (WHERE quality = 1) AS hits
FROM frames LEFT JOIN labels USING (doc_id) JOIN split USING (session_id) GROUP BY fold_id, bucket"""
)
def bucket_label_balance(spark, d):
    from diffspark.operators import splits
    from registry.common import frames, table

    y = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = frames(spark, d).join(y, "doc_id", "left")
    split = splits.session_split(_sessions(spark, d), LANGS)
    return splits.frames_of_split(rows, split).groupBy("fold_id", "bucket").agg(
        F.count(F.lit(1)).alias("frames"), F.count("label").alias("labelled"), F.count_if(F.col("label") == 1).alias("hits")
    )


@query(
    "WITH "
    + _LANG_SQL
    + ", m AS (SELECT avg(ap) AS mean_ap, stddev_samp(ap) AS std_ap FROM r) "
    + _table_sql(
        """SELECT 1 AS line_no, printf('%-8s %-15s %8s', 'Fold', 'Detector', 'AP') AS line
  UNION ALL SELECT 2, repeat('-', 33) UNION ALL SELECT 7, repeat('-', 33)
  UNION ALL SELECT fold_id + 2, printf('%-8s %-15s %8.4f', 'fold_' || fold_id, test_detector, ap) FROM r
  UNION ALL SELECT 8, printf('%-8s %-15s %8.4f', 'Mean', '', mean_ap) || '  +/- ' || printf('%.4f', std_ap) FROM m"""
    )
)
def stored_results_table(spark, d):
    latest = _by_language(spark, d).withColumn("file", F.lit("b"))
    stale = latest.withColumns({"file": F.lit("a"), "ap": F.lit(0.0)})
    stored = stale.unionByName(latest).withColumns({"backbone": F.lit("net"), "seed": F.lit(1)})
    return evaluation.stored_table(stored, LANGS)


@query(
    """WITH r AS (SELECT user_id % 7 AS seed, user_id % 4 + 1 AS fold_id, event_id, value FROM events),
k AS (SELECT seed, fold_id, arg_max(value, event_id) AS ap FROM r GROUP BY ALL)
SELECT 'net' AS backbone, seed, count(*) AS folds, """
    + q6("avg(ap)")
    + " AS mean_ap, "
    + q6("stddev_samp(ap)")
    + " AS std_ap FROM k GROUP BY seed"
)
def aggregate_runs(spark, d):
    from registry.common import table

    rows = table(spark, d, "events").select(
        F.lit("net").alias("backbone"),
        (F.col("user_id") % 7).alias("seed"),
        (F.col("user_id") % 4 + 1).alias("fold_id"),
        F.col("event_id").alias("file"),
        F.col("value").alias("ap"),
    )
    return rounded(evaluation.aggregate_runs(rows), "mean_ap", "std_ap")




@query(
    f"""WITH {FOLDS_SQL}, r AS (SELECT user_id % 7 AS seed, user_id % 14 % 4 + 1 AS fold_id, event_id, value FROM events),
k AS (SELECT seed, fold_id, arg_max(value, event_id) AS ap, arg_max(value / 2, event_id) AS in_domain_ap FROM r GROUP BY ALL)
SELECT 'net' AS backbone, s.seed, f.fold_id, f.test_detector, {q6('ap')} AS ap, {q6('in_domain_ap')} AS in_domain_ap, ap IS NULL AS missing
FROM (SELECT DISTINCT seed FROM r) s CROSS JOIN folds f LEFT JOIN k ON k.seed = s.seed AND k.fold_id = f.fold_id"""
)
def run_fold_report(spark, d):
    """Folds of stored runs with cross and in-domain values; runs lack some folds."""
    from registry.common import table

    rows = table(spark, d, "events").select(
        F.lit("net").alias("backbone"),
        (F.col("user_id") % 7).alias("seed"),
        (F.col("user_id") % 14 % 4 + 1).cast("int").alias("fold_id"),
        F.col("event_id").alias("file"),
        F.col("value").alias("ap"),
        (F.col("value") / 2).alias("in_domain_ap"),
    )
    return rounded(evaluation.run_folds(rows, LANGS), "ap", "in_domain_ap")
