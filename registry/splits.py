"""Folds, session splits, random splits and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from diffspark.constants import SEMI_SUPERVISED_VARIANT
from diffspark.operators import catalog, sampling, splits
from diffspark.plans import loaders
from diffspark.sources import tables
from registry.common import FRAMES_SQL, LANGS, frames, q6, rounded, table

QUERIES = {}
ORACLES = {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


FOLDS_SQL = "folds AS (SELECT * FROM (VALUES (1, 'en'), (2, 'fr'), (3, 'de'), (4, 'es')) f(fold_id, test_detector))"

SPLIT_SQL = f"""{FRAMES_SQL}, {FOLDS_SQL},
sessions AS (SELECT detector, session_id, count(*) AS frame_count FROM frames GROUP BY ALL),
pool AS (
  SELECT fold_id, test_detector, detector, session_id, frame_count,
    row_number() OVER (PARTITION BY fold_id ORDER BY frame_count DESC, session_id) AS k, count(*) OVER (PARTITION BY fold_id) AS n
  FROM folds, sessions WHERE detector <> test_detector
),
shares AS (
  SELECT b, bucket, CAST(r AS DOUBLE) AS r
  FROM (VALUES (1, 'train', '0.8'), (2, 'val', '0.1'), (3, 'in_domain_test', '0.1')) x(b, bucket, r)
),
seats AS (
  SELECT fold_id, bucket, row_number() OVER (PARTITION BY fold_id ORDER BY r * CAST(n AS DOUBLE) - CAST(k - 1 AS DOUBLE) DESC, b) AS k
  FROM pool, shares
),
split AS (
  SELECT fold_id, test_detector, detector, session_id, frame_count, bucket FROM pool JOIN seats USING (fold_id, k)
  UNION ALL
  SELECT fold_id, test_detector, detector, session_id, frame_count, 'cross_detector_eval' FROM folds, sessions
  WHERE detector = test_detector
)"""


def _sessions(spark, d):
    return catalog.sessions(frames(spark, d), "detector", ("session_id",))


def _split(spark, d, **options):
    return splits.session_split(_sessions(spark, d), LANGS, **options)


@query(
    f"""WITH {FRAMES_SQL}, {FOLDS_SQL}, s AS (SELECT DISTINCT detector, session_id FROM frames)
SELECT fold_id, test_detector, count(*) FILTER (WHERE detector = test_detector) AS held_out,
  count(*) FILTER (WHERE detector <> test_detector) AS train_pool,
  array_to_string(list_filter(['en', 'fr', 'de', 'es'], lambda x: x <> test_detector), ',') AS train_detectors
FROM folds, s GROUP BY ALL"""
)
def lodo_folds(spark, d):
    held = F.col("detector") == F.col("test_detector")
    counts = splits.with_folds(_sessions(spark, d), LANGS).groupBy("fold_id", "test_detector").agg(
        F.count_if(held).alias("held_out"), F.count_if(~held).alias("train_pool")
    )
    folds = splits.fold_table(spark, LANGS).select("fold_id", F.array_join("train_detectors", ",").alias("train_detectors"))
    return counts.join(folds, "fold_id")


@query(
    """SELECT f.fold_id, f.test_detector FROM (VALUES (1, 'en'), (2, 'xx'), (3, 'fr'), (4, 'yy')) f(fold_id, test_detector)
WHERE f.test_detector NOT IN (SELECT lang FROM documents)"""
)
def fold_guard(spark, d):
    found = splits.folds_without_sessions(_sessions(spark, d), ("en", "xx", "fr", "yy"))
    return found.select("fold_id", "test_detector")


@query(f"WITH {SPLIT_SQL} SELECT *, 'strict_lodo' AS variant FROM split")
def session_split(spark, d):
    return _split(spark, d)


@query(f"WITH {SPLIT_SQL} SELECT * FROM split WHERE fold_id IN (2, 4)")
def session_split_chosen_folds(spark, d):
    return _split(spark, d, fold_ids=(2, 4)).drop("variant")


@query(
    f"""WITH {SPLIT_SQL}, strat AS (
  SELECT fold_id, detector, session_id, row_number() OVER (PARTITION BY fold_id, detector ORDER BY frame_count DESC, session_id) AS k,
    count(*) OVER (PARTITION BY fold_id, detector) AS n FROM folds, sessions WHERE detector <> test_detector
), st AS (
  SELECT fold_id, detector, bucket,
    row_number() OVER (PARTITION BY fold_id, detector ORDER BY r * CAST(n AS DOUBLE) - CAST(k - 1 AS DOUBLE) DESC, b) AS k FROM strat, shares
)
SELECT fold_id, detector, session_id, bucket FROM strat JOIN st USING (fold_id, detector, k)
UNION ALL SELECT fold_id, detector, session_id, 'cross_detector_eval' FROM folds, sessions WHERE detector = test_detector"""
)
def session_split_stratified(spark, d):
    done = _split(spark, d, stratify_by=("detector",))
    return done.select("fold_id", "detector", "session_id", "bucket")


@query(
    f"""WITH {SPLIT_SQL}, c AS (SELECT fold_id, bucket, count(*) AS sessions, CAST(sum(frame_count) AS BIGINT) AS frames
  FROM split WHERE bucket <> 'cross_detector_eval' GROUP BY ALL)
SELECT *, {q6('sessions / CAST(sum(sessions) OVER (PARTITION BY fold_id) AS DOUBLE)')} AS share FROM c"""
)
def split_share(spark, d):
    return rounded(splits.bucket_shares(_split(spark, d)), "share")


@query(
    f"""WITH {SPLIT_SQL}, lost AS (SELECT fold_id, session_id, bucket FROM split
  UNION ALL SELECT fold_id, session_id, 'val' FROM split WHERE session_id LIKE '%11%')
SELECT fold_id, session_id, min(bucket) AS first_bucket, max(bucket) AS last_bucket FROM lost GROUP BY ALL HAVING min(bucket) <> max(bucket)"""
)
def split_leak_check(spark, d):
    parts = _split(spark, d).select("fold_id", "session_id", "bucket")
    wrong = parts.where("session_id LIKE '%11%'").withColumn("bucket", F.lit("val"))
    return splits.split_leaks(parts.unionByName(wrong))


@query(f"WITH {SPLIT_SQL} SELECT fold_id, 'strict_lodo' AS variant, test_detector, session_id, bucket FROM split")
def split_artifact_maps(spark, d):
    return tables.unpack_split(tables.pack_split(_split(spark, d)))


@query(f"WITH {SPLIT_SQL} SELECT doc_id, fold_id, test_detector, bucket FROM frames JOIN split USING (session_id) WHERE bucket IN ('val', 'in_domain_test')")
def frames_of_split(spark, d):
    joined = splits.frames_of_split(frames(spark, d), _split(spark, d), buckets=("val", "in_domain_test"))
    return joined.select("doc_id", "fold_id", "test_detector", "bucket")


@query(
    f"""WITH {SPLIT_SQL}
SELECT doc_id, fold_id, bucket, CASE WHEN bucket = 'train' THEN quality END AS label
FROM frames LEFT JOIN labels USING (doc_id) JOIN split USING (session_id) WHERE bucket IN ('train', 'cross_detector_eval')"""
)
def semi_supervised_union(spark, d):
    y = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    split = _split(spark, d, variant=SEMI_SUPERVISED_VARIANT)
    rows = splits.semi_supervised_frames(frames(spark, d).join(y, "doc_id", "left"), split)
    return rows.select("doc_id", "fold_id", "bucket", "label")


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS k, CAST(count(*) OVER () AS DOUBLE) AS n FROM documents),
c AS (SELECT doc_id, k, floor(n * CAST('0.1' AS DOUBLE)) AS t, floor(n * CAST('0.15' AS DOUBLE)) AS v FROM r)
SELECT doc_id, CASE WHEN k <= t THEN 'test' WHEN k <= t + v THEN 'val' ELSE 'train' END AS bucket FROM c"""
)
def exact_random_split(spark, d):
    return sampling.train_val_test(table(spark, d, "documents").select("doc_id"), "doc_id", val=0.15, test=0.1, seed=42)


@query(
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY md5('3:' || event_id)) AS k, CAST(count(*) OVER () AS DOUBLE) AS n FROM events)
SELECT event_id, CASE WHEN k <= floor(n * CAST('0.8' AS DOUBLE)) THEN 'train' ELSE 'val' END AS bucket FROM r"""
)
def exact_two_way_split(spark, d):
    return sampling.train_val(table(spark, d, "events").select("event_id"), "event_id", 0.8, seed=3)


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id FROM documents")
def batch_numbers(spark, d):
    return loaders.batches(table(spark, d, "documents").select("doc_id"), "doc_id", 32)


@query("SELECT event_id, (row_number() OVER (ORDER BY md5('5:' || event_id)) - 1) // 64 AS batch_id FROM events")
def batch_numbers_shuffled(spark, d):
    return loaders.batches(table(spark, d, "events").select("event_id"), "event_id", 64, shuffle_seed=5)


@query(
    """WITH b AS (SELECT user_id AS batch_id, count(*) AS n FROM events GROUP BY user_id)
SELECT batch_id, n, CAST(sum(n) OVER (ORDER BY batch_id) AS BIGINT) AS processed FROM b"""
)
def batch_progress(spark, d):
    sizes = table(spark, d, "events").groupBy(F.col("user_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("n"))
    return loaders.processed_so_far(sizes)
