import numpy as np
import pytest
from pyspark.sql import functions as F

from diffspark.constants import DETECTORS
from diffspark.operators import sampling, splits
from diffspark.plans import loaders

SESSIONS = "detector string, session_id string, frame_count long"


def greedy(sessions, held_out, ratios=(0.8, 0.1, 0.1)):
    """One session after another to the bucket with the largest deficit."""
    pool = sorted((s for s in sessions if s[0] != held_out), key=lambda s: (-s[2], s[1]))
    goal = [r * len(pool) for r in ratios]
    have = [0, 0, 0]
    result = {s[1]: "cross_detector_eval" for s in sessions if s[0] == held_out}
    for s in pool:
        left = [g - h for g, h in zip(goal, have, strict=True)]
        i = left.index(max(left))
        have[i] += 1
        result[s[1]] = splits.BUCKETS[i]
    return result


def make(n, seed, detectors=DETECTORS):
    rng = np.random.default_rng(seed)
    return [(detectors[i % len(detectors)], f"s{i:04d}", int(rng.integers(1, 8) * 10)) for i in range(n)]


@pytest.mark.parametrize("n,ratios", [(4, (0.8, 0.1, 0.1)), (25, (0.8, 0.1, 0.1)), (203, (0.8, 0.1, 0.1)), (120, (0.7, 0.15, 0.15)), (60, (0.5, 0.5, 0.5)), (40, (0.2, 0.1, 0.1))])
def test_split_equals_greedy(spark, n, ratios):
    sessions = make(n, n)
    got = splits.session_split(spark.createDataFrame(sessions, SESSIONS), ratios=ratios, blocks=5).collect()
    assert len(got) == 4 * n
    for fold in range(1, 5):
        expected = greedy(sessions, DETECTORS[fold - 1], ratios)
        assert {r["session_id"]: r["bucket"] for r in got if r["fold_id"] == fold} == expected


def test_shares_and_leaks(spark):
    table = spark.createDataFrame(make(400, 1), SESSIONS)
    split = splits.session_split(table)
    for row in splits.bucket_shares(split).collect():
        assert abs(row["share"] - {"train": 0.8, "val": 0.1, "in_domain_test": 0.1}[row["bucket"]]) <= 0.05
    assert splits.split_leaks(split).isEmpty()


def test_stratified_split_covers_every_detector(spark):
    table = spark.createDataFrame(make(160, 3), SESSIONS)
    split = splits.session_split(table, stratify_by=("detector",))
    seen = split.where("bucket = 'val'").select("fold_id", "detector").distinct().count()
    assert seen == 12


def test_fold_definitions(spark):
    folds = splits.fold_table(spark).orderBy("fold_id").collect()
    assert [f["fold_id"] for f in folds] == [1, 2, 3, 4]
    assert all(f["test_detector"] not in f["train_detectors"] and len(f["train_detectors"]) == 3 for f in folds)
    assert [f["test_detector"] for f in splits.fold_table(spark, fold_ids=[2, 4]).orderBy("fold_id").collect()] == ["JUNGFRAU_4M", "Eiger4M"]


def test_fold_guard(spark):
    table = spark.createDataFrame([("AGIPD", "a", 1)], SESSIONS)
    with pytest.raises(ValueError, match="Eiger4M"):
        splits.require_fold_detectors(table)
    splits.require_fold_detectors(table, fold_ids=[1])


def test_semi_supervised_rows_hide_held_out_labels(spark):
    sessions = make(40, 5)
    split = splits.session_split(spark.createDataFrame(sessions, SESSIONS))
    frames = spark.createDataFrame([(s[1], 1) for s in sessions], "session_id string, label int")
    rows = splits.semi_supervised_frames(frames, split).collect()
    assert {r["bucket"] for r in rows} == {"train", "cross_detector_eval"}
    assert all((r["label"] is None) == (r["bucket"] != "train") for r in rows)


@pytest.mark.parametrize("n", [0, 1, 10, 999, 5000])
def test_exact_random_split_sizes(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "k")
    parts = {r["bucket"]: r["count"] for r in sampling.train_val_test(rows, "k", 0.15, 0.1, seed=1).groupBy("bucket").count().collect()}
    test, val = int(n * 0.1), int(n * 0.15)
    assert {k: v for k, v in {"test": test, "val": val, "train": n - test - val}.items() if v} == parts


def test_exact_split_ignores_partitioning_and_follows_the_seed(spark):
    rows = spark.range(2000)
    one = {r["id"] for r in sampling.train_val(rows, "id", seed=1).where("bucket = 'train'").collect()}
    other = {r["id"] for r in sampling.train_val(rows.repartition(13), "id", seed=1).where("bucket = 'train'").collect()}
    assert one == other
    assert one != {r["id"] for r in sampling.train_val(rows, "id", seed=2).where("bucket = 'train'").collect()}


def test_order_statistics_with_small_steps(spark):
    keys = spark.range(3000).select(sampling.shuffle_key(F.col("id"), 9).alias("key"))
    expected = sorted(r["key"] for r in keys.collect())
    got = sampling.smallest_keys(keys, "key", [0, 1, 1500, 3000], settle=1)
    assert got == {0: None, 1: expected[0], 1500: expected[1499], 3000: expected[-1]}


def test_repeated_ids_are_refused(spark):
    rows = spark.range(3000).select(F.lit(7).alias("id"))
    with pytest.raises(ValueError, match="unique"):
        sampling.train_val(rows, "id")


def test_batches(spark):
    rows = spark.range(10)
    got = loaders.batches(rows, "id", 4).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in got] == [4, 4, 2]
    shuffled = loaders.batches(rows, "id", 4, shuffle_seed=3).orderBy("batch_id", "id").collect()
    again = loaders.batches(rows.repartition(5), "id", 4, shuffle_seed=3).orderBy("batch_id", "id").collect()
    assert shuffled == again


@pytest.mark.parametrize("n", [4, 300, 5000])
def test_repeated_ids_at_a_cut_are_refused_at_every_size(spark, n):
    twice = spark.range(n).union(spark.range(n))
    with pytest.raises(ValueError, match="unique"):
        sampling.exact_split(twice, "id", [("a", 0.5), ("b", 1.01 / (2 * n))], "c", seed=1)
