import math

import pytest
from pyspark.sql import functions as F

from diffspark.operators import benchmark as B
from diffspark.plans import evaluation, fit

RESULTS = [(1, "AGIPD", 0.85), (2, "JUNGFRAU_4M", 0.82), (3, "ePix10k", 0.78), (4, "Eiger4M", 0.90)]
ORACLE = [("AGIPD", 0.95), ("JUNGFRAU_4M", 0.93), ("ePix10k", 0.88), ("Eiger4M", 0.97)]


def results(spark, rows=RESULTS):
    return spark.createDataFrame(rows, "fold_id int, test_detector string, ap double")


def oracle(spark, rows=ORACLE):
    return spark.createDataFrame(rows, "test_detector string, oracle_ap double")


def lines(df):
    return [r["line"] for r in df.collect()]


def test_plain_table(spark):
    r = results(spark)
    got = lines(B.results_table(r, B.summarise_folds(r)))
    assert got[0] == "Fold     Detector              AP" and got[1] == "-" * 33
    assert got[2] == "fold_1   AGIPD             0.8500"
    assert got[-1] == "Mean                       0.8375  +/- 0.0506"
    assert len(got) == 8


def test_table_with_oracle(spark):
    r = results(spark)
    got = lines(B.results_table(r, B.summarise_folds(r), oracle(spark)))
    assert got[2] == "fold_1   AGIPD             0.8500      0.9500      10.5%"
    assert got[-1] == f"{'Mean':<8} {'':<15} {0.8375:>8.4f}  {'':>10}  {'+/- 0.0506':>9}"


def test_missing_folds_and_unknown_oracle(spark):
    r = results(spark, RESULTS[:2])
    got = lines(B.results_table(r, B.summarise_folds(r), oracle(spark, [("AGIPD", float("nan")), ("Eiger4M", 0.5)])))
    assert got[2].endswith("         N/A        N/A")
    assert got[4] == f"{'fold_3':<8} {'ePix10k':<15} {'nan':>8}  {'N/A':>10}  {'N/A':>9}"
    assert got[5] == f"{'fold_4':<8} {'Eiger4M':<15} {'nan':>8}  {0.5:>10.4f}  {'nan':>8}%"
    assert [x["fold_id"] for x in B.missing_folds(r).orderBy("fold_id").collect()] == [3, 4]


def test_summary(spark):
    row = B.summarise_folds(results(spark)).first()
    assert row["mean_ap"] == pytest.approx(0.8375) and row["std_ap"] == pytest.approx(0.05057997)
    assert math.isnan(B.summarise_folds(results(spark, RESULTS[:1])).first()["std_ap"])
    with pytest.raises(Exception, match="no fold id"):
        B.summarise_folds(results(spark, [(None, "x", 0.5)])).collect()


def test_pass_rule(spark):
    gaps = B.oracle_gaps(results(spark), oracle(spark))
    assert tuple(B.pass_rule(gaps, 15, 0.75).first()) == (4, 4, True)
    assert tuple(B.pass_rule(gaps, 11, 0.75).first()) == (4, 2, False)
    assert tuple(B.pass_rule(gaps.where("fold_id < 4"), 15, 0.75).first()) == (3, 3, False)


def test_one_result_per_run(spark):
    rows = [("net", 1, 1, "a", 0.1), ("net", 1, 1, "b", 0.3), ("net", 1, 2, "a", 0.5), ("net", 2, 1, "a", 0.9)]
    df = spark.createDataFrame(rows, "backbone string, seed int, fold_id int, file string, ap double")
    got = {r["seed"]: (r["folds"], r["mean_ap"]) for r in evaluation.aggregate_runs(df).collect()}
    assert got[1] == (2, pytest.approx(0.4)) and got[2] == (1, pytest.approx(0.9))


def test_in_domain_and_cross_results(spark):
    rows = [(1, "A", b, i, i % 2, 0.9 if i % 2 else 0.1) for b in ("cross_detector_eval", "train") for i in range(6)]
    df = spark.createDataFrame(rows, "fold_id int, test_detector string, bucket string, ordinal long, y_true int, y_score double")
    row = B.fold_results(df, ("A", "B")).orderBy("fold_id").first()
    assert row["cross_ap"] == 1.0 and math.isnan(row["in_domain_ap"])
    assert [r["n"] for r in B.evaluate_folds(df, ("A", "B")).orderBy("fold_id").collect()] == [6, 0]


def fitted_inputs(spark):
    rows = spark.range(800).select(
        F.col("id").alias("ordinal"),
        F.concat(F.lit("g"), F.col("id") % 2).alias("detector"),
        F.concat(F.lit("s"), F.col("id") % 20).alias("session_id"),
        (F.pmod(F.xxhash64("id"), F.lit(2))).cast("int").alias("label"),
    )
    return rows.withColumn("features", F.array(F.col("label") * 2.0 + F.rand(1), F.rand(2)))


def test_fit_and_resume(spark):
    from diffspark.operators import catalog, splits

    frames = fitted_inputs(spark)
    split = splits.session_split(catalog.sessions(frames, "detector", ("session_id",)), ("g0", "g1"))
    folds = ((1, "g0"), (2, "g1"))
    done = fit.fit_folds(frames.drop("detector"), split, folds, reg_params=(0.0, 5.0), max_iter=5)
    rows = done.orderBy("fold_id").collect()
    assert [r["fold_id"] for r in rows] == [1, 2] and all(r["cross_ap"] > 0.99 for r in rows)
    assert fit.fit_folds(frames.drop("detector"), split, folds, done=done).columns == done.columns
    first = done.where("fold_id = 1")
    both = fit.fit_folds(frames.drop("detector"), split, folds, reg_params=(0.0, 5.0), max_iter=5, done=first)
    assert both.columns == done.columns and [r["fold_id"] for r in both.orderBy("fold_id").collect()] == [1, 2]
    with pytest.raises(RuntimeError, match="do not match"):
        fit.fit_folds(frames.drop("detector"), split, folds, done=first, num_classes=3)
    runs = spark.createDataFrame([("net18", 2)], "backbone string, num_classes int")
    fit.check_same_run(runs, "net18", 2)
    with pytest.raises(RuntimeError, match="do not match"):
        fit.check_same_run(runs, "net50", 2)
