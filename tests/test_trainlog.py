import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffspark.operators import trainlog


def walk(values, patience, delta=0.0):
    best, waited, at, last = -1.0, 0, 0, 0
    for epoch, v in enumerate(values, start=1):
        last = epoch
        if v > best + delta:
            best, waited, at = v, 0, epoch
        else:
            waited += 1
            if waited >= patience:
                return last, True, at, best
    return last, False, at, best


def logs(seed):
    rng = np.random.default_rng(seed)
    made = {f"r{i}": list(np.round(rng.random(int(rng.integers(1, 60))), 2)) for i in range(25)}
    made["rising"] = [i / 100 for i in range(90)]
    made["falling"] = [1 - i / 100 for i in range(30)]
    made["flat"] = [0.5] * 20
    made["nan first"] = [math.nan, 0.2, math.nan, 0.3, 0.1, 0.1, 0.1, 0.1]
    made["below start"] = [-2.0, -1.0, -3.0]
    return made


def frame(spark, made):
    rows = [(run, e, float(v)) for run, vs in made.items() for e, v in enumerate(vs, start=1)]
    return spark.createDataFrame(rows, "run string, epoch int, val_f1 double")


@pytest.mark.parametrize("patience,delta", [(1, 0.0), (3, 0.0), (10, 0.0), (4, 0.05), (7, 1e-4), (5, 0.3)])
def test_early_stopping_equals_the_loop(spark, patience, delta):
    made = logs(patience)
    got = trainlog.early_stopping(frame(spark, made), ["run"], [F.col("epoch")], patience=patience, min_delta=delta, blocks=6)
    for row in got.collect():
        assert tuple(row)[1:] == walk(made[row["run"]], patience, delta), row["run"]


def test_min_delta_over_many_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = logs(2)
        got = trainlog.early_stopping(frame(spark, made), ["run"], [F.col("epoch")], patience=6, min_delta=0.015).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for row in got:
        assert tuple(row)[1:] == walk(made[row["run"]], 6, 0.015), row["run"]


def test_marks_stop_at_the_stop(spark):
    made = {"a": [0.1, 0.3, 0.2, 0.2, 0.9]}
    rows = trainlog.mark_improvements(frame(spark, made), ["run"], [F.col("epoch")], patience=2).orderBy("epoch").collect()
    assert [r["improved"] for r in rows] == [True, True, False, False, True]
    assert [r["no_improve"] for r in rows] == [0, 0, 1, 2, 0]
    assert [r["kept"] for r in rows] == [True, True, True, True, False]


def test_weighted_loss(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 4.0, 1), ("b", 5.0, 0)], "s string, loss double, n int")
    got = {r["s"]: r["loss"] for r in trainlog.weighted_loss(df, ["s"]).collect()}
    assert got == {"a": 2.0, "b": 0.0}
    empty = trainlog.weighted_loss(df.where("s = 'z'"), []).collect()
    assert [r["loss"] for r in empty] == [0.0]


def test_min_delta_takes_no_walk(spark):
    rows = spark.range(20_000).select(F.lit("one").alias("run"), F.col("id").alias("epoch"), (F.col("id") / 20_000).alias("val_f1"))
    done = trainlog.early_stopping(rows, ["run"], [F.col("epoch")], "val_f1", patience=50_000, min_delta=0.1)
    assert "Python" not in done._jdf.queryExecution().toString()
    best, at = -1.0, 0
    for i in range(20_000):
        if i / 20_000 > best + 0.1:
            best, at = i / 20_000, i + 1
    row = done.first()
    assert (row["best_epoch"], row["best_value"], row["last_epoch"]) == (at, best, 20_000)
