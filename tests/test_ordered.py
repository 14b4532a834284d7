"""Running aggregates inside range partitions."""

import random

import pytest
from pyspark.sql import functions as F

from diffspark.operators.ordered import cut_blocks, number_rows, running
from diffspark.operators.trainlog import mark_improvements


def table(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), i, rng.choice([None, rng.randint(-5, 5)]), rng.choice([None, rng.random()])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, i long, v int, w double"), rows


@pytest.mark.parametrize("blocks", [1, 7, 40])
@pytest.mark.parametrize("inclusive", [True, False])
def test_against_loops(spark, blocks, inclusive):
    df, rows = table(spark)
    order = [F.col("i").desc()]
    got = running(
        cut_blocks(df, ["k"], order, blocks),
        ["k"],
        order,
        {"s": ("sum", F.col("v")), "m": ("max", F.col("w")), "n": ("min", F.col("v"))},
        inclusive=inclusive,
        totals={"ts": ("sum", F.col("v")), "tm": ("max", F.col("w"))},
    )
    got = {r["i"]: (r["s"], r["m"], r["n"], r["ts"], r["tm"]) for r in got.collect()}
    for key in "ab":
        own = sorted((r for r in rows if r[0] == key), key=lambda r: -r[1])
        vs, ws = [r[2] for r in own if r[2] is not None], [r[3] for r in own if r[3] is not None]
        for at, row in enumerate(own):
            before = own[: at + inclusive]
            v, w = [r[2] for r in before if r[2] is not None], [r[3] for r in before if r[3] is not None]
            assert got[row[1]] == (sum(v), max(w, default=None), min(v, default=None), sum(vs), max(ws))
    assert len(got) == len(rows)


def test_one_full_exchange(spark):
    df, _ = table(spark)
    order = [F.col("i").asc()]
    got = number_rows(df, ["k"], order, blocks=5)
    assert got.count() == 400
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [line for line in plan.splitlines() if "Exchange rangepartitioning" in line]
    assert sum("ReusedExchange" not in line for line in exchanges) == 1
    # What else moves are sums of blocks.
    assert plan.count("Exchange hashpartitioning") <= 3


def test_no_rows_and_no_keys(spark):
    df, rows = table(spark)
    assert number_rows(df.where("false"), ["k"], [F.col("i").asc()]).collect() == []
    got = number_rows(df, [], [F.col("i").asc()], "at", 9).collect()
    assert all(r["at"] == r["i"] + 1 for r in got) and len(got) == len(rows)


def test_other_kinds_are_refused(spark):
    df, _ = table(spark)
    with pytest.raises(TypeError, match="numeric"):
        running(cut_blocks(df, [], [F.col("i").asc()]), [], [F.col("i").asc()], {"x": ("max", F.col("k"))})


@pytest.mark.parametrize("blocks", [1, 3, 16])
@pytest.mark.parametrize("delta", [0.05, 0.5, 2.0])
def test_improvements_with_a_margin_over_blocks(spark, blocks, delta):
    rng = random.Random(blocks)
    runs = {"long": [i / 100 + rng.random() / 10 for i in range(300)], "short": [0.3, 0.1], "down": [0.9 - i / 50 for i in range(40)], "none": [float("nan"), -3.0]}
    rows = [(k, i, v) for k, vs in runs.items() for i, v in enumerate(vs)]
    log = spark.createDataFrame(rows, "run string, epoch int, val_f1 double")
    got = {(r["run"], r["epoch"]): r["improved"] for r in mark_improvements(log, ["run"], [F.col("epoch").asc()], min_delta=delta, blocks=blocks).collect()}
    for k, vs in runs.items():
        bar = -1.0
        for i, v in enumerate(vs):
            better = v > bar + delta
            assert got[k, i] == better, (k, i)
            bar = v if better else bar
