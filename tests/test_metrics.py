import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffspark.functions.labels import hit_score
from diffspark.operators import metrics as M
from diffspark.operators.ordered import number_rows

SCHEMA = "eval_id string, ordinal long, y_true int, y_score double"


def table(spark, cases):
    rows = [
        (name, i, int(y), float(s)) for name, (ys, ss) in cases.items() for i, (y, s) in enumerate(zip(ys, ss, strict=True))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_key(df, key="eval_id"):
    return {r[key]: r for r in df.collect()}


def brute_ap(y, s):
    order = sorted(range(len(y)), key=lambda i: (s[i] if not math.isnan(s[i]) else math.inf, i), reverse=True)
    if sum(y) == 0:
        return 0.0
    tp, total = 0, 0.0
    for rank, i in enumerate(order, start=1):
        tp += y[i]
        if y[i]:
            total += tp / rank
    return total / sum(y)


def brute_auc(y, s):
    pos = [v for v, t in zip(s, y, strict=True) if t]
    neg = [v for v, t in zip(s, y, strict=True) if not t]
    if not pos or not neg:
        return 0.5
    low = lambda v: -math.inf if math.isnan(v) else v
    return sum(low(p) >= low(n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_f1(y, s):
    y, s = np.array(y), np.array(s)
    if y.sum() == 0:
        return 0.0, math.nan
    cuts = np.unique(s)
    best, at = 0.0, cuts[0]
    for t in cuts:
        hit = s >= t
        tp, fp, fn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum()
        if tp == 0:
            continue
        p, r = tp / (tp + fp), tp / (tp + fn)
        if 2 * p * r / (p + r) > best:
            best, at = 2 * p * r / (p + r), t
    return best, at


CASES = {
    "perfect": ((1, 1, 0, 0), (0.9, 0.8, 0.2, 0.1)),
    "known": ((1, 0, 0, 1), (0.9, 0.8, 0.7, 0.6)),
    "no positives": ((0, 0, 0), (0.9, 0.5, 0.1)),
    "inverted": ((0, 1), (0.9, 0.1)),
    "one class": ((1, 1), (0.9, 0.8)),
    "known f1": ((1, 0, 0, 0), (0.9, 0.6, 0.5, 0.1)),
    "ties": ((1, 0, 1, 0), (0.8, 0.8, 0.5, 0.5)),
    "all tied": ((1, 0, 1, 0, 0), (0.5,) * 5),
}


def test_hand_computed_values(spark):
    got = by_key(M.evaluate(table(spark, CASES), ["eval_id"]))
    assert got["perfect"]["ap"] == 1 and got["perfect"]["auc_roc"] == 1
    assert (got["perfect"]["f1"], got["perfect"]["threshold"]) == (1, 0.8)
    assert got["known"]["ap"] == pytest.approx(0.75)
    assert got["no positives"]["ap"] == 0 and got["no positives"]["f1"] == 0
    assert math.isnan(got["no positives"]["threshold"])
    assert got["inverted"]["auc_roc"] == 0
    assert got["one class"]["auc_roc"] == 0.5
    assert (got["known f1"]["f1"], got["known f1"]["threshold"]) == (1, 0.9)
    assert got["ties"]["ap"] == pytest.approx(0.5)
    assert got["all tied"]["ap"] == pytest.approx(11 / 30)
    assert got["all tied"]["auc_roc"] == 1.0
    grouped = by_key(M.average_precision(table(spark, CASES), ["eval_id"], ties="group"))
    assert grouped["all tied"]["ap"] == pytest.approx(0.4)


def test_two_and_one_logit_heads(spark):
    rows = [("one", 0, 1, [2.197]), ("one", 1, 1, [1.386]), ("one", 2, 0, [-1.386]), ("one", 3, 0, [-2.197])]
    rows += [("two", i, y, [-v[0], v[0]]) for _, i, y, v in rows]
    df = spark.createDataFrame(rows, "eval_id string, ordinal long, y_true int, logits array<double>")
    scored = df.withColumn("y_score", hit_score(F.col("logits")))
    got = by_key(M.evaluate(scored, ["eval_id"]))
    assert got["one"]["ap"] == got["two"]["ap"] == 1.0
    values = {(r["eval_id"], r["ordinal"]): r["y_score"] for r in scored.collect()}
    assert values["one", 0] == pytest.approx(0.9, abs=1e-4)
    assert values["two", 0] == pytest.approx(1 / (1 + math.exp(-4.394)), abs=1e-6)


def random_cases(seed, with_nan):
    rng = np.random.default_rng(seed)
    cases = {}
    for k, n in enumerate((1, 2, 7, 40, 150)):
        for levels in (2, 5, 1000):
            s = rng.integers(0, levels, n) / levels
            if with_nan:
                s[rng.random(n) < 0.2] = np.nan
            cases[f"{k}-{levels}"] = (rng.integers(0, 2, n), s)
    return cases


@pytest.mark.parametrize("blocks", [1, 3, 16])
@pytest.mark.parametrize("with_nan", [False, True])
def test_against_brute_force(spark, blocks, with_nan):
    cases = random_cases(blocks, with_nan)
    got = by_key(M.evaluate(table(spark, cases), ["eval_id"], blocks=blocks))
    for name, (y, s) in cases.items():
        y, s = list(map(int, y)), list(map(float, s))
        assert got[name]["ap"] == pytest.approx(brute_ap(y, s), abs=1e-12), name
        assert got[name]["auc_roc"] == pytest.approx(brute_auc(y, s), abs=1e-12), name
        f1, at = brute_f1(y, s)
        assert got[name]["f1"] == pytest.approx(f1, abs=1e-12), name
        assert got[name]["threshold"] == pytest.approx(at, nan_ok=True), name


def test_shortcuts_agree_with_evaluate(spark):
    scored = table(spark, random_cases(5, False))
    whole = by_key(M.evaluate(scored, ["eval_id"]))
    auc, f1 = by_key(M.auc_roc(scored, ["eval_id"])), by_key(M.best_f1(scored, ["eval_id"]))
    for name, row in whole.items():
        assert auc[name]["auc_roc"] == pytest.approx(row["auc_roc"])
        assert f1[name]["f1"] == pytest.approx(row["f1"])
        assert f1[name]["threshold"] == pytest.approx(row["threshold"], nan_ok=True)


def test_hot_key_is_spread_over_blocks(spark):
    """One evaluation with nearly all rows, half of them one score: no block may hold it whole."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") < 39_000, "hot").otherwise("cold").alias("eval_id"),
        F.col("id").alias("ordinal"),
        (F.col("id") % 3 == 0).cast("int").alias("y_true"),
        F.when(F.col("id") % 2 == 0, 0.5).otherwise((F.col("id") % 1000) / 1000.0).alias("y_score"),
    )
    from diffspark.operators.ordered import BLOCK, cut_blocks

    order = [F.col("y_score").desc(), F.col("ordinal").desc()]
    sizes = [r["count"] for r in cut_blocks(rows, ["eval_id"], order, 16).groupBy(BLOCK).count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 40_000 / 16 * 1.6
    local = [r.asDict() for r in rows.where("eval_id = 'hot'").orderBy("ordinal").collect()]
    y, s = [r["y_true"] for r in local], [r["y_score"] for r in local]
    got = by_key(M.evaluate(rows, ["eval_id"], blocks=16))
    assert got["hot"]["ap"] == pytest.approx(brute_ap(y, s), abs=1e-12)


def test_row_numbers_over_everything(spark):
    rows = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = number_rows(rows, [], [F.col("k")], "at", blocks=7).orderBy("k").collect()
    assert [r["at"] for r in got] == list(range(1, 1001))
    assert [r["k"] for r in got] == sorted(r["k"] for r in got)


def test_null_key_is_an_error(spark):
    rows = spark.createDataFrame([(None, 0, 1, 0.5)], SCHEMA)
    with pytest.raises(Exception, match="NULL in group column"):
        M.evaluate(rows, ["eval_id"]).collect()


def test_evaluation_without_rows(spark):
    evals = spark.createDataFrame([("perfect",), ("absent",)], "eval_id string")
    scored = table(spark, {"perfect": CASES["perfect"]})
    got = by_key(M.evaluate(scored, ["eval_id"], evals=evals))
    assert got["perfect"]["ap"] == 1.0
    assert got["absent"]["n"] == 0
    assert all(math.isnan(got["absent"][m]) for m in ("ap", "auc_roc", "f1", "threshold"))


def test_report_and_confusion_agree(spark):
    scored = table(spark, random_cases(9, True))
    report = by_key(M.evaluation_report(scored, ["eval_id"]))
    for name, row in report.items():
        assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == row["n"]
        if row["hits"] == 0:
            assert (row["tp"], row["fp"]) == (0, 0)
            continue
        counted = M.confusion(scored.where(F.col("eval_id") == name), ["eval_id"], F.lit(row["threshold"])).first()
        for c in ("tp", "fp", "fn", "tn"):
            assert counted[c] == row[c], (name, c)
        assert counted["precision"] == pytest.approx(row["precision"])
        assert counted["recall"] == pytest.approx(row["recall"])


def test_curves(spark):
    scored = table(spark, CASES)
    pr = M.pr_curve(scored, ["eval_id"]).where("eval_id = 'known'").orderBy("rank").collect()
    assert [r["precision"] for r in pr] == pytest.approx([1, 1 / 2, 1 / 3, 1 / 2])
    assert [r["recall_step"] for r in pr] == pytest.approx([0.5, 0, 0, 0.5])
    roc = M.roc_curve(scored, ["eval_id"]).where("eval_id = 'ties'").orderBy("step").collect()
    assert [(r["tpr"], r["fpr"]) for r in roc] == [(0, 0), (0.5, 0), (0.5, 0.5), (1, 0.5), (1, 1)]
