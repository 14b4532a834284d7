"""Many logistic regressions in shared scans."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from diffspark.plans import logistic


def rows(spark, n=600, d=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.array([1.0, 50.0, 0.01, 1.0])[:d] + np.array([0.0, 300.0, 0.0, 5.0])[:d]
    y = (rng.random(n) < logistic.sigmoid(x[:, 0] + (x[:, 1] - 300) / 50)).astype(float)
    data = [(x[i].tolist(), float(y[i]), [1, int(i % 3 != 0), int(i % 2)]) for i in range(n)]
    return spark.createDataFrame(data, "features array<double>, label double, masks array<int>").repartition(5)


def test_against_one_fit_each(spark):
    table = rows(spark)
    slots = [logistic.Slot(m, reg) for m in range(3) for reg in (0.0, 0.1)]
    models = logistic.fit(table, slots, 3, max_iter=200, tolerance=1e-10)
    for k, slot in enumerate(slots):
        own = table.where(F.get("masks", F.lit(slot.mask)) == 1).withColumn("x", array_to_vector("features"))
        one = LogisticRegression(featuresCol="x", regParam=slot.reg, maxIter=500, tol=1e-12).fit(own)
        assert np.allclose(models.weights[:, k], one.coefficients.toArray(), rtol=1e-3, atol=1e-5)
        assert models.intercepts[k] == pytest.approx(one.intercept, rel=1e-3, abs=1e-3)


def test_scans_do_not_grow_with_the_slots(spark):
    table = rows(spark)
    one = logistic.fit(table, [logistic.Slot(0, 0.1)], 3, max_iter=10)
    many = logistic.fit(table, [logistic.Slot(m, reg) for m in range(3) for reg in (0.01, 0.1, 1.0)], 3, max_iter=10)
    assert one.scans <= many.scans <= 2 * one.scans + 4


def test_reruns_agree_and_edge_cases(spark):
    table = rows(spark)
    a, b = (logistic.fit(t, [logistic.Slot(1, 0.1)], 3).weights for t in (table, table))
    assert (a == b).all()
    flat = table.withColumn("features", F.array(F.lit(7.0), F.get("features", F.lit(0))))
    assert logistic.fit(flat, [logistic.Slot(0, 0.0)], 3).weights[0, 0] == 0.0
    ones = logistic.fit(table.where("label = 1"), [logistic.Slot(0, 0.1)], 3)
    assert ones.probabilities(np.zeros((1, 4)))[0, 0] == 1.0
    with pytest.raises(ValueError, match="no training rows in mask 1"):
        logistic.fit(table.withColumn("masks", F.array(F.lit(1), F.lit(0))), [logistic.Slot(0, 0.1)], 2)
    with pytest.raises(Exception, match="one length"):
        logistic.fit(table.union(table.limit(1).withColumn("features", F.array(F.lit(1.0)))), [logistic.Slot(0, 0.1)], 3)
