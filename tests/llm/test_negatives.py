"""Hard negatives against brute force."""

import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from diffspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, windows string"


def brute(rows, anchor=lambda i: i % 5 == 0, positives=5, negatives_=3):
    good = []
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for i in sorted({i for i, _, _ in good if anchor(i)}):
        _, q, label = min((r for r in good if r[0] == i), key=lambda r: (r[2], r[1]))
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, lab) for j, v, lab in good if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, rank, n, -s, -ns) for rank, (ns, n, _) in enumerate(inside[:negatives_], 1)]
    return sorted(out)


def vectors(seed, n, labels=4, width=6):
    pick = random.Random(seed)
    rows = [(i, [pick.choice([-0.5, 0.0, 0.25, 0.5, pick.gauss(0, 1)]) for _ in range(width)], pick.randrange(labels), i, "w") for i in range(n)]
    rows += [(n, None, 1, 0, ""), (n + 1, [1.0] * width, None, 0, ""), (n + 2, [float("nan")] + [1.0] * (width - 1), 1, 0, "")]
    rows += [(n + 3, [None] + [1.0] * (width - 1), 1, 0, ""), (n + 4, [float("inf")] * width, 2, 0, ""), (None, [1.0] * width, 0, 0, "")]
    return rows


def run(spark, rows, **more):
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = negatives.hard_negatives(table, F.col("vec_id") % 5 == 0, **more).collect()
    return sorted(map(tuple, got))


def test_against_brute_force_over_blocks(spark):
    for seed, block_rows in ((1, 1000), (2, 17)):
        rows = vectors(seed, 120)
        assert run(spark, rows, block_rows=block_rows, least_rows=10) == brute(rows)


def test_ties_repeated_rows_and_one_label(spark):
    same = [(i, [0.5, 0.5], i % 3, 0, "") for i in range(60)] + [(7, [0.5, 0.5], 0, 0, "")] * 9 + [(11, [0.25, 0.25], 2, 0, "")] * 9
    assert run(spark, same, least_rows=8) == brute(same)
    assert run(spark, [(i, [1.0, i / 10], 3, 0, "") for i in range(20)]) == []


def test_zero_and_negative_scores_and_ragged_vectors(spark):
    rows = [(0, [0.0, 0.0], 1, 0, ""), (1, [1.0, 1.0], 1, 0, ""), (2, [2.0, -3.0], 2, 0, ""), (5, [-1.0, -1.0], 1, 0, ""), (6, [0.5], 2, 0, ""), (10, [], 2, 0, "")]
    assert run(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [300_000.0 + i, -20_000.5 * i], i % 2, 0, "") for i in range(30)]
    assert run(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None, None, None, None)]) == []


def test_keys_sort_as_their_parts():
    pick = random.Random(5)
    parts = [(pick.randint(-3, 3), pick.choice([-(2**60), -1, 0, 1, 2**60]), pick.randint(-5, 5)) for _ in range(300)]
    import numpy as np

    a, s, i = (np.array(x, np.int64) for x in zip(*parts))
    keys = negatives.pack_keys(a, s, 1, i)
    assert [x.tolist() for x in negatives.unpack_keys(keys)] == [a.tolist(), s.tolist(), [1] * 300, i.tolist()]
    order = sorted(range(300), key=lambda k: keys[k].as_py())
    assert [(a[k], -s[k], i[k]) for k in order] == sorted((x, -y, z) for x, y, z in parts)
    assert pa.types.is_binary(keys.type)
