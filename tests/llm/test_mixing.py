"""The mix against its definition: targets by repeated sharing, draws in order of the keys."""

import hashlib
import math
import random
from collections import defaultdict

from diffspark.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        more = {s for s in free if share[s] > most * sizes[s]}
        if not more:
            return {s: share.get(s, most * sizes[s]) for s in names}
        capped |= more


def docs(seed):
    pick = random.Random(seed)
    names = ["a", "b", "B", "é", "z" * 50, "", None]
    rows = [(i, "w " * pick.randint(0, 40), pick.choice(names[: 1 + i % len(names)]), pick.choice([None, 0.0, 1.0, 4.0, float("nan")])) for i in range(300)]
    return rows + [(500, None, "a", 1.0), (501, "", None, 1.0), (7, "again the same id", "a", 2.0), (None, "no id", "b", 1.0)]


def test_against_definition(spark):
    for seed in (1, 2):
        rows = docs(seed)
        table = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
        got = mixing.mix(table.repartition(7), quality_col="q").collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(table.repartition(2), quality_col="q").collect()), key=str)
        sizes = defaultdict(int)
        for _, text, source, _ in rows:
            sizes[source] += len((text or "").split())
        targets = brute_targets(sizes)
        assert len(got) == len(rows)
        taken, largest = defaultdict(int), defaultdict(int)
        for r in got:
            assert r.source_size == sizes[r.source]
            assert math.isclose(r.target, targets[r.source], rel_tol=1e-12, abs_tol=1e-9)
            assert r.taken == r.epochs * r.size <= 3 * r.size
            whole = int(r.target // max(r.source_size, 1))
            assert r.epochs in (whole, whole + 1)
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
        for s, t in targets.items():
            assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6

        def key(i, q):
            q = 1.0 if q is None else q
            u = (int(hashlib.md5(f"42:{i or 0}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / q if q > 0 else math.inf

        # Documents taken once more come before the others of their source in order of the keys.
        more = {s: [] for s in sizes}
        for i, text, source, q in rows:
            more[source].append((key(i, q), -1 if i is None else i, len((text or "").split())))
        for s, drawn in more.items():
            whole, before, want = int(targets[s] // max(sizes[s], 1)), 0, []
            for _, i, size in sorted(drawn):
                extra = size > 0 and whole < 3 and 2 * before + size <= 2 * (targets[s] - whole * sizes[s])
                want.append((i, size, (whole + extra) * size))
                before += size
            assert sorted(want) == sorted((-1 if r.id is None else r.id, r.size, r.taken) for r in got if r.source == s)


def test_quality_weights_decide_the_chance(spark):
    rows = [(i, "one two three", "a" if i % 2 else "b", 4.0 if i % 4 < 2 else 1.0) for i in range(8000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    got = mixing.mix(table, quality_col="q", weights=(1, 3)).collect()
    quality = {i: q for i, _, _, q in rows}
    drawn = [quality[r.id] for r in got if r.source == "a" and r.taken]
    assert 0.42 * len(drawn) < 4000 * 0.5 and drawn.count(4.0) > 2.0 * drawn.count(1.0)


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).collect() == []
    rows = [(1, "a b", "s", 0, "x", 9.0), (2, None, None, 1, "y", 9.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, _name string, target double")
    assert sorted((r.id, r.size, r.taken) for r in mixing.mix(table).collect()) == [(1, 2, 2), (2, 0, 0)]


def test_only_empty_texts(spark):
    table = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r.id, r.target, r.taken) for r in mixing.mix(table).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_very_long_text(spark):
    table = spark.createDataFrame([(1, "word " * 400_000, "a"), (2, "one", "a")], "doc_id long, text string, source string")
    assert sorted((r.id, r.size, r.taken) for r in mixing.mix(table).collect()) == [(1, 400_000, 400_000), (2, 1, 1)]
