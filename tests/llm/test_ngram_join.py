"""Component ids of the n-gram join against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from diffspark.llm import linking, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j < i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), low[root(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(3)]
    texts = [None, "", " \n\t", "one", "One", "one two three four", "one two  THREE\nfour", "one two three four five", "É é", "é É"]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 40, 120]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(" ".join(base[:20]) + " " + rng.choice(common))
    base = [rng.choice(vocabulary) for _ in range(100)]
    for _ in range(60):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(100)] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("flush", [ngram_join.FLUSH, 900])
def test_components_against_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(ngram_join, "FLUSH", flush)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(5)
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(docs).collect())
    assert got == brute(rows)


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (4, "")], "doc_id long, text string")
    got = {tuple(r) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {(None, 2, 4), (4, 2, 4), (9, 2, 4), (4, 0, 4)}


def test_union_find(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = dict(map(tuple, linking.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: root(x) for x in parent}
