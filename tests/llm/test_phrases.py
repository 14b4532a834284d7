"""Phrases against a direct reading of their definition."""

import random
import re
from collections import Counter, defaultdict

import pytest

from diffspark.llm import phrases


def brute(rows, least, first=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = set()
    for lang, f in counts.items():
        found = []
        frequent = [p for p, a in f.items() if a >= least and len(p) > 1]
        inside = {p[i:j] for p in frequent for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and f[p] >= f[p[i:j]]}
        for p in frequent:
            a = f[p]
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in inside:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def texts(seed, n):
    pick = random.Random(seed)
    words = ["new", "York", "of", "the", "en", "es", "état", "x", "y z", "New"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(pick.randint(0, 30)):
            parts.append(pick.choice(words) if pick.random() < 0.7 else "new York of the state")
            parts.append(pick.choice([" ", " ", " ", "\t", "  ", ", ", ".\r\n", "!? "]))
        out.append(("".join(parts), pick.choice(["en", "es", "", None, "und"])))
    return out + [(None, "en"), ("", None), (" \t ", "fr"), ("." * 50, "fr")]


@pytest.mark.parametrize("least,first", [(3, 2000), (9, 12)])
def test_against_brute_force(spark, least, first):
    rows = texts(least, 160)
    docs = spark.createDataFrame([(t, lang, 1) for t, lang in rows], "text string, lang string, hash int").repartition(5)
    got = phrases.collocations(docs, least=least, first=first)
    assert {tuple(r) for r in got.collect()} == brute(rows, least, first)


def test_full_filter(spark):
    # A bitmap so full that it lets nearly everything pass.
    rows = [(" ".join(random.Random(i).choices("abcdef", k=400)), "en") for i in range(3)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = phrases.collocations(docs, least=5, filter_bits=8)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5)


def test_long_text_over_several_rows(spark):
    words = random.Random(1).choices(["a", "b", "c", "d"], k=phrases.CHUNK_WORDS + 1000)
    text = " ".join(words)
    docs = spark.createDataFrame([(text, "en")], "text string, lang string")
    got = {r.phrase: r.a for r in phrases.collocations(docs).collect()}
    want = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    assert got and all(want[tuple(p.split())] == a for p, a in got.items() if p.count(" ") == 4)


def test_exact_beyond_64_bits(spark):
    # 1000 * a * n is beyond 64 bits where a * n is beyond 2^54.
    row = spark.range(1).selectExpr(
        "cast(1000 as decimal(4,0)) * (cast(90000000000 as decimal(17,0)) * cast(9000000000000 as decimal(17,0))) "
        "div (cast(90000000000 as decimal(19,0)) * cast(90000000001 as decimal(19,0))) as s"
    )
    assert row.first().s == 1000 * 90000000000 * 9000000000000 // (90000000000 * 90000000001)


def test_no_rows_and_no_frequent_phrase(spark):
    for rows in ([], [("one two three", "en")], [(None, None)]):
        assert phrases.collocations(spark.createDataFrame(rows, "text string, lang string")).collect() == []
