"""Tiling against a plain greedy search, and planted benchmark passages."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from diffspark.llm import decontaminate as dc


def greedy(item, doc, minimum):
    free_item, free_doc, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and free_item[i + n] and free_doc[d + n]:
                    n += 1
                if n > best[2]:
                    best = (i, d, n)
        i, d, n = best
        if n < minimum:
            return out
        out.append(best)
        for k in range(n):
            free_item[i + k] = free_doc[d + k] = False


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=25), st.lists(st.integers(1, 3), max_size=40), st.integers(1, 4))
def test_tiles_against_greedy_search(item, doc, minimum):
    got = dc.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), minimum)
    assert got == greedy(item, doc, minimum)


@pytest.mark.parametrize("block", [dc.BLOCK_WORDS, 40])
def test_planted_passages(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    rng = random.Random(7)
    words = [f"t{i}" for i in range(500)]
    tests = [[rng.choice(words) for _ in range(40)] for _ in range(20)]
    items = [(i, " ".join(t).capitalize() + ".") for i, t in enumerate(tests)] + [(50, None), (51, ""), (52, "too short item")]
    items += [(53, items[3][1])]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, filler(60) + ", " + " ".join(t) + "! " + filler(30)) for i, t in enumerate(tests[:5])]
    t = tests[6]
    docs += [(10, filler(10) + " " + " ".join(t[20:]) + " " + filler(5) + " " + " ".join(t[:20]))]  # reordered
    docs += [(11, " ".join(t[:12])), (12, filler(300)), (13, None), (14, ""), (None, " ".join(tests[7])), (15, "too short item")]
    docs += [(16, filler(20_000) + " " + " ".join(tests[8])), (0, docs[0][1])]
    docs = spark.createDataFrame([(d, x, 0) for d, x in docs], "doc_id long, text string, item int").repartition(3)
    got = dc.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(i, i) for i in range(5)] + [(3, 53), (10, 6), (None, 7), (16, 8), (0, 0)]
    assert sorted(map(str, ((r["doc_id"], r["item"]) for r in got))) == sorted(map(str, want))
    assert next(r for r in got if r["doc_id"] == 10)["n_tiles"] >= 2
    assert dc.contaminated(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert dc.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_scripts_without_spaces_and_other_marks(spark):
    texts = ["漢字仮名交じり文の例文はここにあり、十分に長い行です。", "ผู้เขียนกล่าวถึงเรื่องนี้ไว้ในหนังสือเล่มแรก", "She said: \"it isn't here\", and he went - slowly - to the old mill", "ÉTÉ À LA MER AVEC LES ÉLÈVES DE L'ÉCOLE"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = ["前の文章です。" + texts[0] + "後の文章もここにあります。", "บทนำ" + texts[1] + "จบ", "Then: she said: “it isn’t here”, and he went\u00a0– slowly\u00a0– to the old\u00a0mill.", "été à la mer avec les élèves de l’école", "全く別の内容を持つ文書で、何も共有しない。", None, "plain words only in this one here"]
    got = dc.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), items).collect()
    assert sorted((r["doc_id"], r["item"], r["covered_words"] == r["item_words"]) for r in got) == [(i, i, True) for i in range(4)]
