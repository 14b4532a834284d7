"""Counts after edits against encoding the edited text anew."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from diffspark.llm import edit_counts as ec

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def pre():
    return ec.counter(RANKS, PATTERN)


ALPHABET = list("aab  \n\t'slrevd.,!19é漢🙂") + ["'ll", "   ", "\n\n", " word", "'re"]


def test_tree_follows_random_edits(pre, monkeypatch):
    rng = random.Random(11)
    for slot in (1, 3, 16):
        monkeypatch.setattr(ec, "SLOT", slot)
        for _ in range(300):
            text = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 5, 40, 300])))
            tree = ec.Tree.of(text, pre)
            for _ in range(6):
                start = rng.randint(0, len(text))
                stop = rng.randint(start, min(len(text), start + rng.choice([0, 1, 3, 50])))
                new = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 0, 1, 4, 20])))
                want = text[:start] + new + text[stop:]
                text, _ = tree.edit(text, start, stop, new, pre)
                assert text == want
                assert tree.tokens == len(pre.encoding.encode_ordinary(text)), (want, start, stop, new)
                assert tree.chars == len(text)


def test_far_text_is_not_read_again(pre):
    text = "plain words in a row, " * 5000
    tree = ec.Tree.of(text, pre)
    text, read = tree.edit(text, 50_000, 50_003, "xyz", pre)
    assert read < 100 and tree.tokens == len(pre.encoding.encode_ordinary(text))


def test_edits_of_documents(spark, pre):
    rows = [(1, "hello there", [(0, 5, "Bye"), (None, None, " end"), (3, None, "x")], "c"), (2, None, [(0, 0, "new text")], "c"), (None, "", None, "c")]
    rows += [(3, "keep me", [], "c"), (3, "keep me", [None, (99, 5, None)], "c"), (4, "long text " * 20_000, [(77_777, 77_790, None)], "c")]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {ec.EDITS}, tree string").repartition(2)
    trees = ec.build(docs, RANKS, PATTERN, keep=("edits",))
    got = ec.apply_edits(trees, RANKS, PATTERN).orderBy("doc_id", "n_edits").collect()
    for r in got:
        assert r["n_tokens"] == len(pre.encoding.encode_ordinary(r["text"]))
    assert [r["text"][:20] for r in got] == ["", "Byex there end", "new text", "keep me", "keep me", "long text long text "]
    assert trees.where(F.col("doc_id") == 1).first()["n_tokens"] == 2
    assert ec.apply_edits(ec.build(docs.limit(0), RANKS, PATTERN, keep=("edits",)), RANKS, PATTERN).count() == 0
