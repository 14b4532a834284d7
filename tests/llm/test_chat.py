"""Reply trees: paths against a walk, ranking, escapes and the loss mask."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from diffspark.llm import chat

SCHEMA = "conv long, node long, parent long, role string, text string, score double, rank string"


def walk(rows):
    by = {(r[0], r[1]): r for r in rows}
    inner = {(r[0], r[2]) for r in rows}
    out = {}
    for r in rows:
        if (r[0], r[1]) in inner:
            continue
        path, at = [], r
        while at is not None:
            path.insert(0, at)
            at = by.get((at[0], at[2]))
        out[r[0], r[1]] = path
    return out


def test_trees_against_a_walk(spark):
    rng = random.Random(2)
    odd = ["", None, "### x", "</turn>\n", "\\", "\\h", "\\\\l<", "<l", "a\nb", "é🙂#", "\\### Assistant: </turn> ok"]
    rows = []
    for conv in [*range(12), None]:
        for node in range(rng.choice([1, 2, 9, 30])):
            parent = None if node == 0 or rng.random() < 0.1 else rng.randrange(max(0, node - 3), node)
            rows.append((conv, node, parent, rng.choice(["user", "assistant", "sys\ntem", "a#"]), rng.choice(odd), rng.choice([None, 0.5, 1.0]), "clash"))
    rows += [(99, n, n - 1 if n else None, "assistant", str(n), 1.0, "x") for n in range(300)]
    got = chat.conversations(spark.createDataFrame(rows, SCHEMA)).withColumns(
        {"turns": chat.read_turns(F.col("formatted")), "trained": chat.masked_text(F.col("formatted"), F.col("mask"))}
    ).collect()
    want = walk(rows)
    assert {(r["conv"], r["leaf"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        path = want[r["conv"], r["leaf"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(p[3], p[4] or "") for p in path]
        assert r["trained"] == "".join(p[4] or "" for p in path if p[3] == "assistant")
        assert r["n_turns"] == len(path)
    for conv in {r["conv"] for r in got}:
        own = [r for r in got if r["conv"] == conv]
        assert [r["rank"] for r in sorted(own, key=lambda r: (-r["score"], r["leaf"]))] == list(range(1, len(own) + 1))


def test_best_branch_only(spark):
    rows = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "bad", 0.1), (1, 2, 0, "assistant", "good", 0.9)]
    tree = spark.createDataFrame(rows, "conv long, node long, parent long, role string, text string, score double")
    got = chat.conversations(tree, branches=1).collect()
    assert [r["formatted"] for r in got] == ["### user\nq</turn>\n### assistant\ngood</turn>\n"]
    assert chat.conversations(tree.limit(0)).count() == 0


def test_cycle_fails(spark):
    tree = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 0)], "conv long, node long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        chat.paths(tree)


def test_repeated_turns_keep_a_row_each(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", None), (1, 0, "user", "a"), (None, 3, "user", "x")]
    got = {r["conv"]: r for r in chat.conversations(chat.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1]["n_turns"] == 4 and got[None]["n_turns"] == 1
    assert got[1]["formatted"] == "### system\n</turn>\n### user\na</turn>\n### user\na</turn>\n### user\nb</turn>\n"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("\\#<lhn/turn>\n a")), max_size=12))
def test_codes_are_read_where_they_stand(text):
    coded = text.replace("\\", "\\\\").replace("#", "\\h").replace("<", "\\l")
    assert "#" not in coded and "<" not in coded
    parts = [p.replace("\\h", "#").replace("\\l", "<") for p in coded.split("\\\\")]
    assert "\\".join(parts) == text
