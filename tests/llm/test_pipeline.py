"""The pipeline's stages, each on its own input, against plain Python."""

import random

import pytest

import corpus_pipeline as cp

rng = random.Random(12)
VOCABULARY = [f"{a}{b}" for a in "bacedifogu" for b in ("lamen", "torin", "sk", "pado", "ven", "rilo", "mest", "kura")]


def sentence(n):
    return (" ".join(rng.choice(VOCABULARY) for _ in range(n)) + ".").capitalize()


def corpus():
    test = sentence(40)
    base = "\n".join(sentence(30) for _ in range(4))
    words = base.split(" ")
    words[50] = "changed"
    shared = sentence(25)
    docs = {1: base, 2: base, 3: " ".join(words), 4: sentence(60) + " " + test + " " + sentence(20), 5: "too short", 6: None, 7: ""}
    docs |= {8: shared + "\n" + sentence(50), 9: sentence(50) + "\n" + shared, 10: "A | B | C | D\n" * 30, 11: sentence(200)}
    docs |= {12: "Home | News | Mail | Shop\n" + sentence(80)}
    return docs, shared, test


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, shared, test = corpus()
    path = tmp_path_factory.mktemp("corpus")
    frame(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, test), (1, sentence(40))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, shared


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_one_by_one(spark, folder):
    path, docs, shared = folder
    stages = dict(cp.STAGES)
    docs_in = spark.read.parquet(f"{path}/documents.parquet")
    clean = stages["quality_rules"](spark, docs_in, path)
    assert clean.columns == docs_in.columns
    assert set(texts(clean)) == {1, 2, 3, 4, 8, 9, 11, 12} and texts(clean)[12] == docs[12].split("\n")[1]
    lines = stages["line_dedup"](spark, clean, path)
    assert lines.columns == docs_in.columns
    got = texts(lines)
    assert 2 not in got and got[1] == docs[1] and got[9] == docs[9].split("\n")[0] and got[8] == docs[8]
    near = stages["ngram_jaccard"](spark, docs_in, path)
    assert near.columns == docs_in.columns and set(texts(near)) == set(docs) - {2, 3}
    left = stages["decontamination"](spark, docs_in, path)
    assert left.columns == docs_in.columns and set(texts(left)) == set(docs) - {4}


def test_run_is_the_stages_in_turn(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, path)
    want = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, cp.run(spark, path).collect())) == want
    assert {w[0] for w in want} >= {1, 8, 9, 11, 12} and not {2, 4, 5, 6, 7, 10} & {w[0] for w in want}


def test_empty_and_odd_rows(spark, folder):
    path, docs, _ = folder
    empty = frame(spark, docs).limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, path).count() == 0
    odd = spark.createDataFrame([(None, docs[11], None, None, None), (11, docs[11], "en", "s", 5), (11, docs[11], "en", "s", 5)], empty.schema)
    for _, stage in cp.STAGES:
        assert stage(spark, odd, path).count() >= 1


def test_clashing_names_and_a_very_long_text(spark, folder):
    path, docs, _ = folder
    names = ["id", "component_id", "found", "holder", "_cut", "_kept", "_found", "item", "kept", "cleaned", "ids", "node"]
    rows = [(i, t, *range(12)) for i, t in docs.items()] + [(99, "\n".join(sentence(40) for _ in range(4000)), *range(12))]
    table = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, table, path)
        assert got.columns == table.columns and 99 in {r["doc_id"] for r in got.collect()}, name
    assert cp.STAGES[-1][1](spark, table, path).where("doc_id = 99").first()["n_tokens"] > 100_000
