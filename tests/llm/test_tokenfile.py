"""Token files: round trip, order and the byte format."""

import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from diffspark.llm import storage, tokenfile, wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.sampled_from([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24]), max_size=40))
def test_pack_round_trip(ranks):
    control, data = tokenfile.pack(np.array(ranks, np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert tokenfile.unpack(control, data, len(ranks)).tolist() == ranks


def want(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_TOKENS", 300)
    rng = random.Random(4)
    texts = [None, "", " ", "<|endoftext|> x", "the the the " * 2000, "é\nñ"]
    texts += ["".join(rng.choice("abc DE,.\n9") for _ in range(rng.randint(0, 200))) for _ in range(120)]
    rows = list(zip(rng.sample(range(-500, 5000), len(texts)), texts, strict=True))
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, ids int").repartition(4)
    path = storage.shared_path(spark, "test-token-files")
    tokenfile.write(docs, path, PATH, partitions=5)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], tokenfile.checksum(bytes(r["ids"]))) for r in tokenfile.read(spark, path).collect())
    assert got == want(sorted(rows))
    counts = spark.read.parquet(f"{path}/ranks").count()
    assert counts == len({i for _, t in rows for i in [1, *Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids]})


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (1, "c d")], "doc_id long, text string")
    path = storage.shared_path(spark, "test-token-files")
    tokenfile.write(docs, path, PATH)
    got = tokenfile.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 1] and [r["start"] for r in got][0] == 0
    assert sum(r["n_tokens"] for r in got) == 9
    path = storage.shared_path(spark, "test-token-files")
    tokenfile.write(docs.limit(0), path, PATH)
    assert tokenfile.read(spark, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.sampled_from([0, 255, 256, 65535, 65536, 2**24]), max_size=9), min_size=1, max_size=8))
def test_many_runs_at_once(runs):
    counts = np.array([len(r) for r in runs], np.int64)
    flat = np.array([x for r in runs for x in r], np.uint32)
    control, data = tokenfile.pack_all(flat, counts)
    assert list(zip(control.to_pylist(), data.to_pylist(), strict=True)) == [tokenfile.pack(np.array(r, np.uint32)) for r in runs]
    assert tokenfile.unpack_all(control, data, counts).tolist() == flat.tolist()


def test_frequencies_without_another_look_at_the_ids(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, None), (3, "the")], "doc_id long, text string").repartition(2)
    coded = tokenfile._tokenise(docs, PATH, "doc_id", "text")
    the = Tokenizer.from_file(PATH).encode("the", add_special_tokens=False).ids[0]
    # Counts alone, no streams: the most frequent ids are that word and the end of a document, three times each.
    assert sorted(tokenfile._frequencies(coded.select("seen"))[:2].tolist()) == sorted([the, 1])


def test_latin_units_against_the_library(monkeypatch):
    """Words of Latin-1 letters, digits and marks go to the library's model without its normaliser, with the same ids."""
    library, tokenizer = wordbpe.Library(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(8)
    signs = [chr(c) for c in range(32, 256)] + [chr(c) for c in range(0xC0, 0x100)] * 3
    texts = ["Élan ÉTÉ, ¿qué? ¡Sí! über-Straße2024 ÿ Þ ×÷", "l'été <|endoftext|> µ ª º"] + ["".join(rng.choice(signs) for _ in range(60)) for _ in range(300)]
    for text in texts:
        assert library.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, library.type).tobytes(), text
    monkeypatch.setattr(wordbpe.Library, "_strange", None)
    assert library.encode("Élan été qué ¡aña!") and wordbpe.Library(PATH).encode("naïve Fräulein, garçon")
