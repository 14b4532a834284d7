"""Quality rules and BPE against brute force."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from diffspark.llm import bpe, quality, wordbpe

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts(n=300, seed=3):
    rng = random.Random(seed)
    alphabet = list("aAbB zé́ÉΣςİ 's'RE0189½ 。漢か🙂\xa0\x85\x1c\x00\t\n\r!?$$<|># \n\n") + ["<|endoftext|>", "don't ", "one two "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    texts += [None, "", "   \n\t ", "word", "a b c d e f g h " * 9, "x\nx\nx\n\n x", "long " * 30_000, "a|b|c| d | e\n" * 40]
    return texts + texts[:20]


def frame(spark, texts):
    rows = [(i if i % 50 else None, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)


def measures(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    hit = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed)


def test_quality_measures(spark):
    texts = odd_texts()
    got = quality.quality(frame(spark, texts)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(measures(t) for t in texts)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_cuts_lines_and_rejects(spark):
    clean = "A plain sentence of words that says something here.\n" * 1 + " ".join(f"w{i}" for i in range(40)) + "."
    menu = "Home | News | About | Contact | More | Help | Shop | Jobs | Team | Blog | Talk | Press"
    rows = [(1, clean), (2, clean + "\n" + "Home | News | About"), (3, menu + "\n" + menu.lower() + "\nshort words"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in quality.keep_clean(docs).collect()}
    assert kept == {1: clean, 2: clean + "\n"}


def test_prose_lines_are_not_boilerplate():
    fault = lambda x: quality.line_fault(x, len(x.split()), quality.LineRules())
    prose = ["The design in the hall is by a pupil of his.", "He kept a blog in French.", "A dialog in three parts.", "She baked one cookie for each of the guests that evening."]
    prose += ["यह एक वाक्य है और इसमें कई शब्द हैं। " * 5, "یہ ایک جملہ ہے اور اس میں کئی الفاظ ہیں۔ " * 5, "ผู้เขียน กล่าวถึง เรื่องนี้ " * 12]
    prose += ["यह एक वाक्य है। " * 8 + "और शब्द"]
    assert [fault(x) for x in prose] == [None] * len(prose)
    boiler = ["Sign in", "Copyright 2020 Some Firm. All rights reserved.", "Privacy Policy - Terms of Service", "© 2019 Firm", "We use cookies. Read more", "Subscribe now"]
    boiler += ["Licensed under the Apache License, SPDX-License-Identifier: Apache-2.0"]
    assert [fault(x) for x in boiler] == ["boilerplate"] * len(boiler)
    assert fault("word " * 40) == "punctuation"


def test_quality_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality(docs).count() == 0 and quality.keep_clean(docs).count() == 0


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_round_trip(spark, reference):
    texts = odd_texts()
    rows = bpe.encode_documents(frame(spark, texts), public_tokenizers.path("word_bpe_49k.json")).collect()
    want = [reference.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sorted((r["ids"], r["decoded"]) for r in rows) == sorted((w, reference.decode(w, skip_special_tokens=False)) for w in want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_pieces_table_starts_anew(monkeypatch, reference):
    monkeypatch.setattr(wordbpe, "TABLE_ENTRIES", 5)
    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib = wordbpe.WordBPE(path), wordbpe.Library(path)
    for text in [t for t in odd_texts(80) if t]:
        want = reference.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        assert np.frombuffer(lib.encode(text), lib.code).tolist() == want
