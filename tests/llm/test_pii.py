"""Personal data: base hits against plain regular expressions, disclosure against counting, spans and sanitised texts."""

import math
import random
import re

from pyspark.sql import functions as F

from diffspark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def ok(kind, hit):
    digits = re.sub(r"\D", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


def test_base_hits(spark):
    rng = random.Random(6)
    parts = ["a@b.co", "x.y+z@d-e.f.gh", "@", ".", "4111 1111 1111 1111", "5500-0000-0000-0004", "12", "+49 30 (123) 456-78", "+1.", "10.0.0.1", "256.1.1.1"]
    parts += ["00000000000000000001.2.3.4", "1.2.3.4.5.6.7.8", "\n", " ", "é🙂", "word", "_", "%", "a@b.c_d@e.f", "-", "+", "4111111111111111"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "-"]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += [None, "", "1 " * 40_000, "a" * 60_000 + "@", "a@" + "b." * 20_000 + "c", "+1" + "2" * 60_000, "1.2." * 20_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "q@r.st", "x"), (0, texts[0], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string").repartition(4)
    got = sorted((str(r["id"]), [(s["kind"], s["start"], s["end"]) for s in r["base"]]) for r in pii.personal_data(docs).collect())
    assert got == sorted((str(i), brute(t)) for i, t, _ in rows)
    assert pii.personal_data(docs.limit(0)).count() == 0


def planted():
    rng = random.Random(8)
    words = [f"word{i}x" for i in range(60)]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{fill(12)}\n{fill(6)} Zorblatt {fill(3)} zed@mail.org {fill(4)}\n{fill(5)}") for i in range(6)]
    rows += [(10 + i, fill(30) + "\n" + fill(20)) for i in range(60)]
    rows += [(100, "Zorblatt alone, far from it")]
    return rows


def test_disclosing_terms_against_counting(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosing_terms(docs, pii.hits(docs), threshold=-9, support=2).collect()}
    lines = [x for _, t in rows for x in t.split("\n") if x.strip()]
    terms = [set(re.findall(r"[^\W_]{3,}", x.lower())) for x in lines]
    having = [("zed@mail.org" in x) for x in lines]
    n_entity = sum(having)
    want = {}
    for term in set().union(*terms) - {"zed", "mail", "org"}:
        both = sum(h and term in t for h, t in zip(having, terms, strict=True))
        if both >= 2:
            n_term = sum(term in t for t in terms)
            want["email:zed@mail.org", term] = math.log(len(lines) * both / (n_term * n_entity)) / math.log(len(lines) / n_entity)
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_term_spans_and_sanitised_text(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r for r in pii.personal_data(docs).collect()}
    text = dict(rows)
    for i in range(6):
        assert [text[i][s["start"] : s["end"]] for s in got[i]["terms"]] == ["Zorblatt"]
    assert all(not got[i]["terms"] for i in (10, 100))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[0] == text[0].replace("Zorblatt", "[TERM]").replace("zed@mail.org", "[EMAIL]")
    assert clean[100] == text[100]


def test_copies_of_one_line_are_no_evidence(spark):
    docs = spark.createDataFrame([(i, "Kilroy writes to k@mail.org now") for i in range(9)] + [(10, "else here")], "doc_id long, text string")
    assert pii.personal_data(docs).select(F.sum(F.size("terms"))).first()[0] == 0


def test_terms_beside_entities_of_one_line(spark):
    rng = random.Random(9)
    words = [f"word{i}x" for i in range(60)]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{fill(20)}\n{fill(20)}") for i in range(200)]
    rows += [(300, f"{fill(3)} Wendeline {fill(3)} w@home.net"), (301, f"{fill(4)} Ottokar +49 30 1234 5678\nOttokar again")]
    rows += [(400 + i, "Kilroy writes to k@mail.org now") for i in range(9)]
    rows += [(500 + i, f"odd{i}odd {fill(4)} info@firm.org") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = [x for _, t in rows for x in t.split("\n")]
    terms = [set(re.findall(r"[^\W_]{3,}", x.lower())) for x in lines]
    entities = {"w@home.net": "email:w@home.net", "+49 30 1234 5678": "phone:493012345678", "k@mail.org": "email:k@mail.org", "info@firm.org": "email:info@firm.org"}
    want = {}
    for mark, name in entities.items():
        n_entity = sum(mark in x for x in lines)
        own = set(re.findall(r"[^\W_]{3,}", mark))
        for term in set().union(*(t for x, t in zip(lines, terms, strict=True) if mark in x)) - own:
            held = [x for x, t in zip(lines, terms, strict=True) if mark in x and term in t]
            n_term = sum(term in t for t in terms) + len(held) / len(set(held))
            value = math.log(len(lines) * len(held) / (n_term * n_entity)) / math.log(len(lines) / n_entity)
            if value >= 0.8:
                want[name, term] = value
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosing_terms(docs, pii.hits(docs)).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    text = dict(rows)
    spans = {r["id"]: [text[r["id"]][s["start"] : s["end"]] for s in r["terms"]] for r in pii.personal_data(docs).collect()}
    assert spans[300] == ["Wendeline"] and spans[301] == ["Ottokar"] and not spans[0]
    # Each rare word is marked in its own line alone.
    assert all(spans[500 + i] == [f"odd{i}odd"] * (("email:info@firm.org", f"odd{i}odd") in want) for i in range(40))


def test_only_data_frame_functions(spark):
    docs = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    plan = pii.personal_data(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
