"""Line components against brute force."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from diffspark.llm import line_dedup as ld


def shingles(line):
    n = ld.SHINGLE
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def brute(rows, percent=80):
    places = [(d, k, x.strip(" ").lower()) for d, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    places = [p for p in places if p[2]]
    texts = sorted({p[2] for p in places})
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j < i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                parent[root(i)] = root(j)
    at = {t: i for i, t in enumerate(texts)}
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    head = {}
    for p in sorted(places, key=key):
        head.setdefault(root(at[p[2]]), p[:2])
    return [(*p[:2], *head[root(at[p[2]])]) for p in places]


def corpus(seed=4):
    rng = random.Random(seed)
    syllables = "ta ri on es mo la ve st en qu er si pa du ro ke li".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    pool = [" ".join(word() for _ in range(rng.choice([1, 3, 8, 30]))).capitalize() + "." for _ in range(60)]
    pool += ["漢字仮名交じり文の例文はここにあり、十分に長い行です。これは二つ目の文で、さらに続きます。"]
    rows = []
    for d in range(150):
        out = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(pool)
            if rng.random() < 0.5 and len(line) > 100:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyz") + line[at + 1 :]
            if rng.random() < 0.3:
                line = " ".join(word() for _ in range(12))
            out.append(rng.choice(["", " ", "  "]) + line)
            if rng.random() < 0.2:
                out.append(rng.choice(["", "  "]))
        rows.append((d * 3, "\n".join(out)))
    rows += [(1, None), (2, ""), (4, "\n\n"), (None, pool[0]), (7, "x " * 30_000), (8, "x " * 30_000 + "y"), (10, rows[3][1])]
    return rows


def test_components(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, node string").repartition(4)
    got = [tuple(r)[:4] for r in ld.line_components(docs).collect()]
    want = brute(rows)
    assert sorted(map(str, (g[:2] for g in got))) == sorted(map(str, (w[:2] for w in want)))
    # Links are exact; the banding may miss a few.
    head, true = {g[:2]: g[2:] for g in got}, {w[:2]: w[2:] for w in want}
    wrong = [p for p in true if head[p] != true[p]]
    assert len(wrong) <= 0.02 * len(true)


def test_documents_without_repeated_lines(spark):
    rows = [(2, "Some longer line of text here.\nOnly in the second document.", 5), (1, "some longer line of text here. ", 6), (3, None, 7)]
    rows += [(4, "", 8), (5, "Some longer line of text here.\n", 9), (6, "Unique words.\n\nUnique words.", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component int")
    got = {r["doc_id"]: r["text"] for r in ld.drop_repeated_lines(docs).collect()}
    assert got == {1: "some longer line of text here. ", 2: "Only in the second document.", 3: None, 4: "", 6: "Unique words.\n"}
    assert ld.drop_repeated_lines(docs.limit(0)).count() == 0 and ld.line_components(docs.limit(0)).count() == 0


def test_only_data_frame_functions(spark):
    plan = ld.line_components(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_all_hashes_of_long_lines(spark):
    text = "".join(random.Random(1).choice("abcdé漢🙂 ") for _ in range(500))
    for n in (1, 7, 8, 9, 39, 40, 41, 500):
        row = spark.createDataFrame([(text[:n],)], "line string").select(F.size(ld.all_hashes("line"))).first()
        assert row[0] == len(shingles(text[:n]))


def edited(rng, text):
    at = rng.randrange(len(text))
    return text[:at] + rng.choice("xyz") + text[at + 1 :]


def test_recall_by_the_shape_of_lines(spark):
    """Pairs of full Jaccard 0.8 or more that meet in a band, for lines of many and few words, of long words and of none."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    shapes = {"60 words": (60, 2, 7), "35 words": (35, 2, 7), "25 words": (25, 2, 7), "13 words": (13, 4, 9), "8 words": (8, 8, 14), "6 words": (6, 12, 20)}
    shapes |= {"4 words": (4, 20, 30), "3 words": (3, 30, 40), "one run": (1, 110, 140)}
    lines, pairs = [], []
    for name, (count, low, high) in shapes.items():
        found = 0
        while found < 60:
            a = " ".join(word(low, high) for _ in range(count))
            b = edited(rng, a)
            if 100 * len(shingles(a) & shingles(b)) >= 80 * len(shingles(a) | shingles(b)):
                pairs.append((name, len(lines), len(lines) + 1))
                lines += [a, b]
                found += 1
    urls = [f"https://example.com/{word(8, 12)}/{word(20, 40)}" for _ in range(60)]
    keyed = ld.band_keys(spark.createDataFrame(list(enumerate(lines + urls)), "i int, line string")).collect()
    keys = {r["i"]: {k for k in r[1:] if k is not None} for r in keyed}
    for name in shapes:
        own = [(a, b) for n, a, b in pairs if n == name]
        assert sum(bool(keys[a] & keys[b]) for a, b in own) >= 0.95 * len(own), name
    # Different addresses of one site do not all share a key.
    at = range(len(lines), len(lines) + len(urls))
    assert sum(bool(keys[a] & keys[b]) for a in at for b in at if a < b) < 0.1 * len(urls) * len(urls) / 2


def test_carriage_returns_and_tabs_are_white_space(spark):
    text = "First line of a letter here.\r\n\r\nSecond line of a letter here.\r\n\t\r\nThird line of a letter here.\r\n"
    rows = [(1, text), (2, "\r\n" + text + "And a line of its own.\t"), (3, "\r\n \t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in ld.drop_repeated_lines(docs).collect()}
    assert got[1] == text and got[3] == "\r\n \t" and got[2].split("\n")[-1] == "And a line of its own.\t" and "letter" not in got[2]
    assert {(r["id"], r["line_no"]) for r in ld.line_components(docs).collect() if r["id"] == 1} == {(1, 0), (1, 2), (1, 4)}


def test_clashing_names_of_other_columns(spark):
    names = ["holder", "_cut", "_all", "_line_id", "_lines", "_gone", "id", "node", "line", "raw", "k0", "component", "_line_text"]
    rows = [(1, "A line of text that is long enough.", *range(13)), (2, "A line of text that is long enough.\nAnother.", *range(13))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    assert ld.line_components(docs).count() == 3
    got = ld.drop_repeated_lines(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [rows[0], (2, "Another.", *range(13))]


def test_bitmaps_rule_out_unlike_lines_and_no_link(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmné漢🙂") for _ in range(rng.randint(2, 9)))
    pairs = []
    for n in (1, 2, 6, 20, 60, 120):
        for _ in range(40):
            a = " ".join(word() for _ in range(n))
            b = a
            for _ in range(rng.choice([0, 1, 2, 5, n, n])):
                b = edited(rng, b)
            pairs.append((a, b))
    pairs += [("x " * 300, "x " * 500 + "y"), ("a" * 200, "a" * 900), ("ab", "abc")]
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    bits = ld.bitmaps(spark.createDataFrame(rows, "node long, line string"))
    a = bits.select((F.col("node") / 2).cast("long").alias("i"), *[F.col(c).alias(f"{c}_a") for c in ("most", "bits")]).where("node % 2 = 0")
    b = bits.select(((F.col("node") - 1) / 2).cast("long").alias("i"), *[F.col(c).alias(f"{c}_b") for c in ("most", "bits")]).where("node % 2 = 1")
    likely = {r["i"] for r in a.join(b, "i").where(ld.can_link(80)).select("i").collect()}
    share = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs]
    assert {i for i, s in enumerate(share) if s >= 0.8} <= likely
    unlike = [i for i, s in enumerate(share) if s < 0.5]
    assert len(unlike) > 40 and sum(i in likely for i in unlike) <= 0.05 * len(unlike)


def test_repetitive_lines_have_keys(spark):
    rows = list(enumerate(["x " * 30_000, "=-" * 5_000, "abc " * 700 + "the end", "z", "漢" * 3_000]))
    keyed = ld.band_keys(spark.createDataFrame(rows, "i int, line string")).collect()
    assert sorted(r["i"] for r in keyed) == [0, 1, 2, 3, 4] and all(k is not None for r in keyed for k in r)


def test_bitmaps_of_long_lines_rule_out_unlike_ones(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghijklmn ") for _ in range(n))
    pairs = []
    for same in (800, 1300, 2450):
        passage = text(same)
        pairs += [(same, passage + text(2500 - same), passage + text(2500 - same)) for _ in range(20)]
    rows = [(2 * i + k, p[1 + k]) for i, p in enumerate(pairs) for k in (0, 1)]
    bits = ld.bitmaps(spark.createDataFrame(rows, "node long, line string"))
    a = bits.select((F.col("node") / 2).cast("long").alias("i"), *[F.col(c).alias(f"{c}_a") for c in ("most", "bits")]).where("node % 2 = 0")
    b = bits.select(((F.col("node") - 1) / 2).cast("long").alias("i"), *[F.col(c).alias(f"{c}_b") for c in ("most", "bits")]).where("node % 2 = 1")
    likely = {r["i"] for r in a.join(b, "i").where(ld.can_link(80)).select("i").collect()}
    assert likely == {i for i, (same, _, _) in enumerate(pairs) if same == 2450}


def test_lines_around_one_passage_are_not_verified(spark, monkeypatch):
    """All lines share keys, none are similar: they must fail the test of bitmaps in the join, before any pair is written out."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghijklmn ") for _ in range(n))
    passage = text(700)
    docs = spark.createDataFrame([(i, f"{text(200)} {passage} {text(200)}") for i in range(60)], "doc_id long, text string")
    tested, connect = [], ld.linking.connect

    def counted(postings, verify, *more):
        return connect(postings, lambda pairs: (tested.append(pairs.count()), verify(pairs))[1], *more)

    monkeypatch.setattr(ld.linking, "connect", counted)
    got = ld.line_components(docs).collect()
    assert len(got) == 60 and all(r["kept"] for r in got)
    assert tested and tested[-1] <= 30
