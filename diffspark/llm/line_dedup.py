"""Fuzzy line deduplication with DataFrame functions only: MinHash, banding, exact Jaccard, distributed union-find.

A line is trimmed and lower-cased; equal lines are one *node* from there on.  Its signature is one-permutation MinHash over all its
shingles of 8 bytes: the smallest hash in each of 32 parts of the hash range.  Each band takes the four smallest of these at or above its
own start, going round at the top, so two lines of similarity s agree in a band with probability about s^4.  Lines that agree in a
band are candidates; candidates link when the Jaccard similarity of all their *character* shingles reaches the threshold.
Before that, bitmaps of the character shingles rule out pairs that differ in too many bits to reach it; this loses none.  Smaller ones do
so inside the last join, where all lines of a key meet.
Hashes are made in rows of their own, not inside array functions, so Spark compiles that work.
Nodes are named by 64-bit hashes of their text, so results are exact up to a hash collision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.llm import linking, storage

SHINGLE = 8
BANDS, MINS_PER_BAND = 8, 4
#: Shingles that a part of the hash range keeps on average, the others having larger hashes; a part that stays empty does so in
#: similar lines alike.
PER_PART = 3
#: Bytes from which a line's repeated words do not count as shingles of it.
LONG = 512
#: Longs of the bitmap of a candidate line; those it is folded to for the tests of pairs; and for the join on a key.
WIDE, BITMAP, FOLDED = 128, 32, 16
#: Nodes (8 bytes each) up to which the list of candidate lines is broadcast; a longer list is shuffled.
BROADCAST_NODES = 1_000_000
_AT_ONCE, _AT_A_TIME = 1024, 8

# Fixed value: the white space that is no part of a line.
_BLANK = " \t\n\x0b\x0c\r"


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, line_no, line, node)`` of every line that is not blank, numbered from 0 among all lines of its text."""
    cut = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "raw"))
    cut = cut.withColumn("raw", F.trim("raw"))
    # To trim a set of characters takes a step for each of the line, so it is done where one of them stands at an end.
    ends = reduce(Column.__or__, [end("raw", F.lit(c)) for c in _BLANK[1:] for end in (F.startswith, F.endswith)])
    cut = cut.withColumn("raw", F.when(ends, F.btrim("raw", F.lit(_BLANK))).otherwise(F.col("raw"))).where("raw != ''")
    return cut.select("id", "line_no", F.lower("raw").alias("line")).withColumn("node", F.xxhash64("line"))


def all_hashes(line: str) -> Column:
    """Distinct hashes of all character shingles of column ``line``; a shorter line is one shingle.

    In UTF-32 every character has four bytes, so a shingle is cut out at its place without a search for it.
    """

    def of(wide: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.octet_length(wide) - 4 * SHINGLE + 1, F.lit(1)), F.lit(4))
        return F.transform(places, lambda i: F.xxhash64(F.substr(wide, i, F.lit(4 * SHINGLE))))

    return F.array_distinct(F.flatten(F.transform(F.array(F.encode(line, "UTF-32")), of)))


def _exploded(of_line: DataFrame, carried: list[str], unit: int = 1) -> DataFrame:
    """``carried``, ``_n``, ``_first`` and the ``_hash`` of each shingle of the ``_bytes``, of which each character takes ``unit``.

    A copy of _AT_ONCE characters is made for the shingles that begin there, and shingles are cut out of that.
    """
    parts = of_line.withColumn("_n", F.expr(f"cast(greatest(octet_length(_bytes) / {unit} - {SHINGLE - 1}, 1) as int)"))
    parts = parts.withColumn("_at", F.explode(F.expr(f"sequence(0, _n - 1, {_AT_ONCE})")))
    parts = parts.select(*carried, "_n", "_at", F.expr(f"substring(_bytes, {unit} * _at + 1, {unit * (_AT_ONCE + SHINGLE - 1)})").alias("_cut"))
    places = parts.withColumn("_place", F.explode(F.expr(f"sequence(0, least({_AT_ONCE}, _n - _at) - 1)")))
    shingle = f"xxhash64(substring(_cut, {unit} * _place + 1, {unit * SHINGLE}))"
    return places.select(*carried, "_n", F.expr("_at + _place = 0").alias("_first"), F.expr(shingle).alias("_hash"))


KEYS = [f"k{b}" for b in range(BANDS)]


def band_keys(of_line: DataFrame) -> DataFrame:
    """The rows of ``of_line`` with one ``k0, k1, ...`` per band in place of ``line``, which the other columns must determine.

    Equal rows are one.
    """
    parts = BANDS * MINS_PER_BAND
    carried = [c for c in of_line.columns if c != "line"]
    # The rows of a line stay in its task from here on.
    own = of_line.repartition(*carried).distinct()
    distinct = F.octet_length(F.array_join(F.array_distinct(F.split("line", " ")), " "))
    own = own.select(*carried, F.when(F.octet_length("line") > LONG, distinct).otherwise(F.octet_length("line")).alias("_about"), F.col("line").cast("binary").alias("_bytes"))
    hashed = _exploded(own, [*carried, "_about"])
    # The first bits name the part, the next 32 the height in it.  High ones are no part's least if it has any other.  The first shingle
    # stays, so that no line is without any.
    width = parts.bit_length() - 1
    low = f"(_hash >>> {32 - width} & {(1 << 32) - 1}) * _about < {PER_PART * parts << 32}"
    hashed = hashed.where(f"{low} or _first").withColumn("_part", F.expr(f"cast(_hash >>> {64 - width} as int)"))
    # A few parts at a time: each least is one more test for every row.
    some = hashed.withColumn("_group", F.expr(f"_part div {_AT_A_TIME}")).withColumn("_part", F.expr(f"_part % {_AT_A_TIME}"))
    some = some.groupBy(*carried, "_group").agg(*[F.min(F.when(F.col("_part") == j, F.col("_hash"))).alias(f"_l{j}") for j in range(_AT_A_TIME)])
    least = some.groupBy(*carried).agg(
        *[F.min(F.when(F.col("_group") == j // _AT_A_TIME, F.col(f"_l{j % _AT_A_TIME}"))).alias(f"_m{j}") for j in range(parts)]
    )
    ring = F.array_compact(F.array(*[f"_m{j}" for j in range(parts)]))
    below = [sum((F.col(f"_m{j}").isNotNull().cast("int") for j in range(MINS_PER_BAND * b)), F.lit(1)).alias(f"_b{b}") for b in range(BANDS)]
    rings = least.select(*carried, F.explode(F.array(ring)).alias("_ring"), *below)
    rings = rings.select(*carried, F.concat("_ring", F.slice("_ring", 1, MINS_PER_BAND)).alias("_ring"), *[f"_b{b}" for b in range(BANDS)])
    return rings.select(*carried, *[F.xxhash64(F.lit(b), F.slice("_ring", F.col(f"_b{b}"), MINS_PER_BAND)).alias(KEYS[b]) for b in range(BANDS)])


def bitmaps(of_line: DataFrame) -> DataFrame:
    """``(node, most, bits)``: folded bitmap of the character shingles of ``(node, line)``, and the most shingles it can have.

    Shingles set bits of WIDE longs, and BITMAP ones are the exclusive or of those that have one place among them.  So lines that share
    most of their shingles differ in few bits also when they are long, while bits set by any of many shingles would be set for all.
    """
    own = of_line.repartition("node").select("node", F.encode("line", "UTF-32").alias("_bytes"))
    hashed = _exploded(own, ["node"], 4)
    told = hashed.select("node", "_n", F.expr("shiftleft(1L, cast(_hash >>> 58 as int))").alias("_bit"), F.expr(f"cast(_hash & {WIDE - 1} as int)").alias("_long"))
    # A few longs at a time, as with the least hashes.
    some = told.withColumn("_group", F.expr(f"_long div {_AT_A_TIME}")).withColumn("_long", F.expr(f"_long % {_AT_A_TIME}"))
    some = some.groupBy("node", "_group").agg(F.max("_n").alias("_n"), *[F.bit_or(F.when(F.col("_long") == j, F.col("_bit"))).alias(f"_l{j}") for j in range(_AT_A_TIME)])
    place = F.col("_group") % (BITMAP // _AT_A_TIME)
    bits = [F.bit_xor(F.when(place == k // _AT_A_TIME, F.col(f"_l{k % _AT_A_TIME}"))).alias(f"_x{k}") for k in range(BITMAP)]
    told = some.groupBy("node").agg(F.max("_n").alias("most"), *bits)
    return told.select("node", "most", F.array(*[F.coalesce(f"_x{k}", F.lit(0).cast("long")) for k in range(BITMAP)]).alias("bits"))


def _few_apart(apart: Column, most: Column, percent: int) -> Column:
    """Where bits of two lines differ there is a shingle, of its own for each, that one alone has.  Similar lines of n shingles together
    have no more such shingles than n (100 - percent) / (100 + percent)."""
    return (100 + percent) * apart <= (100 - percent) * most


def can_link(percent: int) -> Column:
    """Whether lines with ``bits_a``, ``bits_b``, ``most_a`` and ``most_b`` can have the similarity."""
    apart = sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(BITMAP)), F.lit(0))
    return _few_apart(apart, F.col("most_a") + F.col("most_b"), percent)


def folded(bits: DataFrame) -> DataFrame:
    """``(id, most, x0, x1, ...)``: bitmaps of FOLDED longs.  Two of them differ in no more bits than the whole ones do."""
    longs = [reduce(Column.bitwiseXOR, [F.col("bits")[k] for k in range(j, BITMAP, FOLDED)]).alias(f"x{j}") for j in range(FOLDED)]
    return bits.select(F.col("node").alias("id"), "most", *longs)


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``(id, line_no, head_id, head_line, kept)`` of every line that is not blank.

    The head is the first line of the component by document id and line number, and the only one kept; NULL ids come first.
    Blank lines, NULL and empty texts give no rows; repeated rows give repeated lines, of which those at the head's place
    are kept; no rows give no rows.  Other columns are not read.
    """
    # Under names of their own, so that no other column is met.
    texts_of = docs.select(F.col(id_col).alias("_line_id"), F.col(text_col).alias("_line_text"))
    told = lines(texts_of, "_line_id", "_line_text")
    # Texts are cut into lines for their names, for the keys of all distinct lines, and for the few documents with candidate lines.
    every = storage.kept(told.select("id", "line_no", "node"), "lines")
    keys = storage.kept(band_keys(told.select("node", "line")), "node-keys")
    postings = linking.shared(keys.select(F.explode(F.array(*KEYS)).alias("key"), F.col("node").alias("id")))

    wanted = storage.kept(postings.select(F.col("id").alias("node")).distinct(), "candidates")
    few = wanted.count() <= BROADCAST_NODES
    wanted = F.broadcast(wanted) if few else wanted
    # One line of each node is enough; only the documents that hold it are cut again.
    holders = every.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    ids = storage.kept(holders.select(F.col("id").alias("holder")).distinct(), "holders")
    held = texts_of.join(F.broadcast(ids) if few else ids, F.col("_line_id").eqNullSafe(F.col("holder")), "left_semi")
    some = lines(held, "_line_id", "_line_text").select("node", "line").join(wanted, "node", "left_semi")
    texts = storage.kept(some.groupBy("node").agg(F.first("line").alias("line")), "candidate-lines")
    bits = storage.kept(bitmaps(texts), "candidate-bits")

    def side(letter: str) -> DataFrame:
        return bits.select(F.col("node").alias(letter), F.col("most").alias(f"most_{letter}"), F.col("bits").alias(f"bits_{letter}"))

    def verify(pairs: DataFrame) -> DataFrame:
        # Lines are an eighth of their shingles' size, so they move and the shingles are made where a pair meets.
        likely = pairs.join(side("a"), "a").join(side("b"), "b").where(can_link(percent)).select("a", "b")
        both = likely.join(texts.select(F.col("node").alias("a"), F.col("line").alias("la")), "a")
        both = both.join(texts.select(F.col("node").alias("b"), F.col("line").alias("lb")), "b")
        sets = F.struct(all_hashes("la").alias("a"), all_hashes("lb").alias("b"))
        both = both.select("a", "b", F.explode(F.array(sets)).alias("s"))
        both = both.select("a", "b", (F.size("s.a") + F.size("s.b")).alias("n"), F.size(F.array_intersect("s.a", "s.b")).alias("common"))
        return both.where(100 * F.col("common") >= percent * (F.col("n") - F.col("common"))).select("a", "b")

    def fits(x: Column, y: Column) -> Column:
        apart = sum((F.bit_count(x[f"x{j}"].bitwiseXOR(y[f"x{j}"])) for j in range(FOLDED)), F.lit(0))
        # Lines that meet in several keys are one pair, that of the first of these.
        first = F.coalesce(*[F.when(x[k] == y[k], x[k]) for k in KEYS])
        return _few_apart(apart, x["most"] + y["most"], percent) & (first == F.col("key"))

    known = folded(bits).join(keys.join(wanted, "node", "left_semi").withColumnRenamed("node", "id"), "id")
    labels = linking.connect(postings, verify, fits, known)
    storage.delete(keys)
    named = every.select("id", "line_no", "node").join(labels.withColumnRenamed("id", "node"), "node", "left")
    named = named.select("id", "line_no", F.coalesce("component", "node").alias("component"))
    heads = named.groupBy("component").agg(F.min(F.struct("id", "line_no")).alias("head"))
    out = named.join(heads, "component")
    kept = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("line_no") == F.col("head.line_no"))
    return out.select("id", "line_no", F.col("head.id").alias("head_id"), F.col("head.line_no").alias("head_line"), kept.alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The documents with all their columns, their repeated lines cut; documents of which no line with words is left go.

    Blank lines (white space only, carriage returns too) stay where they are.  Other columns pass through, whatever their names.  A document without any line (NULL, empty, blank) is kept as it is.  ``id_col`` must be unique.
    """
    found = line_components(docs, id_col, text_col, percent)
    of, every, gone = (fresh(docs, n) for n in ("_line_id", "_lines", "_gone"))
    cut = found.groupBy(F.col("id").alias(of)).agg(
        F.count(F.lit(1)).alias(every), F.collect_set(F.when(~F.col("kept"), F.col("line_no"))).alias(gone)
    )
    cut = cut.where(F.size(gone) > 0)
    rest = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(gone, i))
    marked = docs.join(cut, docs[id_col].eqNullSafe(cut[of]), "left").where(F.col(gone).isNull() | (F.size(gone) < F.col(every)))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    return marked.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
