"""Personal data: pattern hits, and terms that give a protected value away, measured on the whole corpus.

Only DataFrame functions are used.  Hits of a kind are found with one expression that splits a text at the pattern and one that
extracts it; the lengths of the parts in turn give the places in code points.  A hit's normal form is a protected *entity*.
For the terms beside it, the pointwise mutual information of term and entity over distinct lines, as a share of the
entity's own information, says how much of the entity the term discloses: near 1 if the term occurs only with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.llm import storage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

# The base patterns.  Repeats that nothing after them can shorten are possessive, so that very long runs need no
# deep stack; a run is entered only at its start or where the last match ended, so that it is read once.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a kind cannot occur; looking for it is cheaper than the pattern.
_MARK = {"email": "@", "phone": "+"}
_TERM = r"[\p{L}\p{M}\p{N}]{3,}"
_SPAN = "struct<kind:string,start:int,end:int,hit:string,line:string,line_start:int>"
#: Terms up to which the list of candidate terms is broadcast (some tens of MB); a longer list is shuffled.
BROADCAST_TERMS = 1_000_000


def _digits(text: Column) -> Column:
    return F.translate(text, " ().+-", "")


def _passes(kind: str, hit: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(hit))
    if kind == "phone":
        return n.between(9, 15)
    figures = F.transform(F.split(F.reverse(_digits(hit)), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    luhn = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0
    return n.between(13, 19) & luhn


def _normal(kind: Column, hit: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.when(kind == "email", F.lower(hit)).when(kind == "ip", hit).otherwise(_digits(hit)))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _placed(text: Column, pattern: str, found: Column) -> Column:
    """``array<struct<start, end, hit>>`` of the matches ``found`` of ``pattern``, in code points.

    Splitting at the pattern gives what lies between the matches, so the lengths of both in turn are the places.
    """
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.char_length), 1, F.size(found))
    steps = F.zip_with(gaps, found, lambda g, h: F.struct(g.alias("gap"), F.char_length(h).alias("own"), h.alias("hit")))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["own"]).alias("end"), x["hit"].alias("hit"))
        return F.struct((start + x["own"]).alias("at"), F.array_append(a["out"], span).alias("out"))

    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, hits)`` of every document: kind, start, end, text of the match and the line it begins in with its start.

    Matches are leftmost and do not overlap within a kind; those that fail the check of their digits are dropped.  They come
    by kind as listed, then by place.  One pass without a shuffle.
    """
    told = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    empty = F.array().cast("array<string>")
    found = {}
    for kind in KINDS:
        got = _matches(F.col("text"), PATTERNS[kind])
        found[kind] = F.when(F.contains("text", F.lit(_MARK[kind])), got).otherwise(empty) if kind in _MARK else got
    # A generator of one row keeps the patterns from being written into every expression below that uses the matches.
    told = told.select("id", "text", F.explode(F.array(F.struct(*[c.alias(k) for k, c in found.items()]))).alias("m"))

    def of_kind(kind: str) -> Column:
        got = F.col(f"m.{kind}")
        spans = F.filter(_placed(F.col("text"), PATTERNS[kind], got), lambda s: _passes(kind, s["hit"]))

        def with_line(s: Column) -> Column:
            head = F.substr("text", F.lit(1), s["start"])
            start = F.char_length(head) - F.char_length(F.substring_index(head, "\n", -1))
            line = F.substring_index(F.substr("text", start + 1, F.char_length("text")), "\n", 1)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), line.alias("line"), start.alias("line_start"))

        return F.when(F.size(got) > 0, F.transform(spans, with_line)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return told.select("id", F.concat(*[of_kind(k) for k in KINDS]).alias("hits"))


def _terms(line: Column) -> Column:
    """Distinct lower-case terms of a line: runs of three or more letters, marks and digits."""
    return F.array_distinct(F.transform(_matches(line, _TERM), F.lower))


def _beside(found: DataFrame) -> DataFrame:
    """``(id, entity, line, line_start, own)`` of every line of a document and entity in it, once; ``own`` are the terms of its hits."""
    one = found.select("id", F.explode("hits").alias("h"))
    one = one.select("id", _normal(F.col("h.kind"), F.col("h.hit")).alias("entity"), "h.line", "h.line_start", _terms(F.col("h.hit")).alias("own"))
    return one.groupBy("id", "entity", "line", "line_start").agg(F.flatten(F.collect_set("own")).alias("own"))


def _line_terms(beside: DataFrame) -> DataFrame:
    """``(entity, term, line, n)``: the terms beside each entity by the hash of their line, with the copies of that line."""
    others = F.array_except(_terms(F.col("line")), F.col("own"))
    pairs = beside.select("entity", F.xxhash64("line").alias("line"), F.explode(others).alias("term"))
    return storage.kept(pairs.groupBy("entity", "term", "line").agg(F.count(F.lit(1)).alias("n")), "line-terms")


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str = "text", threshold: float = 0.8, support: int | None = None) -> DataFrame:
    """``(entity, term, disclosure)`` of the terms that reach ``threshold``.

    The unit of all counts is a line of a document, over all documents.  Most entities stand in a single line, so no number of
    lines is asked for; the estimate is smoothed instead: a term counts as if it stood in one more line without the entity.
    A line that stands c times in the corpus is one line for that, so the line added has the copies of the pair's own lines
    on average.  With a ``support`` the estimate is the plain one, of terms that stand beside the entity in at least so many
    different lines.  Entities and terms are counted with partial sums before any shuffle, so one that is in a third of all
    lines costs one row for each task.
    """
    beside = _beside(found)
    return _disclosing(docs, beside, _line_terms(beside), text_col, threshold, support)


def _disclosing(docs: DataFrame, beside: DataFrame, line_terms: DataFrame, text_col: str, threshold: float, support: int | None) -> DataFrame:
    joint = line_terms.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("n_lines_both"))
    joint = storage.kept(joint if support is None else joint.where(F.col("n_lines_both") >= support), "joint-terms")
    lines = docs.select(F.explode(F.split(text_col, "\n")).alias("line")).where("trim(line) != ''")
    wanted = joint.select("term").distinct()
    n_wanted = wanted.count()
    if not n_wanted:
        return joint.select("entity", "term", F.lit(0.0).alias("disclosure"))
    if n_wanted <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    n_lines = lines.count()
    each = lines.select(F.explode(_terms(F.col("line"))).alias("term")).join(wanted, "term", "left_semi")
    of_term = each.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    of_entity = beside.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    known = joint.join(of_term, "term").join(of_entity, "entity")
    information = F.log(F.lit(float(n_lines)) / F.col("n_entity"))
    more = F.col("n_both") / F.col("n_lines_both") if support is None else F.lit(0)
    shared = F.log(F.lit(float(n_lines)) * F.col("n_both") / ((F.col("n_term") + more) * F.col("n_entity")))
    disclosure = F.when(information > 0, shared / information).otherwise(F.lit(0.0))
    return known.select("entity", "term", disclosure.alias("disclosure")).where(F.col("disclosure") >= threshold)


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, support: int | None = None
) -> DataFrame:
    """``(id, base, terms)`` of every document: spans ``(kind, start, end, hit)`` of the base kinds, and spans of disclosing terms.

    A term span is one occurrence of a term in a line that holds the entity it discloses; its ``hit`` is the term.  A NULL text is empty
    and has no spans.  A NULL id keeps its row; rows that repeat an id and its text repeat its spans.  Other columns are not
    read; no rows give no rows.
    """
    found = storage.kept(hits(docs, id_col, text_col), "hits")
    beside = _beside(found)
    line_terms = _line_terms(beside)
    giving = _disclosing(docs, beside, line_terms, text_col, threshold, support)
    # Terms go to their own lines, not to all lines of the entity, which are as many again.
    of_line = line_terms.join(giving, ["entity", "term"]).groupBy(F.col("line").alias("key")).agg(F.collect_set("term").alias("terms"))
    places = beside.select("id", "line", "line_start", F.xxhash64("line").alias("key")).distinct()
    said = places.join(of_line, "key")
    placed = F.filter(
        _placed(F.col("line"), _TERM, _matches(F.col("line"), _TERM)), lambda s: F.array_contains("terms", F.lower(s["hit"]))
    )
    spans = F.transform(
        placed,
        lambda s: F.struct(
            F.lit(TERM).alias("kind"), (s["start"] + F.col("line_start")).alias("start"), (s["end"] + F.col("line_start")).alias("end"), s["hit"].alias("hit")
        ),
    )
    added = said.select(F.col("id").alias("said_id"), spans.alias("spans")).groupBy("said_id").agg(F.flatten(F.collect_list("spans")).alias("terms"))
    base = F.transform("hits", lambda h: F.struct(h["kind"].alias("kind"), h["start"].alias("start"), h["end"].alias("end"), h["hit"].alias("hit")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,hit:string>>")
    rows = found.select("id", base.alias("base"))
    return rows.join(added, rows["id"].eqNullSafe(added["said_id"]), "left").select(
        "id", "base", F.array_sort(F.array_distinct(F.coalesce("terms", none)), lambda a, b: a["start"] - b["start"]).alias("terms")
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The documents with all their columns; base hits are removed for a mark of their kind, disclosing terms generalised to a mark.

    Where spans overlap, the one that starts first (the longer at one start) is replaced and the others with it.  ``id_col`` must be unique.
    """
    known = personal_data(docs, id_col, text_col, **limits)
    whole = F.array_sort(
        F.concat("base", "terms"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])
    )

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        kept = F.concat(a["out"], F.substr(F.col(text_col), a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(fresh, s["end"]).otherwise(F.greatest(a["at"], s["end"])).alias("at"), F.when(fresh, kept).otherwise(a["out"]).alias("out"))

    text = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda a: F.concat(a["out"], F.substr(F.col(text_col), a["at"] + 1, F.char_length(text_col))),
    )
    found = known.where(F.size("base") > 0).select(F.col("id").alias("_span_id"), whole.alias("_spans"))
    marked = docs.join(found, docs[id_col].eqNullSafe(found["_span_id"]), "left")
    new = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(text)
    return marked.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])
