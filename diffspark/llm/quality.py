"""Line-first quality rules: failing lines go, then documents that lost too much text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from diffspark.llm import storage
from diffspark.llm import textbatch as tb

#: Text whose measures a task holds at once, beyond a single longer document.
PIECE_BYTES = 1 << 20

#: Phrases of boilerplate lines (licences, cookie notices, site furniture).
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of service", "terms of use", "cookie", "javascript", "subscribe",
    "sign up", "log in", "sign in", "click here", "read more", "powered by", "copyright", "©",
    "licensed under", "spdx-license-identifier", "permission is hereby granted", "without warranty",
)

_TERMINAL = regex.compile(r"[\p{Sentence_Terminal}…:;,)\]}\"'»”’।॥،؛፣፤፥、，；：」』）】》]\s*$")
# Whole phrases; a mark of copyright has its years with it.
_BOILER = regex.compile(
    r"(?<!\w)(?:" + "|".join(map(regex.escape, BOILERPLATE)) + r"|cookies)(?!\w)(?:(?<=©|copyright)(?:\s*(?:©|\(c\)|[0-9]{4}[,–-]?))+)?", regex.IGNORECASE
)
_SENTENCE = regex.compile(r"[\p{Sentence_Terminal}…]")
# Scripts whose prose is written without sentence marks: Thai, Lao, Khmer, Burmese and their neighbours, Tibetan.
_UNMARKED = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tai_Tham}\p{New_Tai_Lue}\p{Tai_Le}\p{Tai_Viet}\p{Tibetan}]")
_SYMBOLS = regex.compile(r"[#*$%&<>]{2,}")
_BARS = regex.compile(r"[|>»•·]")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


@dataclass(frozen=True)
class LineRules:
    """A line fails as navigation if it has at least ``bar_share`` as many bars or bullets as words; as boilerplate if it has
    at most ``boiler_words`` words and whole phrases of ``BOILERPLATE`` that are ``boiler_phrases`` different ones or make up
    ``boiler_share`` of its characters; for punctuation if runs of symbols make up ``symbol_share`` of
    its characters, or if it has at least ``open_words`` words, no closing mark and under one sentence mark in ``open_words``
    words, unless half of its letters are of a script that uses no sentence marks.  A document fails if under ``keep_share`` of its word characters is left."""

    bar_share: float = 0.4
    boiler_words: int = 40
    boiler_phrases: int = 2
    boiler_share: float = 0.3
    open_words: int = 30
    symbol_share: float = 0.15
    keep_share: float = 0.5
    min_words: int = 20
    max_repeat_percent: int = 30


def _is_boilerplate(line: str, rules: LineRules) -> bool:
    found = [x.lower() for x in _BOILER.findall(line)]
    return bool(found) and (len(set(found)) >= rules.boiler_phrases or sum(map(len, found)) >= rules.boiler_share * len(line.strip()))


def line_fault(line: str, words: int, rules: LineRules) -> str | None:
    """The rule that ``line`` of ``words`` words fails, or None."""
    if words and len(_BARS.findall(line)) >= max(2, rules.bar_share * words):
        return "navigation"
    if words <= rules.boiler_words and _is_boilerplate(line, rules):
        return "boilerplate"
    if sum(map(len, _SYMBOLS.findall(line))) >= max(6, rules.symbol_share * len(line)):
        return "punctuation"
    if words >= rules.open_words and not _TERMINAL.search(line) and rules.open_words * len(_SENTENCE.findall(line)) < words:
        return None if 2 * len(_UNMARKED.findall(line)) >= sum(map(str.isalpha, line)) > 0 else "punctuation"
    return None


def _measure(texts: pa.Array, rules: LineRules) -> Iterator[tuple[int, dict[str, np.ndarray | list]]]:
    """The first row and the measures of some texts at a time."""
    for first, last, data, offsets in tb.pieces(texts, PIECE_BYTES):
        n = last - first
        starts, ends, owner = tb.spans(data, offsets)
        word_hash = tb.hashes(data, starts, ends)
        chars = tb.code_points(data, starts, ends)
        n_words = np.bincount(owner, minlength=n)
        word_chars = np.bincount(owner, chars, minlength=n).astype(np.int64)
        of_byte = np.repeat(np.arange(n), np.diff(offsets))
        n_symbols = np.bincount(of_byte[_SYMBOL[data]], minlength=n)

        # Lines: runs without \n that hold a word; equal bytes in one text are equal lines.
        line_from, line_to, line_owner = tb.spans(data, offsets, _NEWLINE)
        before = np.searchsorted(starts, line_from)
        line_words = np.searchsorted(starts, line_to) - before
        real = line_words > 0
        line_from, line_to, line_owner, line_words, before = (x[real] for x in (line_from, line_to, line_owner, line_words, before))
        line_hash = tb.hashes(data, line_from, line_to)
        order = np.lexsort((line_hash, line_owner))
        same = (line_hash[order][1:] == line_hash[order][:-1]) & (line_owner[order][1:] == line_owner[order][:-1])
        n_dup = np.bincount(line_owner[order][1:][same], minlength=n)

        at, value = tb.windows(word_hash, owner, 8)
        order = np.lexsort((value, owner[at]))
        v, o = value[order], owner[at][order]
        same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
        twice = np.zeros(len(at), bool)
        twice[1:][same] = True
        twice[:-1][same] = True
        edge = np.zeros(len(owner) + 1, np.int64)
        np.add.at(edge, at[order][twice], 1)
        np.add.at(edge, at[order][twice] + 8, -1)
        covered = np.cumsum(edge)[:-1] > 0
        n_repeat = np.bincount(owner[covered], minlength=n)

        char_sum = np.concatenate([[0], np.cumsum(chars)])
        line_chars = char_sum[before + line_words] - char_sum[before]
        raw = data.tobytes()
        lost = np.zeros(n, np.int64)
        cut: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for i in range(len(line_from)):
            line = raw[line_from[i] : line_to[i]].decode()
            if line_fault(line, int(line_words[i]), rules):
                lost[line_owner[i]] += line_chars[i]
                cut[line_owner[i]].append((int(line_from[i]), int(line_to[i])))
        failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
        kept = ~failed & (word_chars - lost >= rules.keep_share * word_chars)
        cleaned = []
        for i in range(n):
            begin, parts = int(offsets[i]), []
            for a, b in cut[i]:
                parts.append(raw[begin:a])
                begin = min(b + 1, int(offsets[i + 1]))  # with its line end
            parts.append(raw[begin : offsets[i + 1]])
            cleaned.append(b"".join(parts).decode())
        yield first, {
            "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup,
            "n_repeat_words": n_repeat, "base_failed": failed, "kept": kept,
            "n_cut_lines": np.array([len(c) for c in cut]), "cleaned": cleaned,
        }


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_cut_lines")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = False) -> DataFrame:
    """Measures, verdict and (``with_text``) cleaned text of every document, one row each in one pass without a shuffle.

    A NULL or empty text has no words: all counts 0, ``base_failed``.  Repeated rows give repeated results; a NULL id
    stays NULL; other columns are not read, so their names cannot clash; no rows give no rows.  A document's own length
    is the only bound on memory beyond one batch.
    """

    def run(batches):
        for batch in batches:
            for first, measures in _measure(batch.column(1), rules):
                names, arrays = [id_col], [batch.column(0).slice(first, len(measures["kept"]))]
                for k in _FIELDS:
                    names.append(k)
                    arrays.append(pa.array(np.asarray(measures[k], np.int64)))
                for k in ("base_failed", "kept"):
                    names.append(k)
                    arrays.append(pa.array(np.asarray(measures[k], bool)))
                if with_text:
                    names.append("cleaned")
                    arrays.append(pa.array(measures["cleaned"], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{k} bigint" for k in _FIELDS) + ", base_failed boolean, kept boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema + ", cleaned string" * with_text)


def keep_clean(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, with all their columns, in one pass without a join; failing lines are cut from the text.

    A NULL or empty text has no words and fails.  Rows that repeat are judged each on its own; other columns and NULLs in them pass through,
    whatever their names; no rows give no rows.  A document is in one task's memory as a whole.
    """
    at = docs.columns.index(text_col)
    storage.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for first, measures in _measure(batch.column(at), rules):
                kept = pa.array(np.asarray(measures["kept"], bool))
                some = batch.slice(first, len(kept))
                text = pa.array(measures["cleaned"], batch.schema.field(at).type)
                arrays = [text if i == at else c for i, c in enumerate(some.columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(kept)

    return docs.mapInArrow(run, docs.schema)
