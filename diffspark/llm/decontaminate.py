"""Benchmark decontamination by greedy string tiling.

Documents and test items that share a seed (a run of ``minimum`` words) are candidates.  For each candidate the longest common
runs of words that are still free on both sides are marked as tiles, again and again, down to ``minimum`` words; the
share of the item's words under tiles does not depend on the order of its passages in the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffspark.llm import textbatch as tb

#: Words of test items handed to the tasks at once; a larger benchmark goes in several blocks, each against all documents.
BLOCK_WORDS = 1_000_000

# Scripts written without spaces, each character of which is a word; the marks of Japanese belong to no script.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\x{3005}\x{30FC}\x{FF70}])"
_OTHER = r"[^\x00-\x7F\p{L}\p{M}\p{N}]"

# Words are runs of letters, marks and digits.  Of the bytes of a ``plain`` text, all beyond ASCII are of such characters.
_APART = np.ones(256, bool)
_APART[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _APART[_a:_b] = False


def plain(texts: pa.Array) -> pa.Array:
    """Texts with characters beyond ASCII lower-cased, their punctuation and spaces as blanks, and blanks around each character of a
    script without spaces; other texts as they are."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    wide = pc.invert(pc.string_is_ascii(texts))
    if not pc.any(wide).as_py():
        return texts
    some = texts.filter(wide)
    try:
        some = pc.utf8_lower(some)
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        some = pa.array([x.decode(errors="replace").lower() for x in some.cast(pa.large_binary()).to_pylist()], pa.large_string())
    some = pc.replace_substring_regex(some, pattern=_OTHER, replacement=" ")
    some = pc.replace_substring_regex(some, pattern=_UNSPACED, replacement=r" \1 ")
    return pc.replace_with_mask(texts, wide, some)


def words_of(texts: pa.Array):
    """``(first row, words, owner, rows)`` of each piece of the batch."""
    texts = plain(texts)
    for first, last, data, offsets in tb.pieces(texts):
        data = tb.lowered(data)
        starts, ends, owner = tb.spans(data, offsets, _APART)
        yield first, tb.hashes(data, starts, ends), owner, last - first


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``size`` words: each follows from the one before by one word in and one out, which
    for a whole array is a difference of running sums."""
    power, inverse = tb._powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    n = len(words) - size + 1
    return (total[size:] - total[:n]) * inverse[:n]


def _free_runs(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of the runs of ``size`` free words."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[size:] == taken[:-size])


def tiles(item: np.ndarray, doc: np.ndarray, minimum: int) -> list[tuple[int, int, int]]:
    """``(item position, document position, length)`` of the tiles, by running Karp-Rabin greedy string tiling."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    size = max(minimum, min(len(item), len(doc)))
    while size >= minimum:
        found = _matches(item, doc, free_item, free_doc, size)
        if found and found[0][2] >= 2 * size:
            size = found[0][2]
            continue
        for i, d, n in found:
            # A longer tile may have covered a part; what is left may still be longer than the next match, so look anew.
            if not (free_item[i : i + n].all() and free_doc[d : d + n].all()):
                break
            free_item[i : i + n] = False
            free_doc[d : d + n] = False
            out.append((i, d, n))
        if not found or not _matches(item, doc, free_item, free_doc, size):
            size = minimum if minimum < size < 2 * minimum else size // 2
    return out


def _matches(item, doc, free_item, free_doc, size):
    """Maximal free matches of at least ``size`` words, longest first, then by place."""
    if len(item) < size or len(doc) < size:
        return []
    at_item, at_doc = _free_runs(free_item, size), _free_runs(free_doc, size)
    if not len(at_item) or not len(at_doc):
        return []
    value_item, value_doc = rolled(item, size)[at_item], rolled(doc, size)[at_doc]
    common = np.isin(value_doc, value_item)
    at_doc, value_doc = at_doc[common], value_doc[common]
    if not len(at_doc):
        return []
    order = np.argsort(value_item, kind="stable")
    value_item, at_item = value_item[order], at_item[order]
    low, high = np.searchsorted(value_item, value_doc), np.searchsorted(value_item, value_doc, "right")
    best: dict[tuple[int, int], int] = {}
    reach: dict[int, int] = {}  # end on each diagonal of the last match extended there
    for d, a, b in zip(at_doc.tolist(), low.tolist(), high.tolist(), strict=True):
        for i in at_item[a:b].tolist():
            if reach.get(d - i, -1) > d:
                continue
            room = min(len(item) - i, len(doc) - d)
            differ = np.flatnonzero((item[i : i + room] != doc[d : d + room]) | ~free_item[i : i + room] | ~free_doc[d : d + room])
            n = int(differ[0]) if len(differ) else room
            if n >= size:
                best[i, d] = n
                reach[d - i] = d + n
    return sorted(((i, d, n) for (i, d), n in best.items()), key=lambda m: (-m[2], m[0], m[1]))


class _Items:
    """One block of test items with the places of their seeds."""

    def __init__(self, rows: list[tuple[int, str | None]], minimum: int):
        texts = pa.array([t for _, t in rows], pa.string())
        self.ids: list = []
        self.words: list[np.ndarray] = []
        for first, words, owner, n in words_of(texts):
            cut = np.searchsorted(owner, np.arange(n + 1))
            for k in range(n):
                if cut[k + 1] - cut[k] >= minimum:
                    self.ids.append(rows[first + k][0])
                    self.words.append(words[cut[k] : cut[k + 1]])
        seeds = [rolled(w, minimum) for w in self.words]
        count = [len(s) for s in seeds]
        value = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(seeds)), count)
        place = np.concatenate([np.arange(c) for c in count]) if seeds else np.zeros(0, np.int64)
        order = np.argsort(value, kind="stable")
        self.value, self.item, self.place = value[order], item[order], place[order]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self._slot(self.value)] = True

    @staticmethod
    def _slot(value: np.ndarray) -> np.ndarray:
        return (tb.mix(value) >> np.uint64(42)).astype(np.int64)

    def pairs(self, words: np.ndarray, owner: np.ndarray, minimum: int, least: float):
        """``(text, item)`` whose shared seeds could cover ``least`` of the item: tiles lie within runs of shared seeds."""
        if len(words) < minimum or not len(self.value):
            return
        value = rolled(words, minimum)
        at = np.flatnonzero((owner[: len(value)] == owner[minimum - 1 :]) & self.sieve[self._slot(value)])
        low = np.searchsorted(self.value, value[at])
        n = np.searchsorted(self.value, value[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        if not len(at):
            return
        seed = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        keys = np.unique(np.stack([np.repeat(owner[at], n), self.item[seed], self.place[seed]], 1), axis=0)
        edge = np.flatnonzero(np.concatenate([[True], (keys[1:, :2] != keys[:-1, :2]).any(1), [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            text, item = keys[a, :2].tolist()
            step = np.diff(keys[a:b, 2])
            if minimum + int(np.minimum(step, minimum).sum()) >= least * len(self.words[item]):
                yield text, item


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", minimum: int = 5, coverage: float = 0.5,
) -> DataFrame:
    """``(id, item, item_words, covered_words, n_tiles)`` of every document and test item whose tiles cover ``coverage`` of it.

    One pass over the documents for each block of items, without a shuffle.  NULL and empty texts hold no words; an item of
    fewer than ``minimum`` words cannot be told from chance and is never matched.  Repeated documents and items give a row
    each; NULL ids stay NULL; other columns are not read; empty tables give no rows.
    """
    spark = docs.sparkSession
    test = items.select(F.col(item_id_col).cast("long").alias("item"), F.col(item_text_col).alias("words"))
    size = test.agg(F.sum(F.coalesce(F.octet_length("words"), F.lit(0)) + 1)).first()[0] or 0
    blocks = max(1, -(-size // (4 * BLOCK_WORDS)))  # about four bytes or more for each word and its gap
    kind = docs.schema[id_col].dataType.simpleString()
    out = None
    for block in range(blocks):
        own = test.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block) if blocks > 1 else test
        shared = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])  # one block, bounded by BLOCK_WORDS

        def run(batches, shared=shared):
            block_items = _Items(shared.value, minimum)
            for batch in batches:
                rows: list[tuple] = []
                for first, words, owner, n in words_of(batch.column(1)):
                    cut = np.searchsorted(owner, np.arange(n + 1))
                    for text, item in block_items.pairs(words, owner, minimum, coverage):
                        target = block_items.words[item]
                        got = tiles(target, words[cut[text] : cut[text + 1]], minimum)
                        covered = sum(m[2] for m in got)
                        if covered >= coverage * len(target):
                            rows.append((first + text, block_items.ids[item], len(target), covered, len(got)))
                if rows:
                    take, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(take)), *(pa.array(x, pa.int64()) for x in rest)],
                        [id_col, "item", "item_words", "covered_words", "n_tiles"],
                    )

        found = docs.select(id_col, text_col).mapInArrow(
            run, f"`{id_col}` {kind}, item bigint, item_words bigint, covered_words bigint, n_tiles bigint"
        )
        out = found if out is None else out.unionByName(found)
    return out
