"""Phrase collocations from count streams in prefix and suffix order.

Counting goes level by level: a phrase of m words can only be frequent if its first and its last m - 1 words are.  Each level has two
passes over the coded text.  The first counts candidates by a few bits of their hash only, which travels in about two bytes each; the second counts
exactly, but only candidates whose bits were counted often enough.  What a level knows goes to the tasks as a bitmap of bounded size; a
bit set by chance only lets a phrase be counted in vain.

The frequent phrases with their counts are then put in prefix order (by their words from the first) and read as a stream: the phrases
that a phrase begins with stand right before it, so their counts, left of its cuts, are on a stack, and a phrase learns of the
longer ones that begin with it.  In suffix order (by the words from the last) the same reading gives the counts right of the cuts and the
longer phrases that end with it.  Nothing is looked up by hashing; the counts of the single outer words come by merge joins.
Words and phrases are named by 64-bit hashes of language and words; results are exact up to a hash collision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffspark.llm import storage
from diffspark.llm import textbatch as tb

LONGEST = 5
#: Bytes of text that are cut into words at once, words of a row of coded text, and hashes that a task gathers before it counts them.
PIECE_BYTES = 1 << 20
CHUNK_WORDS, GATHERED = 1 << 14, 1 << 19
#: Rows of a batch that are worked on at once.
ROWS_AT_ONCE = 1000
#: Bits of the bitmaps that go to every task: one for about twelve words of the corpus, between 2^16 and this many (2^30 are 128 MB).
FILTER_BITS = 30
#: Buckets that are counted together; hashes whose first bits agree.
_SLOT_BITS = 16
#: Parts in which the rows of one language are ranked before they meet.
RANK_PARTS = 64

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_APART = _PIECE_END.copy()
_APART[[0x20, 0x09]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def phrase_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a single word is its own."""
    if size == 1:
        return words
    n = max(len(words) - size + 1, 0)
    value = np.zeros(n, np.uint64)
    for j in range(size if n else 0):
        value = value * _BASE + words[j : j + n]
    return tb.mix(value + np.uint64(size))


def _words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(languages, bytes, starts, ends, language of word, hash of word, owner, piece)`` of pieces of a batch of texts and languages."""
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield from _some_words(batch.slice(at, ROWS_AT_ONCE))
    # What the batch's working arrays took goes back, so that workers stay small.
    pa.default_memory_pool().release_unused()


def _some_words(batch: pa.RecordBatch):
    names, lang_of = np.unique(np.array(batch.column(1).fill_null("und").to_pylist(), object), return_inverse=True)
    # Mixed once more, so that a word that is the name of a language hashes like any other.
    lang_hash = tb.mix(np.array([tb.hashes(x := np.frombuffer(s.encode(), np.uint8), np.array([0]), np.array([len(x)]))[0] for s in names], np.uint64))
    for first, _, data, offsets in tb.pieces(batch.column(0), PIECE_BYTES):
        data = tb.lowered(data)
        starts, ends, owner = tb.spans(data, offsets, _APART)
        if not len(starts):
            continue
        lang = lang_of[first + owner]
        words = tb.mix(tb.hashes(data, starts, ends) ^ lang_hash[lang])
        words[words == 0] = 1
        yield names, data.tobytes(), starts, ends, lang, words, owner, np.cumsum(_PIECE_END[data])[starts]


def _code(told: DataFrame) -> DataFrame:
    """``(lang, words, core, n)``: the word hashes of stretches of text, 0 between pieces.  Runs that start in the first ``core`` words
    belong to the row; ``n`` of these are words."""

    def run(batches):
        for batch in batches:
            for names, _, _, _, lang, words, owner, piece in _words(batch):
                rows = []
                for k in np.unique(lang):
                    own = np.flatnonzero(lang == k)
                    apart = np.flatnonzero((piece[own][1:] != piece[own][:-1]) | (owner[own][1:] != owner[own][:-1])) + 1
                    coded = np.insert(words[own], apart, np.uint64(0))
                    for at in range(0, len(coded), CHUNK_WORDS):
                        core = min(CHUNK_WORDS, len(coded) - at)
                        n = int(np.count_nonzero(coded[at : at + core]))
                        rows.append((names[k], coded[at : at + core + LONGEST - 1].tobytes(), core, n))
                kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "words", "core", "n"])

    return told.mapInArrow(run, "lang string, words binary, core bigint, n bigint")


class _Filter:
    """A bitmap of hashes, known on every task."""

    def __init__(self, slots: DataFrame, bits: int):
        self.shift = np.uint64(64 - bits)
        whole = np.zeros(1 << (bits - 3), np.uint8)
        width = len(whole) >> max(bits - _SLOT_BITS, 0)
        # At most 2^bits / 8 bytes, whatever the number of hashes.
        for row in slots.collect():
            whole[row["slot"] * width : (row["slot"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
        self.shared = slots.sparkSession.sparkContext.broadcast(whole)
        self.any = bool(whole.any())

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> self.shift
        return (self.shared.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _candidates(size: int, shorter: _Filter | None, bucket: _Filter | None = None) -> Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]:
    """Places below ``core`` and hashes of runs of ``size`` words in one piece, both shorter runs of which ``shorter`` holds and which
    ``bucket`` holds."""

    def of(words: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray]:
        n = max(min(core, len(words) - size + 1), 0)
        inside = words != 0
        whole = inside[:n].copy()
        for j in range(1, size):
            whole &= inside[j : j + n]
        at = np.flatnonzero(whole)
        if shorter is not None and n:
            known = shorter(phrase_hashes(words, size - 1)[: n + 1])
            at = at[known[at] & known[at + 1]]
        hashes = phrase_hashes(words, size)[at]
        if bucket is not None:
            held = bucket(hashes)
            at, hashes = at[held], hashes[held]
        return at, hashes

    return of


def _coded_rows(batches) -> Iterator[tuple[np.ndarray, int]]:
    for batch in batches:
        for raw, core in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            yield np.frombuffer(raw.as_buffer(), np.uint64), core
        pa.default_memory_pool().release_unused()


def _buckets(coded: DataFrame, bits: int, least: int, candidates) -> _Filter:
    """The first ``bits`` bits that candidates of ``least`` or more occurrences together have."""
    low = min(bits, _SLOT_BITS)
    shift, mask = np.uint64(64 - bits), (1 << low) - 1

    def count(batches):
        gathered, held = [], 0

        def counted():
            places, n = np.unique(np.concatenate(gathered), return_counts=True)
            slots = (places >> np.uint64(low)).astype(np.int64)
            cuts = np.flatnonzero(slots[1:] != slots[:-1]) + 1
            lows, few = (places & np.uint64(mask)).astype("<u2"), np.minimum(n, 255).astype(np.uint8)
            parts = list(zip([0, *cuts], [*cuts, len(slots)], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(slots[a]) for a, _ in parts], pa.int64()), pa.array([lows[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([few[a:b].tobytes() for a, b in parts], pa.binary())],
                ["slot", "lows", "counts"],
            )

        for words, core in _coded_rows(batches):
            _, hashes = candidates(words, core)
            if len(hashes):
                gathered.append(hashes >> shift)
                held += len(hashes)
            if held >= GATHERED:
                yield from counted()
                gathered, held = [], 0
        if gathered:
            yield from counted()

    def add(batches):
        slot, total = None, None
        for batch in batches:
            for at, lows, few in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if at != slot:
                    if slot is not None:
                        yield from bitmap(slot, total)
                    slot, total = at, np.zeros(1 << low, np.int64)
                # A count of 255 may be more, but any count that large is enough by itself or is counted on exactly.
                total[np.frombuffer(lows.as_buffer(), "<u2")] += np.frombuffer(few.as_buffer(), np.uint8)
        if slot is not None:
            yield from bitmap(slot, total)

    def bitmap(slot, total):
        enough = total >= min(least, 255)
        if enough.any():
            yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([np.packbits(enough, bitorder="little").tobytes()], pa.binary())], ["slot", "bits"])

    counted = coded.select("words", "core").mapInArrow(count, "slot bigint, lows binary, counts binary")
    dealt = counted.repartition("slot").sortWithinPartitions("slot")
    return _Filter(dealt.mapInArrow(add, "slot bigint, bits binary"), bits)


def _merged(packed: DataFrame, least: int, width: int) -> DataFrame:
    """``(lang, hash, n, words, word)`` of the entries with ``least`` occurrences, from packed rows that share slots."""

    def run(batches):
        key, held = None, []
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(i) for i in (2, 3, 4, 5)), strict=True):
                if row[:2] != key:
                    if held:
                        yield merged(key, held)
                    key, held = row[:2], []
                held.append(row[2:])
        if held:
            yield merged(key, held)

    def merged(key, rows):
        hashes = np.concatenate([np.frombuffer(h.as_buffer(), np.uint64) for h, *_ in rows])
        counts = np.concatenate([np.frombuffer(c.as_buffer(), np.int64) for _, c, *_ in rows])
        distinct, first, group = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(group, counts, minlength=len(distinct)).astype(np.int64)
        kept = total >= least
        place = pa.array(first[kept])
        n = len(place)
        if width:
            own = np.concatenate([np.frombuffer(w.as_buffer(), np.uint64) for _, _, w, _ in rows]).reshape(-1, width)[first[kept]]
            words = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel().view(np.int64)), width).cast(pa.list_(pa.int64()))
            text = pa.nulls(n, pa.string())
        else:
            words = pa.nulls(n, pa.list_(pa.int64()))
            text = pa.concat_arrays([s.values for *_, s in rows]).take(place)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[1]] * n, pa.string()), pa.array(distinct[kept].view(np.int64)), pa.array(total[kept]), words, text], ["lang", "hash", "n", "words", "word"]
        )

    dealt = packed.repartition("slot", "lang").sortWithinPartitions("slot", "lang")
    return dealt.mapInArrow(run, "lang string, hash bigint, n bigint, words array<bigint>, word string")


_PACKED = "slot bigint, lang string, hashes binary, counts binary, words binary, text array<string>"


def _packed(slot_bits: int, lang, hashes: np.ndarray, counts: np.ndarray, words: np.ndarray | None, texts: list[str] | None):
    """One row for each slot from sorted distinct hashes."""
    slots = (hashes >> np.uint64(64 - slot_bits)).astype(np.int64)
    cuts = (np.flatnonzero(slots[1:] != slots[:-1]) + 1).tolist()
    parts = list(zip([0, *cuts], [*cuts, len(slots)], strict=True)) if len(slots) else []
    counts = counts.astype(np.int64)
    # One batch, because every batch costs the receiver buffers of its own.
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([int(slots[a]) for a, _ in parts], pa.int64()),
            pa.array([lang] * len(parts), pa.string()),
            pa.array([hashes[a:b].tobytes() for a, b in parts], pa.binary()),
            pa.array([counts[a:b].tobytes() for a, b in parts], pa.binary()),
            pa.array([None if words is None else words[a:b].tobytes() for a, b in parts], pa.binary()),
            pa.array([None if texts is None else texts[a:b] for a, b in parts], pa.list_(pa.string())),
        ],
        ["slot", "lang", "hashes", "counts", "words", "text"],
    )


def _single_words(told: DataFrame, bucket: _Filter, slot_bits: int, least: int) -> DataFrame:
    """The frequent words as they are spelled, counted exactly."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                hashes, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                texts = [t for p in parts for t in p[2]]
                distinct, first, group = np.unique(hashes, return_index=True, return_inverse=True)
                total = np.bincount(group, counts, minlength=len(distinct)).astype(np.int64)
                yield from _packed(slot_bits, lang, distinct, total, None, [texts[i].decode() for i in first])

        for batch in batches:
            for names, raw, starts, ends, lang, words, _, _ in _words(batch):
                at = np.flatnonzero(bucket(words))
                for k in np.unique(lang[at]):
                    own = at[lang[at] == k]
                    distinct, first, n = np.unique(words[own], return_index=True, return_counts=True)
                    place = own[first]
                    texts = [raw[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist(), strict=True)]
                    held.setdefault(names[k], []).append((distinct, n, texts))
                    size += len(distinct)
                if size >= GATHERED // 4:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return _merged(told.mapInArrow(run, _PACKED), least, 0)


def _level(coded: DataFrame, size: int, candidates, slot_bits: int, least: int) -> DataFrame:
    """The frequent phrases of ``size`` words among the candidates, counted exactly."""

    def run(batches):
        gathered, held = [], 0

        def flush():
            hashes, own = (np.concatenate([g[i] for g in gathered]) for i in (0, 1))
            counts = np.concatenate([g[2] for g in gathered])
            distinct, first, group = np.unique(hashes, return_index=True, return_inverse=True)
            total = np.bincount(group, counts, minlength=len(distinct)).astype(np.int64)
            yield from _packed(slot_bits, None, distinct, total, own[first], None)

        for words, core in _coded_rows(batches):
            at, hashes = candidates(words, core)
            if not len(at):
                continue
            distinct, first, n = np.unique(hashes, return_index=True, return_counts=True)
            gathered.append((distinct, words[at[first][:, None] + np.arange(size)], n))
            held += len(distinct)
            if held >= GATHERED:
                yield from flush()
                gathered, held = [], 0
        if gathered:
            yield from flush()

    return _merged(coded.select("words", "core").mapInArrow(run, _PACKED), least, size)


def _streamed(phrases: DataFrame, backwards: bool, extension_percent: int) -> DataFrame:
    """``phrases`` read in prefix order, or backwards in suffix order.

    Adds to ``left`` (``right`` backwards) the counts of the phrases of two or more words that a phrase begins (ends) with, shortest
    first, and sets ``inner`` where a phrase one word longer has ``extension_percent`` of its occurrences.  A phrase lies in one
    partition with all that begin with its first two words, and only the phrases that the current one begins with are held.
    """
    order = F.reverse("words") if backwards else F.col("words")
    side = "right" if backwards else "left"
    dealt = phrases.withColumn("_order", order)
    dealt = dealt.repartition(F.get("_order", F.lit(0)), F.get("_order", F.lit(1))).sortWithinPartitions("_order")
    names = phrases.columns
    at = names.index(side)

    def run(batches):
        stack: list[tuple[list[int], dict]] = []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                own = row.pop("_order")
                while stack and stack[-1][0] != own[: len(stack[-1][0])]:
                    done.append(stack.pop()[1])
                row[side] = [r["a"] for _, r in stack]
                if stack and len(stack[-1][0]) == len(own) - 1 and 100 * row["a"] >= extension_percent * stack[-1][1]["a"]:
                    stack[-1][1]["inner"] = True
                stack.append((own, row))
            if done:
                yield told(done)
        if stack:
            yield told([r for _, r in stack])

    def told(rows):
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("hash", pa.int64()), ("words", pa.list_(pa.int64())), ("a", pa.int64()), ("inner", pa.bool_()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])
    assert at >= 0 and schema.names == names
    return dealt.mapInArrow(run, phrases.schema)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, first: int = 2000, extension_percent: int = 100, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first phrases of two to five words by their lowest-scoring cut.

    A-Z count as a-z, punctuation and line ends cut texts into pieces, phrases lie within pieces.  A phrase with ``a`` occurrences, at
    least ``least``, whose cut parts occur ``l`` and ``r`` times among ``n`` words scores ``floor(1000 a n / (l r))``, in 128-bit decimal
    arithmetic.  Phrases inside a longer frequent one with ``extension_percent`` of their occurrences go.  Equal scores rank by
    occurrences, then by phrase.  A NULL language is ``und``; NULL and empty texts hold no words; repeated rows count each; a language
    without frequent phrases, or no rows, give no rows.  Other columns are not read.  A text is in one task's memory as a whole.
    ``extension_percent`` must be 100 or more: then only phrases one word longer have to be looked at.
    """
    if extension_percent < 100:
        raise ValueError("extension_percent must be 100 or more")
    storage.small_batches(docs.sparkSession)
    told = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    coded = storage.kept(_code(told), "coded-words")
    totals = storage.kept(coded.groupBy("lang").agg(F.sum("n").alias("total")), "language-words")
    size_of_all = totals.agg(F.sum("total").alias("n")).first()["n"] or 0
    bits = min(max(size_of_all.bit_length() - 4, 16), max(filter_bits, 3))
    slot_bits = min(max(size_of_all.bit_length() - 18, 4), 20)

    seen = _buckets(coded, bits, least, _candidates(1, None))
    singles = storage.kept(_single_words(told, seen, slot_bits, least).select("lang", "hash", "n", "word"), "words")
    levels = []
    # The words' bitmap holds some that are not frequent, which the next level's own count leaves out.
    for size in range(2, LONGEST + 1):
        if not seen.any:
            break
        seen_here = _buckets(coded, bits, least, _candidates(size, seen))
        level = _level(coded, size, _candidates(size, seen, seen_here), slot_bits, least)
        levels.append(storage.kept(level.select("hash", "words", F.col("n").alias("a")), f"phrases-{size}"))
        seen = seen_here
    storage.delete(coded)

    none = F.lit(None).cast("array<bigint>")
    stream = told.sparkSession.createDataFrame([], "hash bigint, words array<bigint>, a bigint")
    for level in levels:
        stream = stream.unionByName(level)
    stream = stream.select("hash", "words", "a", F.lit(False).alias("inner"), none.alias("left"), none.alias("right"))
    streamed = _streamed(_streamed(stream, False, extension_percent), True, extension_percent).where("not inner")

    outer = streamed.select("hash", "words", "a", "left", "right", F.get("words", F.lit(0)).alias("first_word"), F.element_at("words", -1).alias("last_word"))
    heads = singles.select(F.col("hash").alias("first_word"), "lang", F.col("n").alias("l1"))
    tails = singles.select(F.col("hash").alias("last_word"), F.col("n").alias("r1"))
    outer = outer.join(heads.hint("merge"), "first_word").join(tails.hint("merge"), "last_word").join(totals, "lang")
    lefts, rights = F.concat(F.array("l1"), "left"), F.concat(F.array("r1"), "right")
    whole = outer.select("hash", "lang", "words", "a", "total", lefts.alias("lefts"), rights.alias("rights"))
    cuts = F.expr(
        """transform(sequence(1, size(lefts)), k -> struct(
          cast(1000 as decimal(4,0)) * (cast(a as decimal(17,0)) * cast(total as decimal(17,0)))
            div (cast(get(lefts, k - 1) as decimal(19,0)) * cast(get(rights, size(lefts) - k) as decimal(19,0))) as score,
          k as cut, get(lefts, k - 1) as l, get(rights, size(lefts) - k) as r))"""
    )
    scored = storage.kept(whole.withColumn("low", F.array_min(cuts)).select("hash", "lang", "words", "a", "total", "low"), "scored")

    # Each part of a language gives no more than its first rows, and their equals, to the one task that ranks them.
    by_count = [F.col("low.score").desc(), F.col("a").desc()]
    part = Window.partitionBy("lang", F.pmod("hash", F.lit(RANK_PARTS))).orderBy(*by_count)
    near = scored.withColumn("_near", F.rank().over(part)).where(F.col("_near") <= first)
    near = near.withColumn("_near", F.rank().over(Window.partitionBy("lang").orderBy(*by_count))).where(F.col("_near") <= first)
    near = storage.kept(near.drop("_near"), "leading")
    letters = singles.select(F.col("hash").alias("word_hash"), "word")
    placed = near.select("hash", F.posexplode("words").alias("at", "word_hash")).join(letters, "word_hash")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    named = near.join(placed.groupBy("hash").agg(phrase.alias("phrase")), "hash")
    order = [*by_count, F.col("phrase").asc()]
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("total").alias("n"), F.col("low.score").alias("score")
    )
