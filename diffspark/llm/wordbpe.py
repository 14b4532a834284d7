"""Word-level BPE over Arrow string batches: with an own merge loop, and the same vocabulary through the tokenizers library.

Text is normalised, cut into words by a pattern, and each word is merged on its own; so any text can be cut at white space first.
A batch is cut with numpy: stretches without white space are *pieces*; a piece of printable ASCII without apostrophe or ``<`` is lower-cased and cut
into runs of letters, single digits and runs of marks, which are its words.  Any other piece is a unit as it stands, left to the library's own
normaliser and pre-tokeniser, so that every code point counts as the library says.  A unit that the table of units does not hold is encoded once in a batch.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from diffspark.llm import textbatch as tb

#: Text of a piece of a batch, in bytes.
PIECE_BYTES = 1 << 20
#: Places of a worker's table of units (16 bytes each) and room for their ids (2 or 4 bytes each): 32 and 16 MB.
PLACES_BITS, ID_ROOM = 21, 8 << 20
#: Units that are kept for later batches at most.
TABLE_ENTRIES = 2_000_000
#: Words that go to the library in one string.
AT_ONCE = 4096

_LETTER, _DIGIT, _MARK, _ODD = 1, 2, 3, 4
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("A") : ord("Z") + 1] = _LETTER
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[[ord("'"), ord("<")]] = _ODD
_CLASS[tb.BLANK] = 0


# Units of Latin-1 letters, digits and marks, which the library lower-cases letter by letter and cuts like ASCII.
_LATIN = regex.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:;=-@\[-`{-~¡¿]+")
_LATIN_WORDS = regex.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


@dataclass(frozen=True)
class Units:
    """The units of a run of texts in their order: their hashes, places in ``raw``, which of them need the library's normaliser, and
    the number of their text."""

    first: int
    last: int
    raw: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    odd: np.ndarray
    owner: np.ndarray

    def texts(self, at: np.ndarray) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def units(texts: pa.Array) -> Iterator[Units]:
    """The units of a batch of texts, some texts at a time; NULL is empty."""
    for first, last, data, offsets in tb.pieces(texts, PIECE_BYTES):
        kind = _CLASS[data]
        starts, ends, owner = tb.spans(data, offsets)
        strange = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == _ODD, out=strange[1:])
        odd = strange[ends] > strange[starts]
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts[~odd]] += 1
        edge[ends[~odd]] -= 1
        plain = np.cumsum(edge[:-1], dtype=np.int8) > 0
        data = np.where(plain, tb.lowered(data), data)
        begins = np.zeros(len(data), bool)
        begins[starts] = True
        begins[1:] |= plain[1:] & plain[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        at = np.flatnonzero(begins)
        piece = np.searchsorted(starts, at, "right") - 1
        to = np.minimum(np.append(at[1:], len(data)), ends[piece])
        yield Units(first, last, data.tobytes(), tb.hashes(data, at, to), at, to, odd[piece], owner[piece])


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of a flat array, one after the other."""
    return flat[np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)]


class Table:
    """Ids of units seen before, by hash, in arrays of fixed size: a unit takes the place that the first bits of its hash name, whoever had it
    before; when the room for ids is used up the table starts anew."""

    def __init__(self, kind: type):
        self.shift = np.uint64(64 - PLACES_BITS)
        self.hashes = np.zeros(1 << PLACES_BITS, np.uint64)
        self.start = np.zeros(1 << PLACES_BITS, np.int32)
        self.length = np.zeros(1 << PLACES_BITS, np.int32)
        self.flat = np.zeros(ID_ROOM, kind)
        self.used = self.entries = 0

    def look_up(self, found: Units, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each unit start and how many they are; ``encode(places of units)`` makes what is missing.  Only units
        that the table does not have are sorted, to find the distinct ones."""
        if 2 * self.used > len(self.flat) or self.entries >= TABLE_ENTRIES:
            self.hashes[:], self.used, self.entries = 0, 0, 0
        place = (found.hashes >> self.shift).astype(np.int64)
        known = self.hashes[place] == found.hashes
        start, length = self.start[place].astype(np.int64), self.length[place].astype(np.int64)
        missing = np.flatnonzero(~known)
        if not len(missing):
            return self.flat, start, length
        distinct, new, which = np.unique(found.hashes[missing], return_index=True, return_inverse=True)
        new = missing[new]
        flat, n = encode(new)
        begin = self.used + np.cumsum(n) - n
        start[missing], length[missing] = begin[which], n[which]
        if self.used + len(flat) > len(self.flat):  # more than there is room for: of use here, not kept
            return np.concatenate([self.flat[: self.used], flat]), start, length
        self.flat[self.used : self.used + len(flat)] = flat
        self.used, self.entries = self.used + len(flat), self.entries + len(new)
        self.hashes[place[new]], self.start[place[new]], self.length[place[new]] = distinct, begin, n
        return self.flat, start, length


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


class Vocabulary:
    """A vocabulary file with an end-of-word suffix, and the library's tokenizer over it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ids: dict[str, int] = self.spec["model"]["vocab"]
        self.end: str = self.spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.words = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.type = np.uint16 if max(self.words) < 1 << 16 else np.uint32

        self.table = Table(self.type)

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text."""
        return [i for found in units(pa.array([text], pa.string())) for i in self.ids_of(found)[0].tolist()]

    def ids_of(self, found: Units) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        flat, start, length = self.table.look_up(found, lambda at: self.of(found, at))
        return ragged(flat, start, length), np.bincount(found.owner, length, minlength=found.last - found.first).astype(np.int64)

    def of(self, found: Units, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units ``at``, one after the other, and their numbers."""
        plain, odd = self._plain, self._odd
        groups = []
        for own, encode in ((np.flatnonzero(~found.odd[at]), plain), (np.flatnonzero(found.odd[at]), odd)):
            for i in range(0, len(own), AT_ONCE):
                groups.append((own[i : i + AT_ONCE], *encode(found.texts(at[own[i : i + AT_ONCE]]))))
        return together(groups, len(at), self.type)

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _odd(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError


def together(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of ``n`` entries from groups of ``(entries, flat values, lengths)``."""
    lengths = np.zeros(n, np.int64)
    for own, _, length in groups:
        lengths[own] = length
    starts = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), kind)
    for own, values, length in groups:
        flat[np.arange(len(values)) + np.repeat(starts[own] - (np.cumsum(length) - length), length)] = values
    return flat, lengths


class Library(Vocabulary):
    """Units encoded by the library, many at once."""

    def __init__(self, path: str):
        super().__init__(path)
        letters = byte_letters()
        self.spelling = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(33, 256)}

    @property
    def code(self) -> str:
        return np.dtype(self.type).char

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as native unsigned integers of the size that ``code`` says."""
        return np.array(super().encode(text), self.type).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # Plain words are normalised and cut already, and their bytes stand for themselves; so the library's model takes them as they are.
        return self._modelled(b" ".join(texts).decode("ascii").split(" "))

    def _modelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised words, spelled with the letters that stand for their bytes."""
        told = list(map(self.tokenizer.model.tokenize, words))
        counts = np.array(list(map(len, told)), np.int64)
        return np.fromiter((t.id for word in told for t in word), self.type, int(counts.sum())), counts

    def _odd(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        told = [t.decode() for t in texts]
        latin = np.array([_LATIN.fullmatch(t) is not None for t in told])
        groups = []
        own = np.flatnonzero(latin)
        if len(own):
            words = [_LATIN_WORDS.findall(told[i].lower()) for i in own.tolist()]
            spelled = " ".join([w for of_unit in words for w in of_unit]).translate(self.spelling)
            flat, counts = self._modelled(spelled.split(" "))
            ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(list(map(len, words)))]
            groups.append((own, flat, np.diff(ends, prepend=0)))
        own = np.flatnonzero(~latin)
        if len(own):
            groups.append((own, *self._strange([told[i] for i in own.tolist()])))
        return together(groups, len(texts), self.type)

    def _strange(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Between special tokens each unit is normalised and cut on its own.
        if not self.special:
            return self._one_by_one(texts)
        mark, number = next(iter(self.special.items()))
        ids = self._ids(mark.join(texts))
        stops = np.flatnonzero(ids == number)
        if len(stops) != len(texts) - 1:  # a text that holds the mark itself
            return self._one_by_one(texts)
        return np.delete(ids, stops), np.diff(stops, prepend=-1, append=len(ids)) - 1

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._ids(t) for t in texts]
        return np.concatenate(parts), np.array([len(p) for p in parts])


class WordBPE(Vocabulary):
    """Units encoded by an own merge loop.

    A word is a contiguous array of its parts with the rank of every two neighbours beside it.  Each step scans the ranks for the
    smallest, deletes the boundary there and refreshes the two ranks beside it.  Words of one length take their steps together, as rows
    of a matrix that gets narrower by one part a step; a row leaves it when no neighbours can be joined.
    """

    def __init__(self, path: str):
        super().__init__(path)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in self.spec["model"]["merges"]]
        del self.spec
        ids, letters = self.ids, byte_letters()
        self.letters = {letter: b for b, letter in letters.items()}
        self.none = len(pairs)
        self.width = len(self.words) + 1  # parts without an id of their own cannot be joined
        # The pairs by their two ids, in a table of twice their number or more, each at the first free place from the one its hash names.
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.pair_key = np.full(1 << self.bits, -1, np.int64)
        self.pair_rank = np.full(1 << self.bits, self.none, np.int32)
        self.joined = np.array([ids[a + b] for a, b in pairs] + [0], np.int32)
        self.longest = 0
        for rank, (a, b) in enumerate(pairs):
            key = ids[a] * self.width + ids[b]
            at = int(self._place(np.array([key]))[0])
            probes = 1
            while self.pair_key[at] != -1 and self.pair_key[at] != key:
                at, probes = (at + 1) % len(self.pair_key), probes + 1
            if self.pair_key[at] == -1:
                self.pair_key[at], self.pair_rank[at] = key, rank
            self.longest = max(self.longest, probes)
        missing = self.width - 1
        self.inner = np.array([ids.get(letters[b], missing) for b in range(256)], np.int32)
        self.last = np.array([ids.get(letters[b] + self.end, missing) for b in range(256)], np.int32)
        self.missing = missing
        self.mark = os.path.commonprefix(list(self.special)).encode()
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        tokens = [(self.words.get(i, "") + " ").encode() for i in range(self.width)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; those that are no pair have the number of all pairs."""
        key = left.astype(np.int64) * self.width + right
        at = self._place(key)
        found = self.pair_key[at]
        out = np.where(found == key, self.pair_rank[at], self.none)
        left_over = np.flatnonzero((found != key) & (found != -1))
        for step in range(1, self.longest):
            if not len(left_over):
                break
            place = (at[left_over] + step) & (len(self.pair_key) - 1)
            got = self.pair_key[place]
            hit = got == key[left_over]
            out[left_over[hit]] = self.pair_rank[place[hit]]
            left_over = left_over[~hit & (got != -1)]
        return out

    def merged(self, parts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(rows, parts)`` of words of one length, given as rows of letter ids, when no two parts of them can be joined."""
        out, rows = [], np.arange(len(parts))
        near = self._ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(parts), -1)
        while len(rows):
            width = parts.shape[1]
            if width == 1:
                out.append((rows, parts))
                break
            at = near.argmin(1)
            low = near[np.arange(len(rows)), at]
            done = low == self.none
            if done.any():
                out.append((rows[done], parts[done]))
                rows, parts, near, at, low = (x[~done] for x in (rows, parts, near, at, low))
                if not len(rows):
                    break
            every = np.arange(len(rows))
            parts[every, at] = self.joined[low]
            keep = np.arange(width - 1)[None, :]
            parts = np.take_along_axis(parts, keep + (keep > at[:, None]), 1)
            if width > 2:
                keep = keep[:, :-1]
                near = np.take_along_axis(near, keep + (keep >= at[:, None]), 1)
                has_right = np.flatnonzero(at < width - 2)
                near[has_right, at[has_right]] = self._ranks(parts[has_right, at[has_right]], parts[has_right, at[has_right] + 1])
                has_left = np.flatnonzero(at > 0)
                near[has_left, at[has_left] - 1] = self._ranks(parts[has_left, at[has_left] - 1], parts[has_left, at[has_left]])
        return out

    def words_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given by their bytes."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(size) - size
        groups = []
        for width in np.unique(size).tolist():
            at = np.flatnonzero(size == width)
            # Few rows of long words at a time, so that a matrix stays small.
            for own in np.array_split(at, -(-len(at) * width // (1 << 20)) or 1):
                octets = data[starts[own][:, None] + np.arange(width)]
                parts = np.concatenate([self.inner[octets[:, :-1]], self.last[octets[:, -1:]]], axis=1)
                for rows, done in self.merged(parts):
                    known = done != self.missing
                    groups.append((own[rows], done[known], known.sum(1)))
        return together(groups, len(words), self.type)

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # Printable ASCII stands for itself.
        return self.words_ids(texts)

    def _odd(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # Parts of the units between special tokens; one without text stands for each of these.
        parts: list[str] = []
        of_part, special = [], []
        for i, text in enumerate(texts):
            for k, part in enumerate(self._cut.split(text.decode()) if self._cut and self.mark in text else [text.decode()]):
                if k % 2:
                    special.append((len(parts), self.special[part]))
                    part = ""
                parts.append(part)
                of_part.append(i)
        normal = self._normal(parts)
        begins = np.cumsum([0, *(len(p) + 1 for p in normal)])[:-1]
        told = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ".join(normal))
        words = [bytes(map(self.letters.__getitem__, letters)) for letters, _ in told]
        at = np.searchsorted(begins, np.array([a for _, (a, _) in told], np.int64), "right") - 1
        for part, _ in special:
            place = int(np.searchsorted(at, part))
            words.insert(place, b" ")
            at = np.insert(at, place, part)
        special = [(int(np.searchsorted(at, part)), number) for part, number in special]
        counts = np.bincount(np.array(of_part, np.int64)[at], minlength=len(texts)) if len(at) else np.zeros(len(texts), np.int64)
        if not words:
            return np.zeros(0, self.type), np.zeros(len(texts), np.int64)
        flat, lengths = self.words_ids(words)
        if special:
            # A stand-in of one id for each special token.
            parts = np.split(flat, np.cumsum(lengths)[:-1])
            for at, number in special:
                parts[at] = np.array([number], self.type)
            flat, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        return flat, np.diff(ends, prepend=0)

    def _normal(self, parts: list[str]) -> list[str]:
        """Parts as the library normalises them, with a character between that it leaves alone."""
        normal = self.tokenizer.normalizer.normalize_str
        told = normal("\0".join(parts)).split("\0")
        return told if len(told) == len(parts) else [normal(p) for p in parts]

    def decode(self, ids) -> str:
        """The tokens with a space between; unknown ids are left out."""
        return self.decoded(np.asarray(list(ids), np.int64), np.array([len(ids)]))[0].as_py()

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of runs of ids: the bytes of all tokens, looked up at once."""
        ids = np.where(ids < self.missing, ids, self.missing).astype(np.int64)
        size = self.token_size[ids]
        size = np.where(size > 1, size, 0)
        text = ragged(self.token_bytes, self.token_start[ids], size)
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        # Each token brings the space behind it; the one behind the last of a text goes.
        some = np.diff(ends) > 0
        text = np.delete(text, ends[1:][some] - 1)
        offsets = (ends - np.concatenate([[0], np.cumsum(some)])).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes())]).cast(pa.string())


@lru_cache(maxsize=1)
def encoder(path: str) -> WordBPE:
    """One encoder for each worker process."""
    return WordBPE(path)


@lru_cache(maxsize=1)
def library(path: str) -> Library:
    return Library(path)
