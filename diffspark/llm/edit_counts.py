"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

A slot of the tree is a run of pre-tokens; it holds their characters and tokens, and each inner node the sums below it.  An
edit re-encodes the pre-tokens that it touches and those that could look as far as it, until a cut of the new text
falls on a cut of the old one; only the slots in between and the sums above them change.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SLOT = 16
TABLE_ENTRIES = 400_000

EDITS = "array<struct<start:int,stop:int,text:string>>"


class Counter:
    """Token counts of pre-tokens under a byte-level vocabulary given as a rank file."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self._table: dict[str, int] = {}

    def count(self, piece: str) -> int:
        """Tokens of one pre-token."""
        n = self._table.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self._table) >= TABLE_ENTRIES:
                self._table.clear()
            if len(piece) < 200:
                self._table[piece] = n
        return n


@lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class Tree:
    """Sums of characters and tokens over the slots; node k has the children 2k and 2k + 1, the root is node 1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.width = 1 << max(0, int(len(chars) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(chars)] = np.stack([chars, tokens], 1)
        level = self.width
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level = half

    @classmethod
    def of(cls, text: str, pre: Counter) -> Tree:
        pieces = pre.pattern.findall(text)
        if not pieces:
            return cls(np.zeros(1, np.int64), np.zeros(1, np.int64))
        cuts = np.arange(0, len(pieces), SLOT)
        return cls(
            np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), cuts),
            np.add.reduceat(np.fromiter(map(pre.count, pieces), np.int64, len(pieces)), cuts),
        )

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, place: int) -> tuple[int, int]:
        """Slot that holds character ``place`` (the last used one at the end of the text) and where it begins."""
        node, before = 1, 0
        place = min(place, self.chars - 1)
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            node *= 2
            if place - before >= left:
                before += left
                node += 1
        return node - self.width, before

    def set(self, slot: int, chars: int, tokens: int) -> None:
        """New sums of one slot, and of the nodes above it."""
        node = self.width + slot
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, text: str, start: int, stop: int, new: str, pre: Counter) -> tuple[str, int]:
        """Replace ``text[start:stop]``: the new text and the number of pre-tokens that were encoded again."""
        after = text[:start] + new + text[stop:]
        if not self.chars:
            fresh = Tree.of(after, pre)
            self.width, self.sums = fresh.width, fresh.sums
            return after, len(pre.pattern.findall(after))
        # A pre-token looks at most two characters beyond its end, so those that end two before the edit stay.
        slot, at = self.find(max(0, start - 2))
        delta = len(after) - len(text)
        # Old cuts from the end of the edit on, where the new reading may fall into step with the old one.
        last, end = slot, at + int(self.sums[self.width + slot, 0])
        begin, chars, tokens, read = at, 0, 0, 0
        for match in pre.pattern.finditer(after, at):
            chars += match.end() - match.start()
            tokens += pre.count(match.group())
            read += 1
            while end + delta < begin + chars and last + 1 < self.width:
                last += 1
                end += int(self.sums[self.width + last, 0])
            if end >= stop and end + delta == begin + chars:
                break
        else:
            last = self.width - 1
        self.set(slot, chars, tokens)
        for other in range(slot + 1, last + 1):
            if self.sums[self.width + other].any():
                self.set(other, 0, 0)
        return after, read


def build(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, text, n_tokens, tree binary, *keep)``: each document with its tree; one pass without a shuffle.

    A NULL text is the empty text, which has no tokens.  Rows stand alone: ids may repeat or be NULL.
    """

    def run(batches):
        pre = counter(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [t or "" for t in some.column(1).to_pylist()]
                trees = [Tree.of(t, pre) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array(texts, pa.string()),
                        pa.array([t.tokens for t in trees], pa.int64()),
                        pa.array([t.sums.astype("<i4").tobytes() for t in trees], pa.binary()),
                        *some.columns[2:],
                    ],
                    names,
                )

    names = [id_col, "text", "n_tokens", "tree", *keep]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"`{id_col}` {kinds[id_col]}, text string, n_tokens bigint, tree binary"
    schema += "".join(f", `{k}` {kinds[k]}" for k in keep)
    return docs.select(id_col, text_col, *keep).mapInArrow(run, schema)


def apply_edits(trees: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """``(id, text, n_before, n_tokens, n_read, n_edits, tree)`` of rows of :func:`build` after their edits.

    ``edits_col`` is ``EDITS``, applied in order, each to the text as the ones before left it; places are code points, cut to the
    text.  A NULL start means the end of the text, a NULL stop or one before the start means an insertion, a NULL text a
    deletion, NULL edits none.  ``n_read`` counts the pre-tokens encoded again.
    """

    def run(batches):
        pre = counter(ranks, pattern)
        for batch in batches:
            out: list[tuple] = []
            for text, tokens, packed, edits in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                tree = Tree.__new__(Tree)
                tree.sums = np.frombuffer(packed, "<i4").reshape(-1, 2).astype(np.int64)
                tree.width = len(tree.sums) // 2
                read = 0
                for edit in edits or ():
                    if edit is None:
                        continue
                    start = len(text) if edit["start"] is None else min(max(edit["start"], 0), len(text))
                    stop = min(max(start, edit["stop"] or 0), len(text))
                    text, n = tree.edit(text, start, stop, edit["text"] or "", pre)
                    read += n
                out.append((text, tokens, tree.tokens, read, len(edits or ()), tree.sums.astype("<i4").tobytes()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                [id_col, "text", "n_before", "n_tokens", "n_read", "n_edits", "tree"],
            )

    kind = trees.schema[id_col].dataType.simpleString()
    return trees.select(id_col, "text", "n_tokens", "tree", edits_col).mapInArrow(
        run, f"`{id_col}` {kind}, text string, n_before bigint, n_tokens bigint, n_read bigint, n_edits bigint, tree binary"
    )
