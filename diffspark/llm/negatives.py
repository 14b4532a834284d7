"""Hard-negative mining with a secondary sort.

An anchor's scores against all rows are worked out in blocks: each task holds one block of rows as a matrix and the anchors
stream past it.  What can still matter leaves the block: the best positives of the block in a first pass, and in a second one the
best negatives of each positive's window.  These travel as packed keys ``(anchor, descending score, kind, id)``; Spark deals them out
by anchor and sorts them within the partitions.  An iterator then reads the sorted stream: a positive opens a window, negatives
that fall into open windows are emitted, and nothing of an anchor is held but its open windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.llm import storage

#: Rows of a block at most; blocks are smaller, down to ``LEAST_ROWS``, while there are fewer of them than cores.
BLOCK_ROWS, LEAST_ROWS = 32_768, 4_096
#: Anchors whose scores against a block are held at once.
ANCHORS_AT_ONCE = 64
#: Scores must stay below this, so that a hundred times one fits 64 bits.
SCORE_LIMIT = 1 << 56

_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)
_POSITIVE, _NEGATIVE = 0, 1


def pack_keys(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys whose byte order is (anchor, score descending, kind, id), all signed 64-bit numbers."""
    keys = np.empty(len(ids), _KEY)
    keys["anchor"] = np.asarray(anchor, np.int64).view(np.uint64) ^ _SIGN
    keys["score"] = ~(np.asarray(score, np.int64).view(np.uint64) ^ _SIGN)
    keys["kind"] = kind
    keys["id"] = np.asarray(ids, np.int64).view(np.uint64) ^ _SIGN
    offsets = np.arange(len(ids) + 1, dtype=np.int32) * _KEY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(keys.tobytes())])


def unpack_keys(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchor, score, kind, id`` of packed keys."""
    packed = np.frombuffer(b"".join(keys.to_pylist()), _KEY)
    back = lambda x: (x.astype(np.uint64) ^ _SIGN).view(np.int64)
    return back(packed["anchor"]), back(~packed["score"].astype(np.uint64)), packed["kind"].astype(np.int8), back(packed["id"])


def leading(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, equal scores in order of place."""
    at = None
    if len(scores) > 8 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores = scores[at]
    first = np.argsort(-scores, kind="stable")[:k]
    return first if at is None else at[first]


def _quantised(rows: DataFrame, scale: int) -> DataFrame:
    """``(id, label, vector binary, spot)`` of the rows that take part; ``spot`` numbers them, so any block of spots is even."""

    def run(batches):
        from pyspark import TaskContext

        spot = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, labels = batch.column(0), batch.column(1)
            vectors = batch.column(2).cast(pa.list_(pa.float64()))
            flat, ends = vectors.flatten(), np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            values = flat.to_numpy(zero_copy_only=False)
            good = np.isfinite(values) if len(values) else np.zeros(0, bool)
            begins = np.concatenate([[0], ends])[:-1]
            bad = np.concatenate([[0], np.cumsum(~good)])
            whole = (bad[ends] == bad[begins]) & ~(ids.is_null().to_numpy(False) | labels.is_null().to_numpy(False) | vectors.is_null().to_numpy(False))
            quantised = np.floor(np.where(good, values, 0.0) * scale)
            if len(quantised) and np.abs(quantised).max() > 2**31 - 1:
                raise ValueError(f"a vector component times {scale} is beyond 32 bits")
            small = quantised.astype("<i4")
            rows_at = np.flatnonzero(whole)
            keep = pa.array(whole)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.filter(keep),
                    labels.filter(keep),
                    pa.array([small[begins[i] : ends[i]].tobytes() for i in rows_at], pa.binary()),
                    pa.array(spot + np.arange(len(rows_at)), pa.int64()),
                ],
                ["id", "label", "vector", "spot"],
            )
            spot += len(rows_at)

    return rows.select("id", "label", "vector").mapInArrow(run, "id bigint, label bigint, vector binary, spot bigint")


def _matrix(vectors: list[bytes], width: int | None = None) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros."""
    size = max([4 * (width or 0), *map(len, vectors)])
    return np.frombuffer(b"".join(v.ljust(size, b"\0") for v in vectors), "<i4").reshape(len(vectors), size // 4)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point while every sum is below 2^53, else by integers."""
    width = min(anchors.shape[1], rows.shape[1])
    anchors, rows = anchors[:, :width], rows[:, :width]
    most = int(np.abs(anchors.astype(np.int64)).max(initial=0)) * int(np.abs(rows.astype(np.int64)).max(initial=0)) * width
    if most < 1 << 53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if most >= SCORE_LIMIT:
        raise ValueError("a score may be beyond 2^56")
    return anchors.astype(np.int64) @ rows.astype(np.int64).T


def _against_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, pick, kind: int) -> DataFrame:
    """Packed keys of what ``pick(anchor row, its scores, labels, ids)`` finds in each block of rows for each anchor.

    ``pick`` gives places in the block.  A row goes to one block and an anchor to all; a task holds one block at a time.
    """
    spread = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "label", "vector", "windows")
    own = rows.select(
        F.pmod(F.xxhash64("spot"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "label", "vector",
        F.lit(None).cast("array<bigint>").alias("windows"),
    )

    def run(batches):
        block, held, matrix = None, [], None
        ids = labels = None
        for batch in batches:
            of, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if of[a] != block:
                    block, held, matrix = of[a], [], None
                if kinds[a] == 0:
                    held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).to_pylist()))
                    continue
                if not held:
                    continue  # a block without rows
                if matrix is None:
                    ids, labels = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                    matrix = _matrix([v for h in held for v in h[2]])
                for at in range(0, part.num_rows, ANCHORS_AT_ONCE):
                    some = part.slice(at, ANCHORS_AT_ONCE)
                    scores = _scores(_matrix(some.column(4).to_pylist(), 1), matrix)
                    found, anchor = [], []
                    for i, (name, label, windows) in enumerate(zip(*(some.column(c).to_pylist() for c in (2, 3, 5)), strict=True)):
                        places = pick(name, label, windows, scores[i], labels, ids)
                        found.append((scores[i][places], ids[places]))
                        anchor.append(np.full(len(places), name, np.int64))
                    who = np.concatenate(anchor)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(who), pack_keys(who, np.concatenate([s for s, _ in found]), kind, np.concatenate([i for _, i in found]))], ["anchor", "key"]
                    )

    both = own.unionByName(spread).repartition(blocks, "block").sortWithinPartitions("block", "kind", "id")
    return both.mapInArrow(run, "anchor bigint, key binary")


def _by_anchor(keys: DataFrame) -> DataFrame:
    """Keys dealt out by anchor and sorted within the partitions: the secondary sort."""
    return keys.repartition("anchor").sortWithinPartitions("key")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    block_rows: int = BLOCK_ROWS,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components count as ``floor(scale * x)``, scores are their exact inner products, higher first, ties by smaller id.  ``is_anchor`` is
    an expression of ``id_col``.  An anchor's positives are its first ``positives`` other rows of the same label; for each, the first
    ``negatives`` rows of another label with ``low_percent * positive score <= 100 * negative score <= high_percent * positive score``.
    Rows with a NULL id, label or vector, or with a NULL or non-finite component, take no part.  A shorter vector ends in
    zeros.  Rows that repeat an id are rows of their own, but never partners of an anchor of that id; an anchor id is one anchor, the
    repeated row with the smallest label and vector.  An anchor without positives or a window without negatives gives no rows; no rows
    give no rows.  Other columns are not read.  Scores from 2^56 and components beyond 32 bits fail the job.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    told = storage.kept(_quantised(named, scale), "vectors")
    asking = told.select(F.col("id").alias(id_col), F.struct("label", "vector").alias("row")).where(is_anchor)
    first = asking.groupBy(F.col(id_col).alias("id")).agg(F.min("row").alias("row"))
    anchors = storage.kept(first.select("id", "row.label", "row.vector"), "anchors")
    count = told.count()
    blocks = max(-(-count // block_rows), min(spark.sparkContext.defaultParallelism, -(-count // least_rows)), 1)

    def best(name, label, _, scores, labels, ids):
        same = np.flatnonzero((labels == label) & (ids != name))
        return same[leading(scores[same], positives)]

    def windowed(name, label, windows, scores, labels, ids):
        other = np.flatnonzero((labels != label) & (ids != name))
        held, picked = scores[other], []
        for score in set(windows):
            inside = np.flatnonzero((100 * held >= low_percent * score) & (100 * held <= high_percent * score))
            picked.append(inside[leading(held[inside], negatives)])
        return other[np.unique(np.concatenate(picked))]

    def first_of_anchor(batches):
        anchor, taken = None, 0
        for batch in batches:
            who, score, _, ids = unpack_keys(batch.column(1))
            keep = np.zeros(len(who), bool)
            for i, name in enumerate(who):
                if name != anchor:
                    anchor, taken = name, 0
                keep[i] = taken < positives
                taken += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[keep]) for x in (who, score, ids)] + [batch.column(1).filter(pa.array(keep))], ["anchor", "score", "positive", "key"]
            )

    none = anchors.withColumn("windows", F.lit(None).cast("array<bigint>"))
    near = _by_anchor(_against_blocks(told, none, blocks, best, _POSITIVE))
    near = storage.kept(near.mapInArrow(first_of_anchor, "anchor bigint, score bigint, positive bigint, key binary"), "positives")
    # At most `positives` scores for each anchor.
    windows = near.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("windows"))
    asked = anchors.join(windows, "id")
    far = _against_blocks(told, asked, blocks, windowed, _NEGATIVE)

    def emit(batches):
        anchor, opened = None, []
        for batch in batches:
            out = []
            for name, score, kind, row in zip(*(x.tolist() for x in unpack_keys(batch.column(1))), strict=True):
                if name != anchor:
                    anchor, opened = name, []
                if kind == _POSITIVE:
                    opened.append([row, score, 0])
                    continue
                for window in opened:
                    if window[2] < negatives and low_percent * window[1] <= 100 * score <= high_percent * window[1]:
                        window[2] += 1
                        out.append((name, window[0], window[2], row, window[1], score))
                # A window closes when it is full or the scores have fallen below it.
                opened = [w for w in opened if w[2] < negatives and 100 * score >= low_percent * w[1]]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(_RESULT))

    stream = _by_anchor(near.select("anchor", "key").unionByName(far))
    return stream.mapInArrow(emit, ", ".join(f"{n} {t}" for n, t in _RESULT.items()))


_RESULT = {
    "anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint",
}
