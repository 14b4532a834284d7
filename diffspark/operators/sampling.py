"""Seeded shuffles, exact random splits and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.operators.ordered import number_rows

_STEP = 4  # hex digits settled per pass: at most 65,536 counters


def shuffle_key(row_id: Column, seed: int) -> Column:
    """A seeded pseudo-random text per row: equal for equal ids, whatever the partitioning.

    32 hex digits of a digest followed by the id itself, so that keys order totally.
    """
    text = row_id.cast("string")
    return F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), text)), F.lit("/"), text)


def seeded_shuffle(rows: DataFrame, row_id: str, seed: int) -> DataFrame:
    """Rows in a reproducible random order."""
    return rows.orderBy(shuffle_key(F.col(row_id), seed))


def smallest_keys(rows: DataFrame, key: str, ranks: Sequence[int], settle: int = 1000) -> dict[int, str | None]:
    """Exact order statistics of a digest key: rank r -> the r-th smallest key (None for r = 0).

    Every pass counts key prefixes, at most 65,536 per wanted rank, and keeps the one prefix that
    holds the rank; when a prefix holds at most ``settle`` rows, those few keys are read.  Rows are
    never sorted or moved.
    """
    wanted = {r: ("", r) for r in set(ranks) if r > 0}
    found: dict[int, str | None] = {0: None}
    length = 0
    while wanted:
        prefixes = sorted({p for p, _ in wanted.values()})
        length += _STEP
        part = rows.select(F.col(key).alias("k"))
        if length > _STEP:
            part = part.where(F.substring("k", 1, length - _STEP).isin(*prefixes))
        counts = part.groupBy(F.substring("k", 1, length).alias("p")).count().orderBy("p").collect()
        narrowed: dict[int, tuple[str, int, int]] = {}
        for rank, (prefix, left) in wanted.items():
            for row in counts:
                if not row["p"].startswith(prefix):
                    continue
                if left <= row["count"]:
                    narrowed[rank] = (row["p"], left, row["count"])
                    break
                left -= row["count"]
        done = {r: v for r, v in narrowed.items() if v[2] <= settle}
        if done:
            near = sorted({p for p, _, _ in done.values()})
            keys = part.where(F.substring("k", 1, length).isin(*near)).orderBy("k").collect()
            for rank, (prefix, left, _) in done.items():
                found[rank] = [k["k"] for k in keys if k["k"].startswith(prefix)][left - 1]
        wanted = {r: (p, left) for r, (p, left, _) in narrowed.items() if r not in done}
        if length > 64 and wanted:  # so many rows can only share whole keys; the one that holds the rank is read
            for rank, (prefix, left) in wanted.items():
                same = part.where(F.substring("k", 1, length) == prefix).groupBy("k").count().orderBy("k").toLocalIterator()
                for row in same:
                    left -= row["count"]
                    if left <= 0:
                        found[rank] = row["k"]
                        break
            return found
    return found


def exact_split(rows: DataFrame, row_id: str, fractions: Sequence[tuple[str, float]], rest: str, seed: int) -> DataFrame:
    """Random split with exact sizes ``int(n * fraction)``; the remaining rows go to ``rest``.

    Only the cut points of the shuffle order are looked up; assigning rows is then a comparison
    per row, without a shuffle.  ``row_id`` must be unique.
    """
    key = shuffle_key(F.col(row_id), seed)
    n = rows.count()
    ends, total = [], 0
    for _, fraction in fractions:
        total += int(n * fraction)
        ends.append(total)
    keys = rows.select(key.alias("key"))
    cuts = smallest_keys(keys, "key", ends)
    # A repeated id at a cut would make a part larger than asked; the count holds at every size.
    sizes = keys.agg(*[F.count_if(F.col("key") <= F.lit(cuts[end])).alias(f"c{i}") for i, end in enumerate(ends)]).first()
    if any(cuts[end] is not None and sizes[i] != end for i, end in enumerate(ends)):
        raise ValueError("row ids must be unique for an exact split")
    bucket = F.lit(rest)
    for (name, _), end in reversed(list(zip(fractions, ends, strict=True))):
        if cuts[end] is not None:
            bucket = F.when(key <= F.lit(cuts[end]), name).otherwise(bucket)
    return rows.withColumn("bucket", bucket)


def train_val_test(rows: DataFrame, row_id: str, val: float, test: float, seed: int) -> DataFrame:
    """Three-way exact split; test and validation sizes are ``int(n * fraction)``."""
    return exact_split(rows, row_id, [("test", test), ("val", val)], "train", seed)


def train_val(rows: DataFrame, row_id: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Two-way split cut at ``int(n * train)`` of the shuffle order."""
    return exact_split(rows, row_id, [("train", train)], "val", seed)


def number_batches(
    rows: DataFrame, row_id: str, batch_size: int, order: Column | None = None, blocks: int | None = None
) -> DataFrame:
    """``batch_id`` from 0 in the given order of a unique ``row_id``, the last batch possibly short.

    Only the ids are sorted and numbered; the rows, which may carry whole frames, meet their
    number in one join.
    """
    by = order if order is not None else F.col(row_id).asc()
    numbered = number_rows(rows.select(row_id), [], [by], "_at", blocks)
    batch = F.floor((F.col("_at") - 1) / batch_size).cast("long").alias("batch_id")
    ids = numbered.select(row_id, batch)
    return ids if rows.columns == [row_id] else rows.join(ids, row_id)
