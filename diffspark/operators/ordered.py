"""Exact running aggregates over ordered groups of any size, with one move of the rows.

A plain ``Window.partitionBy(key).orderBy(...)`` puts each key into one task, so a key holding a
third of the rows becomes the whole job's run time.  Here Spark's range partitioner first cuts the
rows into *blocks*: contiguous stretches of the total order ``(keys, order)``, so that a hot key
simply spans many blocks.  Running values are then worked out inside the blocks, where the rows lie.

A block starts inside at most one key.  So only keys that span blocks need anything from outside:
their totals in earlier blocks and over all, at most two rows for each block.  These are broadcast;
every other key is whole within its block.  Both the sums and the rows read the same range
exchange; a task that finds another number of rows for a spanning key than was summed fails.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = "_block"
#: Rows of an Arrow batch that leaves a block.
BATCH_ROWS = 50_000

_AGGREGATE = {"sum": F.sum, "max": F.max, "min": F.min}
_STEP = {"sum": np.add, "max": np.maximum, "min": np.fmin}
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def require(value: Column, message: str | Column) -> Column:
    """``value`` unless it is NULL, in which case the running task fails with ``message``."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.coalesce(value, F.raise_error(text))


def default_blocks(spark: SparkSession) -> int:
    """The session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], blocks: int | None = None
) -> DataFrame:
    """The rows in blocks along ``(keys, order)``, sorted inside, with the block's number as ``_block``.

    ``order`` must be unique within a key for the blocks to stay balanced.  NULL keys are an error.
    A block should fit the memory of a task; more ``blocks`` make smaller ones.
    """
    count = blocks or default_blocks(df.sparkSession)
    checked = df.withColumns({k: require(F.col(k), f"NULL in group column {k}") for k in keys})
    along = [*[F.col(k) for k in keys], *order]
    # The block number stands above the sort, which the optimiser would else drop below a join.
    ranged = checked.repartitionByRange(count, *along).sortWithinPartitions(*along)
    return ranged.withColumn(BLOCK, F.spark_partition_id())


def _changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before."""
    if pa.types.is_floating(column.type):
        x = column.to_numpy(zero_copy_only=False)
        return (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
    if pa.types.is_nested(column.type):
        x = column.to_pylist()
        return np.array([a != b for a, b in zip(x[1:], x[:-1], strict=True)], bool)
    return pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False).astype(bool)


def whole_block(batches, keys: Sequence[str]) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray] | None:
    """The columns of a block, and where the rows of each key start and end in it; None for a block without rows."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    table = pa.Table.from_batches(held)
    column = {n: pa.concat_arrays(table.column(n).chunks) for n in table.column_names}
    fresh = np.zeros(table.num_rows, bool)
    fresh[0] = True
    for k in keys:
        fresh[1:] |= _changes(column[k])
    starts = np.flatnonzero(fresh)
    return column, starts, np.append(starts[1:], table.num_rows)


class _Values:
    """A numeric column as values and a mask of those that count; what is missing holds the neutral value of its kind."""

    def __init__(self, column: pa.Array, kind: str):
        self.kind = kind
        self.there = column.is_valid().to_numpy(zero_copy_only=False)
        whole = pa.types.is_integer(column.type)
        self.type = column.type
        if kind == "sum":
            neutral = 0
        elif whole:
            info = np.iinfo(column.type.to_pandas_dtype())
            neutral = info.min if kind == "max" else info.max
        else:
            neutral = -np.inf if kind == "max" else np.inf
        self.neutral = neutral
        self.values = pc.fill_null(column, pa.scalar(neutral, column.type)).to_numpy(zero_copy_only=False)

    def running(self, starts: np.ndarray, ends: np.ndarray, inclusive: bool) -> tuple[np.ndarray, np.ndarray]:
        """Running value inside each segment and whether any value counts so far."""
        segment = np.repeat(np.arange(len(starts)), ends - starts)
        if self.kind == "sum" and self.values.dtype.kind in "iu":
            total = np.cumsum(self.values)
            out = total - (total[starts] - self.values[starts])[segment]
        else:
            out = np.empty_like(self.values)
            step = _STEP[self.kind].accumulate
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                out[a:b] = step(self.values[a:b])
        seen = np.cumsum(self.there)
        some = seen - (seen[starts] - self.there[starts])[segment] > 0
        if not inclusive:
            out, some = np.concatenate([out[:1], out[:-1]]), np.concatenate([some[:1], some[:-1]])
            out[starts], some[starts] = self.neutral, False
        return out, some

    def whole(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One aggregate for each segment and whether any value counts."""
        return _STEP[self.kind].reduceat(self.values, starts), np.logical_or.reduceat(self.there, starts)

    def with_outer(self, inside: np.ndarray, some: np.ndarray, outer: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Combined with an outside value where there is one."""
        other = _Values(outer.cast(self.type), self.kind)
        return _STEP[self.kind](other.values, inside), some | other.there


def _array(values: np.ndarray, there: np.ndarray | None, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, mask=None if there is None else ~there)


def running(
    blocked: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    values: Mapping[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    totals: Mapping[str, tuple[str, Column]] | None = None,
    runs_of: str | None = None,
    spans: str | None = None,
    reduce: tuple[Callable[[dict[str, pa.Array], np.ndarray], pa.Table], T.StructType] | None = None,
) -> DataFrame:
    """Add one running aggregate per entry of ``values`` and one whole-key aggregate per ``totals``.

    Each maps an output name to ``(kind, numeric expression)``, kind being sum, max or min; NULLs do not
    count, and a running sum of nothing is 0.  With ``inclusive=False`` the current row is left out.
    ``blocked`` comes from :func:`cut_blocks`, possibly with more columns added since; rows stay in
    their blocks and in order.

    ``runs_of`` names the first column of ``order``: rows of a key with equal values of it in one block are
    a run.  Then ``_run_end`` marks the last row of a run, ``_edge`` the runs that may go on in another block,
    and ``_before_<name>`` is each running value ahead of the run (inclusive sums only).  ``spans`` names a
    column that tells whether the row's key has rows in other blocks.

    ``reduce`` turns the columns of a block, with what was added and the places where its keys start, into other rows before they
    leave the task; it comes with the schema of these.
    """
    totals = dict(totals or {})
    given = {**{f"_v_{n}": e for n, (_, e) in values.items()}, **{f"_t_{n}": e for n, (_, e) in totals.items()}}
    rows = blocked.withColumns(given)
    for name in given:
        if not isinstance(rows.schema[name].dataType, _NUMERIC):
            raise TypeError(f"{name[3:]} must be numeric, not {rows.schema[name].dataType.simpleString()}")

    # The checksum keeps all columns in this branch, so that both branches read one exchange.
    plain = [F.map_entries(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in blocked.schema]
    sums = rows.groupBy(*keys, BLOCK).agg(
        *[_AGGREGATE[kind](f"_v_{n}").alias(f"_o_{n}") for n, (kind, _) in values.items()],
        *[_AGGREGATE[kind](f"_t_{n}").alias(f"_g_{n}") for n, (kind, _) in totals.items()],
        F.count(F.lit(1)).alias("_k_rows"),
        F.bit_xor(F.xxhash64(*plain)).alias("_k_sum"),
    )
    group = [F.col(k) for k in keys] or [F.lit(0)]
    earlier = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    spanning = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(BLOCK).alias("_k_block"),
        "_k_rows",
        "_k_sum",
        F.count(F.lit(1)).over(whole).alias("_k_blocks"),
        *[_AGGREGATE[kind](f"_o_{n}").over(earlier).alias(f"_o_{n}") for n, (kind, _) in values.items()],
        *[_AGGREGATE[kind](f"_g_{n}").over(whole).alias(f"_g_{n}") for n, (kind, _) in totals.items()],
    ).where("_k_blocks > 1 and _k_sum is not null")
    on = [F.col(BLOCK) == F.col("_k_block")] + [F.col(k) == F.col(f"_k_{k}") for k in keys]
    # A key that spans blocks holds the end of one and the start of another: at most two rows a block.
    joined = rows.join(F.broadcast(spanning), on, "left")
    outer = [*[f"_o_{n}" for n in values], *[f"_g_{n}" for n in totals]]
    given_rows = joined.select(*blocked.columns, *given, "_k_rows", *outer)

    added: dict[str, T.DataType] = {}
    for name, prefix in [*[(n, "_o_") for n in values], *[(n, "_g_") for n in totals]]:
        added[name] = joined.schema[prefix + name].dataType
    if runs_of is not None:
        added |= {"_run_end": T.BooleanType(), "_edge": T.BooleanType()}
        added |= {f"_before_{n}": added[n] for n in values}
    if spans is not None:
        added[spans] = T.BooleanType()
    schema = T.StructType([*blocked.schema, *[T.StructField(n, t) for n, t in added.items()]])
    columns, names = list(blocked.columns), list(schema.names)
    kinds = {n: kind for n, (kind, _) in {**values, **totals}.items()}
    value_names, total_names, key_names = list(values), list(totals), list(keys)

    def run(batches):
        block = whole_block(batches, key_names)
        if block is None:
            return
        column, starts, ends = block
        n = int(ends[-1])
        told = column["_k_rows"].take(pa.array(starts))
        if pc.any(pc.not_equal(told, pa.array(ends - starts))).as_py():
            raise RuntimeError("a block holds other rows than were summed")
        outside = column["_k_rows"].is_valid().to_numpy(zero_copy_only=False)
        out = [column[c] for c in columns]
        inner = {}
        for name in value_names:
            outer_type = column[f"_o_{name}"].type
            v = _Values(column[f"_v_{name}"].cast(outer_type), kinds[name])
            got, some = v.with_outer(*v.running(starts, ends, inclusive), column[f"_o_{name}"])
            inner[name] = got
            out.append(_array(got, None if kinds[name] == "sum" else some, outer_type))
        segment = np.repeat(np.arange(len(starts)), ends - starts)
        for name in total_names:
            outer_type = column[f"_g_{name}"].type
            v = _Values(column[f"_t_{name}"].cast(outer_type), kinds[name])
            got, some = (x[segment] for x in v.whole(starts))
            other = _Values(column[f"_g_{name}"], kinds[name])
            out.append(_array(np.where(outside, other.values, got), np.where(outside, other.there, some), outer_type))
        if runs_of is not None:
            begins = np.zeros(n, bool)
            begins[starts] = True
            begins[1:] |= _changes(column[runs_of])
            stops = np.append(begins[1:], True)
            number = np.cumsum(begins) - 1
            first, last = number[starts][segment], number[ends - 1][segment]
            out += [pa.array(stops), pa.array(outside & ((number == first) | (number == last)))]
            run_starts = np.flatnonzero(begins)
            for name in value_names:
                own = _Values(column[f"_v_{name}"].cast(column[f"_o_{name}"].type), "sum").values
                out.append(pa.array((inner[name][run_starts] - own[run_starts])[number]))
        if spans is not None:
            out.append(pa.array(outside))
        made = pa.Table.from_arrays(out, names) if reduce is None else reduce[0](dict(zip(names, out, strict=True)), starts)
        yield from made.to_batches(max_chunksize=BATCH_ROWS)

    return given_rows.mapInArrow(run, schema if reduce is None else reduce[1])


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position", blocks: int | None = None
) -> DataFrame:
    """1-based exact position of every row inside its key (``keys`` may be empty)."""
    blocked = cut_blocks(df, keys, order, blocks)
    return running(blocked, keys, order, {name: ("sum", F.lit(1).cast("long"))}).drop(BLOCK)
