"""Epoch logs: losses, best epoch and early stopping."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffspark.constants import PATIENCE
from diffspark.operators.ordered import BATCH_ROWS, BLOCK, cut_blocks, running, whole_block
from diffspark.session import checkpointed

START = -1.0  # the value the first epoch has to beat


def weighted_loss(batches: DataFrame, by: Sequence[str], loss: str = "loss", n: str = "n") -> DataFrame:
    """``sum(loss * n) / max(sum(n), 1)``; 0.0 without rows of weight."""
    total = F.sum(F.col(loss) * F.col(n))
    return batches.groupBy(*by).agg(
        (F.coalesce(total, F.lit(0.0)) / F.greatest(F.coalesce(F.sum(n), F.lit(0)), F.lit(1))).alias("loss")
    )


def _positions(log: DataFrame, keys, order, metric, blocks) -> DataFrame:
    """Blocks with ``position``, the best earlier metric (NaN never counts) and whether the run has other blocks."""
    blocked = cut_blocks(log, keys, order, blocks)
    value = F.when(~F.isnan(metric), F.col(metric))
    placed = running(
        blocked,
        keys,
        order,
        {"_earlier": ("sum", F.lit(1).cast("long")), "_best_before": ("max", value)},
        inclusive=False,
        spans="_spans",
    )
    return placed.withColumn("position", F.col("_earlier") + 1).drop("_earlier")


def _accepted_with_delta(rows: DataFrame, keys: Sequence[str], metric: str, min_delta: float) -> DataFrame:
    """``rows`` with ``improved``, when an epoch must beat the accepted best by ``min_delta``.

    An accepted epoch always beats every earlier one, so only strict prefix maxima (records) can be accepted.  They rise
    along a run; after one is accepted, the next is the first record above its value plus ``min_delta``.  Inside a block
    these steps are pointers in an array, and doubling them tells for every record which one is accepted last when it
    is the first.  A run over several blocks is then followed block by block, one search in each; the bars that its blocks
    start with are at most two a block and go to all tasks, which mark their own rows.
    """
    names, kinds = list(keys), {k: rows.schema[k].dataType.simpleString() for k in keys}
    key_columns = ", ".join(f"`{k}` {t}" for k, t in kinds.items())
    key_columns = key_columns + ", " if names else ""

    def exits(batches):
        block = whole_block(batches, names)
        if block is None:
            return
        column, starts, ends = block
        across = column["_spans"].to_numpy(zero_copy_only=False)
        value = column[metric].cast(pa.float64()).to_numpy(zero_copy_only=False)
        beats = column["_beats"].to_numpy(zero_copy_only=False).astype(bool)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if not across[a]:
                continue
            v = value[a:b][beats[a:b]]
            last, step = np.arange(len(v)), np.append(np.searchsorted(v, v + min_delta, "right"), len(v))
            while (step[:-1] < len(v)).any():
                last = np.where(step[:-1] < len(v), np.append(last, 0)[step[:-1]], last)
                step = step[step]
            yield pa.RecordBatch.from_arrays(
                [column[k].slice(a, 1) for k in names]
                + [column[BLOCK].slice(a, 1), pa.array([v.tobytes()], pa.binary()), pa.array([v[last].tobytes()], pa.binary())],
                [*names, BLOCK, "_from", "_last"],
            )

    def bars(batches):
        key, bar = None, 0.0
        for batch in batches:
            for row in batch.to_pylist():
                if (own := tuple(row[k] for k in names)) != key:
                    key, bar = own, START + min_delta
                yield pa.RecordBatch.from_pylist([{**{k: row[k] for k in names}, BLOCK: row[BLOCK], "_bar": bar}], schema=bar_schema(batch))
                first = int(np.searchsorted(np.frombuffer(row["_from"]), bar, "right"))
                last = np.frombuffer(row["_last"])
                if first < len(last):
                    bar = float(last[first]) + min_delta

    def bar_schema(batch):
        return pa.schema([*[batch.schema.field(k) for k in names], batch.schema.field(BLOCK), pa.field("_bar", pa.float64())])

    def mark(batches):
        block = whole_block(batches, names)
        if block is None:
            return
        column, starts, ends = block
        value = column[metric].cast(pa.float64()).to_numpy(zero_copy_only=False)
        beats = column["_beats"].to_numpy(zero_copy_only=False).astype(bool)
        bar_of = column["_bar"].to_numpy(zero_copy_only=False)
        improved = np.zeros(len(value), bool)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            at = a + np.flatnonzero(beats[a:b])
            v = value[at]
            i = int(np.searchsorted(v, bar_of[a], "right"))
            while i < len(v):
                improved[at[i]] = True
                i = int(np.searchsorted(v, v[i] + min_delta, "right"))
        yield from pa.Table.from_arrays([column[c] for c in kept] + [pa.array(improved)], [*kept, "improved"]).to_batches(BATCH_ROWS)

    kept = [c for c in rows.columns if c not in ("_beats", "_spans")]
    told = rows.mapInArrow(exits, f"{key_columns}{BLOCK} int, _from binary, _last binary")
    dealt = (told.repartition(*names) if names else told.coalesce(1)).sortWithinPartitions(*names, BLOCK)
    started = dealt.mapInArrow(bars, f"{key_columns}{BLOCK} int, _bar double")
    started = started.select(*[F.col(k).alias(f"_k_{k}") for k in names], F.col(BLOCK).alias("_k_block"), "_bar")
    on = [F.col(BLOCK) == F.col("_k_block")] + [F.col(k) == F.col(f"_k_{k}") for k in names]
    joined = rows.join(F.broadcast(started), on, "left").select(*rows.columns, F.coalesce("_bar", F.lit(START + min_delta)).alias("_bar"))
    return joined.mapInArrow(mark, T.StructType([*[rows.schema[c] for c in kept], T.StructField("improved", T.BooleanType())]))


def _tracked(log, keys, order, metric, min_delta, blocks) -> DataFrame:
    """Epochs with ``position``, ``improved``, ``no_improve`` and the last improvement ``_last``.

    Improvements only rise, so the last one has the highest position and the highest value."""
    rows = _positions(log, keys, order, metric, blocks)
    before = F.greatest(F.coalesce("_best_before", F.lit(START)), F.lit(START))
    beats = ~F.isnan(metric) & F.col(metric).isNotNull() & (F.col(metric) > before)
    if min_delta == 0.0:
        marked = rows.withColumn("improved", beats).drop("_spans")
    else:
        # Read by both branches of the next pass, so the marks are worked out once.
        marked = checkpointed(_accepted_with_delta(rows.withColumn("_beats", beats), keys, metric, min_delta))
    at, value = (F.when(F.col("improved"), F.col(c)) for c in ("position", metric))
    tracked = running(marked, keys, order, {"_last_at": ("max", at), "_last_value": ("max", value)})
    waited = F.col("position") - F.coalesce("_last_at", F.lit(0))
    last = F.struct(F.col("_last_at").alias("position"), F.col("_last_value").alias("value"))
    return tracked.withColumns({"no_improve": waited, "_last": last}).drop("_best_before", "_last_at", "_last_value")


def mark_improvements(
    log: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    metric: str = "val_f1",
    patience: int = PATIENCE,
    min_delta: float = 0.0,
    blocks: int | None = None,
) -> DataFrame:
    """Every epoch with ``position``, ``improved``, ``no_improve`` and ``kept``.

    An epoch improves when its metric exceeds the best so far (by more than ``min_delta``).
    Training stops at the first epoch that is the ``patience``-th in a row without improvement;
    later rows have ``kept`` false.
    """
    tracked = _tracked(log, keys, order, metric, min_delta, blocks)
    stop = F.when(F.col("no_improve") >= patience, F.col("position"))
    marked = running(tracked, keys, order, {}, totals={"_stop": ("min", stop)})
    kept = F.col("_stop").isNull() | (F.col("position") <= F.col("_stop"))
    return marked.withColumn("kept", kept).drop(BLOCK, "_last", "_stop")


def early_stopping(
    log: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    metric: str = "val_f1",
    patience: int = PATIENCE,
    min_delta: float = 0.0,
    blocks: int | None = None,
) -> DataFrame:
    """Per run: last epoch run, whether it stopped early, and the best epoch and value.

    The last improvement as seen from the stopping epoch is the best epoch, so one aggregate after
    the ranking passes is enough: first per ``(keys, block)``, as the rows lie, then per key.
    """
    tracked = _tracked(log, keys, order, metric, min_delta, blocks)
    row = F.struct("position", "_last")
    per_block = tracked.groupBy(*keys, BLOCK).agg(
        F.min(F.when(F.col("no_improve") >= patience, row)).alias("_stop"), F.max(row).alias("_final")
    )
    ends = per_block.groupBy(*keys).agg(F.min("_stop").alias("_stop"), F.max("_final").alias("_final"))
    end = F.coalesce("_stop", "_final")
    return ends.select(
        *keys,
        end["position"].alias("last_epoch"),
        F.col("_stop").isNotNull().alias("stopped_early"),
        F.coalesce(end["_last"]["position"], F.lit(0)).alias("best_epoch"),
        F.coalesce(end["_last"]["value"], F.lit(START)).alias("best_value"),
    )
