"""Column functions on frames stored as one array per row.

They run inside the row's task, so a frame is never spread over rows and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(pixels: Column) -> Column:
    return F.transform(pixels, lambda v: v.cast("double"))


def mean(pixels: Column) -> Column:
    total = F.aggregate(doubles(pixels), F.lit(0.0), lambda acc, v: acc + v)
    return total / F.nullif(F.size(pixels).cast("double"), F.lit(0.0))


def population_std(pixels: Column, mu: Column) -> Column:
    squares = F.aggregate(doubles(pixels), F.lit(0.0), lambda acc, v: acc + (v - mu) * (v - mu))
    return F.sqrt(squares / F.nullif(F.size(pixels).cast("double"), F.lit(0.0)))


def all_finite(pixels: Column) -> Column:
    """No NaN, infinity or NULL among the pixels."""
    bound = float("inf")
    return F.forall(
        pixels, lambda v: v.isNotNull() & ~F.isnan(v) & (v < F.lit(bound)) & (v > F.lit(-bound))
    )


def _order_statistics(values: np.ndarray, quantiles: Sequence[float]) -> list[float]:
    """Linearly interpolated percentiles of values in any order, by selection of the few places needed."""
    places = [q * (len(values) - 1) for q in quantiles]
    lows = [int(p) for p in places]
    highs = [min(low + 1, len(values) - 1) for low in lows]
    chosen = np.partition(values, sorted({*lows, *highs}))
    return [chosen[a] + (chosen[b] - chosen[a]) * (p - a) for p, a, b in zip(places, lows, highs, strict=True)]


def display_range(pixels: Column, vmax: float | None = None) -> Column:
    """Struct ``(vmin, vmax)``: 1st and 99.9th percentile of the pixels above zero, vmin at least 0.

    Without a positive pixel the range is (0, 1).  The two places are selected, which takes time in proportion to the pixels.
    """

    @F.arrow_udf("vmin double, vmax double")
    def limits(arrays: pa.Array) -> pa.Array:
        low, high = [], []
        for pixels_of_frame in arrays:
            values = np.zeros(0) if pixels_of_frame.values is None else pixels_of_frame.values.drop_null().to_numpy(zero_copy_only=False)
            values = values[values > 0]
            found = _order_statistics(values, (0.01, 0.999)) if len(values) else (0.0, 1.0)
            low.append(found[0])
            high.append(found[1] if vmax is None else float(vmax))
        return pa.StructArray.from_arrays([pa.array(low, pa.float64()), pa.array(high, pa.float64())], ["vmin", "vmax"])

    return limits(pixels.cast("array<double>"))


def frame_count(shape: Column, native_ndim: Column | None = None) -> Column:
    """Frames in a dataset of the given shape.

    By default three dimensions mean ``shape[0]`` frames and anything else one.  With
    ``native_ndim``, the dimensions of one frame, one extra leading dimension counts the frames,
    which also covers stacks of multi-module frames.
    """
    stacked = F.size(shape) == (F.lit(3) if native_ndim is None else native_ndim + 1)
    return F.when(stacked, F.get(shape, F.lit(0))).otherwise(1)


def shape_2d(shape: Column, panel_ss: Column | None = None, panel_fs: Column | None = None) -> Column:
    """Struct ``(h, w)`` of a frame as an image; pixel order never changes.

    2-D stays, 3-D modules are stacked by rows, 1-D needs the panel size; else the task fails.
    """
    dims = F.size(shape)
    at = lambda i: F.get(shape, F.lit(i)).cast("int")
    flat_ok = panel_ss is not None and panel_fs is not None
    flat_h = panel_ss.cast("int") if flat_ok else F.raise_error(F.lit("a 1-D frame needs panel_ss and panel_fs"))
    flat_w = panel_fs.cast("int") if flat_ok else F.raise_error(F.lit("a 1-D frame needs panel_ss and panel_fs"))
    bad = F.raise_error(F.concat(F.lit("unexpected number of dimensions: "), dims.cast("string")))
    return F.struct(
        F.when(dims == 2, at(0)).when(dims == 3, at(0) * at(1)).when(dims == 1, flat_h).otherwise(bad.cast("int")).alias("h"),
        F.when(dims == 2, at(1)).when(dims == 3, at(2)).when(dims == 1, flat_w).otherwise(bad.cast("int")).alias("w"),
    )


def agipd_panel(pixel: Column, module_ss: int, module_fs: int, panel_ss: int) -> Column:
    """Panel number of a pixel of a stacked-module frame, from its row-major position."""
    per_module = module_ss // panel_ss
    row = F.floor(pixel / module_fs)
    return (F.floor(row / module_ss) * per_module + F.floor((row % module_ss) / panel_ss)).cast("int")
