"""Global contrast, local contrast and resize, always in that order.

Two forms with the same results:

* ``arrow``: one row per frame.  Frames stay in their row; Arrow batches go through a few numpy
  lines, frames of one shape together.  Nothing is shuffled.  This is the form for data.
* ``pixels``: one row per pixel (``frame_id, y, x, v``), joins with weight tables and group-bys.
  It moves every pixel, so it is meant for small frames and for checking the other form in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffspark.constants import GCN_EPSILON, LCN_EPSILON, LCN_WINDOW, TARGET_SIZE
from diffspark.operators.axis_weights import box_matrix, nonzero, reflect_edge, resize_bands, resize_matrix, window_span

_CACHED_PIXELS = 1 << 16  # of all frames worked on together: half a MB for each working array


# ---------------------------------------------------------------- one row per frame


def gcn_frames(frames: DataFrame, pixels: str = "pixels", eps: float = GCN_EPSILON) -> DataFrame:
    """``(v - mean) / (population std + eps)`` per frame ``(..., h, w, pixels)``, in doubles."""
    return normalize_frames(frames, size=None, pixels=pixels, lcn=False, gcn_eps=eps, double=True)


def _gcn(images: np.ndarray, eps: float) -> np.ndarray:
    flat = images.reshape(len(images), -1)
    centred = flat - flat.mean(axis=1)[:, None]
    spread = np.sqrt(np.einsum("ij,ij->i", centred, centred) / flat.shape[1])
    centred /= (spread + eps)[:, None]
    return centred.reshape(images.shape)


def _box_means(lines: np.ndarray, n: int, window: int) -> np.ndarray:
    """Mean of the window around each pixel of ``n`` lines, given with the lines before and after; one axis after the other."""
    before, after = window_span(window)
    lines = _window_sums(lines, n, window, 1) / window
    w = lines.shape[2]
    padded = np.take(lines, reflect_edge(np.arange(-before, w + after), w), axis=2)
    return _window_sums(padded, w, window, 2) / window


def _window_sums(padded: np.ndarray, n: int, window: int, axis: int) -> np.ndarray:
    """Sums of ``window`` neighbours along an axis, from sums of 1, 2, 4, ... neighbours."""

    def part(a: np.ndarray, first: int, length: int) -> np.ndarray:
        return a[:, first : first + length, :] if axis == 1 else a[:, :, first : first + length]

    total, offset, width = None, 0, 1
    while True:
        if window & width:
            piece = part(padded, offset, n)
            total = piece.copy() if total is None else total + piece
            offset += width
        if 2 * width > window:
            return total
        length = padded.shape[axis] - width
        padded = part(padded, 0, length) + part(padded, width, length)
        width *= 2


def _lcn(images: np.ndarray, first: int, end: int, window: int, eps: float) -> np.ndarray:
    """Local contrast of a strip of lines; both local moments come from one box pass over the pixels and their squares."""
    before, after = window_span(window)
    lines = images[:, reflect_edge(np.arange(first - before, end + after), images.shape[1])]
    mean, second = np.split(_box_means(np.concatenate([lines, lines * lines]), end - first, window), 2)
    second -= mean * mean
    np.maximum(second, 0.0, out=second)
    return (images[:, first:end] - mean) / (np.sqrt(second) + eps)


def _strips(images: np.ndarray, halo: int) -> Iterator[tuple[int, int]]:
    """Stretches of lines whose working arrays stay in a core's cache."""
    n, h, w = images.shape
    lines = max(16, 2 * halo, _CACHED_PIXELS // max(1, n * w))
    for first in range(0, h, lines):
        yield first, min(h, first + lines)


def _finish(images: np.ndarray, window: int | None, eps: float, size: tuple[int, int] | None) -> np.ndarray:
    """Local contrast (unless ``window`` is None) and resize, a strip of lines at a time."""
    if window is None and size is None:
        return images
    n, h, w = images.shape
    out = np.empty_like(images) if size is None else np.zeros((n, *size))
    for first, end in _strips(images, window or 0):
        strip = images[:, first:end] if window is None else _lcn(images, first, end, window, eps)
        if size is None:
            out[:, first:end] = strip
            continue
        narrow = np.empty((n, end - first, size[1]))
        for x0, x1, low, high, weights in resize_bands(w, size[1]):
            narrow[:, :, x0:x1] = strip[:, :, low:high] @ weights.T
        for y0, y1, low, high, weights in resize_bands(h, size[0]):
            a, b = max(first, low), min(end, high)
            if a < b:
                out[:, y0:y1] += weights[:, a - low : b - low] @ narrow[:, a - first : b - first]
    return out


def normalize_frames(
    frames: DataFrame,
    size: tuple[int, int] | None = TARGET_SIZE,
    window: int = LCN_WINDOW,
    pixels: str = "pixels",
    window_column: str | None = None,
    windows: Sequence[int] | None = None,
    gcn: bool = True,
    lcn: bool = True,
    gcn_eps: float = GCN_EPSILON,
    lcn_eps: float = LCN_EPSILON,
    assembly: Sequence[Mapping[str, tuple[int, np.ndarray]]] | None = None,
    assemble_as: str | None = None,
    double: bool = False,
) -> DataFrame:
    """GCN, LCN and resize of frames ``(..., h, w, pixels)``; other columns pass through.

    ``size=None`` keeps the frame size.  ``window_column`` takes the LCN window from the row.
    ``assembly`` are groups of names with ``(side, runs)``; a frame whose ``assemble_as`` column holds such
    a name is first placed on that square image (``runs`` as in ``geometry.assembly_lists``).  Each group is a broadcast of
    its own, which a task fetches when it meets one of the group's names.
    ``windows`` gives every frame once per LCN window, with the window in ``lcn_window``; the work before LCN is done once.
    Output pixels are float32, or float64 with ``double``.
    """
    carried = [c for c in frames.columns if c not in ("h", "w", pixels, assemble_as)]
    sc = frames.sparkSession.sparkContext
    shared = {name: (i, group) for i, group in enumerate(map(sc.broadcast, map(dict, assembly or []))) for name in group.value}
    numbers = {name: i for i, name in enumerate(shared)}
    names = list(shared)
    schema = T.StructType(
        [frames.schema[c] for c in carried]
        + [
            T.StructField("h", T.IntegerType()),
            T.StructField("w", T.IntegerType()),
            T.StructField(pixels, T.ArrayType(T.DoubleType() if double else T.FloatType())),
        ]
        + ([T.StructField("lcn_window", T.IntegerType())] if windows is not None else [])
    )

    def transform(images: np.ndarray, wins: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        if gcn:
            images = _gcn(images, gcn_eps)
        for win in wins:
            yield win, _finish(images, win if lcn else None, lcn_eps, size).astype(np.float64 if double else np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

        def place(code: int) -> tuple[int, np.ndarray, np.ndarray]:
            if code not in places:
                side, runs = shared[names[code]][1].value[names[code]]
                inside = np.arange(runs["length"].sum()) - np.repeat(np.cumsum(runs["length"]) - runs["length"], runs["length"])
                target = np.repeat(runs["target"], runs["length"]) + inside
                places[code] = side, target, np.repeat(runs["source"], runs["length"]) + inside * np.repeat(runs["stride"], runs["length"])
            return places[code]

        for batch in batches:
            hs = batch.column("h").to_numpy(zero_copy_only=False)
            ws = batch.column("w").to_numpy(zero_copy_only=False)
            wins = (
                batch.column(window_column).to_numpy(zero_copy_only=False)
                if window_column
                else np.full(len(hs), window)
            )
            codes = np.full(len(hs), -1)
            if shared:
                codes = np.array([numbers.get(name, -1) for name in batch.column(assemble_as).to_pylist()])
            shapes = np.stack([hs, ws, wins, codes], axis=1).astype(np.int64)
            arrays = batch.column(pixels)
            starts = arrays.offsets.to_numpy()
            flat = arrays.values.to_numpy(zero_copy_only=False)
            for h, w, win, code in np.unique(shapes, axis=0):
                rows = np.flatnonzero((shapes == (h, w, win, code)).all(axis=1))
                side, target, source = place(code) if code >= 0 else (None, None, None)
                if (starts[rows + 1] - starts[rows] != h * w).any():
                    raise ValueError(f"a frame does not hold {h} x {w} pixels")
                at_once = max(1, int(_CACHED_PIXELS // max(1, h * w, (side or 0) ** 2)))
                for first in range(0, len(rows), at_once):
                    part = rows[first : first + at_once]
                    taken = [flat[s : s + h * w] for s in starts[part]]
                    if side is None:
                        images = np.stack(taken).reshape(len(part), h, w)
                    else:
                        images = np.zeros((len(part), side * side), flat.dtype)
                        for image, t in zip(images, taken, strict=True):
                            image[target] = t[source]
                        images = images.reshape(len(part), side, side)
                    for used, out in transform(images.astype(np.float64), windows or [int(win)]):
                        area = out.shape[1] * out.shape[2]
                        offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * area)
                        columns = [batch.column(c).take(pa.array(part)) for c in carried]
                        columns += [
                            pa.array(np.full(len(part), out.shape[1], dtype=np.int32)),
                            pa.array(np.full(len(part), out.shape[2], dtype=np.int32)),
                            pa.ListArray.from_arrays(offsets, pa.array(out.ravel())),
                        ]
                        if windows is not None:
                            columns.append(pa.array(np.full(len(part), used, dtype=np.int32)))
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    inputs = [*carried, "h", "w", pixels, *([assemble_as] if shared else [])]
    return frames.select(*inputs).mapInArrow(run, schema)


# ---------------------------------------------------------------- one row per pixel


def pixels_of(frames: DataFrame, keys: Sequence[str], width: Column, pixels: str = "pixels") -> DataFrame:
    """Row-major array to ``(keys..., y, x, v)``."""
    rows = frames.select(*keys, width.cast("int").alias("_w"), F.posexplode(pixels).alias("_i", "_v"))
    return rows.select(
        *keys,
        F.floor(F.col("_i") / F.col("_w")).cast("int").alias("y"),
        (F.col("_i") % F.col("_w")).cast("int").alias("x"),
        F.col("_v").cast("double").alias("v"),
    )


def gcn_pixels(pixels: DataFrame, keys: Sequence[str], eps: float = GCN_EPSILON) -> DataFrame:
    """GCN of pixel rows."""
    stats = pixels.groupBy(*keys).agg(F.avg("v").alias("_mu"), F.stddev_pop("v").alias("_sd"))
    scaled = (F.col("v") - F.col("_mu")) / (F.col("_sd") + F.lit(eps))
    return pixels.join(stats.hint("merge"), list(keys)).withColumn("v", scaled).drop("_mu", "_sd")


def along_axis(
    pixels: DataFrame, keys: Sequence[str], axis: str, weights: Sequence[tuple[int, int, float]], values: Sequence[str]
) -> DataFrame:
    """Multiply one axis by a weight table.

    The table has at most ``n_out * n_in`` entries of one image side, which bounds the broadcast.
    """
    table = pixels.sparkSession.createDataFrame(list(weights), "_dst int, _src int, _weight double")
    other = "x" if axis == "y" else "y"
    spread = pixels.join(F.broadcast(table), F.col(axis) == F.col("_src"))
    return (
        spread.groupBy(*keys, other, F.col("_dst").alias("_new"))
        .agg(*[F.sum(F.col(v) * F.col("_weight")).alias(v) for v in values])
        .withColumnRenamed("_new", axis)
        .select(*keys, "y", "x", *values)
    )


def lcn_pixels(
    pixels: DataFrame, keys: Sequence[str], h: int, w: int, window: int = LCN_WINDOW, eps: float = LCN_EPSILON
) -> DataFrame:
    """LCN of pixel rows of ``h x w`` frames."""
    squares = pixels.withColumns({"m": F.col("v"), "q": F.col("v") * F.col("v")}).select(*keys, "y", "x", "m", "q")
    along_y = along_axis(squares, keys, "y", nonzero(box_matrix(h, window)), ("m", "q"))
    local = along_axis(along_y, keys, "x", nonzero(box_matrix(w, window)), ("m", "q"))
    spread = F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)))
    scaled = (F.col("v") - F.col("m")) / (spread + F.lit(eps))
    return pixels.join(local.hint("merge"), [*keys, "y", "x"]).withColumn("v", scaled).drop("m", "q")


def resize_pixels(pixels: DataFrame, keys: Sequence[str], h: int, w: int, size: tuple[int, int]) -> DataFrame:
    """Resize of pixel rows of ``h x w`` frames."""
    along_y = along_axis(pixels, keys, "y", nonzero(resize_matrix(h, size[0])), ("v",))
    return along_axis(along_y, keys, "x", nonzero(resize_matrix(w, size[1])), ("v",))


def normalize_pixels(
    pixels: DataFrame, keys: Sequence[str], h: int, w: int, size: tuple[int, int], window: int = LCN_WINDOW
) -> DataFrame:
    """GCN, LCN and resize of pixel rows; ``v`` ends as float32."""
    result = resize_pixels(lcn_pixels(gcn_pixels(pixels, keys), keys, h, w, window), keys, h, w, size)
    return result.withColumn("v", F.col("v").cast("float"))
