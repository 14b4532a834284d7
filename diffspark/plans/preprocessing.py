"""From stored frames to normalised tensors, mixed detectors in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffspark.constants import AGIPD_MODULE_SS, LCN_WINDOW, LCN_WINDOWS_COMPARED, TARGET_SIZE
from diffspark.functions.arrays import all_finite
from diffspark.operators import catalog, geometry
from diffspark.operators.lookup import BROADCAST_BYTES
from diffspark.operators.normalize import normalize_frames
from diffspark.session import checkpointed


def assembly_of(panels: DataFrame, frame_widths: dict[str, int], module_rows: int = AGIPD_MODULE_SS) -> DataFrame:
    """Assembly runs of all detectors, written once so that every later job only reads them."""
    width = F.coalesce(*[F.when(F.col("detector") == d, F.lit(w)) for d, w in frame_widths.items()])
    stacked = F.when(F.col("module").isNotNull() & (F.col("detector") == "AGIPD"), F.lit(module_rows)).otherwise(F.lit(0))
    cells = geometry.assembly_cells(geometry.panel_pixels(panels, width, stacked))
    return checkpointed(geometry.assembly_lists(cells))


def preprocess_assembled(
    frames: DataFrame, window: int = LCN_WINDOW, size: tuple[int, int] | None = TARGET_SIZE
) -> DataFrame:
    """GCN, LCN, resize of frames that already are images."""
    return normalize_frames(frames, size, window)


def assembly_arrays(lists: DataFrame) -> list[dict[str, tuple[int, np.ndarray]]]:
    """Assembly runs to hand to the tasks, in groups of detectors of at most ``BROADCAST_BYTES``."""
    return geometry.assembly_arrays(lists, BROADCAST_BYTES)


def preprocess_panels(
    frames: DataFrame, lists: DataFrame, window: int = LCN_WINDOW, size: tuple[int, int] | None = TARGET_SIZE
) -> DataFrame:
    """Assemble by ``detector``, then GCN, LCN, resize, in one pass over the frames.

    A frame of a detector without geometry is taken as an image.
    """
    arrays = assembly_arrays(lists)
    named = frames.withColumn("_assemble_as", F.col("detector"))
    return normalize_frames(named, size, window, assembly=arrays, assemble_as="_assemble_as")


def preprocess_routed(
    frames: DataFrame, lists: DataFrame, window: int = LCN_WINDOW, size: tuple[int, int] | None = TARGET_SIZE
) -> DataFrame:
    """Frames of many detectors: those with a usable geometry are assembled, the others taken as images.

    ``frames`` carries ``description`` and ``detector``.  A frame routed to assembly whose detector
    has no list falls back to the assembled route, with the reason kept.
    """
    routed = catalog.route_frames(frames)
    arrays = assembly_arrays(lists)
    usable = [name for group in arrays for name in group]  # one for each detector type
    wanted = F.col("route") != "assembled"
    lost = wanted & ~F.coalesce(F.col("detector").isin(*usable), F.lit(False))
    marked = routed.withColumns(
        {
            "route_reason": F.when(lost, "no geometry").otherwise(F.col("route_reason")),
            "route": F.when(lost, "assembled").otherwise(F.col("route")),
        }
    )
    name = F.when(F.col("route") != "assembled", F.col("detector"))
    return normalize_frames(marked.withColumn("_assemble_as", name), size, window, assembly=arrays, assemble_as="_assemble_as")


def apply_preprocess(frames: DataFrame, fn: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """A user's own preparation step, or the raw frames when there is none."""
    return frames if fn is None else frames.transform(fn)


def window_sweep(
    frames: DataFrame,
    windows: Sequence[int] = LCN_WINDOWS_COMPARED,
    size: tuple[int, int] | None = TARGET_SIZE,
) -> DataFrame:
    """Every frame normalised with every LCN window: adds ``lcn_window``."""
    return normalize_frames(frames, size, windows=[int(w) for w in windows])


def shared_scale(images: DataFrame, by: Sequence[str], pixels: str = "pixels") -> DataFrame:
    """Smallest and largest pixel per group over all its images."""
    return images.groupBy(*by).agg(
        F.min(F.array_min(pixels).cast("double")).alias("vmin"), F.max(F.array_max(pixels).cast("double")).alias("vmax")
    )


def frame_stats(raw: DataFrame, keys: Sequence[str], window: int = LCN_WINDOW, size=TARGET_SIZE) -> DataFrame:
    """Raw range, and range, mean and finiteness after normalisation, per frame."""
    marked = raw.withColumns(
        {
            "raw_min": F.array_min("pixels").cast("double"),
            "raw_max": F.array_max("pixels").cast("double"),
        }
    )
    done = normalize_frames(marked, size, window)
    total = F.aggregate("pixels", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return done.select(
        *keys,
        "raw_min",
        "raw_max",
        F.array_min("pixels").cast("double").alias("norm_min"),
        F.array_max("pixels").cast("double").alias("norm_max"),
        (total / F.size("pixels")).alias("norm_mean"),
        all_finite(F.col("pixels")).alias("finite"),
    )


def shape_report(files: DataFrame, lists: DataFrame, size: tuple[int, int] = TARGET_SIZE) -> DataFrame:
    """Per file: stored shape, assembled shape, output shape, route and PASS or FAIL, from metadata only.

    ``files`` has ``detector, description, h, w`` with ``h x w`` the stored frame as an image.
    """
    routed = catalog.route_frames(files)
    sides = lists.select("detector", "side", F.col("needs").alias("_needs"))
    joined = routed.join(sides, "detector", "left")
    uses = F.col("route") != "assembled"
    fits = ~uses | (F.col("side").isNotNull() & (F.col("_needs") <= F.col("h") * F.col("w")))
    text = lambda a, b: F.concat_ws("x", a.cast("string"), b.cast("string"))
    return joined.select(
        *[c for c in files.columns if c not in ("h", "w")],
        text(F.col("h"), F.col("w")).alias("raw_shape"),
        F.when(uses, text(F.col("side"), F.col("side"))).otherwise(text(F.col("h"), F.col("w"))).alias("assembled_shape"),
        F.lit(f"{size[0]}x{size[1]}").alias("output_shape"),
        F.when(uses, "geometry").otherwise("assembled").alias("route"),
        F.when(F.coalesce(fits, F.lit(False)), "PASS").otherwise("FAIL").alias("result"),
    )
