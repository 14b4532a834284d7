"""Detector panels: summaries, cutting panels out of a canvas, assembling panels into an image.

A *panel* row (see ``schemas.PANELS``) places one rectangular sensor: ``t_vec`` is the position of
its first pixel in metres, ``ss_vec``/``fs_vec`` the steps along its slow and fast axes, and
``ss0..ss1``, ``fs0..fs1`` (end excluded) its rectangle in the stored frame.  ``panel_order`` is
the panel's place in its file.

Image cell of a pixel at ``r``: ``round(r / pixel) + R`` per axis (halves to even), where ``R`` is the largest
absolute rounded offset over both axes; the image is square with side ``2R + 1`` and the beam in
the middle.  When two pixels fall on one cell the later panel wins; cells without pixel are 0.

An image is described by *runs*: stretches of cells of one image line whose sources are equally far apart (1 for a panel
that lies along the line, minus or plus the frame's width for one that is turned).  Their number goes with the lines of
the panels, not with the cells of the image.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffspark.operators import lookup
from diffspark.operators.normalize import normalize_frames
from diffspark.operators.ordered import require

#: An image side is at most so many times the edges of all panels in a row; a larger one is a mistake in the geometry.
MOST_SIDES = 64
#: Panels of all detectors together that are taken for a geometry.
MOST_PANELS = 100_000


def geometry_summary(panels: DataFrame) -> DataFrame:
    """Per detector: panels, pixels, whether every panel has a rectangle, average distance."""
    return panels.groupBy("detector").agg(
        F.count(F.lit(1)).alias("panels"),
        F.sum((F.col("n_ss") * F.col("n_fs")).cast("long")).alias("pixels"),
        F.bool_and(F.col("ss0").isNotNull() & F.col("fs0").isNotNull()).alias("defines_slicing"),
        F.avg(F.col("t_vec")[2]).alias("distance"),
    )


def set_distance(panels: DataFrame, distance: Column) -> DataFrame:
    """Shift every detector along the beam so that its average panel distance is ``distance``."""
    average = panels.groupBy("detector").agg(F.avg(F.col("t_vec")[2]).alias("_average"))
    t = F.col("t_vec")
    moved = F.array(t[0], t[1], t[2] + (distance - F.col("_average")))
    return panels.join(average, "detector").withColumn("t_vec", moved).drop("_average")


def _step(vector: str) -> Column:
    v = F.col(vector)
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def panel_pixels(panels: DataFrame, frame_width: Column, module_rows: Column | None = None) -> DataFrame:
    """One row per detector pixel: its place ``source`` in the row-major frame and its cell offsets.

    ``frame_width`` is the width of the stored frame.  For frames of stacked modules,
    ``module_rows`` is the number of rows per module and the panel's ``module`` selects the stack.
    """
    ss0 = require(F.col("ss0"), "the geometry does not define panel rectangles")
    top = ss0 if module_rows is None else ss0 + F.coalesce("module", F.lit(0)) * module_rows
    rows = panels.select(
        "detector",
        "panel",
        "panel_order",
        "fs_vec",
        "ss_vec",
        "t_vec",
        "n_fs",
        "fs0",
        top.alias("_top"),
        frame_width.alias("_width"),
        _step("fs_vec").alias("_pixel"),
        F.explode(F.sequence(F.lit(0), F.col("n_ss") - 1)).alias("ss"),
    )
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_fs") - 1)).alias("fs"))

    def offset(axis: int) -> Column:
        place = F.col("t_vec")[axis] + F.col("ss") * F.col("ss_vec")[axis] + F.col("fs") * F.col("fs_vec")[axis]
        return F.rint(place / F.col("_pixel")).cast("int")

    return rows.select(
        "detector",
        "panel",
        "panel_order",
        "ss",
        "fs",
        ((F.col("_top") + F.col("ss")) * F.col("_width") + F.col("fs0") + F.col("fs")).cast("int").alias("source"),
        offset(0).alias("dx"),
        offset(1).alias("dy"),
    )


def assembly_cells(pixels: DataFrame) -> DataFrame:
    """Per detector and image cell the winning ``source``: ``(detector, side, y, x, source)``.

    A side beyond ``MOST_SIDES`` times the edges of all panels in a row fails.
    """
    first_pixel = (F.col("ss") == 0) & (F.col("fs") == 0)
    reach = pixels.groupBy("detector").agg(
        F.max(F.greatest(F.abs("dx"), F.abs("dy"))).alias("_r"),
        (F.count_if(first_pixel) * (F.max("ss") + F.max("fs") + 2)).alias("_edges"),
    )
    side = 2 * F.col("_r") + 1
    checked = require(F.when(side <= MOST_SIDES * F.col("_edges"), side), "the panels of a geometry lie too far apart")
    placed = pixels.join(reach.select("detector", "_r", checked.alias("side")), "detector").select(
        "detector",
        "side",
        (F.col("dy") + F.col("_r")).alias("y"),
        (F.col("dx") + F.col("_r")).alias("x"),
        F.struct("panel_order", "ss", "fs", "source").alias("_from"),
    )
    won = placed.groupBy("detector", "side", "y", "x").agg(F.max("_from").alias("_from"))
    return won.select("detector", "side", "y", "x", F.col("_from.source").alias("source"))


def assembly_lists(cells: DataFrame) -> DataFrame:
    """Per detector its image as ``runs`` of ``(target, source, stride, length)`` in row-major order.

    The k-th cell after ``target`` takes the pixel k strides after ``source``; cells in no run are empty.  ``needs`` is the
    number of pixels a frame must have.
    """
    line = Window.partitionBy("detector", "y").orderBy("x")
    told = cells.withColumn("_step", F.when(F.col("x") == F.lag("x").over(line) + 1, F.col("source") - F.lag("source").over(line)))
    # A cell begins a run unless it follows on the one before with the run's stride, which the run's second cell sets.
    before = F.lag("_step").over(line)
    begins = F.col("_step").isNull() | (before.isNotNull() & (F.col("_step") != before))
    numbered = told.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(line))
    runs = numbered.groupBy("detector", "side", "y", "_run").agg(
        F.min(F.struct("x", "source")).alias("_first"), F.max(F.struct("x", "source")).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    stride = F.when(F.col("_n") > 1, ((F.col("_last.source") - F.col("_first.source")) / (F.col("_n") - 1))).otherwise(1)
    run = F.struct(
        (F.col("y").cast("long") * F.col("side") + F.col("_first.x")).alias("target"),
        F.col("_first.source").alias("source"),
        stride.cast("int").alias("stride"),
        F.col("_n").cast("int").alias("length"),
    )
    needs = F.max(F.greatest("_first.source", "_last.source")) + 1
    # As many runs as the lines of a detector's panels and their crossings: a property of the hardware, not of the data.
    return runs.groupBy("detector", "side").agg(F.array_sort(F.collect_list(run)).alias("runs"), needs.alias("needs"))


_RUN = np.dtype([("target", np.int64), ("source", np.int32), ("stride", np.int32), ("length", np.int32)])


def assembly_arrays(lists: DataFrame, group_bytes: int) -> list[dict[str, tuple[int, np.ndarray]]]:
    """The runs of all detectors for the tasks: groups of ``{detector: (side, runs)}``.

    A group has at most ``group_bytes``, or one detector; tasks fetch the groups whose detectors they meet.
    """
    groups: list[dict[str, tuple[int, np.ndarray]]] = []
    held = 0
    # One row for each detector type.
    for row in lists.select("detector", "side", "runs").toLocalIterator():
        runs = np.array([tuple(r) for r in row["runs"]], _RUN)
        if not groups or held + runs.nbytes > group_bytes:
            groups.append({})
            held = 0
        groups[-1][row["detector"]] = (row["side"], runs)
        held += runs.nbytes
    return groups


def assemble_frames(
    frames: DataFrame, lists: DataFrame, pixels: str = "pixels", arrays: Sequence[Mapping[str, tuple[int, np.ndarray]]] | None = None
) -> DataFrame:
    """Place every frame's pixels on its detector's image, in one pass without a join; frames stay one row each.

    A frame of a detector without geometry keeps its pixels and shape.
    """
    arrays = assembly_arrays(lists, lookup.BROADCAST_BYTES) if arrays is None else arrays
    known = [name for group in arrays for name in group]
    marked = frames.withColumns(
        {"_assemble_as": F.col("detector"), "assembled": F.coalesce(F.col("detector").isin(*known), F.lit(False))}
    )
    placed = normalize_frames(marked, None, pixels=pixels, gcn=False, lcn=False, assembly=arrays, assemble_as="_assemble_as")
    return placed.select(*frames.columns, "assembled")


def cut_panels(
    frames: DataFrame, panels: DataFrame, pixels: str = "pixels", module_rows: Column | None = None
) -> DataFrame:
    """One row per frame and panel with the panel's own pixels (``n_ss x n_fs``, row-major)."""
    ss0 = require(F.col("ss0"), "the geometry does not define panel rectangles")
    top = ss0 if module_rows is None else ss0 + F.coalesce("module", F.lit(0)) * module_rows
    wanted = panels.select("detector", "panel", "panel_order", "n_ss", "n_fs", "fs0", top.alias("_top"))
    # A geometry is a description of hardware: its size is checked, and it goes to every task.
    if len(wanted.select("detector").head(MOST_PANELS + 1)) > MOST_PANELS:
        raise ValueError(f"more than {MOST_PANELS} panels are no geometry")
    joined = frames.join(F.broadcast(wanted), "detector")
    lines = F.transform(
        F.sequence(F.col("_top"), F.col("_top") + F.col("n_ss") - 1),
        lambda y: F.slice(F.col(pixels), y * F.col("w") + F.col("fs0") + 1, F.col("n_fs")),
    )
    cut = joined.withColumn(pixels, F.flatten(lines))
    return cut.drop("_top", "fs0", "h", "w").withColumnsRenamed({"n_ss": "h", "n_fs": "w"})
