"""Tensor tables for training and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffspark.operators import catalog
from diffspark.operators.ordered import BLOCK, cut_blocks, running
from diffspark.operators.sampling import number_batches, shuffle_key


def unlabelled_tensors(frames: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Frames of the listed files (all without a list) without label, for pretraining."""
    chosen = frames if paths is None else frames.join(paths.select("path").distinct(), "path", "left_semi")
    return catalog.frame_tensor(chosen.drop("label"))


def session_tensors(
    frames: DataFrame, label_files: DataFrame, session_files: DataFrame, chosen: DataFrame
) -> DataFrame:
    """Labelled frames of the chosen sessions (``chosen`` has ``session_id``, e.g. one bucket of a split).

    ``session_files`` maps ``session_id`` to ``path``; ``label_files`` holds the label array per
    path, whose length decides which frames exist.
    """
    files = session_files.join(chosen.select("session_id").distinct(), "session_id", "left_semi")
    index = catalog.embedded_labels(files.join(label_files.select("path", "labels"), "path", "left"))
    return catalog.frame_tensor(catalog.read_frames(index, frames))


def listed_tensors(frames: DataFrame, split_list: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    """Labelled frames of a split list ``(ordinal, path)``, one frame per file."""
    entries = catalog.attach_labels(split_list, labels, ("path",), strict=strict)
    first = catalog.first_frames(frames, 1)
    return catalog.frame_tensor(catalog.read_frames(entries, first, ("path",)))


def batches(tensors: DataFrame, row_id: str, batch_size: int, shuffle_seed: int | None = None) -> DataFrame:
    """Exact global batch numbers, in id order or in a seeded random order."""
    order = None if shuffle_seed is None else shuffle_key(F.col(row_id), shuffle_seed)
    return number_batches(tensors, row_id, batch_size, order)


def processed_so_far(batch_sizes: DataFrame, blocks: int | None = None) -> DataFrame:
    """Running count of processed rows over ``(batch_id, n)``."""
    order = [F.col("batch_id")]
    return running(cut_blocks(batch_sizes, [], order, blocks), [], order, {"processed": ("sum", F.col("n"))}).drop(BLOCK)
