"""Spark operators for labelled detector frames: catalogue, assemble, normalise, split, score, report."""

__version__ = "0.1.0"
