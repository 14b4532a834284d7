"""Column functions on file paths, container keys and run names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from diffspark.constants import SUPPORTED_SUFFIXES


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """Last suffix of the file name in lower case, dot included; empty when there is none."""
    return F.lower(F.regexp_extract(_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(_name(path), r"^(.+)\.[^.]+$", "$1")


def session_id(detector: Column, path: Column) -> Column:
    """``<detector>_<stem>``."""
    return F.concat_ws("_", detector, stem(path))


def reader(path: Column) -> Column:
    """``image`` for .img, ``container`` for .h5 and .cxi, NULL for anything else."""
    ext = suffix(path)
    return F.when(ext == ".img", "image").when(ext.isin(*SUPPORTED_SUFFIXES), "container")


def key_depth(key: Column) -> Column:
    """Nesting depth of a container key (number of slashes)."""
    return F.size(F.split(key, "/")) - 1


def named_path(argument: Column) -> tuple[Column, Column]:
    """Split ``NAME=path`` at the first ``=``; both parts trimmed, path empty without ``=``."""
    parts = F.split(argument, "=", 2)
    return F.trim(parts[0]), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit(""))


def file_tag(description: Column) -> Column:
    """Description with blanks replaced by underscores."""
    return F.replace(description, F.lit(" "), F.lit("_"))


def run_name(backbone: Column, fold: Column, seed: Column) -> Column:
    """``<backbone>-lodo-fold<fold>-seed<seed>``."""
    return F.format_string("%s-lodo-fold%d-seed%d", backbone, fold.cast("int"), seed.cast("int"))


def run_parts(name: Column) -> Column:
    """Struct ``(backbone, fold, seed)`` read back from a run name."""
    pattern = r"^(.*)-lodo-fold(\d+)-seed(\d+)$"
    return F.struct(
        F.regexp_extract(name, pattern, 1).alias("backbone"),
        F.regexp_extract(name, pattern, 2).try_cast("int").alias("fold"),
        F.regexp_extract(name, pattern, 3).try_cast("int").alias("seed"),
    )


def fold_key(fold: Column) -> Column:
    """``fold_<id>``."""
    return F.concat(F.lit("fold_"), fold.cast("string"))
