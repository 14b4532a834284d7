"""Detector geometry from text and JSON files to panel rows (``schemas.PANELS`` plus ``panel_order``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.constants import GEOMETRY_NAMES, JUNGFRAU_DISTANCE
from diffspark.operators.geometry import set_distance
from diffspark.operators.ordered import require
from diffspark.sources.files import read_lines
from diffspark.sources.json_elements import json_elements

_NUMBER = r"([+-]?\s*(?:\d+\.?\d*|\.\d+)?(?:[eE][+-]?\d+)?)\s*"
_NUMBERS = "corner_x corner_y coffset clen res min_fs max_fs min_ss max_ss".split()
_SHARED = ("clen", "coffset", "res")
#: More partitions than any table of entries has.
_MANY = 1 << 20


def geometry_entries(lines: DataFrame, text: str = "value") -> DataFrame:
    """``panel/key = value`` and ``key = value`` lines to ``panel`` (NULL for globals), ``key``, ``value``.

    Text after ``;`` is a comment.  Bad-region and rigid-group entries are left out.
    """
    others = [c for c in lines.columns if c != text]
    code = F.substring_index(text, ";", 1)
    pairs = lines.select(
        *others,
        F.trim(F.substring_index(code, "=", 1)).alias("_name"),
        F.when(F.instr(code, "=") > 0, F.trim(F.substr(code, F.instr(code, "=") + 1))).alias("value"),
    ).where(F.col("value").isNotNull())
    key = F.substring_index("_name", "/", -1)
    owner = F.substr(F.col("_name"), F.lit(1), F.length("_name") - F.length(key) - 1)
    entries = pairs.select(
        *others, F.when(F.contains("_name", F.lit("/")), owner).alias("panel"), key.alias("key"), "value"
    )
    return (
        entries.where(F.col("key") != "")
        .where(F.coalesce(~F.col("panel").startswith("bad"), F.lit(True)))
        .where(~F.col("key").startswith("rigid_group"))
    )


def _step(rows: DataFrame) -> DataFrame:
    """``rows`` as they are, no partition joined with another one.  Spark compiles what stands before and after it on its own: as one
    method the whole parsing is larger than what the JVM's compiler takes, and is interpreted."""
    return rows.coalesce(_MANY)


def _axis_text(vector: Column, axis: str) -> Column:
    """What stands before ``x``, ``y`` or ``z`` in a vector such as ``-0.99x +0.004y``; NULL without the letter."""
    return F.when(vector.contains(axis), F.regexp_replace(F.regexp_extract(vector, _NUMBER + axis, 1), r"\s", ""))


def _axis_number(raw: Column) -> Column:
    """Coefficient of an axis from its text; a bare sign is one, no text zero."""
    return F.when(raw.isNull(), 0.0).when(raw.isin("", "+"), 1.0).when(raw == "-", -1.0).otherwise(raw.try_cast("double"))


def panels_from_entries(entries: DataFrame, order: str, detector: str = "detector") -> DataFrame:
    """Panel rows from geometry entries; a repeated key takes its last value by ``order``.

    Values become numbers before they are grouped, which keeps the aggregation a hash aggregation.
    One aggregation by panel and one by detector; panel values override the detector's.
    """
    is_vector = F.col("key").isin("fs", "ss")
    # The texts are cut out in a step of their own: an expression that uses one several times would run its pattern as often.
    texts = _step(entries).withColumns({f"_{a}": F.when(is_vector, _axis_text(F.col("value"), a)) for a in "xyz"})
    typed = texts.withColumns(
        {
            "_number": F.when(~is_vector, F.col("value").try_cast("double")),
            **{f"_{a}": F.when(is_vector, _axis_number(F.col(f"_{a}"))) for a in "xyz"},
        }
    )

    def latest(key: str, column: str = "_number") -> Column:
        hit = F.col("key") == key
        return F.max_by(F.when(hit, F.col(column)), F.when(hit, F.col(order)))

    typed = _step(typed)
    here = F.col("panel").isNotNull()
    per_panel = typed.where(here).groupBy(detector, "panel").agg(
        *[latest(k).alias(k) for k in _NUMBERS],
        *[latest(v, f"_{a}").alias(f"{v}_{a}") for v in ("fs", "ss") for a in "xyz"],
        F.min(order).alias("panel_order"),
    )
    shared = (
        typed.where(~here).where(F.col("key").isin(*_SHARED)).groupBy(detector).agg(*[latest(k).alias(f"_all_{k}") for k in _SHARED])
    )
    rows = per_panel.join(shared, detector, "left")

    def number(key: str) -> Column:
        return F.coalesce(key, f"_all_{key}") if key in _SHARED else F.col(key)

    def required(value: Column, key: str) -> Column:
        return require(value, F.concat_ws(" ", F.lit(f"no usable {key} for panel"), detector, "panel"))

    def place(key: str) -> Column:
        return required(F.col(key).cast("int"), key)

    pixel = 1.0 / required(number("res"), "res")
    depth = F.coalesce(number("clen"), F.lit(0.0)) + F.coalesce(number("coffset"), F.lit(0.0))
    return rows.select(
        detector,
        "panel",
        "panel_order",
        (place("max_ss") - place("min_ss") + 1).alias("n_ss"),
        (place("max_fs") - place("min_fs") + 1).alias("n_fs"),
        *[F.array(*[required(F.col(f"{v}_{a}"), v) * pixel for a in "xyz"]).alias(f"{v}_vec") for v in ("fs", "ss")],
        F.array(*[required(F.col(c), c) * pixel for c in ("corner_x", "corner_y")], depth).alias("t_vec"),
        place("min_ss").alias("ss0"),
        (place("max_ss") + 1).alias("ss1"),
        place("min_fs").alias("fs0"),
        (place("max_fs") + 1).alias("fs1"),
        F.regexp_extract("panel", r"^p(\d+)a\d+$", 1).try_cast("int").alias("module"),
    )


def read_geometry_text(spark: SparkSession, path: str, detector: str) -> DataFrame:
    """Panels of one geometry text file."""
    lines = read_lines(spark, path).withColumn("detector", F.lit(detector))
    entries = geometry_entries(lines).withColumn("_line", F.struct("block_start", "line_in_task"))
    return panels_from_entries(entries, "_line")


_JSON_PANEL = (
    "name string, n_ss int, n_fs int, fs_vec array<double>, ss_vec array<double>, t_vec array<double>, "
    "parent_data_shape array<int>, parent_data_slice array<array<int>>"
)


def panels_from_json(texts: DataFrame, text: str = "value", detector: str = "detector", order: str | None = None) -> DataFrame:
    """Panel rows from JSON arrays of panel objects with parent slices ``[[ss0, ss1, _], [fs0, fs1, _]]``.

    A malformed document fails the job.  Where each row is a part of a document, ``order`` is the place of its first panel.
    """
    parsed = F.from_json(text, f"array<struct<{_JSON_PANEL.replace(' array', ':array').replace(' string', ':string').replace(' int', ':int')}>>", {"mode": "FAILFAST"})
    place = F.lit(0) if order is None else F.col(order)
    rows = texts.select(detector, place.alias("_first"), F.posexplode(parsed).alias("_at", "p"))
    rows = rows.withColumn("panel_order", F.col("_first") + F.col("_at"))
    cut = lambda i, j: F.get(F.get(F.col("p.parent_data_slice"), F.lit(i)), F.lit(j))
    return rows.select(
        detector,
        F.col("p.name").alias("panel"),
        F.col("panel_order").cast("long").alias("panel_order"),
        *[F.col(f"p.{c}").alias(c) for c in ("n_ss", "n_fs", "fs_vec", "ss_vec", "t_vec")],
        cut(0, 0).alias("ss0"),
        cut(0, 1).alias("ss1"),
        cut(1, 0).alias("fs0"),
        cut(1, 1).alias("fs1"),
        F.lit(None).cast("int").alias("module"),
    )


def read_geometry_json(spark: SparkSession, path: str, detector: str) -> DataFrame:
    """Panels of one geometry JSON file, read by as many tasks as it has splits."""
    entries = json_elements(spark, path, "array")
    texts = entries.select(F.lit(detector).alias("detector"), F.concat(F.lit("["), "text", F.lit("]")).alias("value"), "ordinal")
    return panels_from_json(texts, order="ordinal")


def load_geometry(
    spark: SparkSession, name: str, files: dict[str, str], distance: float | None = None
) -> DataFrame:
    """Panels of a named detector from its geometry file (text, or JSON by suffix).

    ``distance`` moves the panels to that average distance; without it the file's own distance
    holds, except for JUNGFRAU_4M, which has a default.
    """
    if name not in GEOMETRY_NAMES:
        raise ValueError(f"unknown detector {name!r}; valid: {sorted(GEOMETRY_NAMES)}")
    read = read_geometry_json if files[name].endswith(".json") else read_geometry_text
    panels = read(spark, files[name], name)
    if distance is None and name == "JUNGFRAU_4M":
        distance = JUNGFRAU_DISTANCE
    return panels if distance is None else set_distance(panels, F.lit(distance))


def geometry_matrix(rows: DataFrame, matrix: str = "geometry") -> DataFrame:
    """Geometry rows ``[distance mm, wavelength angstrom, pixel mm, ...]`` with lengths in metres."""
    at = lambda i: F.get(F.col(matrix), F.lit(i)).cast("double")
    return rows.withColumns(
        {"distance_m": at(0) * 1e-3, "wavelength_m": at(1) * 1e-10, "pixel_m": at(2) * 1e-3}
    )
