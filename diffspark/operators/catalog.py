"""Files, container keys, frames, labels and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffspark.constants import DATA_KEYS, DESCRIPTIONS, EXPECTED_KEY, LABEL_KEY
from diffspark.functions.arrays import all_finite
from diffspark.functions.labels import rounded_label
from diffspark.functions.paths import key_depth, reader, suffix
from diffspark.operators.ordered import require


def dispatch_by_suffix(files: DataFrame, path: str = "path", strict: bool = True) -> DataFrame:
    """Add ``ext`` and ``reader``; an unsupported suffix fails the job or, not strict, gives NULL."""
    kind = reader(F.col(path))
    if strict:
        kind = require(kind, F.concat(F.lit("unsupported file format: "), F.col(path)))
    return files.withColumns({"ext": suffix(F.col(path)), "reader": kind})


def resolve_data_key(
    container_keys: DataFrame,
    by: Sequence[str] = ("path",),
    key: str = "key",
    candidates: Sequence[str] = DATA_KEYS,
    strict: bool = True,
) -> DataFrame:
    """First candidate key present in each file; a file with none fails the job (or gives NULL)."""
    place = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col(key))
    best = F.min(F.when(place > 0, place))
    found = container_keys.groupBy(*by).agg(best.alias("priority"))
    # get() and not element_at(): the latter is taken for never NULL, even at a NULL position.
    name = F.get(F.array(*[F.lit(c) for c in candidates]), F.col("priority").cast("int") - 1)
    if strict:
        name = require(name, "no known data key; tried " + ", ".join(candidates))
    return found.select(*by, "priority", name.alias("data_key"))


def audit_keys(
    expected_files: DataFrame, container_keys: DataFrame, expected_key: str = EXPECTED_KEY
) -> DataFrame:
    """Per ``(detector, path)``: number of keys, whether the expected key exists, and a status."""
    seen = container_keys.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_keys"), F.max((F.col("key") == expected_key).cast("int")).alias("hit")
    )
    found = F.coalesce(F.col("hit"), F.lit(0)) == 1
    return expected_files.join(seen, "path", "left").select(
        "detector",
        "path",
        F.coalesce("n_keys", F.lit(0)).alias("n_keys"),
        found.alias("found"),
        F.when(found, "OK").otherwise("ACTION REQUIRED").alias("status"),
    )


def key_listing(container_keys: DataFrame, key: str = "key", expected_key: str = EXPECTED_KEY) -> DataFrame:
    """Every container key with its nesting depth and whether it is the expected one."""
    return container_keys.withColumns({"depth": key_depth(F.col(key)), "expected": F.col(key) == expected_key})


def attach_descriptions(
    files: DataFrame, descriptions: DataFrame, on: Sequence[str] = ("path",), strict: bool = True
) -> DataFrame:
    """Detector description of every file, stored bytes decoded; a missing one fails the job (or is NULL)."""
    stored = descriptions.select(*on, F.col("description"))
    if dict(stored.dtypes)["description"] == "binary":
        stored = stored.withColumn("description", F.decode("description", "UTF-8"))
    joined = files.join(stored, list(on), "left")
    if not strict:
        return joined
    what = F.concat_ws(" ", F.lit("no description in"), *[F.col(c).cast("string") for c in on])
    return joined.withColumn("description", require(F.col("description"), what))


def expand_frames(files: DataFrame, n_frames: str = "n_frames") -> DataFrame:
    """One row per frame, ``frame_idx`` from 0; a file with no frame gives no row, repeats are kept."""
    indices = F.when(F.col(n_frames) > 0, F.sequence(F.lit(0), F.col(n_frames).cast("int") - 1))
    return files.withColumn("frame_idx", F.explode(indices))


def label_arrays(files: DataFrame, datasets: DataFrame, label_key: str = LABEL_KEY) -> DataFrame:
    """Files with the array stored under their label key (``datasets``: path, key, values), NULL without one."""
    found = datasets.where(F.col("key") == label_key).select("path", F.col("values").alias("labels"))
    return files.join(found, "path", "left")


def embedded_labels(files: DataFrame, labels: str = "labels", strict: bool = True) -> DataFrame:
    """One row per stored label: ``frame_idx`` and the integer ``label``; a missing array fails."""
    array = F.col(labels)
    if strict:
        array = require(array, F.concat(F.lit("no label array in "), F.col("path")))
    rows = files.select("*", F.posexplode(array).alias("frame_idx", "_raw"))
    return rows.withColumn("label", rounded_label(F.col("_raw"))).drop("_raw", labels)


def label_length_errors(files: DataFrame, labels: str = "labels", n_frames: str = "n_frames") -> DataFrame:
    """Files whose label array is absent or not as long as their frame count."""
    size = F.when(F.col(labels).isNotNull(), F.size(labels))
    return files.where(~size.eqNullSafe(F.col(n_frames))).withColumn("n_labels", size)


def read_frames(requests: DataFrame, frames: DataFrame, on: Sequence[str] = ("path", "frame_idx")) -> DataFrame:
    """The requested frames; a request beyond the stored frames fails the job."""
    stored = frames.withColumn("_stored", F.lit(1))
    joined = requests.join(stored, list(on), "left")
    asked = F.concat_ws(" ", F.lit("frame out of range:"), *[F.col(c).cast("string") for c in on])
    return joined.where(require(F.col("_stored"), asked) == 1).drop("_stored")


def first_frames(frames: DataFrame, n: int = 1) -> DataFrame:
    """The first ``n`` frames of every file."""
    return frames.where(F.col("frame_idx") < n)


def attach_labels(
    frames: DataFrame, labels: DataFrame, on: Sequence[str] = ("path",), label: str = "label", strict: bool = True
) -> DataFrame:
    """Equi-join of frames and labels; strict fails on a frame without label, else label is NULL.

    The failure is an expression of the plan, so strictness costs no second pass.
    """
    joined = frames.join(labels.select(*on, label), list(on), "left")
    if not strict:
        return joined
    what = F.concat_ws(" ", F.lit("no label for"), *[F.col(c).cast("string") for c in on])
    return joined.withColumn(label, require(F.col(label), what))


def unlabelled(frames: DataFrame, labels: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    """Frames that have no label."""
    return frames.join(labels.select(*on), list(on), "left_anti")


def membership_labels(frames: DataFrame, hits: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    """Label 1 for frames named in a hit list, 0 otherwise; repeats in the list do not matter."""
    listed = hits.select(*on).distinct().withColumn("_hit", F.lit(1))
    return frames.join(listed, list(on), "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def sessions(frames: DataFrame, detector: str = "detector", session: Sequence[str] = ("path",)) -> DataFrame:
    """Frames per session; a session never spans detectors."""
    return frames.groupBy(detector, *session).agg(F.count(F.lit(1)).alias("frame_count"))


def session_totals(session_table: DataFrame, detector: str = "detector") -> DataFrame:
    """Sessions and frames per detector and over all (detector ``ALL``)."""
    level = F.when(F.grouping(detector) == 1, "ALL").otherwise(F.col(detector))
    return (
        session_table.rollup(detector)
        .agg(
            level.alias("_level"),
            F.count(F.lit(1)).alias("sessions"),
            F.sum("frame_count").alias("frames"),
        )
        .select(F.col("_level").alias(detector), "sessions", "frames")
    )


def label_balance(labelled: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """Hits, non-hits and hit rate."""
    total = F.count(label)
    hits = F.count_if(F.col(label) == 1)
    return labelled.groupBy(*by).agg(
        total.alias("n"),
        hits.alias("hits"),
        (total - hits).alias("non_hits"),
        (hits / F.nullif(total, F.lit(0))).alias("hit_rate"),
    )


def route_frames(frames: DataFrame, description: str = "description") -> DataFrame:
    """Add ``route`` (flat, canvas or assembled) and ``route_reason`` from the stored description.

    A missing or unknown description takes the assembled route, as does a pre-assembled detector;
    the reason tells them apart.
    """
    table = F.create_map(*[F.lit(x) for d, (_, r) in DESCRIPTIONS.items() for x in (d, r)])
    known = F.try_element_at(table, F.coalesce(F.col(description), F.lit("")))
    reason = (
        F.when(F.col(description).isNull(), "no description")
        .when(known.isNull(), "unknown description")
        .when(known == "assembled", "pre-assembled")
        .otherwise("geometry")
    )
    return frames.withColumns({"route": F.coalesce(known, F.lit("assembled")), "route_reason": reason})


def known_detectors(
    frames: DataFrame, names: Sequence[str], detector: str = "detector", strict: bool = True
) -> DataFrame:
    """Check a detector column against the valid names; strict fails and lists them."""
    valid = F.when(F.col(detector).isin(*names), F.col(detector))
    if not strict:
        return frames.withColumn("known_detector", valid.isNotNull())
    text = F.concat(F.lit("unknown detector "), F.col(detector), F.lit("; valid: " + ", ".join(sorted(names))))
    return frames.withColumn(detector, require(valid, text))


def quality_gate(frames: DataFrame, size: tuple[int, int] | None, pixels: str = "pixels") -> DataFrame:
    """Add ``finite``, ``right_size`` and ``passed``."""
    fits = F.size(pixels) == F.col("h") * F.col("w")
    if size is not None:
        fits = fits & (F.col("h") == size[0]) & (F.col("w") == size[1])
    checked = frames.withColumns({"finite": all_finite(F.col(pixels)), "right_size": fits})
    return checked.withColumn("passed", F.col("finite") & F.col("right_size"))


def distinct_paths(frames: DataFrame, path: str = "path") -> DataFrame:
    """Each file once."""
    return frames.select(path).distinct()


def frame_tensor(frames: DataFrame, label: Column | None = None) -> DataFrame:
    """Frames as single-channel float tensors with shape columns ``c=1, h, w``."""
    keep = [c for c in frames.columns if c not in ("pixels", "h", "w", "label")]
    given = label if label is not None else (F.col("label") if "label" in frames.columns else F.lit(None).cast("int"))
    return frames.select(
        *keep, given.alias("label"), F.lit(1).alias("c"), "h", "w", F.col("pixels").cast("array<float>").alias("pixels")
    )
