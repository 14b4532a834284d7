"""Leave-one-detector-out folds and session-level splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffspark.constants import (
    CROSS_DETECTOR,
    DETECTORS,
    IN_DOMAIN_TEST,
    SPLIT_RATIOS,
    STRICT_VARIANT,
    TRAIN,
    VAL,
)
from diffspark.operators.ordered import BLOCK, cut_blocks, running

BUCKETS = (TRAIN, VAL, IN_DOMAIN_TEST)


def fold_column(detectors: Sequence[str] = DETECTORS, fold_ids: Sequence[int] | None = None) -> Column:
    """All folds as one constant array of ``(fold_id, test_detector, train_detectors)``, ids from 1 by place."""
    every = F.array(*[F.lit(d) for d in detectors])
    folds = F.transform(
        every,
        lambda held, at: F.struct(
            (at + 1).alias("fold_id"), held.alias("test_detector"), F.array_remove(every, held).alias("train_detectors")
        ),
    )
    return folds if fold_ids is None else F.filter(folds, lambda f: f["fold_id"].isin(*fold_ids))


def fold_table(spark: SparkSession, detectors: Sequence[str] = DETECTORS, fold_ids: Sequence[int] | None = None) -> DataFrame:
    """One row per fold: ``fold_id, test_detector, train_detectors`` in the detectors' order."""
    return spark.range(1).select(F.inline(fold_column(detectors, fold_ids)))


def with_folds(
    rows: DataFrame, detectors: Sequence[str] = DETECTORS, fold_ids: Sequence[int] | None = None
) -> DataFrame:
    """Repeat every row once per fold (``fold_id, test_detector``); the fan-out is the fold count."""
    return rows.select("*", F.inline(fold_column(detectors, fold_ids))).drop("train_detectors")


def folds_without_sessions(
    session_table: DataFrame, detectors: Sequence[str] = DETECTORS, fold_ids: Sequence[int] | None = None
) -> DataFrame:
    """Folds whose held-out detector has no session at all."""
    wanted = fold_table(session_table.sparkSession, detectors, fold_ids).select("fold_id", "test_detector")
    known = session_table.select(F.col("detector").alias("test_detector")).distinct()
    return wanted.join(known, "test_detector", "left_anti")


def require_fold_detectors(session_table: DataFrame, detectors=DETECTORS, fold_ids=None) -> None:
    """Fail unless every fold's held-out detector has sessions (reads at most one row per fold)."""
    missing = [r["test_detector"] for r in folds_without_sessions(session_table, detectors, fold_ids).collect()]
    if missing:
        raise ValueError(f"no sessions for held-out detectors: {sorted(missing)}")


def _seats_before(target: Column, level: Column, n: Column, ties_count: bool) -> Column:
    """Seats ``j = 0..n-1`` of a bucket whose priority ``target - j`` beats ``level``.

    The floor estimate can be off by one either way in floating point, so the seats around it are
    compared exactly.
    """
    guess = F.floor(target - level)
    sure = F.least(F.greatest(guess - 1, F.lit(0)), n)

    def beats(j: Column) -> Column:
        priority = target - j.cast("double")
        return (j >= 0) & (j < n) & ((priority >= level) if ties_count else (priority > level))

    return sure + F.size(F.filter(F.sequence(guess - 1, guess + 2), beats))


def session_split(
    session_table: DataFrame,
    detectors: Sequence[str] = DETECTORS,
    ratios: Sequence[float] = SPLIT_RATIOS,
    fold_ids: Sequence[int] | None = None,
    variant: str | None = STRICT_VARIANT,
    ties: Sequence[str] = ("session_id",),
    stratify_by: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """Bucket of every session in every fold.

    Sessions of the held-out detector go to ``cross_detector_eval``.  The others, largest first
    (then by ``ties``), each go to the bucket furthest below its share of the session count, the
    first bucket on equal deficits.  Handing out places that way is the same as merging three
    descending lists of seats with priority ``ratio * n - seat``; a seat's place in that merge is
    arithmetic, so no step depends on the previous one.
    """
    table = with_folds(session_table, detectors, fold_ids)
    held = F.col("detector").eqNullSafe(F.col("test_detector"))
    keys = ["fold_id", *stratify_by]
    order = [F.col("frame_count").desc(), *[F.col(t).asc() for t in ties]]
    one = F.lit(1).cast("long")
    pool = running(
        cut_blocks(table.where(~held), keys, order, blocks),
        keys,
        order,
        {"_place": ("sum", one)},
        totals={"_n": ("sum", one)},
    ).drop(BLOCK)

    n = F.col("_n")
    targets = [F.lit(float(r)) * n.cast("double") for r in ratios]
    seat = F.col("_place") - 1
    who = F.struct(*session_table.columns)
    fields = F.struct(F.col("_place"), F.lit(None).cast("string").alias("bucket"), who.alias("_who"))
    nobody = F.when(F.lit(False), who)
    entries = [fields]
    for i, name in enumerate(BUCKETS):
        level = targets[i] - seat.cast("double")
        place = seat + 1
        for k in range(len(BUCKETS)):
            if k != i:
                place = place + _seats_before(targets[k], level, n, k < i)
        entries.append(F.struct(place.cast("long").alias("_place"), F.lit(name).alias("bucket"), nobody.alias("_who")))
    # A session and the seat of its place meet in one group of two rows: every session offers one
    # seat per bucket, and of all seats exactly the first n are filled.
    offers = pool.select(*keys, "test_detector", n.alias("_seats"), F.inline(F.array(*entries)))
    assigned = (
        offers.where(F.col("_place") <= F.col("_seats"))
        .groupBy(*keys, "test_detector", "_place")
        .agg(F.max("bucket").alias("bucket"), F.max("_who").alias("_who"))
        .select("fold_id", "test_detector", "_who.*", "bucket")
    )

    outside = table.where(held).withColumn("bucket", F.lit(CROSS_DETECTOR))
    return assigned.unionByName(outside).withColumn("variant", F.lit(variant).cast("string"))


def bucket_shares(split: DataFrame) -> DataFrame:
    """Sessions, frames and share of the fold's sessions per bucket (held-out sessions excluded)."""
    pool = split.where(F.col("bucket") != CROSS_DETECTOR)
    per = pool.groupBy("fold_id", "bucket").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("frame_count").alias("frames")
    )
    total = per.groupBy("fold_id").agg(F.sum("sessions").alias("_all"))
    return per.join(total, "fold_id").select(
        "fold_id", "bucket", "sessions", "frames", (F.col("sessions") / F.col("_all")).alias("share")
    )


def split_leaks(split: DataFrame, session: Sequence[str] = ("session_id",)) -> DataFrame:
    """Sessions found in more than one bucket of a fold; must be empty."""
    return (
        split.groupBy("fold_id", *session)
        .agg(F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"))
        .where(F.col("first_bucket") != F.col("last_bucket"))
    )


def frames_of_split(
    frames: DataFrame, split: DataFrame, session: Sequence[str] = ("session_id",), buckets: Sequence[str] | None = None
) -> DataFrame:
    """Frames with the fold and bucket of their session.

    The split has one row per session and fold.  Catalyst broadcasts it when it is small; when it
    is not, a session holding much of the data is split by the adaptive skew join.
    """
    chosen = split if buckets is None else split.where(F.col("bucket").isin(*buckets))
    return frames.join(chosen.select(*session, "fold_id", "test_detector", "bucket"), list(session))


def buckets_per_session(split: DataFrame, session: Sequence[str] = ("session_id",)) -> DataFrame:
    """One row per session with its bucket in every fold as ``buckets map<int,string>``."""
    entry = F.struct(F.col("fold_id").cast("int"), "bucket")
    return split.groupBy(*session).agg(F.map_from_entries(F.collect_list(entry)).alias("buckets"))


def semi_supervised_frames(frames: DataFrame, split: DataFrame, session: Sequence[str] = ("session_id",)) -> DataFrame:
    """Pretraining rows per fold: the train frames with labels and the held-out frames without."""
    parts = frames_of_split(frames, split, session, (TRAIN, CROSS_DETECTOR))
    label = F.when(F.col("bucket") == TRAIN, F.col("label"))
    return parts.withColumn("label", label)
