"""Shared inputs: the driver's tables seen as frames, labels, scores and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGS = ("en", "fr", "de", "es")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(value: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as frames: language = detector, (language, source) = session."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("detector"),
        "source",
        F.concat_ws("_", "lang", "source").alias("session_id"),
        "n_chars",
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a smooth score."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y_true"))
    n = F.col("n_chars").cast("double")
    return (
        frames(spark, sf_dir)
        .join(labels, "doc_id")
        .select("detector", "session_id", F.col("doc_id").alias("ordinal"), "y_true", (n / (n + 1500.0)).alias("y_score"))
    )


def tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a coarse score, hence long ties."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y_true"))
    return (
        frames(spark, sf_dir)
        .join(labels, "doc_id")
        .select("detector", F.col("doc_id").alias("ordinal"), "y_true", F.floor(F.col("n_chars") / 500).cast("double").alias("y_score"))
    )


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows: purchase or not, by value; one evaluation per user id modulo four."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("eval_id"),
        F.col("event_id").alias("ordinal"),
        (F.col("event_type") == "purchase").cast("int").alias("y_true"),
        F.col("value").alias("y_score"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("pixels")
    )


FRAMES_SQL = """
frames AS (
  SELECT doc_id, lang AS detector, source, lang || '_' || source AS session_id, n_chars FROM documents
)"""

SCORED_SQL = (
    FRAMES_SQL
    + """,
scored AS (
  SELECT f.detector, f.session_id, f.doc_id AS ordinal, CAST(l.quality AS BIGINT) AS y,
         CAST(f.n_chars AS DOUBLE) / (CAST(f.n_chars AS DOUBLE) + CAST(1500 AS DOUBLE)) AS s
  FROM frames f JOIN labels l ON f.doc_id = l.doc_id
)"""
)

TIED_SQL = (
    FRAMES_SQL
    + """,
scored AS (
  SELECT f.detector, f.doc_id AS ordinal, CAST(l.quality AS BIGINT) AS y,
         floor(CAST(f.n_chars AS DOUBLE) / CAST(500 AS DOUBLE)) AS s
  FROM frames f JOIN labels l ON f.doc_id = l.doc_id
)"""
)

EVENTS_SQL = """
scored AS (
  SELECT user_id % 4 AS eval_id, event_id AS ordinal, CAST(event_type = 'purchase' AS BIGINT) AS y, value AS s
  FROM events
)"""


def metric_ctes(keys: str, source: str = "scored") -> str:
    """SQL of every metric: ``ranked`` rows, ``cells`` of equal scores, ``ap``, ``auc`` and ``f1`` per key."""
    part = f"PARTITION BY {keys}"
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""
ranked AS (
  SELECT {keys}, ordinal, y, s,
         CAST(sum(y) OVER ({part} ORDER BY s DESC, ordinal DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS tp,
         row_number() OVER ({part} ORDER BY s DESC, ordinal DESC) AS rk,
         CAST(sum(y) OVER ({part}) AS DOUBLE) AS p
  FROM {source}
),
ap AS (
  SELECT {keys}, CASE WHEN max(p) = 0 THEN 0.0 ELSE coalesce(sum(CASE WHEN y = 1 THEN tp / rk END), 0) / max(p) END AS ap
  FROM ranked GROUP BY {keys}
),
cells0 AS (
  SELECT {keys}, s, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY {keys}, s
),
cells AS (
  SELECT *, sum(pos) OVER ({part} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
         sum(n) OVER ({part} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS seen,
         sum(pos) OVER ({part}) AS p, sum(n) OVER ({part}) AS total
  FROM cells0
),
auc AS (
  SELECT {keys}, CASE WHEN max(p) = 0 OR max(p) = max(total) THEN 0.5
         ELSE sum((n - pos) * tp) / (max(p) * (max(total) - max(p))) END AS auc_roc
  FROM cells GROUP BY {keys}
),
f1s AS (
  SELECT {keys}, s, tp, seen, p, total, CASE WHEN tp > 0 THEN 2 * (tp / seen) * (tp / p) / ((tp / seen) + (tp / p)) ELSE 0.0 END AS f1
  FROM cells
),
f1r AS (
  SELECT *, row_number() OVER ({part} ORDER BY f1 DESC, s ASC) AS place FROM f1s
),
f1 AS (
  SELECT {keys}, CASE WHEN p = 0 THEN 0.0 ELSE f1 END AS f1,
         CASE WHEN p = 0 THEN CAST('NaN' AS DOUBLE) ELSE s END AS threshold,
         CAST(total AS BIGINT) AS n, CAST(p AS BIGINT) AS n_pos,
         CASE WHEN p = 0 THEN 0 ELSE CAST(tp AS BIGINT) END AS tp,
         CASE WHEN p = 0 THEN 0 ELSE CAST(seen AS BIGINT) END AS predicted
  FROM f1r WHERE place = 1
),
metrics AS (
  SELECT a.*, b.auc_roc, c.f1, c.threshold, c.n, c.n_pos, c.tp, c.predicted
  FROM ap a JOIN auc b ON {on} JOIN f1 c ON {on.replace('b.', 'c.')}
)"""


def q6(expr: str) -> str:
    """Six decimals, without a negative zero, as DOUBLE."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"
