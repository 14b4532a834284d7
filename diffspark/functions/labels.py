"""Column functions for labels, logits and losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_label(raw: Column) -> Column:
    """Integer label from a stored float, rounding halves to even."""
    return F.bround(raw.cast("double")).cast("int")


def background_label(label_row: Column) -> Column:
    """Hit label from a label row whose last entry is 1.0 for background-only frames."""
    last = F.element_at(label_row, -1)
    return F.when((last == 1.0) & ~F.isnan(last), 0).otherwise(1)


def hit_score(logits: Column) -> Column:
    """Positive-class probability: softmax for two logits, sigmoid for one."""
    margin = F.when(F.size(logits) == 2, F.get(logits, F.lit(1)) - F.get(logits, F.lit(0))).otherwise(
        F.get(logits, F.lit(0))
    )
    return 1.0 / (1.0 + F.exp(-margin.cast("double")))


def cross_entropy(logits: Column, y: Column) -> Column:
    """``-log softmax(logits)[y]``, shifted by the largest logit."""
    values = F.transform(logits, lambda v: v.cast("double"))
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.log(total) + top - F.get(values, y.cast("int"))


def predicted(score: Column, threshold: Column) -> Column:
    """1 where the score reaches the threshold; a NaN score never does."""
    return ((score >= threshold) & ~F.isnan(score)).cast("int")
