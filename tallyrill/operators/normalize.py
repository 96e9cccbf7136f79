"""Cumulative counters to deltas, by series and in order of arrival.

The first sample of a series is its baseline and gives nothing. A monotonic counter that falls has been reset, and its new
value is the delta; otherwise the delta is the difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.record import SEQ, entries


def series() -> list[Column]:
    """What makes two samples of one series: name, scope and all attributes of resource and point, types included."""
    return [F.col("name"), F.col("scope"), entries("resource"), entries("attrs")]


def delta(value: Column, before: Column, monotonic: Column) -> Column:
    return F.when(monotonic & (value < before), value).otherwise(value - before)


def apply(df: DataFrame, cumulative: str = "_cumulative", monotonic: str = "_monotonic", order: tuple[str, ...] = (SEQ,)) -> DataFrame:
    """Deltas in place of cumulative samples; other records pass. Both flag columns go."""
    rest = df.where(~F.col(cumulative)).drop(cumulative, monotonic)
    w = W.partitionBy(*series()).orderBy(*order)
    sums = df.where(cumulative).withColumn("_last", F.lag("value").over(w))
    deltas = sums.where("_last is not null").withColumn("value", delta(F.col("value"), F.col("_last"), F.col(monotonic)))
    return rest.unionByName(deltas.drop("_last", cumulative, monotonic))
