"""Keeps records by an attribute: there is one of that key, or its text is as given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.record import display, lookup


def kept(key: str, equals: str | None = None) -> Column:
    a = lookup(key)
    return a.isNotNull() if equals is None else F.coalesce(display(a) == F.lit(equals), F.lit(False))


def apply(df: DataFrame, key: str, equals: str | None = None) -> DataFrame:
    return df.where(kept(key, equals))


def dropped(df: DataFrame, key: str, equals: str | None = None) -> dict[str, DataFrame]:
    return {"filtered": df.where(~kept(key, equals))}
