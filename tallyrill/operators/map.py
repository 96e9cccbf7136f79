"""Replaces each record's value by an expression over its value and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from .faults import checked, kept


def apply(df: DataFrame, value: str, name: str | None = None, on_missing: str = "skip", on_invalid: str = "skip", node: str = "map") -> DataFrame:
    out = expr.evaluated(df, expr.parse(value)).where(kept(F.col("_fault"), on_missing, on_invalid))
    new = checked(F.col("_new"), F.col("_fault"), node, on_missing, on_invalid)
    return out.withColumns({"value": new} | ({"name": F.lit(name)} if name is not None else {})).drop("_fault", "_new")


def dropped(df: DataFrame, value: str) -> dict[str, DataFrame]:
    return {"invalid": expr.evaluated(df, expr.parse(value)).where("_fault is not null")}
