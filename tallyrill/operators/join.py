"""Aligns the outputs of several windows on their labels and bounds, and reduces them to one value.

Inputs are tagged, put together and grouped by (bounds, labels), which is one shuffle however many inputs there are, with a
partial aggregate before it. Only groups that every input has are emitted. Of several values of one input the last counts.
``max_groups`` bounds the groups of a window, in the order in which the inputs, one after the other, bring them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import expr
from ..functions.record import SEQ, attr, attr_map, display, fault, numeric


def _aligned(inputs: dict[str, DataFrame], group_by: list[str], max_groups: int | None) -> tuple[DataFrame, list[str]]:
    keys = [f"_k{i}" for i in range(len(group_by))]
    parts = None
    for n, df in enumerate(inputs.values()):
        order = F.col(SEQ) if SEQ in df.columns else F.lit(0).cast("bigint")
        part = df.select(F.col("start_ts_nanos").alias("_start"), F.col("ts_nanos").alias("_end"), *(F.col("attrs").getItem(k).alias(c) for k, c in zip(group_by, keys, strict=True)), F.lit(n).alias("_input"), order.alias("_order"), F.col("value").alias("_value"))
        parts = part if parts is None else parts.unionByName(part)
    own = lambda n, c: F.when(F.col("_input") == n, F.col(c))
    values = [F.max_by(own(n, "_value"), own(n, "_order")).alias(f"_v{n}") for n in range(len(inputs))]
    groups = parts.groupBy("_start", "_end", *keys).agg(*values, F.min("_input").alias("_first"))
    if max_groups is not None:
        rank = F.row_number().over(W.partitionBy("_end").orderBy("_first", *keys))
        groups = groups.withColumn("_rank", rank).where(F.col("_rank") <= max_groups)
    return groups, keys


def _full(n: int) -> Column:
    out = F.lit(True)
    for i in range(n):
        out = out & F.col(f"_v{i}").isNotNull()
    return out


def reduced(groups: DataFrame, ids: list[str], group_by: list[str], keys: list[str], value: str) -> DataFrame:
    """Groups with the expression's ``_new`` and ``_fault``. Ids of inputs come before labels of that name."""

    def resolve(name: str) -> tuple[Column, Column]:
        none = F.lit(None).cast("string")
        if name == "value":
            return F.lit(0.0), none
        if name in ids:
            return F.col(f"_v{ids.index(name)}"), none
        if name in group_by:
            a = F.col(keys[group_by.index(name)])
            return numeric(a), fault(a)
        return F.lit(None).cast("double"), F.lit("missing")

    return expr.evaluated(groups, expr.parse(value), resolve)


def apply(inputs: dict[str, DataFrame], group_by: list[str], value: str | None = None, name: str | None = None, max_groups: int | None = None, node: str = "join") -> DataFrame:
    groups, keys = _aligned(inputs, group_by, max_groups)
    ids = list(inputs)
    groups = groups.where(_full(len(ids)))
    labels = {k: F.col(c) for k, c in zip(group_by, keys, strict=True)}
    if value is None:
        out, labels = F.lit(0.0), labels | {i: attr(F.col(f"_v{n}"), 3) for n, i in enumerate(ids)}
    else:
        groups = reduced(groups, ids, group_by, keys, value).where("_fault is null")
        out = F.col("_new")
    return groups.select(
        F.col("_end").alias("ts_nanos"),
        F.col("_start").alias("start_ts_nanos"),
        attr_map({}).alias("resource"),
        F.lit(None).cast("string").alias("scope"),
        F.lit(name if name is not None else node).alias("name"),
        out.alias("value"),
        attr_map(labels).alias("attrs"),
        F.col("_start").alias(SEQ),
    )


def open_groups(inputs: dict[str, DataFrame], group_by: list[str]) -> DataFrame:
    """The groups that still lack an input when the inputs end: labels as text, bounds, and the values that are there."""
    groups, keys = _aligned(inputs, group_by, None)
    pairs = lambda of, kind: F.map_filter(F.create_map(*(x for k, c in of for x in (F.lit(k), c))), lambda _, v: v.isNotNull()) if of else F.create_map().cast(f"map<string,{kind}>")
    labels = pairs([(k, display(F.col(c))) for k, c in zip(group_by, keys, strict=True)], "string")
    values = pairs([(i, F.col(f"_v{n}")) for n, i in enumerate(inputs)], "double")
    return groups.where(~_full(len(inputs))).select(labels.alias("labels"), F.col("_start").alias("window_start_nanos"), F.col("_end").alias("window_end_nanos"), values.alias("inputs"))


def dropped(inputs: dict[str, DataFrame], group_by: list[str], value: str | None = None, max_groups: int | None = None) -> dict[str, DataFrame]:
    """Groups that lack an input, groups that the expression can't be read for, and groups over the cap."""
    groups, keys = _aligned(inputs, group_by, max_groups)
    out = {"incomplete": groups.where(~_full(len(inputs)))}
    if value is not None:
        out["invalid"] = reduced(groups.where(_full(len(inputs))), list(inputs), group_by, keys, value).where("_fault is not null")
    if max_groups is not None:
        every, _ = _aligned(inputs, group_by, None)
        rank = F.row_number().over(W.partitionBy("_end").orderBy("_first", *keys))
        out["capped"] = every.withColumn("_rank", rank).where(F.col("_rank") > max_groups)
    return out
