"""Aggregates over event-time windows, for bounded input.

Windows are aligned to the epoch. By default (``exact=False``) all records count, and the plan is one partial and one final
hash aggregate. With ``exact=True`` records are taken in their order of arrival (SEQ): the watermark is the greatest event
time of the records before, less the allowed lateness; a record all of whose windows end at or before it is late, and
``max_groups`` admits the groups of a window that came first. At the end of the input every open window fires.

The watermark needs a running maximum over all records. Its prefix is taken in two passes: a maximum for each of a bounded
number of ranges of SEQ, then a running maximum within each range, so no task has all records.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.record import SEQ, attr_map, fault, lookup, numeric
from .faults import checked, kept

#: Ranges of SEQ for the running maximum, by the input's size; their maxima are one small table.
LEAST_RANGES, MOST_RANGES, RANGE_BYTES = 16, 4096, 64 << 20


@dataclass(frozen=True)
class Spec:
    size: int
    slide: int | None = None
    lateness: int = 0
    group_by: tuple[str, ...] = ()
    op: str = "count"
    field: str | None = None
    on_missing: str = "skip"
    on_invalid: str = "skip"
    max_groups: int | None = None
    name: str | None = None
    node: str = "window"

    @property
    def step(self) -> int:
        return self.slide or self.size


def reading(spec: Spec) -> tuple[Column, Column]:
    """The number that is aggregated, and its fault."""
    if spec.field is None or spec.field == "value":
        return F.col("value"), F.lit(None).cast("string")
    a = lookup(spec.field)
    return numeric(a), fault(a)


def start_column(spec: Spec, ts: Column) -> Column:
    """The start of a tumbling window."""
    return ts - F.pmod(ts, F.lit(spec.size))


def with_starts(df: DataFrame, spec: Spec) -> DataFrame:
    """A row for each record and window that holds it, with the window's ``_start``. Windows before the epoch aren't made."""
    if spec.step == spec.size:
        return df.withColumn("_start", start_column(spec, F.col("ts_nanos")))
    last = F.col("ts_nanos") - F.pmod(F.col("ts_nanos"), F.lit(spec.step))
    many = -(-spec.size // spec.step)
    starts = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: last - i.cast("bigint") * F.lit(spec.step))
    holds = F.filter(starts, lambda s: (s >= 0) & (s + F.lit(spec.size) > F.col("ts_nanos")))
    return df.withColumn("_start", F.explode(holds))


def result(spec: Spec) -> Column:
    """The aggregate of column ``_number``. NaN counts in sums but is passed over by min and max, whose empty values are the infinities."""
    x = F.col("_number")
    real = F.when(~F.isnan(x), x)
    return {
        "count": F.count(x).cast("double"),
        "sum": F.sum(x),
        "min": F.coalesce(F.min(real), F.lit(float("inf"))),
        "max": F.coalesce(F.max(real), F.lit(float("-inf"))),
        "avg": F.sum(x) / F.count(x),
    }[spec.op]


def key_columns(spec: Spec) -> list[str]:
    return [f"_k{i}" for i in range(len(spec.group_by))]


def prepared(df: DataFrame, spec: Spec) -> DataFrame:
    """Only what the aggregate needs, faulty records still there (``_fault``)."""
    number, wrong = reading(spec)
    number = checked(number, wrong, spec.node, spec.on_missing, spec.on_invalid)
    keys = [lookup(k).alias(c) for k, c in zip(spec.group_by, key_columns(spec), strict=True)]
    return df.select("ts_nanos", "name", number.alias("_number"), wrong.alias("_fault"), *keys, *([SEQ] if SEQ in df.columns else []))


def readable(spec: Spec) -> Column:
    return kept(F.col("_fault"), spec.on_missing, spec.on_invalid)


def emitted(groups: DataFrame, spec: Spec) -> DataFrame:
    """Records of groups (``_start``, keys, ``_value``, ``_name``): an event at the window's end."""
    keys = {k: F.col(c) for k, c in zip(spec.group_by, key_columns(spec), strict=True)}
    return groups.select(
        (F.col("_start") + F.lit(spec.size)).alias("ts_nanos"),
        F.col("_start").alias("start_ts_nanos"),
        attr_map({}).alias("resource"),
        F.lit(None).cast("string").alias("scope"),
        (F.lit(spec.name) if spec.name is not None else F.col("_name")).alias("name"),
        F.col("_value").alias("value"),
        attr_map(keys).alias("attrs"),
        F.col("_start").alias(SEQ),
    )


def _first_name(spec: Spec, columns: list[str]) -> list[Column]:
    if spec.name is not None:
        return []
    return [(F.min_by("name", SEQ) if SEQ in columns else F.first("name")).alias("_name")]


def _range_of(df: DataFrame) -> Column:
    """The number of SEQ's range: as many ranges as the input's size asks for, with near equally many records each."""
    plan = df._jdf.queryExecution().optimizedPlan() if hasattr(df, "_jdf") else None
    n = MOST_RANGES if plan is None else min(MOST_RANGES, max(LEAST_RANGES, int(plan.stats().sizeInBytes()) // RANGE_BYTES))
    edges = sorted({int(b) for b in df.approxQuantile(SEQ, [i / n for i in range(1, n)], 1 / (4 * n))})
    if not edges:
        return F.lit(0)
    # found in two steps, each over the square root of their number
    k = math.isqrt(len(edges)) + 1
    array = lambda xs: "array(" + ", ".join(f"{x}L" for x in xs) + ")"
    blocks = [edges[i : i + k] for i in range(0, len(edges), k)]
    coarse = f"size(filter({array(b[0] for b in blocks)}, b -> b <= {SEQ}))"
    fine = f"size(filter(element_at(array({', '.join(map(array, blocks))}), greatest({coarse}, 1)), b -> b <= {SEQ}))"
    return F.expr(f"greatest({coarse} - 1, 0) * {k} + {fine}")


def with_watermark(df: DataFrame, spec: Spec) -> DataFrame:
    """``_before``: the watermark just before each record. Records that share SEQ, as a user function makes them of one, are in order of time and name."""
    ranged = df.withColumn("_range", _range_of(df))
    tops = ranged.groupBy("_range").agg(F.max("ts_nanos").alias("_top"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    tops = tops.withColumn("_earlier", F.max("_top").over(earlier)).select("_range", "_earlier")
    own = W.partitionBy("_range").orderBy(SEQ, "ts_nanos", "name").rowsBetween(W.unboundedPreceding, -1)
    seen = F.greatest(F.max("ts_nanos").over(own), F.col("_earlier"))
    return ranged.join(F.broadcast(tops), "_range").withColumn("_before", F.greatest(F.lit(0), F.coalesce(seen, F.lit(0)) - F.lit(spec.lateness))).drop("_range", "_earlier")


def _live(df: DataFrame, spec: Spec) -> DataFrame:
    """Records with the windows that hadn't fired when they came."""
    rows = with_watermark(prepared(df, spec), spec).where(readable(spec))
    return with_starts(rows, spec).where(F.col("_start") + F.lit(spec.size) > F.col("_before"))


def _groups(rows: DataFrame, spec: Spec, exact: bool) -> DataFrame:
    order = [F.min(SEQ).alias("_first")] if exact else []
    groups = rows.groupBy("_start", *key_columns(spec)).agg(result(spec).alias("_value"), F.count("_number").alias("_samples"), *_first_name(spec, rows.columns), *order)
    if exact and spec.max_groups is not None:
        rank = F.row_number().over(W.partitionBy("_start").orderBy("_first"))
        groups = groups.withColumn("_rank", rank).where(F.col("_rank") <= spec.max_groups)
    return groups


def apply(df: DataFrame, spec: Spec, exact: bool | None = None) -> DataFrame:
    """Aggregated records. ``exact``: by default where the order of arrival is known and matters to the outcome asked for."""
    if exact is None:
        exact = spec.max_groups is not None
    if exact and SEQ not in df.columns:
        raise ValueError(f"{spec.node}: exact windows need the order of arrival in {SEQ}")
    rows = _live(df, spec) if exact else with_starts(prepared(df, spec).where(readable(spec)), spec)
    return emitted(_groups(rows, spec, exact), spec)


def dropped(df: DataFrame, spec: Spec) -> dict[str, DataFrame]:
    """The records that an exact window leaves out, by reason."""
    rows = with_watermark(prepared(df, spec), spec)
    good = rows.where("_fault is null")
    windows = with_starts(good, spec)
    open_ = F.col("_start") + F.lit(spec.size) > F.col("_before")
    state = windows.groupBy(SEQ).agg(F.max(F.when(open_, 1).otherwise(0)).alias("live"))
    out = {"invalid": rows.where("_fault is not null"), "late": state.where("live = 0")}
    if spec.max_groups is not None:
        live = windows.where(open_)
        groups = live.groupBy("_start", *key_columns(spec)).agg(F.min(SEQ).alias("_first")).withColumn("_rank", F.row_number().over(W.partitionBy("_start").orderBy("_first")))
        same = (live["_start"] == groups["_start"]) if not spec.group_by else None
        for c in key_columns(spec):
            condition = live[c].eqNullSafe(groups[c])
            same = condition & (live["_start"] == groups["_start"]) if same is None else same & condition
        folded = live.join(groups, same).groupBy(live[SEQ]).agg(F.max(F.when(groups["_rank"] <= spec.max_groups, 1).otherwise(0)).alias("folded"))
        out["capped"] = folded.where("folded = 0")
    return out


def open_groups(df: DataFrame, spec: Spec) -> DataFrame:
    """The groups still open when the input ends, before the last flush: labels as text, bounds, running value and samples."""
    from ..functions.record import display

    rows = _live(df, spec)
    end = df.agg(F.greatest(F.lit(0), F.max("ts_nanos") - F.lit(spec.lateness)).alias("_end"))
    groups = _groups(rows, spec, True).join(F.broadcast(end), F.col("_start") + F.lit(spec.size) > F.col("_end"))
    labels = {k: display(F.col(c)) for k, c in zip(spec.group_by, key_columns(spec), strict=True)}
    pairs = F.create_map(*(x for k, v in labels.items() for x in (F.lit(k), v))) if labels else F.create_map().cast("map<string,string>")
    return groups.select(F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("labels"), F.col("_start").alias("window_start_nanos"), (F.col("_start") + F.lit(spec.size)).alias("window_end_nanos"), F.col("_value").alias("value"), F.col("_samples").alias("samples"))


