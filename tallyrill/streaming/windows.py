"""Windows and joins over unbounded input, by Structured Streaming in append mode.

The watermark advances by micro-batch, not by record, so within a batch records are kept that a record-wise watermark would
call late. ``max_groups`` and ``idle_timeout`` depend on the order of arrival and on wall-clock time across all groups; they
run in streaming.stateful, as do joins with ``max_groups`` and joins of windows with either.

Input that comes to an end is flushed by a mark: a record later than all others, read from the files of a folder of its own,
which end_input() writes. It joins the records at each window, counts for the watermark and for nothing else, and so every
window fires. What comes after it is late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.record import ARRIVAL, ATTR, attr, attr_map
from ..operators import window
from ..operators.join import reduced
from . import stateful

#: Carries the watermark from node to node; the digits after it count the windows that the records have gone through.
TIME = "_time"


def _micros(ns: int, what: str) -> int:
    if ns % 1000:
        raise ValueError(f"{what}: whole microseconds are needed in a stream")
    return ns // 1000


def _interval(us: int) -> str:
    return f"{us} microseconds"


def time_column(df: DataFrame) -> str | None:
    return next((c for c in df.columns if c.startswith(TIME)), None)


def end_input(spark: SparkSession, marks: str) -> None:
    """The folder ``marks`` is there, and the mark is in it."""
    spark.range(1).select(F.lit("end").alias("value")).write.mode("append").text(marks)


def marked(df: DataFrame, marks: str | None) -> DataFrame:
    """Records, and the mark at their end; it has neither name nor value."""
    if marks is None:
        return df
    mark = df.sparkSession.readStream.schema("value string").format("text").load(marks)
    have = {"ts_nanos": F.lit(stateful.LAST), ARRIVAL: F.lit("~")}  # after all digits
    return df.unionByName(mark.select(*(have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema)))


def with_time(df: DataFrame, lateness_us: int, marks: str | None = None) -> DataFrame:
    if time_column(df):
        return df  # the output of a window has its time and watermark
    df = marked(df, marks)
    # nanoseconds within a microsecond never part a window
    return df.withColumn(f"{TIME}0", F.timestamp_micros(F.expr("ts_nanos div 1000"))).withWatermark(f"{TIME}0", _interval(lateness_us))


def apply(df: DataFrame, spec: window.Spec, idle: int | None = None, marks: str | None = None) -> DataFrame:
    """``marks``: the folder of the mark at the end of the input, if there will be one."""
    if spec.max_groups is not None or idle is not None:
        return stateful.window(marked(df.drop(*[c for c in df.columns if c.startswith(TIME)]), marks), spec, idle)
    size, step = _micros(spec.size, "size"), _micros(spec.step, "slide")
    timed = with_time(df, _micros(spec.lateness, "allowed_lateness"), marks)
    time = time_column(timed)
    shift = int(time.removeprefix(TIME))
    number, wrong = window.reading(spec)
    number = window.checked(number, wrong, spec.node, spec.on_missing, spec.on_invalid)
    keys = [window.lookup(k).alias(c) for k, c in zip(spec.group_by, window.key_columns(spec), strict=True)]
    rows = timed.select(time, "name", number.alias("_number"), wrong.alias("_fault"), *keys)
    # the condition names the time, so that it isn't moved before the watermark, which faulty records and the mark advance, too
    rows = rows.where(F.when(F.col(time).isNull(), False).otherwise(window.readable(spec) & F.col("name").isNotNull()))
    # a window's time is a microsecond before its end, and one more for each window before; shifted so, its end falls where a record at that time would
    bounds = F.window(time, _interval(size), _interval(step), _interval((-shift) % step))
    names = [] if spec.name is not None else [F.first("name").alias("_name")]
    groups = rows.groupBy(bounds.alias("_w"), *window.key_columns(spec)).agg(window.result(spec).alias("_value"), *names)
    start = (F.unix_micros("_w.start") + shift) * 1000
    groups = groups.withColumn("_start", start).where("_start >= 0").withColumn(f"{TIME}{shift + 1}", F.window_time("_w"))
    keyed = {k: F.col(c) for k, c in zip(spec.group_by, window.key_columns(spec), strict=True)}
    return groups.select(
        (F.col("_start") + F.lit(spec.size)).alias("ts_nanos"), F.col("_start").alias("start_ts_nanos"), attr_map({}).alias("resource"), F.lit(None).cast("string").alias("scope"),
        (F.lit(spec.name) if spec.name is not None else F.col("_name")).alias("name"), F.col("_value").alias("value"), attr_map(keyed).alias("attrs"), f"{TIME}{shift + 1}",
    )


def join(inputs: dict[str, DataFrame], group_by: list[str], value: str | None = None, name: str | None = None, max_groups: int | None = None, node: str = "join") -> DataFrame:
    """Inner joins of windowed streams on bounds and labels, input by input."""
    out: DataFrame | None = None
    times = {time_column(df) for df in inputs.values()}
    keys = [f"_k{i}" for i in range(len(group_by))]
    if max_groups is not None or len(times) != 1 or None in times:
        return reduced_or_aligned(stateful.join(inputs, group_by, max_groups, node), list(inputs), group_by, keys, value, name if name is not None else node)
    time = times.pop()
    for n, df in enumerate(inputs.values()):
        part = df.select(time, "start_ts_nanos", "ts_nanos", F.col("value").alias(f"_v{n}"), *(F.col("attrs").getItem(k).alias(c) for k, c in zip(group_by, keys, strict=True)))
        if out is None:
            out = part
            continue
        on = (out[time] == part[time]) & (out["start_ts_nanos"] == part["start_ts_nanos"]) & (out["ts_nanos"] == part["ts_nanos"])
        for k in keys:
            on = on & out[k].eqNullSafe(part[k])
        out = out.join(part, on).select(*(out[c] for c in out.columns), part[f"_v{n}"])
    return reduced_or_aligned(out, list(inputs), group_by, keys, value, name if name is not None else node)


def reduced_or_aligned(out: DataFrame, ids: list[str], group_by: list[str], keys: list[str], value: str | None, name: str) -> DataFrame:
    """Records of aligned values: the expression's, or zero with the values as attributes."""
    labels = {k: F.col(c) for k, c in zip(group_by, keys, strict=True)}
    if value is None:
        result, labels = F.lit(0.0), labels | {i: attr(F.col(f"_v{n}"), 3) for n, i in enumerate(ids)}
    else:
        out = reduced(out, ids, group_by, keys, value).where("_fault is null")
        result = F.col("_new")
    return out.select(
        "ts_nanos", "start_ts_nanos", F.create_map().cast(f"map<string,{ATTR}>").alias("resource"), F.lit(None).cast("string").alias("scope"),
        F.lit(name).alias("name"), result.alias("value"), attr_map(labels).alias("attrs"), *(c for c in out.columns if c.startswith(TIME)),
    )
