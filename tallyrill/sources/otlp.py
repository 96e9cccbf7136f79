"""OTLP metrics in their JSON encoding: one export request a line, gauges and sums of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.record import ARRIVAL, ATTR, BOOL, DOUBLE, INT, SEQ, STR, attr
from ..operators import normalize
from .files import arrival, lines

_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_POINT = f"struct<attributes:{_ATTRS},startTimeUnixNano:string,timeUnixNano:string,asDouble:double,asInt:string>"
REQUEST = (
    f"struct<resourceMetrics:array<struct<resource:struct<attributes:{_ATTRS}>,scopeMetrics:array<struct<scope:struct<name:string>,"
    f"metrics:array<struct<name:string,gauge:struct<dataPoints:array<{_POINT}>>,"
    f"sum:struct<dataPoints:array<{_POINT}>,aggregationTemporality:string,isMonotonic:boolean>>>>>>>>"
)
_CUMULATIVE = ("2", "AGGREGATION_TEMPORALITY_CUMULATIVE")


def _attr(v: Column) -> Column:
    # arrays, lists of pairs and bytes have no place in a record
    return F.coalesce(attr(v["stringValue"], STR), attr(v["boolValue"], BOOL), attr(v["intValue"].try_cast("bigint"), INT), attr(v["doubleValue"], DOUBLE))


def _attrs(pairs: Column) -> Column:
    """A map of the pairs; of several with one key the last counts."""
    given = F.filter(F.transform(F.coalesce(pairs, F.array().cast(_ATTRS)), lambda p: F.struct(p["key"].alias("key"), _attr(p["value"]).alias("value"))), lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    last = F.filter(given, lambda p, i: ~F.exists(F.slice(given, i + 2, F.greatest(F.size(given) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast(f"map<string,{ATTR}>"))


def decoded(df: DataFrame, line: str = "value") -> DataFrame:
    """Records of a frame of requests, with flags ``_cumulative`` and ``_monotonic``. Other metrics, and points without a number, are left out.

    Exploding keeps the order of a request's points.
    """
    own = [c for c in df.columns if c in (ARRIVAL, SEQ)]
    rows = df.select(*own, F.explode(F.from_json(line, REQUEST)["resourceMetrics"]).alias("rm"))
    rows = rows.select(*own, F.col("rm.resource.attributes").alias("resource"), F.explode("rm.scopeMetrics").alias("sm"))
    rows = rows.select(*own, "resource", F.col("sm.scope.name").alias("scope"), F.explode("sm.metrics").alias("m"))
    rows = rows.select(*own, "resource", "scope", "m", F.explode(F.coalesce("m.gauge.dataPoints", "m.sum.dataPoints")).alias("p"))
    p, total = F.col("p"), F.col("m.sum")
    start = p["startTimeUnixNano"].try_cast("bigint")
    cumulative = F.col("m.gauge").isNull() & F.coalesce(total["aggregationTemporality"].isin(*_CUMULATIVE), F.lit(False))
    return rows.select(
        F.coalesce(p["timeUnixNano"].try_cast("bigint"), F.lit(0)).alias("ts_nanos"),
        F.when(start != 0, start).alias("start_ts_nanos"),
        _attrs(F.col("resource")).alias("resource"),
        F.col("scope"),
        F.coalesce("m.name", F.lit("")).alias("name"),
        F.coalesce(p["asDouble"], p["asInt"].try_cast("bigint").cast("double")).alias("value"),
        _attrs(p["attributes"]).alias("attrs"),
        cumulative.alias("_cumulative"),
        F.coalesce(total["isMonotonic"], F.lit(False)).alias("_monotonic"),
        *own,
    ).where("value is not null")


def batch(spark: SparkSession, path: str) -> DataFrame:
    """Records of files of requests in the order of files and lines, cumulative sums as deltas in the order of a request's points. The records of a request share SEQ."""
    points = decoded(lines(spark, path)).withColumn("_nth", F.monotonically_increasing_id())  # exploding keeps their order
    return normalize.apply(points, order=(SEQ, "_nth")).drop("_nth")


def stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Records of files of requests; cumulative sums still need streaming.stateful.deltas()."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return decoded(reader.load(path).select("value", arrival()))
