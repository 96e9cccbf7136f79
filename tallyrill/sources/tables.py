"""Records from the Parquet tables of the test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.record import INT, STR, attr, record


def nanos(column: str) -> Column:
    """Nanoseconds since the epoch of a timestamp read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def events(spark: SparkSession, sf_dir: str, keys: set[str] | None = None) -> DataFrame:
    """``events`` as records: named by type, with attributes event_type, user_id, bucket and k; they arrive slightly out of order, by a fixed rule. ``keys``: the attributes that are needed."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    attrs = {
        "event_type": attr(F.col("event_type"), STR),
        "user_id": attr(F.col("user_id"), INT),
        "bucket": attr(F.concat(F.lit("b"), F.pmod("user_id", F.lit(5))), STR),
        "k": attr(F.get_json_object("props", "$.k").try_cast("bigint"), INT),
    }
    attrs = {k: v for k, v in attrs.items() if keys is None or k in keys}
    arrival = (F.col("event_id") + F.pmod(F.col("event_id") * 7919, F.lit(37))) * 100_000_000_000 + F.col("event_id")
    return record(e, ts_nanos=nanos("ts"), name=F.col("event_type"), value=F.col("value"), attrs=attrs, seq=arrival)


def lineitem_counters(spark: SparkSession, sf_dir: str, monotonic: bool = True) -> DataFrame:
    """``lineitem`` quantities as cumulative counters by supplier, which grow with the order key and start again every thousand orders."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_quantity").alias("n"))
    w = W.partitionBy("l_suppkey", F.floor(F.col("l_orderkey") / 1000)).orderBy("l_orderkey").rowsBetween(W.unboundedPreceding, 0)
    rows = x.withColumn("total", F.sum("n").over(w))
    records = record(rows, ts_nanos=F.col("l_orderkey"), name=F.lit("shipped"), value=F.col("total"), attrs={"supplier": attr(F.col("l_suppkey"), INT)}, seq=F.col("l_orderkey"))
    return records.withColumns({"_cumulative": F.lit(True), "_monotonic": F.lit(monotonic)})
