"""Synthetic records: service and route take turns, the value cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.record import STR, attr, record

#: What an empty list of services or routes stands for.
SERVICES = ("checkout", "cart", "search")
ROUTES = ("/", "/api/order", "/api/items")


def _records(df: DataFrame, i: Column, ts: Column, metric: str, services: list[str], routes: list[str]) -> DataFrame:
    services, routes = services or list(SERVICES), routes or list(ROUTES)
    pick = lambda names, n: attr(F.get(F.array(*map(F.lit, names)), (n % len(names)).cast("int")), STR)
    turn = F.floor(i / F.lit(len(services))).cast("bigint")
    attrs = {"service.name": pick(services, i), "http.route": pick(routes, turn)}
    return record(df, ts_nanos=ts, name=F.lit(metric), value=50 + (i * 7) % 100, attrs=attrs, seq=i)


def batch(spark: SparkSession, n: int, metric: str = "demo.metric", interval: int = 500_000_000, services: list[str] | None = None, routes: list[str] | None = None, start: int = 0) -> DataFrame:
    """n records whose event times are ``interval`` nanoseconds apart."""
    df = spark.range(n)
    return _records(df, F.col("id"), F.lit(start) + F.col("id") * F.lit(interval), metric, services or [], routes or [])


def stream(spark: SparkSession, metric: str = "demo.metric", interval: int = 500_000_000, services: list[str] | None = None, routes: list[str] | None = None) -> DataFrame:
    """Records in real time, at whole records a second at least."""
    df = spark.readStream.format("rate").option("rowsPerSecond", max(1, round(1_000_000_000 / max(interval, 1)))).load()
    return _records(df, F.col("value"), F.unix_micros("timestamp") * 1000, metric, services or [], routes or [])
