"""Records as text lines, as JSON lines, and as OTLP requests in their JSON encoding."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.record import BOOL, DOUBLE, INT, STR, display, entries

SCOPE = "tallyrill"
MOST_POINTS = 512


def text_line() -> Column:
    """``ts[ [start..end]] name=value {key=value, ...}`` with two decimals and keys in order; resources aren't shown."""
    bounds = F.when(F.col("start_ts_nanos").isNotNull(), F.concat(F.lit(" ["), F.col("start_ts_nanos"), F.lit(".."), F.col("ts_nanos"), F.lit("]"))).otherwise(F.lit(""))
    value = F.when(F.isnan("value"), F.lit("NaN")).when(F.abs("value") == float("inf"), F.when(F.col("value") > 0, F.lit("inf")).otherwise(F.lit("-inf"))).otherwise(F.format_string("%.2f", F.col("value")))
    labels = F.array_join(F.transform(entries("attrs"), lambda p: F.concat(p["key"], F.lit("="), display(p["value"]))), ", ")
    return F.concat(F.col("ts_nanos"), bounds, F.lit(" "), F.col("name"), F.lit("="), value, F.lit(" {"), labels, F.lit("}"))


def _quoted(s: Column) -> Column:
    whole = F.to_json(F.array(s))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _number(d: Column) -> Column:
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit("null")).otherwise(d.cast("string"))


def _json_attr(a: Column) -> Column:
    return F.when(a["t"] == BOOL, a["b"].cast("string")).when(a["t"] == INT, a["i"].cast("string")).when(a["t"] == DOUBLE, _number(a["d"])).when(a["t"] == STR, _quoted(a["s"]))


def _json_map(m: str) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(entries(m), lambda p: F.concat(_quoted(p["key"]), F.lit(":"), _json_attr(p["value"]))), ","), F.lit("}"))


def json_line() -> Column:
    """A record as JSON, from which sources.jsonl reads the same record."""
    opt = lambda c, shown: F.when(F.col(c).isNull(), F.lit("null")).otherwise(shown)
    return F.concat(
        F.lit('{"ts_nanos":'), F.col("ts_nanos"), F.lit(',"start_ts_nanos":'), opt("start_ts_nanos", F.col("start_ts_nanos").cast("string")), F.lit(',"resource":'), _json_map("resource"),
        F.lit(',"scope":'), opt("scope", _quoted(F.col("scope"))), F.lit(',"name":'), _quoted(F.col("name")), F.lit(',"value":'), _number(F.col("value")), F.lit(',"attrs":'), _json_map("attrs"), F.lit("}"),
    )


def lines(df: DataFrame, format: str = "text") -> DataFrame:
    """One column ``line``."""
    return df.select((text_line() if format == "text" else json_line()).alias("line"))


def _otlp_attrs() -> Column:
    def value(a: Column) -> Column:
        none = lambda t: F.lit(None).cast(t)
        return F.struct(
            F.when(a["t"] == STR, a["s"]).otherwise(none("string")).alias("stringValue"), F.when(a["t"] == BOOL, a["b"]).otherwise(none("boolean")).alias("boolValue"),
            F.when(a["t"] == INT, a["i"].cast("string")).otherwise(none("string")).alias("intValue"), F.when(a["t"] == DOUBLE, a["d"]).otherwise(none("double")).alias("doubleValue"),
        )

    return F.transform(entries("attrs"), lambda p: F.struct(p["key"].alias("key"), value(p["value"]).alias("value")))


def otlp_requests(df: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """Export requests (column ``request``): batches of ``most`` records that follow each other in a partition, whatever their names, a gauge for each name. Resources and scopes aren't sent."""
    point = F.struct(_otlp_attrs().alias("attributes"), F.coalesce("start_ts_nanos", F.lit(0)).cast("string").alias("startTimeUnixNano"), F.col("ts_nanos").cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"))
    at = F.monotonically_increasing_id()  # the partition's number, and 33 bits for the row's in it
    rows = df.select(F.struct(at.alias("at"), F.col("name"), point.alias("point")).alias("item"))
    nth = F.floor(F.col("item.at").bitwiseAND(F.lit((1 << 33) - 1)) / most)
    batches = rows.groupBy(F.shiftright("item.at", 33).alias("_partition"), nth.alias("_batch")).agg(F.sort_array(F.collect_list("item")).alias("items"))
    names = F.array_sort(F.array_distinct(F.transform("items", lambda i: i["name"])))
    points = lambda n: F.transform(F.filter("items", lambda i: i["name"] == n), lambda i: i["point"])
    metrics = F.transform(names, lambda n: F.struct(n.alias("name"), F.struct(points(n).alias("dataPoints")).alias("gauge")))
    scope = F.struct(F.struct(F.lit(SCOPE).alias("name")).alias("scope"), metrics.alias("metrics"))
    return batches.select(F.to_json(F.struct(F.array(F.struct(F.array(scope).alias("scopeMetrics"))).alias("resourceMetrics"))).alias("request"))


def deliver(send: Callable[[str], None], request: str, first_wait: float = 0.1, longest_wait: float = 5.0, pause: Callable[[float], None] = time.sleep, attempts: int | None = None) -> int:
    """Sends until it succeeds, waiting twice as long each time; the number of failures. Delivery is at least once."""
    failed, wait = 0, first_wait
    while True:
        try:
            send(request)
            return failed
        except Exception:
            failed += 1
            if attempts is not None and failed >= attempts:
                raise
            pause(wait)
            wait = min(2 * wait, longest_wait)


def post(endpoint: str) -> Callable[[str], None]:
    """Sends requests to a collector's HTTP endpoint."""
    import urllib.request

    def send(body: str) -> None:
        call = urllib.request.Request(f"{endpoint.rstrip('/')}/v1/metrics", body.encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(call, timeout=30):
            pass

    return send


def export(df: DataFrame, endpoint: str) -> None:
    """Sends all records from the executors, each partition its requests one after the other."""
    send_to = endpoint

    def run(rows) -> None:
        send = post(send_to)
        for r in rows:
            deliver(send, r["request"])

    otlp_requests(df).foreachPartition(run)
