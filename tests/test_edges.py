"""Sources and sinks."""

import json

import pytest
from helpers import frame, plain
from pyspark.sql import functions as F

from tallyrill import sinks
from tallyrill.functions.record import SEQ
from tallyrill.sources import generator, jsonl, otlp


def lines(spark, rows):
    return spark.createDataFrame([(r, i) for i, r in enumerate(rows)], f"value string, {SEQ} long")


def test_json_lines(spark):
    rows = ['{"ts_nanos":1,"name":"m","value":2}', "", "  ", "nonsense", '{"ts_nanos":1.5,"name":"m","value":2}', '{"ts_nanos":-1,"name":"m","value":2}', '{"name":"m","value":2}', '{"ts_nanos":1,"name":5,"value":2}', '{"ts_nanos":1,"name":"m","value":"2"}', '{"ts_nanos":1,"name":"m","value":2,"attrs":{"a":null}}', '{"ts_nanos":1,"name":"m","value":2,"attrs":[1]}',
            '{"ts_nanos":2,"name":"n","value":1.5,"start_ts_nanos":1,"scope":"s","resource":{"r":1},"attrs":{"b":true,"i":1,"d":1.5,"s":"1","w":2.0}}']
    got = plain(jsonl.parsed(lines(spark, rows)))
    assert [(r["ts"], r["value"]) for r in got] == [(1, 2.0), (2, 1.5)]
    assert {k: (type(x), x) for k, x in got[1]["attrs"].items()} == {"b": (bool, True), "i": (int, 1), "d": (float, 1.5), "s": (str, "1"), "w": (float, 2.0)}


def test_json_round_trip(spark):
    df = frame(spark, [{"ts": 5, "start": 1, "name": 'a "quoted"\n', "value": 0.1, "scope": "s", "attrs": {"k": "ü\\", "i": -3, "d": 2.0, "b": False}, "resource": {"r": "x"}}])
    again = jsonl.parsed(sinks.lines(df, "json").withColumnRenamed("line", "value"))
    assert [r.asDict() for r in again.drop(SEQ).collect()] == [r.asDict() for r in df.drop(SEQ).collect()]
    json.loads(sinks.lines(df, "json").first()[0])


def test_text(spark):
    df = frame(spark, [{"ts": 100, "name": "http.server.duration", "value": 42, "attrs": {"service.name": "checkout"}}, {"ts": 100, "start": 50, "name": "http.server.duration", "value": 42, "attrs": {"service.name": "checkout", "code": 200.0}}])
    assert [r[0] for r in sinks.lines(df).collect()] == ["100 http.server.duration=42.00 {service.name=checkout}", "100 [50..100] http.server.duration=42.00 {code=200, service.name=checkout}"]


def test_generator(spark):
    rows = plain(generator.batch(spark, 10, start=7, interval=3))
    assert [(r["ts"], r["value"]) for r in rows[:3]] == [(7, 50), (10, 57), (13, 64)]
    assert [(r["attrs"]["service.name"], r["attrs"]["http.route"]) for r in rows[:4]] == [("checkout", "/"), ("cart", "/"), ("search", "/"), ("checkout", "/api/order")]
    assert {r["attrs"]["service.name"] for r in plain(generator.batch(spark, 4, services=["one"]))} == {"one"}


def request(kind, points, **more):
    return json.dumps({"resourceMetrics": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "x"}}, {"key": "list", "value": {"arrayValue": {}}}]}, "scopeMetrics": [{"scope": {"name": "s"}, "metrics": [{"name": "m", kind: {"dataPoints": points} | more}]}]}]})


def point(v, t=1, **more):
    return {"attributes": [{"key": "n", "value": {"intValue": "3"}}], "timeUnixNano": str(t), "asDouble": v} | more


@pytest.fixture
def read(spark, tmp_path):
    def f(*requests):
        (tmp_path / "in.txt").write_text("\n".join(requests))
        return sorted(plain(otlp.batch(spark, str(tmp_path / "in.txt"))), key=lambda r: r["ts"])

    return f


def test_otlp(read):
    got = read(request("gauge", [point(1.5, 1), {"timeUnixNano": "2", "asInt": "7", "startTimeUnixNano": "1"}, {"timeUnixNano": 3}]), request("histogram", [point(1)]), "bad")
    assert [(r["ts"], r["start"], r["value"], r["attrs"]) for r in got] == [(1, None, 1.5, {"n": 3}), (2, 1, 7.0, {})]


def test_otlp_counters(read):
    got = read(request("sum", [point(100, 1)], aggregationTemporality=2, isMonotonic=True), request("sum", [point(175, 2), point(20, 3)], aggregationTemporality="AGGREGATION_TEMPORALITY_CUMULATIVE", isMonotonic=True))
    assert [(r["ts"], r["value"]) for r in got] == [(2, 75), (3, 20)]
    assert [r["value"] for r in read(request("sum", [point(5, 1)], aggregationTemporality=1))] == [5]


def test_files_are_read_in_their_order(spark, tmp_path, monkeypatch):
    """A later file that is larger, and so is packed first; blocks in a broadcast and beyond it."""
    import os

    from tallyrill.sources import files

    folder = tmp_path / "in"
    folder.mkdir()
    for n, name in enumerate("zma"):
        (folder / name).write_text("\n".join(json.dumps({"ts_nanos": 100 * n + i, "name": "m", "value": 1}) for i in range(1 + 20 * n)))
        os.utime(folder / name, (1_000_000 + n, 1_000_000 + n))
    for most in (100_000, 0):
        monkeypatch.setattr(files, "MOST_BLOCKS", most)
        rows = jsonl.batch(spark, str(folder)).select("_seq", "ts_nanos").collect()
        assert [r[1] for r in sorted(rows)] == sorted(r[1] for r in rows) and len({r[0] for r in rows}) == len(rows) == 63


def test_otlp_requests(spark):
    df = frame(spark, [{"ts": i, "name": n, "value": i, "attrs": {"s": "x", "i": 1, "b": True}} for i, n in enumerate("aabab")])
    sent = [json.loads(r[0]) for r in sinks.otlp_requests(df.coalesce(1), most=2).collect()]
    metrics = [[(m["name"], len(m["gauge"]["dataPoints"])) for rm in r["resourceMetrics"] for sm in rm["scopeMetrics"] for m in sm["metrics"]] for r in sent]
    assert sorted(metrics) == [[("a", 1), ("b", 1)], [("a", 2)], [("b", 1)]]
    back = otlp.decoded(sinks.otlp_requests(df).select(F.col("request").alias("value")))
    assert sorted((r["name"], r["value"]) for r in back.collect()) == sorted((n, float(i)) for i, n in enumerate("aabab"))


def test_delivery():
    waits, tries = [], []

    def send(body):
        tries.append(body)
        if len(tries) < 9:
            raise OSError

    assert sinks.deliver(send, "x", pause=waits.append) == 8
    assert waits == [0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 5.0, 5.0]
