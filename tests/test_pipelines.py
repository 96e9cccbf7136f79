import json

import pytest
from helpers import frame, plain

from tallyrill import cli, inspect, metrics
from tallyrill.functions.durations import memory_bytes, nanoseconds
from tallyrill.plans import ir
from tallyrill.plans import validate as v
from tallyrill.plans.compiler import compile_pipeline

LATENCY = """
version: 0
sources:
  - {type: generator, id: made, metric: wait, interval: 200ms, services: [north, south, west], routes: [/in, /out]}
transforms:
  - {type: filter, id: only, input: made, key: service.name, equals: north}
  - {type: window, id: means, input: only, size: 4s, group_by: [http.route, service.name], aggregate: {op: avg, field: value}}
sinks:
  - {type: stdout, id: shown, input: means, format: text}
"""
SPREAD = """
sources: [{type: stdin, id: a}, {type: stdin, id: b}]
transforms:
  - {type: window, id: hi, input: a, size: 5s, group_by: [s], aggregate: {op: max}}
  - {type: window, id: lo, input: b, size: 5000ms, group_by: [s], aggregate: {op: min}}
  - {type: join, id: spread, inputs: [hi, lo], name: diff, value: hi - lo}
sinks: [{type: stdout, id: out, input: spread}]
"""


@pytest.mark.parametrize(("text", "ns"), [("5s", 5 * 10**9), ("200ms", 2 * 10**8), ("1h 30m", 5400 * 10**9), ("1h30m", 5400 * 10**9), ("3ns", 3), ("2 days", 172800 * 10**9), ("0", 0)])
def test_durations(text, ns):
    assert nanoseconds(text) == ns


@pytest.mark.parametrize("text", ["", "5", "abc", "5 parsecs", "-1s", "1s x"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        nanoseconds(text)


def test_memory():
    assert [memory_bytes(x) for x in ("64Mi", "1GiB", "1024", 7)] == [64 << 20, 1 << 30, 1024, 7]
    with pytest.raises(ValueError):
        memory_bytes("lots")


def test_parse():
    p = ir.loads(LATENCY)
    v.validate(p)
    assert ir.from_dict(ir.to_dict(p)) == p
    assert p.sources[0].services == ["north", "south", "west"] and p.transforms[1].aggregate.on_missing == "skip" and p.sinks[0].format == "text"
    v.validate(ir.loads(SPREAD))
    assert json.loads(ir.schema_text())["title"] == "Pipeline"
    with pytest.warns(UserWarning, match="unknown"):
        ir.loads("sources: [{type: stdin, id: a, more: 1}]\nsinks: []")


@pytest.mark.parametrize("text", ["[]", "sources: []", "sources: [{type: kafka, id: a}]\nsinks: []", "sources: [{type: stdin}]\nsinks: []", "sources: [{type: stdin, id: 1}]\nsinks: []", "a: b: c", "sources: []\nsinks: []\ntransforms: [{type: window, id: w, input: a, size: 1s, aggregate: {op: median}}]"])
def test_parse_errors(text):
    with pytest.raises(ir.ParseError):
        ir.loads(text)


def _p(transforms="", sinks="", sources="[{type: stdin, id: a}, {type: stdin, id: b}]"):
    return ir.loads(f"sources: {sources}\ntransforms: [{transforms}]\nsinks: [{sinks}]")


_W = "{type: window, id: %s, input: %s, size: %s, group_by: [%s], aggregate: {op: sum}%s}"


@pytest.mark.parametrize(
    ("pipeline", "error"),
    [
        (_p(sources="[{type: stdin, id: a}, {type: otlp, id: a}]"), v.DuplicateId),
        (_p("{type: filter, id: f, input: none, key: k}"), v.UnknownInput),
        (_p(sinks="{type: stdout, id: o, input: none}"), v.UnknownInput),
        (_p("{type: filter, id: f, input: a, key: k}", "{type: stdout, id: o, input: a}"), v.MultipleConsumers),
        (_p("{type: filter, id: f, input: g, key: k}, {type: filter, id: g, input: f, key: k}"), v.Unreachable),
        (_p(_W % ("w", "a", "soon", "k", "")), v.BadDuration),
        (_p(_W % ("w", "a", "1s", "k", ", idle_timeout: never")), v.BadDuration),
        (_p(sources="[{type: generator, id: a, interval: x}]"), v.BadDuration),
        (_p(_W % ("w", "a", "1s", "k", ", max_groups: 0")), v.InvalidWindow),
        (_p(_W % ("w", "a", "1s", "k", ", slide: 0s")), v.InvalidWindow),
        (_p(_W % ("w", "a", "1s", "k", ", slide: 2s")), v.InvalidWindow),
        (_p(_W % ("w", "a", "0s", "k", "")), v.InvalidWindow),
        (_p("{type: map, id: m, input: a, value: 1 +}"), v.BadExpression),
        (_p("{type: join, id: j, inputs: [a, b], value: a + b}"), v.InvalidJoin),
        (_p(_W % ("w", "a", "1s", "k", "") + "," + _W % ("x", "b", "2s", "k", "") + ", {type: join, id: j, inputs: [w, x], value: w}"), v.InvalidJoin),
        (_p(_W % ("w", "a", "1s", "k", "") + "," + _W % ("x", "b", "1s", "l", "") + ", {type: join, id: j, inputs: [w, x], value: w}"), v.InvalidJoin),
        (_p(_W % ("w", "a", "1s", "k", "") + "," + _W % ("x", "b", "1s", "k", "") + ", {type: join, id: j, inputs: [w, x]}", "{type: stdout, id: o, input: j}"), v.InvalidJoin),
        (_p("{type: udf, id: u, input: a, module: 'oci://x/y@sha256:0'}"), v.InvalidUdf),
        (_p("{type: wasm, id: u, input: a, module: x.py, max_memory: lots}"), v.InvalidUdf),
    ],
)
def test_validation(pipeline, error):
    with pytest.raises(error):
        v.validate(pipeline)


def test_generator_pipeline(spark):
    c = compile_pipeline(spark, ir.loads(LATENCY), records=90)
    rows = plain(c.frames["means"])
    assert {r["attrs"]["http.route"] for r in rows} == {"/in", "/out"} and {r["attrs"]["service.name"] for r in rows} == {"north"}
    counts = {m["node"]: m for m in metrics.collect(c)}
    assert counts["only"]["records.out"] == 30 and counts["only"]["records.dropped.filtered"] == 60 and counts["means"]["window.flushes"] == 5


def test_join_pipeline(spark):
    s = 10**9
    a = frame(spark, [{"ts": s, "value": 10, "attrs": {"s": "x"}}, {"ts": 5 * s, "value": 0, "attrs": {"s": "x"}}])
    b = frame(spark, [{"ts": s, "value": 3, "attrs": {"s": "x"}}, {"ts": 5 * s, "value": 0, "attrs": {"s": "x"}}])
    c = compile_pipeline(spark, ir.loads(SPREAD), {"a": a, "b": b})
    assert sorted((r["start"], r["value"], r["name"]) for r in plain(c.frames["spread"])) == [(0, 7, "diff"), (5 * s, 0, "diff")]


def test_inspect_a_join(spark):
    s = 10**9
    a, b = frame(spark, [{"ts": s, "value": 10, "attrs": {"s": "x"}}, {"ts": s, "value": 4, "attrs": {"s": "y"}}]), frame(spark, [{"ts": s, "value": 3, "attrs": {"s": "x"}}])
    c = compile_pipeline(spark, ir.loads(SPREAD), {"a": a, "b": b})
    assert inspect.render(inspect.snapshot(c, ["spread"])) == "spread (join) - 1 group(s)\n  s=y  window=[0,5000000000)  inputs={hi=4}\n"


def test_late_records_of_bounded_input_are_dropped(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    f, lines = tmp_path / "p.yaml", tmp_path / "in.jsonl"
    f.write_text("sources: [{type: stdin, id: a}]\ntransforms: [{type: window, id: w, input: a, size: 1s, aggregate: {op: sum}}]\nsinks: [{type: stdout, id: o, input: w}]")
    lines.write_text("\n".join(json.dumps({"ts_nanos": t * 10**8, "name": "m", "value": 1.0}) for t in (1, 15, 2)))
    assert cli.main(["run", str(f), "--input", f"a={lines}"]) == 0
    assert [x.rsplit(" ", 2)[1] for x in capsys.readouterr().out.splitlines()] == ["m=1.00", "m=1.00"]
    assert cli.main(["run", str(f), "--input", f"a={lines}", "--keep-late"]) == 0
    assert [x.rsplit(" ", 2)[1] for x in capsys.readouterr().out.splitlines()] == ["m=2.00", "m=1.00"]


def test_inspect(spark):
    s = 10**9
    df = frame(spark, [{"ts": s, "value": 2, "attrs": {"s": "x"}}, {"ts": 6 * s, "value": 4, "attrs": {"s": "x"}}, {"ts": 7 * s, "value": 9}])
    c = compile_pipeline(spark, _p(_W % ("w", "a", "5s", "s", ""), "{type: stdout, id: o, input: w}", "[{type: stdin, id: a}]"), {"a": df})
    nodes = inspect.snapshot(c)
    assert inspect.render(nodes) == "w (window) - 2 group(s)\n  -  window=[5000000000,10000000000)  value=9  samples=1\n  s=x  window=[5000000000,10000000000)  value=4  samples=1\n"
    assert inspect.render(inspect.snapshot(c, ["other"])) == "no stateful nodes\n"
    assert len(list(inspect.watch(lambda: nodes, pause=lambda _: None, times=3))) == 1


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    f, lines = tmp_path / "p.yaml", tmp_path / "in.jsonl"
    f.write_text(LATENCY)
    assert cli.main(["validate", str(f)]) == 0 and capsys.readouterr().out == "ok\n"
    assert cli.main(["schema"]) == 0 and '"title"' in capsys.readouterr().out
    assert cli.main(["run", str(f), "--records", "30", "--metrics"]) == 0
    out = capsys.readouterr()
    assert " wait=" in out.out and '"records.out"' in out.err
    assert cli.main(["inspect", str(f), "--records", "30"]) == 0 and "means (window)" in capsys.readouterr().out
    f.write_text("sources: [{type: stdin, id: a}]\nsinks: [{type: stdout, id: o, input: a, format: json}]")
    lines.write_text('{"ts_nanos":1,"name":"m","value":2.0}\n\nbad\n')
    assert cli.main(["run", str(f), "--input", f"a={lines}"]) == 0
    assert capsys.readouterr().out == '{"ts_nanos":1,"start_ts_nanos":null,"resource":{},"scope":null,"name":"m","value":2.0,"attrs":{}}\n'
    f.write_text("sources: []\nsinks: [{type: stdout, id: o, input: x}]")
    assert cli.main(["validate", str(f)]) == 1 and "x" in capsys.readouterr().err
