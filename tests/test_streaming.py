import json
import os

import pytest
from helpers import plain

from tallyrill import inspect
from tallyrill.operators.window import Spec
from tallyrill.plans import ir
from tallyrill.plans.compiler import compile_pipeline
from tallyrill.sources import jsonl, otlp
from tallyrill.streaming import stateful

S = 10**9


def write(folder, n, rows):
    """Files are read in the order of their times."""
    folder.mkdir(exist_ok=True)
    file = folder / f"{n:03}.jsonl"
    file.write_text("\n".join(json.dumps({"ts_nanos": t * S, "name": "m", "value": v, "attrs": {"s": k}}) for t, v, k in rows))
    os.utime(file, (1_000_000 + n, 1_000_000 + n))


def drained(df, tmp_path, name="q"):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def pipeline(*transforms, sources=("a",)):
    return ir.from_dict({"sources": [{"type": "stdin", "id": s} for s in sources], "transforms": list(transforms), "sinks": [{"type": "stdout", "id": "o", "input": transforms[-1]["id"]}]})


def win(id="w", input="a", **more):
    return {"type": "window", "id": id, "input": input, "size": "5s", "group_by": ["s"], "aggregate": {"op": "sum"}} | more


def test_window(spark, tmp_path):
    for n, rows in enumerate([[(1, 1, "x"), (2, 2, "y"), (3, 3, "x")], [(6, 5, "x")], [(12, 9, "x")]]):
        write(tmp_path / "a", n, rows)
    df = compile_pipeline(spark, pipeline(win()), {"a": jsonl.stream(spark, str(tmp_path / "a"), 1)}, stream=True).frames["w"]
    got = plain(drained(df, tmp_path, "win"))
    assert sorted((r["start"] // S, r["ts"] // S, r["attrs"]["s"], r["value"]) for r in got) == [(0, 5, "x", 4), (0, 5, "y", 2), (5, 10, "x", 5)]
    state = inspect.stream_snapshot(spark, str(tmp_path / "win"), Spec(5 * S, group_by=("s",), node="w"))
    assert [(g["window_start_nanos"] // S, g["labels"]) for g in state["groups"]] == [(10, {"s": "x"})]


def test_join_and_map(spark, tmp_path):
    for k, v in (("a", 10), ("b", 4)):
        write(tmp_path / k, 0, [(1, v, "x"), (2, v + 1, "y")])
        write(tmp_path / k, 1, [(11, 0, "x")])
    p = pipeline(win("hi", "a"), win("lo", "b"), {"type": "join", "id": "j", "inputs": ["hi", "lo"], "value": "hi - lo"}, {"type": "map", "id": "m", "input": "j", "value": "value * 2"}, sources=("a", "b"))
    df = compile_pipeline(spark, p, {k: jsonl.stream(spark, str(tmp_path / k), 1) for k in "ab"}, stream=True).frames["m"]
    assert sorted((r["attrs"]["s"], r["value"]) for r in plain(drained(df, tmp_path, "joined"))) == [("x", 12), ("y", 12)]


def test_window_over_window(spark, tmp_path):
    for n, rows in enumerate([[(1, 1, "x")], [(6, 2, "x")], [(11, 4, "x")], [(40, 0, "x")], [(41, 0, "x")]]):
        write(tmp_path / "a", n, rows)
    p = pipeline(win(), win("w2", "w", size="10s"))
    df = compile_pipeline(spark, p, {"a": jsonl.stream(spark, str(tmp_path / "a"), 1)}, stream=True).frames["w2"]
    got = sorted((r["start"] // S, r["value"]) for r in plain(drained(df, tmp_path, "over")))
    assert got == [(0, 1), (10, 6)]


def test_three_windows(spark, tmp_path):
    for n, rows in enumerate([[(1, 1, "x")], [(6, 2, "x")], [(11, 4, "x")], [(16, 8, "x")], [(90, 0, "x")], [(91, 0, "x")]]):
        write(tmp_path / "a", n, rows)
    p = pipeline(win(), win("w2", "w", size="10s"), win("w3", "w2", size="20s"))
    df = compile_pipeline(spark, p, {"a": jsonl.stream(spark, str(tmp_path / "a"), 1)}, stream=True).frames["w3"]
    # ends at 5, 10, 15 and 20; then at 10, 20 and 30; then in windows from 0, 20
    assert sorted((r["start"] // S, r["value"]) for r in plain(drained(df, tmp_path, "thrice"))) == [(0, 1), (20, 14)]


def test_exact_cap(spark, tmp_path):
    write(tmp_path / "a", 0, [(1, 1, k) for k in "xyzx"])
    write(tmp_path / "a", 1, [(6, 1, "x")])
    df = compile_pipeline(spark, pipeline(win(max_groups=2)), {"a": jsonl.stream(spark, str(tmp_path / "a"), 1)}, stream=True).frames["w"]
    assert sorted((r["attrs"]["s"], r["value"]) for r in plain(drained(df, tmp_path, "cap"))) == [("x", 2), ("y", 1)]


def test_idle_flush(spark, tmp_path):
    import time

    write(tmp_path / "a", 0, [(1, 1, "x"), (1, 4, "x")])
    df = compile_pipeline(spark, pipeline(win(size="1h", idle_timeout="1s")), {"a": jsonl.stream(spark, str(tmp_path / "a"))}, stream=True).frames["w"]
    q = df.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "idle")).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and not spark.table("idle").count():
            time.sleep(0.3)
        assert [r["value"] for r in plain(spark.table("idle"))] == [5]
    finally:
        q.stop()


def test_counters(spark, tmp_path):
    folder = tmp_path / "a"
    folder.mkdir()
    for n, v in enumerate((100, 175, 20)):
        body = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m", "sum": {"aggregationTemporality": 2, "isMonotonic": True, "dataPoints": [{"timeUnixNano": str(n), "asDouble": v}]}}, {"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": str(n), "asDouble": 1}]}}]}]}]}
        (folder / f"{n}.txt").write_text(json.dumps(body))
        os.utime(folder / f"{n}.txt", (1_000_000 + n, 1_000_000 + n))
    df = stateful.deltas(otlp.stream(spark, str(folder), 1))
    assert sorted((r["name"], r["value"]) for r in plain(drained(df, tmp_path, "deltas"))) == [("g", 1), ("g", 1), ("g", 1), ("m", 20), ("m", 75)]


def test_counters_in_a_pipeline(spark, tmp_path):
    folder = tmp_path / "a"
    folder.mkdir()

    def point(t, v, s):
        return {"dataPoints": [{"timeUnixNano": str(t * S), "asDouble": v, "attributes": [{"key": "s", "value": {"stringValue": s}}]}]}

    for n, (t, v) in enumerate([(1, 100), (2, 175), (3, 20), (4, 50)]):
        lines = [{"name": "m", "sum": point(t, v, "x") | {"aggregationTemporality": 2, "isMonotonic": True}}, {"name": "g", "gauge": point(90 if n == 3 else t, 1, "y")}]
        file = folder / f"{9 - n}.txt"  # the last to arrive has the least name
        file.write_text("\n".join(json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [x]}]}]}) for x in lines))
        os.utime(file, (1_000_000 + n, 1_000_000 + n))
    p = ir.from_dict({"sources": [{"type": "otlp", "id": "a"}], "transforms": [win()], "sinks": [{"type": "stdout", "id": "o", "input": "w"}]})
    df = compile_pipeline(spark, p, {"a": str(folder)}, stream=True).frames["w"]
    got = plain(drained(df, tmp_path, "counted"))
    assert sorted((r["start"] // S, r["attrs"]["s"], r["value"]) for r in got) == [(0, "x", 75 + 20 + 30), (0, "y", 3)]


def test_cap_of_a_join(spark, tmp_path):
    for k, v in (("a", 10), ("b", 4)):
        write(tmp_path / k, 0, [(1, v, s) for s in "xyz"])
        write(tmp_path / k, 1, [(11, 0, "x")])
    p = pipeline(win("hi", "a"), win("lo", "b"), {"type": "join", "id": "j", "inputs": ["hi", "lo"], "value": "hi - lo", "max_groups": 2}, sources=("a", "b"))
    df = compile_pipeline(spark, p, {k: jsonl.stream(spark, str(tmp_path / k), 1) for k in "ab"}, stream=True).frames["j"]
    got = plain(drained(df, tmp_path, "capped_join"))
    assert [r["value"] for r in got] == [6, 6] and len({r["attrs"]["s"] for r in got}) == 2


def test_join_of_capped_windows(spark, tmp_path):
    for k, v in (("a", 10), ("b", 4)):
        write(tmp_path / k, 0, [(1, v, s) for s in "xyz"])
        write(tmp_path / k, 1, [(11, 0, "x")])
    p = pipeline(win("hi", "a", max_groups=2), win("lo", "b"), {"type": "join", "id": "j", "inputs": ["hi", "lo"], "value": "hi - lo"}, sources=("a", "b"))
    df = compile_pipeline(spark, p, {k: jsonl.stream(spark, str(tmp_path / k), 1) for k in "ab"}, stream=True).frames["j"]
    assert [r["value"] for r in plain(drained(df, tmp_path, "capped_windows"))] == [6, 6]


def test_open_groups_of_a_join():
    """Groups are there from the first value to the last, count for the cap, and go when all inputs are beyond them."""
    j = stateful.JoinState(2, 2)
    assert [j.value(0, 0, 5, k, 1.0) for k in "xyz"] == [None] * 3 and j.capped == 1
    assert j.value(1, 0, 5, "x", 2.0) == (0, 5, "x", [1.0, 2.0]) and list(j.open) == [(0, 5, "y")]
    assert [j.value(n, 5, 10, "x", 2.0) for n in (0, 1)] == [None, (5, 10, "x", [2.0, 2.0])] and j.open == {} and j.incomplete == 1
    j = stateful.JoinState(2, 2)
    assert j.value(0, 0, 5, "x", 1.0) is None and j.value(0, 0, 5, "x", 3.0) is None  # the last counts
    again = stateful.JoinState(2, 2)
    again.load(j.dump())
    assert again.value(1, 0, 5, "x", 2.0) == (0, 5, "x", [3.0, 2.0])
    again.value(0, 5, 10, "y", 1.0)
    again.value(1, 10, 15, "y", 1.0)
    assert again.incomplete == 0 and [p[0] for p in again.open] == [5, 10]


@pytest.mark.parametrize("more", [{}, {"max_groups": 2}])
def test_a_drained_stream_gives_the_rows_of_bounded_input(spark, tmp_path, capsys, monkeypatch, more):
    from tallyrill import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    for k in "ab":
        for n, rows in enumerate([[(1, 1, "x"), (2, 2, "y")], [(6, 5, "x"), (7, 1, "z"), (8, 1, "y")], [(12, 9, "x")]]):
            write(tmp_path / k, n, [(t, v * (3 if k == "a" else 1), s) for t, v, s in rows])
    p = pipeline({"type": "filter", "id": "f", "input": "a", "key": "s"}, win("hi", "f", **more), win("lo", "b", **more), {"type": "join", "id": "j", "inputs": ["hi", "lo"], "value": "hi - lo"}, sources=("a", "b"))
    file = tmp_path / "p.json"
    file.write_text(json.dumps(ir.to_dict(p)))
    args = ["run", str(file), *(x for k in "ab" for x in ("--input", f"{k}={tmp_path / k}"))]
    assert cli.main(args) == 0
    want = sorted(capsys.readouterr().out.splitlines())
    assert cli.main([*args, "--stream", "--drain", "--checkpoint", str(tmp_path / "state")]) == 0
    assert sorted(capsys.readouterr().out.splitlines()) == want and len(want) == (5 if more else 6)


def test_inspect_a_stream(spark, tmp_path, capsys, monkeypatch):
    from tallyrill import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    write(tmp_path / "a", 0, [(1, 1, "x"), (2, 2, "y")])
    p = pipeline(win(), {"type": "map", "id": "m", "input": "w", "value": "value * 2"})
    df = compile_pipeline(spark, p, {"a": jsonl.stream(spark, str(tmp_path / "a"), 1)}, stream=True).frames["m"]
    drained(df, tmp_path, "o")
    (tmp_path / "p.json").write_text(json.dumps(ir.to_dict(p)))
    assert cli.main(["inspect", str(tmp_path / "p.json"), "--checkpoint", str(tmp_path), "--sink", "o", "--watch", "--times", "2"]) == 0
    out = capsys.readouterr().out
    assert "w (window) - 2 group(s)" in out and out.count("s=x") == 1


def test_sub_microsecond_windows_are_refused(spark, tmp_path):
    (tmp_path / "a").mkdir()
    with pytest.raises(ValueError, match="microseconds"):
        compile_pipeline(spark, pipeline(win(size="5ns")), {"a": jsonl.stream(spark, str(tmp_path / "a"))}, stream=True)
