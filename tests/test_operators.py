import random

import pytest
from helpers import frame, plain, values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyrill.operators import filter as filter_
from tallyrill.operators import join, normalize, udf, window
from tallyrill.operators.window import Spec
from tallyrill.streaming.stateful import WindowState


def test_filter(spark):
    df = frame(spark, [{"value": 1, "attrs": {"code": 200}}, {"value": 2, "attrs": {"code": "200"}}, {"value": 3, "attrs": {"code": 200.0}}, {"value": 4, "resource": {"code": 200}}, {"value": 5, "attrs": {"code": 404}}, {"value": 6}, {"value": 7, "attrs": {"code": 1}, "resource": {"code": 200}}])
    assert values(filter_.apply(df, "code", "200")) == [1, 2, 3, 4]
    assert values(filter_.apply(df, "code")) == [1, 2, 3, 4, 5, 7]
    assert filter_.dropped(df, "code", "200")["filtered"].count() == 3
    assert values(filter_.apply(frame(spark, [{"value": 1, "attrs": {"ok": True}}]), "ok", "true")) == [1]


@pytest.mark.parametrize(("op", "value"), [("count", 3), ("sum", 15), ("min", 2), ("max", 9), ("avg", 5)])
def test_aggregates(spark, op, value):
    df = frame(spark, [{"ts": 1, "value": v} for v in (2, 4, 9)])
    assert plain(window.apply(df, Spec(1000, op=op))) == [{"ts": 1000, "start": 0, "name": "m", "value": value, "attrs": {}}]


def test_not_a_number(spark):
    df = frame(spark, [{"value": 1}, {"value": float("nan")}, {"value": 3}])
    assert values(window.apply(df, Spec(10, op="max"))) == [3]
    assert values(window.apply(df, Spec(10, op="min"))) == [1]
    alone = frame(spark, [{"value": float("nan")}])
    assert values(window.apply(alone, Spec(10, op="max"))) == [float("-inf")]


def test_keys_keep_their_types(spark):
    df = frame(spark, [{"attrs": {"k": 1}}, {"attrs": {"k": "1"}}, {"attrs": {"k": 1.0}}, {}, {"resource": {"k": 1}}])
    got = {str(r["attrs"].get("k")) + type(r["attrs"].get("k")).__name__: r["value"] for r in plain(window.apply(df, Spec(10, group_by=("k",))))}
    assert got == {"1int": 2, "1str": 1, "1.0float": 1, "NoneNoneType": 1}


def test_fields(spark):
    df = frame(spark, [{"attrs": {"lat": 2.5}}, {"attrs": {"lat": 3}}, {"attrs": {"lat": "x"}}, {}])
    assert values(window.apply(df, Spec(10, op="sum", field="lat"))) == [5.5]
    assert values(window.apply(df, Spec(10, op="count", field="none"))) == []
    with pytest.raises(Exception, match="invalid"):
        window.apply(df, Spec(10, op="sum", field="lat", on_invalid="error")).collect()
    with pytest.raises(Exception, match="missing"):
        window.apply(df, Spec(10, op="sum", field="lat", on_missing="error")).collect()


def test_lateness(spark):
    df = frame(spark, [{"ts": t, "value": 1} for t in (100, 1500, 200)])
    assert [(r["start"], r["value"]) for r in sorted(plain(window.apply(df, Spec(1000), exact=True)), key=lambda r: r["start"])] == [(0, 1), (1000, 1)]
    assert window.dropped(df, Spec(1000))["late"].count() == 1
    df = frame(spark, [{"ts": t, "value": 1} for t in (100, 200, 1200, 300, 1500)])
    assert [(r["start"], r["value"]) for r in sorted(plain(window.apply(df, Spec(1000, lateness=500), exact=True)), key=lambda r: r["start"])] == [(0, 3), (1000, 2)]


def test_sliding(spark):
    got = plain(window.apply(frame(spark, [{"ts": 700}]), Spec(1000, slide=500)))
    assert sorted((r["start"], r["ts"], r["value"]) for r in got) == [(0, 1000, 1), (500, 1500, 1)]
    assert [r["start"] for r in plain(window.apply(frame(spark, [{"ts": 100}]), Spec(1000, slide=500)))] == [0]


def test_max_groups(spark):
    df = frame(spark, [{"ts": 1, "attrs": {"svc": s}} for s in "abca"])
    spec = Spec(1000, group_by=("svc",), max_groups=2)
    assert {r["attrs"]["svc"]: r["value"] for r in plain(window.apply(df, spec))} == {"a": 2, "b": 1}
    assert window.dropped(df, spec)["capped"].count() == 1


def test_names(spark):
    df = frame(spark, [{"ts": 1, "name": "first"}, {"ts": 0, "name": "second"}])
    assert plain(window.apply(df, Spec(10)))[0]["name"] == "first"
    assert plain(window.apply(df, Spec(10, name="given")))[0]["name"] == "given"


def test_window_over_window(spark):
    df = frame(spark, [{"ts": t, "value": 1} for t in (1, 6, 11)])
    inner = window.apply(df, Spec(5, op="sum"))
    assert sorted((r["start"], r["value"]) for r in plain(window.apply(inner, Spec(10, op="sum")))) == [(0, 1), (10, 2)]


def simulated(rows, spec):
    state, out = WindowState(spec), []
    for ts, k, v in rows:
        out += state.record(ts, k, "m", v)
    out += state.fire(None)
    totals = {}
    for s, value, n, _, key in out:
        totals[s, key] = (value, n)
    return totals, state


@given(st.integers(0, 10_000))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_exact_windows_equal_a_record_by_record_run(spark, seed):
    r = random.Random(seed)
    size = r.choice([5, 8, 10])
    spec = Spec(size, slide=r.choice([None, 3, size // 2]), lateness=r.choice([0, 4, 9]), group_by=("k",), op="sum", max_groups=r.choice([None, 1, 2]))
    rows = [(max(0, i // 2 + r.randint(-8, 8)), r.choice("abcd"), None if r.random() < 0.1 else float(r.randint(1, 9))) for i in range(80)]
    df = frame(spark, [{"ts": t, "attrs": {"k": k} | ({"x": v} if v is not None else {})} for t, k, v in rows])
    spec = Spec(**(spec.__dict__ | {"field": "x"}))
    want, state = simulated(rows, spec)
    got = {(x["start"], x["attrs"]["k"]): x["value"] for x in plain(window.apply(df, spec, exact=True))}
    assert got == {k: v for k, (v, _) in want.items()}
    dropped = {k: d.count() for k, d in window.dropped(df, spec).items()}
    assert dropped == {"invalid": state.invalid, "late": state.late} | ({"capped": state.capped} if spec.max_groups else {})


@pytest.mark.parametrize("ranges", [2, 7, 100, 4096])
def test_ranges_of_arrival(spark, monkeypatch, ranges):
    monkeypatch.setattr(window, "LEAST_RANGES", ranges)
    monkeypatch.setattr(window, "MOST_RANGES", ranges)
    r = random.Random(ranges)
    rows = [(r.randint(0, 500), r.choice("ab"), 1.0) for _ in range(300)]
    spec = Spec(20, lateness=30, group_by=("k",), op="sum")
    df = frame(spark, [{"ts": t, "attrs": {"k": k}, "value": v} for t, k, v in rows])
    want, state = simulated(rows, spec)
    assert {(x["start"], x["attrs"]["k"]): x["value"] for x in plain(window.apply(df, spec, exact=True))} == {k: v for k, (v, _) in want.items()}
    assert state.late


def rollups(spark, rows):
    return frame(spark, [{"start": s, "ts": e, "value": v, "attrs": {"service.name": k}} for s, e, k, v in rows])


def test_join(spark):
    a, b = rollups(spark, [(0, 60, "x", 214)]), rollups(spark, [(0, 60, "x", 190)])
    assert plain(join.apply({"a": a, "b": b}, ["service.name"], "a - b", node="j")) == [{"ts": 60, "start": 0, "name": "j", "value": 24, "attrs": {"service.name": "x"}}]
    aligned = plain(join.apply({"a": a, "b": b}, ["service.name"], name="n"))[0]
    assert aligned["attrs"] == {"service.name": "x", "a": 214.0, "b": 190.0} and aligned["value"] == 0 and aligned["name"] == "n"
    assert plain(join.apply({"a": a, "b": b}, ["service.name"], "a - c")) == []
    assert join.dropped({"a": a, "b": b}, ["service.name"], "a / (b - b)")["invalid"].count() == 1


def test_join_aligns(spark):
    a, b = rollups(spark, [(0, 60, "x", 1), (60, 120, "x", 3), (60, 120, "y", 4)]), rollups(spark, [(60, 120, "x", 2), (60, 120, "y", 5)])
    assert sorted((r["start"], r["value"]) for r in plain(join.apply({"a": a, "b": b}, ["service.name"], "a + b"))) == [(60, 5), (60, 9)]
    assert join.dropped({"a": a, "b": b}, ["service.name"], "a + b")["incomplete"].count() == 1
    capped = rollups(spark, [(0, 60, k, 1) for k in ("s1", "s2", "s3")])
    assert join.dropped({"a": capped, "b": capped}, ["service.name"], "a", 2)["capped"].count() == 1


def counters(spark, rows, monotonic=True):
    from pyspark.sql import functions as F

    df = frame(spark, [{"ts": i, "value": v, "attrs": {"s": k}} for i, (k, v) in enumerate(rows)])
    return df.withColumns({"_cumulative": F.lit(True), "_monotonic": F.lit(monotonic)})


def test_deltas(spark):
    deltas = lambda rows, m=True: [r["value"] for r in sorted(plain(normalize.apply(counters(spark, rows, m))), key=lambda r: r["ts"])]
    assert deltas([("x", 10), ("x", 30), ("x", 60)]) == [20, 30]
    assert deltas([("x", 200), ("x", 250), ("x", 5), ("x", 12)]) == [50, 5, 7]
    assert deltas([("x", 10), ("x", 7)], False) == [-3]
    assert deltas([("x", 1), ("y", 100), ("x", 3), ("y", 110), (1, 5)]) == [2, 10]


SOURCE = """
ABI_VERSION = {version}
def transform(record):
    if record["name"] == "loop":
        while True: pass
    if record["name"] == "bad":
        raise ValueError("bad")
    return [] if record["value"] < 0 else [record | {{"value": record["value"] * 2}}] * int(record["attrs"].get("times", 1))
"""


def test_udf(spark, tmp_path):
    f = tmp_path / "double.py"
    f.write_text(SOURCE.format(version=1))
    df = frame(spark, [{"value": 21, "attrs": {"times": 2, "ok": True, "x": 1.5}}, {"value": -1}, {"name": "bad"}, {"name": "loop"}, {"value": 1, "start": 3}])
    out = sorted(plain(udf.apply(df, str(f))), key=lambda r: -r["value"])
    assert [(r["value"], r["attrs"]) for r in out] == [(42, {"times": 2, "ok": True, "x": 1.5})] * 2 + [(2, {})]
    assert udf.dropped(df, str(f))["invalid"].count() == 2
    with pytest.raises(Exception, match="bad"):
        udf.apply(df, f"file://{f}", on_error="error").collect()
    with pytest.raises(udf.UdfError):
        udf.apply(df, str(f), sha256="0" * 64)
    f.write_text(SOURCE.format(version=2))
    with pytest.raises(udf.UdfError, match="version"):
        udf.check(str(f))


WIDE = """
def transform(record):
    n = record["attrs"]["n"]
    return [record | {"value": n, "attrs": {"n": n, "wide": 1 << (62 + n)}, "resource": {"r": n > 0, "s": "x", "f": 0.5}}, record | {"attrs": {}}]
"""


def test_udf_keeps_order_and_counts_drops(spark, tmp_path):
    f = tmp_path / "wide.py"
    f.write_text(WIDE)
    df = frame(spark, [{"ts": i, "attrs": {"n": i % 3}, "scope": "s"} for i in range(30)])
    out = udf.apply(df, str(f))
    assert sorted(r[0] for r in out.select("_seq").collect()) == sorted([i for i in range(30) if i % 3 == 0] * 2)  # wider than 64 bits otherwise
    first = out.where("size(attrs) > 0").first()
    assert first["attrs"]["wide"]["i"] == 1 << 62 and first["resource"]["r"]["b"] is False and first["resource"]["f"]["d"] == 0.5 and first["scope"] == "s"
    assert udf.dropped(df, str(f))["invalid"].count() == 20
    with pytest.raises(Exception, match="64 bits"):
        udf.apply(df, str(f), on_error="error").collect()


def test_capped_window_after_a_udf(spark, tmp_path):
    f = tmp_path / "same.py"
    f.write_text("def transform(record):\n    return [record]\n")
    df = frame(spark, [{"ts": 1, "attrs": {"svc": s}} for s in "abcdea"])
    spec = Spec(1000, group_by=("svc",), max_groups=2)
    assert {r["attrs"]["svc"]: r["value"] for r in plain(window.apply(udf.apply(df, str(f)), spec))} == {"a": 2, "b": 1}
    with pytest.raises(ValueError, match="order of arrival"):
        window.apply(df.drop("_seq"), spec)


def test_empty_input(spark):
    df = frame(spark, [])
    assert plain(window.apply(df, Spec(10, max_groups=1))) == []
    assert plain(filter_.apply(df, "x")) == []
    assert plain(join.apply({"a": df, "b": df}, ["k"], "a + b")) == []
