import math

import pytest
from helpers import frame, plain
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrill.functions import expr
from tallyrill.functions.record import display_double
from tallyrill.operators import map as map_


def evaluate(node, env):
    """The same language over Python floats."""
    if isinstance(node, expr.Literal):
        return node.number
    if isinstance(node, expr.Name):
        return env[node.name]
    if isinstance(node, expr.Negate):
        return -evaluate(node.of, env)
    a, b = evaluate(node.left, env), evaluate(node.right, env)
    if node.op == "/":
        return a / b if b else math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)
    if node.op == "%":
        return math.fmod(a, b) if b and not math.isinf(a) else math.nan
    if node.op == "^":
        try:
            r = math.pow(a, b)
        except OverflowError:
            r = math.inf
        except ValueError:
            r = math.nan if a else math.inf
        return r
    return {"+": a + b, "-": a - b, "*": a * b}[node.op]


@pytest.mark.parametrize(("text", "value"), [("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("10 - 2 - 3", 5), ("2 ^ 3 ^ 2", 512), ("10 % 3", 1), ("-2 ^ 2", -4), ("-2 * 3", -6), ("value / 1000", 0.1), ("errors / total", 0.25), ("value - errors", 97), ("http.errors.2xx + 1", 6)])
def test_values(spark, text, value):
    df = frame(spark, [{"value": 100, "attrs": {"errors": 3, "total": 12, "http.errors.2xx": 5}}])
    assert plain(map_.apply(df, text))[0]["value"] == pytest.approx(value)


@pytest.mark.parametrize("text", ["", "1 +", "1 + + 2", "(1 + 2", "value $ 2", "1 2", ".5", "1e5", "1.", ")", "a b"])
def test_rejected(text):
    with pytest.raises(expr.ExpressionError):
        expr.parse(text)


def test_limits():
    with pytest.raises(expr.ExpressionError, match="nested"):
        expr.parse("(" * 80 + "1" + ")" * 80)
    with pytest.raises(expr.ExpressionError, match="tokens"):
        expr.parse("+".join(["1"] * 600))


@given(st.text(alphabet="0123456789.+-*/%^() abx_", max_size=40))
@settings(max_examples=300, deadline=None)
def test_parser_never_breaks(text):
    try:
        expr.parse(text)
    except expr.ExpressionError:
        pass


@pytest.mark.parametrize("text", ["/".join(["a", "b"] * 256), "+".join(["a", "b"] * 256), "a - " * 300 + "b % a / b", "a ^ " * 60 + "b", "a ^ -" * 30 + "b", "a / (" * 30 + "b" + " + b / a)" * 30, "((a / b) % 3 + " * 30 + "b" + ")" * 30, "-" * 60 + "a", "(" * 60 + "a" + ")" * 60, "a * (b / a ^ (a - b)) ^ (b / (a / b))"])
def test_long_expressions_are_planned(spark, text):
    """As long and as deep as the language allows; plans grow as the text does."""
    import time

    rows = [{"value": 1, "attrs": {"a": 1.25, "b": 0.5}}, {"value": 1, "attrs": {"a": 1.0, "b": 2.0}}]
    df = frame(spark, rows)
    began = time.time()
    out = map_.apply(df, text)
    size = len(out._jdf.queryExecution().optimizedPlan().toString())
    took = time.time() - began
    assert took < 10 and size < 400_000
    want = [v for r in rows if math.isfinite(v := evaluate(expr.parse(text), r["attrs"]))]
    assert sorted(r["value"] for r in plain(out)) == pytest.approx(sorted(want))


def test_ieee_arithmetic(spark):
    numbers = [0.0, -0.0, 1.0, -1.0, 2.5, 1e308]
    texts = ["(a + b) / (a - b)", "(a / b) / (b / a)", "(a / b) ^ (b / a)", "(0 - a) ^ (1 / b)", "a / b / a / b / a / b / a / b", "a * b % a * b % 3 / a * b", "1 / (a / b)", "a % b", "1 / (1 / (a ^ b))", "1 ^ (a / b)", "(0 - 1) ^ (a / 0)", "-a / b"]
    rows = [{"value": 1, "attrs": {"a": a, "b": b}} for a in numbers for b in numbers]
    for text in texts:
        node = expr.parse(text)
        got = [r["value"] for r in plain(map_.apply(frame(spark, rows), text))]
        want = [v for r in rows if math.isfinite(v := evaluate(node, r["attrs"]))]
        assert sorted(got) == pytest.approx(sorted(want)), text


def test_zero_over_zero_has_no_finite_result(spark):
    """An infinity on the way is fine, 0 / 0 isn't: its record goes (F1 of round 2)."""
    rows = [{"value": v, "attrs": {"k": 7}} for v in (0.0, -0.0, 2.0, -2.0)]
    assert [r["value"] for r in plain(map_.apply(frame(spark, rows), "1 / (value / 0) + k"))] == [7.0, 7.0]
    assert map_.dropped(frame(spark, rows), "1 / (value / 0) + k")["invalid"].count() == 2


def test_faults(spark):
    rows = [{"value": 1, "attrs": {"n": 2}}, {"value": 1}, {"value": 1, "attrs": {"n": "2"}}, {"value": 1, "attrs": {"n": True}}, {"value": 1, "resource": {"n": 4}}]
    df = frame(spark, rows)
    assert [r["value"] for r in plain(map_.apply(df, "value / n"))] == [0.5, 0.25]
    assert map_.dropped(df, "value / n")["invalid"].count() == 3
    with pytest.raises(Exception, match="missing"):
        map_.apply(df, "value / n", on_missing="error").select("value").collect()
    with pytest.raises(Exception, match="invalid"):
        map_.apply(frame(spark, rows[:1] + rows[2:3]), "value / n", on_invalid="error").select("ts_nanos", "value").collect()
    assert [r["name"] for r in plain(map_.apply(df, "value", name="new"))] == ["new"] * 5


@pytest.mark.parametrize(("d", "text"), [(200.0, "200"), (0.1, "0.1"), (1e21, "1" + "0" * 21), (1e-7, "0.0000001"), (-1.5, "-1.5"), (12345678.9, "12345678.9"), (1.5e-5, "0.000015"), (123456789.0, "123456789"), (float("inf"), "inf"), (float("nan"), "NaN"), (0.0, "0"), (1.25e10, "12500000000")])
def test_display(spark, d, text):
    assert spark.range(1).select(display_double(F.lit(d))).first()[0] == text
