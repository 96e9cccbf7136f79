"""All registered queries of the engine's own operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions.record import display, lookup
from .operators import normalize, udf, window
from .plans.compiler import compile_pipeline, window_spec
from .plans import ir
from .sources import generator, otlp, tables

DAY, HOUR = 86_400_000_000_000, 3_600_000_000_000
Query = Callable[[SparkSession, str], DataFrame]

_REC = """rec as (select event_id, epoch_us(ts) * 1000 as t, event_type, user_id, 'b' || (user_id % 5) as bucket, json_extract(props, '$.k')::bigint as k,
  value as v, (event_id + (event_id * 7919) % 37) * 100000000000 + event_id as seq from events)"""
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _pipeline(*transforms: dict, sources: tuple[str, ...] = ("in",)) -> ir.Pipeline:
    used = {i for t in transforms for i in (t.get("inputs") or [t["input"]])}
    last = [t["id"] for t in transforms if t["id"] not in used]
    return ir.from_dict({"sources": [{"type": "stdin", "id": s} for s in sources], "transforms": list(transforms), "sinks": [{"type": "stdout", "id": f"out{i}", "input": x} for i, x in enumerate(last)]})


def _run(spark: SparkSession, sf_dir: str, *transforms: dict, exact: bool | None = None, sources: tuple[str, ...] = ("in",)) -> DataFrame:
    p = _pipeline(*transforms, sources=sources)
    compiled = compile_pipeline(spark, p, dict.fromkeys(sources, lambda keys: tables.events(spark, sf_dir, keys)), exact=exact)
    return compiled.frames[p.sinks[0].input]


def _text(key: str) -> Column:
    return display(lookup(key)).alias(key)


def _rows(df: DataFrame) -> DataFrame:
    # values have two decimals and are divided by small numbers: at ten digits no value lies half-way
    return df.select(F.col("ts_nanos").alias("t"), "name", F.round("value", 10).alias("v"), _text("user_id"), _text("bucket"))


def _windows(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(F.col("start_ts_nanos").alias("s"), F.col("ts_nanos").alias("e"), *map(_text, keys), F.round("value", 6).alias("v"))


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _filters() -> None:
    out = "select t, event_type as name, round(v, 10) as v, user_id::varchar as user_id, bucket from rec"
    for name, given, where in (
        ("filter_exists", {"key": "k"}, "k is not null"),
        ("filter_equals", {"key": "event_type", "equals": "purchase"}, "event_type = 'purchase'"),
        ("filter_equals_int", {"key": "user_id", "equals": "42"}, "user_id = 42"),
        ("filter_absent", {"key": "no.such"}, "false"),
    ):
        _add(name, lambda s, d, g=given: _rows(_run(s, d, {"type": "filter", "id": "f", "input": "in"} | g)), f"with {_REC} {out} where {where}")


def _maps() -> None:
    for name, value, sql, where in (
        ("map_scale", "value / 1000 * 3", "v / 1000 * 3", "true"),
        ("map_ratio", "value / user_id", "v / user_id", "user_id <> 0"),
        ("map_precedence", "-k ^ 2 + 2 ^ 3 ^ 2 * 2 - (value - 1) % 7", "-(k ^ 2) + 512.0 * 2 - (v - 1) % 7", "k is not null"),
        ("map_div_zero_dropped", "value / (k % 3)", "v / (k % 3)", "k % 3 <> 0"),
        ("map_finite_through_infinity", "1 / (value / 0) + k", "k", "k is not null"),
        ("map_mod_pow", "k % 7 ^ 1 - (k + 0.5) ^ 2 / 10", "k % 7 - power(k + 0.5, 2) / 10", "k is not null"),
        ("map_missing_skipped", "value + no.such", "v", "false"),
        ("map_text_invalid", "value + bucket", "v", "false"),
    ):
        query = lambda s, d, e=value: _rows(_run(s, d, {"type": "map", "id": "m", "input": "in", "value": e}))
        _add(name, query, f"with {_REC} select t, event_type as name, round(({sql})::double, 10) as v, user_id::varchar as user_id, bucket from rec where {where}")
    renamed = lambda s, d: _rows(_run(s, d, {"type": "map", "id": "m", "input": "in", "value": "value", "name": "renamed"}))
    _add("map_rename", renamed, f"with {_REC} select t, 'renamed' as name, round(v, 10) as v, user_id::varchar as user_id, bucket from rec")


def _win(op: str = "avg", field: str | None = None, **more) -> dict:
    return {"type": "window", "id": "w", "input": "in", "size": "1d", "group_by": ["event_type", "bucket"], "aggregate": {"op": op} | ({"field": field} if field else {})} | more


_AGGREGATES = {"count": "count({0})::double", "sum": "sum({0})", "min": "min({0})", "max": "max({0})", "avg": "avg({0})"}


def _group(op: str, starts: str = f"t - t % {DAY}", size: int = DAY, keys: str = "event_type, bucket", x: str = "v", where: str = "true") -> str:
    keys_ = f"{keys}, " if keys else ""
    return (
        f"with {_REC}, x as (select *, {starts} as s from rec) select s, s + {size} as e, {keys_}round(({_AGGREGATES[op].format(x)})::double, 6) as v from x "
        f"where s >= 0 and s + {size} > t and {where} group by s{', ' + keys if keys else ''}"
    )


def _tumbling() -> None:
    keys = ("event_type", "bucket")
    for op in ir.OPS:
        _add(f"win_tumbling_{op}", lambda s, d, op=op: _windows(_run(s, d, _win(op)), *keys), _group(op))
    _add("win_global", lambda s, d: _windows(_run(s, d, _win("sum", group_by=[]))), _group("sum", keys=""))
    _add("win_int_field", lambda s, d: _windows(_run(s, d, _win("sum", "k")), *keys), _group("sum", x="k", where="k is not null"))
    _add("win_missing_skip", lambda s, d: _windows(_run(s, d, _win("count", "no.such")), *keys), _group("count", where="false"))
    _add("win_invalid_skip", lambda s, d: _windows(_run(s, d, _win("count", "bucket")), *keys), _group("count", where="false"))
    _add(
        "win_missing_key",
        lambda s, d: _windows(_run(s, d, _win("count", group_by=["event_type", "no.such"])), "event_type", "no.such").withColumnRenamed("no.such", "absent"),
        _group("count", keys="event_type").replace("select s, s", "select null::varchar as absent, s, s", 1),
    )
    flagship = lambda s, d: _windows(_run(s, d, {"type": "filter", "id": "f", "input": "in", "key": "event_type", "equals": "purchase"}, _win("avg", "value", input="f")), *keys)
    _add("flagship", flagship, _group("avg", where="event_type = 'purchase'"))


def _sliding() -> None:
    for name, size, slide in (("win_sliding", 24, 6), ("win_sliding_nondivisor", 10, 4)):
        starts = f"unnest(range(t - t % {slide * HOUR} - {-(-size // slide) - 1} * {slide * HOUR}::bigint, t - t % {slide * HOUR} + 1, {slide * HOUR}::bigint))"
        query = lambda s, d, a=size, b=slide: _windows(_run(s, d, _win("sum", size=f"{a}h", slide=f"{b}h")), "event_type", "bucket")
        _add(name, query, _group("sum", starts, size * HOUR))


def _exact_sql(size: int, slide: int, late: int, cap: int | None, select: str) -> str:
    n = -(-size // slide)
    return f"""with {_REC}, r as (select *, greatest(0, coalesce(max(t) over (order by seq rows between unbounded preceding and 1 preceding), 0) - {late}) as wm from rec),
      e as (select *, unnest(range(t - t % {slide} - {n - 1} * {slide}::bigint, t - t % {slide} + 1, {slide}::bigint)) as s from r),
      held as (select * from e where s >= 0 and s + {size} > t), live as (select * from held where s + {size} > wm),
      f as (select *, min(seq) over (partition by s, bucket) as first from live),
      adm as (select * from (select *, dense_rank() over (partition by s order by first) as rk from f) where rk <= {cap or 10**9})
      {select}"""


def _exact() -> None:
    size, slide = HOUR, HOUR // 2
    rows = f"select s, s + {size} as e, bucket, round(sum(v), 6) as v from adm group by s, bucket"

    def query(s: SparkSession, d: str, **more) -> DataFrame:
        return _windows(_run(s, d, _win("sum", group_by=["bucket"], size="1h", **more), exact=True), "bucket")

    _add("win_late_drop", query, _exact_sql(size, size, 0, None, rows))
    _add("win_allowed_lateness", lambda s, d: query(s, d, allowed_lateness="2h"), _exact_sql(size, size, 2 * HOUR, None, rows))
    _add("win_sliding_late", lambda s, d: query(s, d, slide="30m", allowed_lateness="10m"), _exact_sql(size, slide, HOUR // 6, None, rows))
    _add("win_max_groups", lambda s, d: query(s, d, max_groups=2, allowed_lateness="1d"), _exact_sql(size, size, DAY, 2, rows))

    def dropped(reason: str) -> Query:
        def counted(s: SparkSession, d: str) -> DataFrame:
            t = _win("sum", group_by=["bucket"], size="1h", max_groups=2)
            spec = window_spec(_pipeline(t).transforms[0])
            return window.dropped(tables.events(s, d), spec)[reason].agg(F.count(F.lit(1)).alias("n"))

        return counted

    _add("win_late_count", dropped("late"), _exact_sql(size, size, 0, 2, "select count(*) as n from rec where seq not in (select seq from live)"))
    _add("win_capped_count", dropped("capped"), _exact_sql(size, size, 0, 2, "select count(distinct seq) as n from live where seq not in (select seq from adm)"))


def _names() -> None:
    t = _win("count", group_by=["bucket"])
    first = lambda s, d: _run(s, d, t).select(F.col("start_ts_nanos").alias("s"), _text("bucket"), "name", F.col("value").alias("v"))
    _add("win_rename_firstname", first, f"with {_REC} select t - t % {DAY} as s, bucket, arg_min(event_type, seq) as name, count(*)::double as v from rec group by 1, 2")
    over = lambda s, d: _windows(_run(s, d, _win("sum", size="1h"), _win("max", id="w2", input="w", group_by=["event_type"])), "event_type")
    _add(
        "win_over_win", over,
        f"with {_REC}, a as (select t - t % {HOUR} + {HOUR} as t, event_type, bucket, sum(v) as v from rec group by 1, 2, 3) select t - t % {DAY} as s, t - t % {DAY} + {DAY} as e, event_type, round(max(v), 6) as v from a group by 1, 2, 3",
    )


def _joins() -> None:
    def inputs(*ops: tuple[str, str], keys: tuple[str, ...] = ("event_type", "bucket")) -> list[dict]:
        return [_win(op, field, id=f"w{i}", input=f"in{i}", group_by=list(keys)) for i, (op, field) in enumerate(ops)]

    def run(s: SparkSession, d: str, windows: list[dict], *more: dict) -> DataFrame:
        return _run(s, d, *windows, *more, sources=tuple(w["input"] for w in windows))

    keys = ("event_type", "bucket")
    two = inputs(("max", "value"), ("min", "value"))
    reduce_ = lambda s, d: _windows(run(s, d, two, {"type": "join", "id": "j", "inputs": ["w0", "w1"], "value": "w0 - w1", "name": "spread"}), *keys)
    _add("join_reduce", reduce_, _group("max").replace("max(v)", "max(v) - min(v)"))
    align = lambda s, d: _windows(run(s, d, two, {"type": "join", "id": "j", "inputs": ["w0", "w1"]}, {"type": "map", "id": "m", "input": "j", "value": "(w0 + w1) / 2"}), *keys)
    _add("join_align_map", align, _group("max").replace("max(v)", "(max(v) + min(v)) / 2"))
    three = [*inputs(("sum", "value"), ("count", "value")), _win("count", "k", id="w2", input="in2")]
    third = lambda s, d: _windows(run(s, d, three, {"type": "join", "id": "j", "inputs": ["w0", "w1", "w2"], "value": "w0 / w1 + w2"}), *keys)
    _add("join_three_way", third, _group("sum").replace("sum(v)", "sum(v) / count(v) + count(k)").replace("where s >=", "where k is not null and s >="))
    typed = inputs(("count", "value"), ("max", "k"), keys=("user_id",))
    keyed = lambda s, d: _windows(run(s, d, typed, {"type": "join", "id": "j", "inputs": ["w0", "w1"], "value": "w1 - w0 + user_id"}), "user_id")
    _add("join_typed_key", keyed, _group("max", keys="user_id").replace("max(v)", "max(k) - count(v) + user_id").replace("e, user_id, round", "e, user_id::varchar as user_id, round"))
    parts = [
        {"type": "filter", "id": "f0", "input": "in0", "key": "event_type", "equals": "purchase"}, {"type": "filter", "id": "f1", "input": "in1", "key": "event_type", "equals": "click"},
        _win("sum", id="w0", input="f0", group_by=["user_id"]), _win("sum", id="w1", input="f1", group_by=["user_id"]), {"type": "join", "id": "j", "inputs": ["w0", "w1"], "value": "w0 / w1"},
    ]
    inner = lambda s, d: _windows(_run(s, d, *parts, sources=("in0", "in1")), "user_id")
    _add(
        "join_incomplete_dropped", inner,
        f"with {_REC}, g as (select t - t % {DAY} as s, user_id, event_type, sum(v) as v from rec group by 1, 2, 3) select a.s, a.s + {DAY} as e, a.user_id::varchar as user_id, round(a.v / b.v, 6) as v from g a join g b using (s, user_id) where a.event_type = 'purchase' and b.event_type = 'click' and b.v <> 0",
    )


def double(record: dict) -> list[dict]:
    return [record | {"value": record["value"] * 2}]


def fan_out(record: dict) -> list[dict]:
    """Nothing for clicks; two records for purchases."""
    kind = record["attrs"]["event_type"]
    return [] if kind == "click" else [record] if kind != "purchase" else [record, record | {"name": "copy", "value": -record["value"]}]


def _udfs() -> None:
    def query(function: str) -> Query:
        return lambda s, d: _rows(udf.apply(tables.events(s, d), f"tallyrill.catalog:{function}", timeout=5.0))

    out = "user_id::varchar as user_id, bucket from rec"
    _add("udf_double", query("double"), f"with {_REC} select t, event_type as name, round(v * 2, 10) as v, {out}")
    _add("udf_drop_fanout", query("fan_out"), f"with {_REC} select t, event_type as name, round(v, 10) as v, {out} where event_type <> 'click' union all select t, 'copy' as name, round(-v, 10) as v, {out} where event_type = 'purchase'")


def _sources() -> None:
    for name, monotonic, reset in (("delta_monotonic", True, "v < p"), ("delta_nonmonotonic", False, "false")):
        query = lambda s, d, m=monotonic: normalize.apply(tables.lineitem_counters(s, d, m)).select(F.col("ts_nanos").alias("t"), _text("supplier"), F.round("value", 6).alias("v"))
        _add(name, query, f"""with a as (select l_suppkey, l_orderkey, sum(l_quantity) as n from lineitem group by 1, 2),
          b as (select *, sum(n) over (partition by l_suppkey, l_orderkey // 1000 order by l_orderkey) as v from a), c as (select *, lag(v) over (partition by l_suppkey order by l_orderkey) as p from b)
          select l_orderkey as t, l_suppkey::varchar as supplier, round(case when {reset} then v else v - p end, 6) as v from c where p is not null""")
    made = lambda s, d: generator.batch(s, 1000).select(F.col("ts_nanos").alias("t"), "name", F.col("value").alias("v"), _text("service.name").alias("service"), _text("http.route").alias("route"))
    _add("generator", made, """select i * 500000000 as t, 'demo.metric' as name, (50 + (i * 7) % 100)::double as v, ['checkout', 'cart', 'search'][(i % 3 + 1)::int] as service,
      ['/', '/api/order', '/api/items'][((i // 3) % 3 + 1)::int] as route from range(1000) r(i)""")

    def demo(spark: SparkSession, _: str) -> DataFrame:
        from .functions.record import STR, attr, record

        i = F.col("id")
        pick = lambda n, p: attr(F.concat(F.lit(p), n.cast("string")), STR)
        attrs = {"service.name": pick(i % 8, "svc-"), "http.route": pick(F.floor(i / 8) % 12, "/api/r"), "pod": pick(F.floor(i / 96) % 5, "pod-"), "status": pick(F.floor(i / 480) % 4, "s")}
        rows = record(spark.range(60_000), ts_nanos=i * 1_000_000, name=F.lit("http.server.duration"), value=(i * 37 % 1000) / 10, attrs=attrs, seq=i)
        p = _pipeline(_win("avg", "value", size="10s", group_by=["service.name", "http.route"]))
        out = compile_pipeline(spark, p, {"in": rows}).frames["w"]
        return _windows(out, "service.name", "http.route").withColumnsRenamed({"service.name": "service", "http.route": "route"})

    _add("edge_reduction_demo", demo, """with r as (select i * 1000000 as t, 'svc-' || (i % 8) as service, '/api/r' || ((i // 8) % 12) as route, (i * 37 % 1000) / 10 as v from range(60000) x(i))
      select t - t % 10000000000 as s, t - t % 10000000000 + 10000000000 as e, service, route, round(avg(v), 6) as v from r group by 1, 2, 3, 4""")


def _sinks() -> None:
    counted = lambda s, d: _run(s, d, _win("count"))
    _add(
        "sink_text", lambda s, d: sinks.lines(counted(s, d).withColumn("name", F.lit("n"))),
        f"with {_REC}, g as (select t - t % {DAY} as s, event_type, bucket, count(*) as c from rec group by 1, 2, 3) select (s + {DAY}) || ' [' || s || '..' || (s + {DAY}) || '] n=' || c || '.00 {{bucket=' || bucket || ', event_type=' || event_type || '}}' as line from g",
    )
    SQL["sink_text"] = SQL["sink_text"].replace("{{", "{").replace("}}", "}")
    _add(
        "sink_json", lambda s, d: sinks.lines(counted(s, d).withColumn("name", F.lit("n")), "json"),
        f"""with {_REC}, g as (select t - t % {DAY} as s, event_type, bucket, count(*) as c from rec group by 1, 2, 3) select '{{"ts_nanos":' || (s + {DAY}) || ',"start_ts_nanos":' || s || ',"resource":{{}},"scope":null,"name":"n","value":' || c || '.0,"attrs":{{"bucket":"' || bucket || '","event_type":"' || event_type || '"}}}}' as line from g""",
    )
    read_back = lambda s, d: otlp.decoded(sinks.otlp_requests(_run(s, d, _win("sum", size="1h"))), "request")
    _add("otlp_encode", lambda s, d: _windows(read_back(s, d), "event_type", "bucket"), _group("sum", f"t - t % {HOUR}", HOUR))


for _part in (_filters, _maps, _tumbling, _sliding, _exact, _names, _joins, _udfs, _sources, _sinks):
    _part()


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
