"""From a pipeline to DataFrames, one for each node; Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import expr
from ..functions.durations import memory_bytes, nanoseconds
from ..operators import filter as filter_
from ..operators import join, udf, window
from ..operators import map as map_
from ..sources import generator, jsonl, otlp
from ..streaming import stateful
from ..streaming import windows as streaming
from . import ir
from .validate import validate


@dataclass
class Compiled:
    """The frame of each node by id, and the records that it drops by reason."""

    pipeline: ir.Pipeline
    frames: dict[str, DataFrame] = field(default_factory=dict)
    drops: dict[str, Callable[[], dict[str, DataFrame]]] = field(default_factory=dict)

    def sinks(self) -> dict[str, tuple[ir.Sink, DataFrame]]:
        return {s.id: (s, self.frames[s.input]) for s in self.pipeline.sinks}


def window_spec(t: ir.Window) -> window.Spec:
    a = t.aggregate
    return window.Spec(
        size=nanoseconds(t.size), slide=nanoseconds(t.slide) if t.slide else None, lateness=nanoseconds(t.allowed_lateness) if t.allowed_lateness else 0, group_by=tuple(t.group_by),
        op=a.op, field=a.field, on_missing=a.on_missing, on_invalid=a.on_invalid, max_groups=t.max_groups, name=t.name, node=t.id,
    )


def read(spark: SparkSession, s: ir.Source, path: str | None, streaming_: bool, records: int) -> DataFrame:
    if isinstance(s, ir.Generator):
        own = {"metric": s.metric, "interval": nanoseconds(s.interval), "services": s.services, "routes": s.routes}
        return generator.stream(spark, **own) if streaming_ else generator.batch(spark, records, **own)
    if path is None:
        raise ValueError(f"source {s.id}: a path is needed")
    if isinstance(s, ir.Stdin):
        return jsonl.stream(spark, path) if streaming_ else jsonl.batch(spark, path)
    return stateful.deltas(otlp.stream(spark, path)) if streaming_ else otlp.batch(spark, path)


def read_keys(p: ir.Pipeline, source: str) -> set[str] | None:
    """The attributes of a source's records that the pipeline reads, or None where it needs them all: a scan needs no others."""
    keys: set[str] = set()
    at = source
    while True:
        t = next((t for t in p.transforms if at in ir.inputs(t)), None)
        if isinstance(t, ir.Filter):
            keys.add(t.key)
        elif isinstance(t, ir.Map):
            keys |= expr.names(expr.parse(t.value)) - {"value"}
        elif isinstance(t, ir.Window):
            return keys | set(t.group_by) | ({t.aggregate.field} if t.aggregate.field else set())
        else:
            return None if t is not None or any(s.input == at for s in p.sinks) else keys
        at = t.id


def compile_pipeline(spark: SparkSession, p: ir.Pipeline, inputs: dict[str, DataFrame | str | Callable[[set[str] | None], DataFrame]] | None = None, *, stream: bool = False, exact: bool | None = None, records: int = 100, marks: str | None = None) -> Compiled:
    """Frames of all nodes.

    ``inputs``: for each source a frame of records, a function that gives one with the attributes that are read (all for None), or the path of its lines (of OTLP requests, for otlp). A generator needs none and makes ``records`` records.
    ``exact``: windows of bounded input take records in their order of arrival, with watermark, lateness and caps; by default those with max_groups do.
    ``marks``: of a stream that will end, the folder of the mark at its end (see streaming.windows).
    """
    validate(p)
    out, inputs = Compiled(p), inputs or {}
    for s in p.sources:
        given = inputs.get(s.id)
        if callable(given):
            given = given(read_keys(p, s.id))
        out.frames[s.id] = given if isinstance(given, DataFrame) else read(spark, s, given, stream, records)
    by_id = {t.id: t for t in p.transforms}
    waiting = list(p.transforms)
    while waiting:
        t = next(x for x in waiting if all(i in out.frames for i in ir.inputs(x)))
        waiting.remove(t)
        sources = [out.frames[i] for i in ir.inputs(t)]
        out.frames[t.id], out.drops[t.id] = _node(t, sources, by_id, exact, marks)
    return out


def _node(t: ir.Transform, sources: list[DataFrame], by_id: dict[str, ir.Transform], exact: bool | None, marks: str | None) -> tuple[DataFrame, Callable[[], dict[str, DataFrame]]]:
    df = sources[0]
    live = df.isStreaming
    if isinstance(t, ir.Filter):
        return filter_.apply(df, t.key, t.equals), lambda: filter_.dropped(df, t.key, t.equals)
    if isinstance(t, ir.Map):
        return map_.apply(df, t.value, t.name, t.on_missing, t.on_invalid, t.id), lambda: map_.dropped(df, t.value)
    if isinstance(t, ir.Udf):
        timeout = nanoseconds(t.timeout or "100ms") / 1e9
        most = memory_bytes(t.max_memory or "64Mi")
        return udf.apply(df, t.module, t.sha256, t.on_error, timeout, most, t.id), lambda: udf.dropped(df, t.module, t.sha256, timeout, most, t.id)
    if isinstance(t, ir.Window):
        spec = window_spec(t)
        if live:
            return streaming.apply(df, spec, idle=nanoseconds(t.idle_timeout) if t.idle_timeout else None, marks=marks), dict
        return window.apply(df, spec, exact), lambda: window.dropped(df, spec) if exact else {"invalid": window.prepared(df, spec).where("_fault is not null")}
    own = dict(zip(t.inputs, sources, strict=True))
    group_by = by_id[t.inputs[0]].group_by
    if live:
        return streaming.join(own, group_by, t.value, t.name, t.max_groups, t.id), dict
    return join.apply(own, group_by, t.value, t.name, t.max_groups, t.id), lambda: join.dropped(own, group_by, t.value, t.max_groups)
