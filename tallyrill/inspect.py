"""The open state of windows: of a bounded input just before its last flush, and of a running stream from its checkpoint."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.record import display
from .operators import join, window
from .plans import ir
from .plans.compiler import Compiled, window_spec


def snapshot(compiled: Compiled, only: list[str] | None = None) -> list[dict[str, Any]]:
    """Open groups of the windows and joins of a compiled, bounded pipeline. Unknown nodes are left out; nodes are in order of their ids."""
    out = []
    by_id = {t.id: t for t in compiled.pipeline.transforms}
    for t in sorted((t for t in compiled.pipeline.transforms if isinstance(t, ir.Window | ir.Join)), key=lambda t: t.id):
        if only and t.id not in only:
            continue
        if isinstance(t, ir.Join):
            rows = join.open_groups({i: compiled.frames[i] for i in t.inputs}, by_id[t.inputs[0]].group_by).collect()
            out.append({"id": t.id, "kind": "join", "groups": sorted((r.asDict() for r in rows), key=lambda g: (g["window_start_nanos"], sorted(g["labels"].items())))})
            continue
        rows = window.open_groups(compiled.frames[t.input], window_spec(t)).collect()
        out.append({"id": t.id, "kind": "window", "groups": sorted((r.asDict() for r in rows), key=lambda g: (g["window_start_nanos"], sorted(g["labels"].items())))})
    return out


def last_window(p: ir.Pipeline, sink: str | None) -> window.Spec:
    """The window nearest to a sink (the only one, if none is named): its state is the first operator's of the sink's query."""
    at = next((s.input for s in p.sinks if sink in (None, s.id)), None)
    by_id = {t.id: t for t in p.transforms}
    while at in by_id:
        t = by_id[at]
        if isinstance(t, ir.Window):
            return window_spec(t)
        at = ir.inputs(t)[0]
    raise SystemExit(f"there is no window before sink {sink}")


def stream_snapshot(spark: SparkSession, checkpoint: str, spec: window.Spec, operator_id: int = 0) -> dict[str, Any]:
    """Open groups in the state store of a streaming window."""
    state = spark.read.format("statestore").option("operatorId", operator_id).load(checkpoint)
    keys = window.key_columns(spec)
    names = state.schema["key"].dataType.names
    bounds = F.col("key").getField(names[0])
    labels = [display(F.col("key").getField(n)).alias(c) for n, c in zip(names[1:], keys, strict=False)]
    rows = state.select((F.unix_micros(bounds["start"]) * 1000).alias("start"), (F.unix_micros(bounds["end"]) * 1000).alias("end"), *labels, F.to_json("value").alias("value")).collect()
    groups = [{"labels": {k: r[c] for k, c in zip(spec.group_by, keys, strict=True) if r[c] is not None}, "window_start_nanos": r["start"], "window_end_nanos": r["end"], "state": r["value"]} for r in rows]
    return {"id": spec.node, "kind": "window", "groups": sorted(groups, key=lambda g: (g["window_start_nanos"], sorted(g["labels"].items())))}


def render(nodes: list[dict[str, Any]]) -> str:
    """A plain table, a line for each group."""
    if not nodes:
        return "no stateful nodes\n"
    out = []
    for n in nodes:
        out.append(f"{n['id']} ({n['kind']}) - {len(n['groups'])} group(s)")
        for g in n["groups"]:
            line = f"  {','.join(f'{k}={v}' for k, v in sorted(g['labels'].items())) or '-'}  window=[{g['window_start_nanos']},{g['window_end_nanos']})"
            if g.get("value") is not None:
                line += f"  value={g['value']:g}"
            if g.get("inputs"):
                line += "  inputs={" + ",".join(f"{k}={v:g}" for k, v in sorted(g["inputs"].items())) + "}"
            if "state" in g:
                line += f"  state={g['state']}"
            out.append(line + (f"  samples={g['samples']}" if "samples" in g else ""))
    return "\n".join(out) + "\n"


def watch(take: Callable[[], list[dict[str, Any]]], least_seconds: float = 0.1, pause: Callable[[float], None] = time.sleep, times: int | None = None) -> Iterator[list[dict[str, Any]]]:
    """Snapshots whenever they have changed, at least ``least_seconds`` apart."""
    last, n = None, 0
    while times is None or n < times:
        now = take()
        if now != last:
            last = now
            yield now
        n += 1
        pause(least_seconds)
