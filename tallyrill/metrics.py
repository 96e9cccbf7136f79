"""What each node passes on and drops. The reasons a record is dropped for."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .plans import ir
from .plans.compiler import Compiled

REASONS = ("filtered", "invalid", "late", "incomplete", "capped")


def collect(compiled: Compiled) -> list[dict[str, Any]]:
    """For each node of a bounded pipeline: records.out, records.dropped by reason, and of windows their flushes and groups.

    All counts are aggregates of one query, so what nodes have in common is shuffled once.
    """
    kinds = {n.id: "source" if n in compiled.pipeline.sources else n.type for n in [*compiled.pipeline.sources, *compiled.pipeline.transforms]}
    counts: list[DataFrame] = []

    def count(node: str, what: str, df: DataFrame, of: Column | None = None) -> None:
        counts.append(df.agg((F.count(F.lit(1)) if of is None else of).alias("n")).select(F.lit(node).alias("node"), F.lit(what).alias("what"), "n"))

    for node, df in compiled.frames.items():
        count(node, "records.out", df)
        for reason, dropped in compiled.drops.get(node, dict)().items():
            count(node, f"records.dropped.{reason}", dropped)
        if kinds[node] == "window":
            count(node, "window.flushes", df, F.count_distinct("start_ts_nanos"))
    out = {node: {"node": node, "kind": kinds[node]} for node in compiled.frames}
    for r in reduce(DataFrame.unionByName, counts).collect():
        out[r["node"]][r["what"]] = r["n"]
    for row in out.values():
        if row["kind"] == "window":
            row["window.groups"] = row["records.out"]
    return list(out.values())


def observed(df: DataFrame, node: str) -> DataFrame:
    """Counts a node's records while a query runs; the counts are in its progress under the node's name."""
    return df.observe(node, F.count(F.lit(1)).alias("records_out"))


class Listener(StreamingQueryListener):
    """Keeps the latest counts of running queries: observed nodes, and the rows that their state operators dropped as late."""

    def __init__(self) -> None:
        self.out: dict[str, int] = {}
        self.late = 0
        self.errors = 0

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        for node, row in event.progress.observedMetrics.items():
            self.out[node] = self.out.get(node, 0) + row["records_out"]
        self.late += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.errors += event.exception is not None


def nodes(p: ir.Pipeline) -> list[str]:
    return [n.id for n in [*p.sources, *p.transforms, *p.sinks]]
