"""What order of arrival or wall-clock time decides in a stream: caps on groups, idle flushes, and counters to deltas.

Windows here are exact by record. Their watermark and caps span all groups of a node, so a node's state is one key: a
throughput limit that the plain streaming windows don't have, chosen only where these options are set. The same holds for a
join's cap, which is on all its open groups: a group is there from its first input's value until all have come, or until every
input has gone beyond its end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.record import ARRIVAL, ATTR, attr_map, schema
from ..operators import normalize
from ..operators import window as batch

#: The event time of the mark at the end of the input.
LAST = 9_000_000_000_000_000_000
_FOLDED = "_start bigint, _value double, _samples bigint, _name string, _keys string"


class WindowState:
    """The open windows of one node; plain Python, so it can be tested without a stream."""

    def __init__(self, spec: batch.Spec):
        self.spec, self.top, self.open = spec, 0, {}
        self.late = self.capped = self.invalid = 0

    def load(self, text: str) -> None:
        data = json.loads(text)
        self.top, self.late, self.capped, self.invalid = data["top"], data["late"], data["capped"], data["invalid"]
        self.open = {int(s): groups for s, groups in data["open"].items()}

    def dump(self) -> str:
        return json.dumps({"top": self.top, "late": self.late, "capped": self.capped, "invalid": self.invalid, "open": self.open})

    @property
    def watermark(self) -> int:
        return max(0, self.top - self.spec.lateness)

    def starts(self, ts: int) -> list[int]:
        first = ts - ts % self.spec.step
        many = -(-self.spec.size // self.spec.step)
        return [s for s in (first - i * self.spec.step for i in range(many)) if s >= 0 and s + self.spec.size > ts]

    def record(self, ts: int, key: str, name: str, number: float | None) -> list[tuple]:
        """Takes a record (without a number if a field is faulty) and returns what fires."""
        if ts == LAST:
            return self.fire(None)
        if number is None:
            self.invalid += 1
        else:
            live = [s for s in self.starts(ts) if s + self.spec.size > self.watermark]
            folded = False
            for s in live:
                groups = self.open.setdefault(s, {})
                if key not in groups and self.spec.max_groups is not None and len(groups) >= self.spec.max_groups:
                    continue
                n, total, low, high, first = groups.get(key, (0, 0.0, float("inf"), float("-inf"), name))
                real = number == number
                groups[key] = (n + 1, total + number, min(low, number) if real else low, max(high, number) if real else high, first)
                folded = True
            if not live:
                self.late += 1
            elif not folded:
                self.capped += 1
        self.top = max(self.top, ts)
        return self.fire(self.watermark)

    def fire(self, upto: int | None) -> list[tuple]:
        """Windows that end at or before ``upto``, or all, the earliest first."""
        out = []
        for s in sorted(s for s in self.open if upto is None or s + self.spec.size <= upto):
            for key, (n, total, low, high, name) in self.open.pop(s).items():
                value = {"count": float(n), "sum": total, "min": low, "max": high, "avg": total / n}[self.spec.op]
                out.append((s, value, n, name, key))
        return out


def in_order(rows: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """A batch's rows in their order of arrival: a shuffle brings those of several files in any. The optimizer may have renamed their columns."""
    pdf = pd.concat([p.set_axis(columns, axis=1) for p in rows])
    yield pdf.sort_values("_arrival", kind="stable")


class _Windows(StatefulProcessor):
    def __init__(self, spec: batch.Spec, idle: int | None):
        self.spec, self.idle = spec, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", T.StructType([T.StructField("json", T.StringType())]))

    def _loaded(self) -> WindowState:
        w = WindowState(self.spec)
        if self.state.exists():
            w.load(self.state.get()[0])
        return w

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["_start", "_value", "_samples", "_name", "_keys"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        w, out = self._loaded(), []
        for pdf in in_order(rows, ["ts_nanos", "name", "_number", "_fault", "_keys", "_arrival", "_node"]):
            for ts, k, name, number in zip(pdf["ts_nanos"], pdf["_keys"], pdf["name"], pdf["_number"].astype(object).where(pdf["_fault"].isna(), None), strict=True):
                out += w.record(int(ts), k, name, None if number is None else float(number))
        self.state.update((w.dump(),))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, self.idle // 1_000_000))
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Silence: every open window fires, and the watermark stays, so a later record can open a window again."""
        w = self._loaded()
        out = w.fire(None)
        self.state.update((w.dump(),))
        yield self._frame(out)

    def close(self) -> None:
        pass


def window(df: DataFrame, spec: batch.Spec, idle: int | None = None) -> DataFrame:
    number, wrong = batch.reading(spec)
    number = batch.checked(number, wrong, spec.node, spec.on_missing, spec.on_invalid)
    keys = F.to_json(F.struct(*(batch.lookup(k).alias(c) for k, c in zip(spec.group_by, batch.key_columns(spec), strict=True)))) if spec.group_by else F.lit("{}")
    rows = df.select("ts_nanos", "name", number.alias("_number"), wrong.alias("_fault"), keys.alias("_keys"), (F.col(ARRIVAL) if ARRIVAL in df.columns else F.lit("")).alias("_arrival"), F.lit(spec.node).alias("_node"))
    out = rows.groupBy("_node").transformWithStateInPandas(_Windows(spec, idle), _FOLDED, "Append", "ProcessingTime" if idle is not None else "None")
    parts = F.from_json("_keys", "struct<" + ",".join(f"{c}:{ATTR}" for c in batch.key_columns(spec)) + ">") if spec.group_by else None
    labels = {k: parts[c] for k, c in zip(spec.group_by, batch.key_columns(spec), strict=True)} if spec.group_by else {}
    return out.select(
        (F.col("_start") + F.lit(spec.size)).alias("ts_nanos"), F.col("_start").alias("start_ts_nanos"), attr_map({}).alias("resource"), F.lit(None).cast("string").alias("scope"),
        (F.lit(spec.name) if spec.name is not None else F.col("_name")).alias("name"), F.col("_value").alias("value"), attr_map(labels).alias("attrs"),
    )


class JoinState:
    """The open groups of a join; plain Python, so it can be tested without a stream."""

    def __init__(self, inputs: int, max_groups: int | None):
        self.inputs, self.max_groups = inputs, max_groups
        self.open: dict[tuple[int, int, str], list[float | None]] = {}
        self.seen = [0] * inputs
        self.capped = self.incomplete = 0

    def load(self, text: str) -> None:
        data = json.loads(text)
        self.seen, self.capped, self.incomplete = data["seen"], data["capped"], data["incomplete"]
        self.open = {(s, e, k): values for s, e, k, values in data["open"]}

    def dump(self) -> str:
        return json.dumps({"seen": self.seen, "capped": self.capped, "incomplete": self.incomplete, "open": [[*key, values] for key, values in self.open.items()]})

    def value(self, of: int, start: int, end: int, key: str, value: float) -> tuple | None:
        """Takes an input's value of a group; the group with all values, if that was the last."""
        place, out = (start, end, key), None
        self.seen[of] = max(self.seen[of], end)
        if place in self.open or self.max_groups is None or len(self.open) < self.max_groups:
            values = self.open.setdefault(place, [None] * self.inputs)
            values[of] = value
            if None not in values:
                del self.open[place]
                out = (start, end, key, values)
        else:
            self.capped += 1
        gone = [p for p in self.open if p[1] < min(self.seen)]  # not yet those of the windows that are still coming in
        for p in gone:
            del self.open[p]
        self.incomplete += len(gone)
        return out


class _Joins(StatefulProcessor):
    def __init__(self, inputs: int, max_groups: int | None):
        self.inputs, self.max_groups = inputs, max_groups

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("groups", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = JoinState(self.inputs, self.max_groups)
        if self.state.exists():
            state.load(self.state.get()[0])
        pdf = pd.concat(list(rows))
        pdf.columns = ["_start", "_end", "_keys", "_value", "_input", "_node"]  # the optimizer may have renamed them
        out = []
        # a batch's windows come in the order in which they fired, the inputs one after the other
        for s, e, k, v, n in zip(*(pdf.sort_values(["_end", "_input"], kind="stable")[c].tolist() for c in ("_start", "_end", "_keys", "_value", "_input")), strict=True):
            if done := state.value(int(n), int(s), int(e), k, float(v)):
                out.append(done)
        self.state.update((state.dump(),))
        yield pd.DataFrame(out, columns=["_start", "_end", "_keys", "_values"])

    def close(self) -> None:
        pass


def join(inputs: dict[str, DataFrame], group_by: list[str], max_groups: int | None, node: str) -> DataFrame:
    """start_ts_nanos, ts_nanos, labels (_k0 ..) and values (_v0 ..) of the groups that every input has."""
    parts = None
    for n, df in enumerate(inputs.values()):
        keys = F.to_json(F.struct(*(F.col("attrs").getItem(k).alias(f"_k{i}") for i, k in enumerate(group_by)))) if group_by else F.lit("{}")
        part = df.select(F.col("start_ts_nanos").alias("_start"), F.col("ts_nanos").alias("_end"), keys.alias("_keys"), F.col("value").alias("_value"), F.lit(n).alias("_input"), F.lit(node).alias("_node"))
        parts = part if parts is None else parts.unionByName(part)
    out = parts.groupBy("_node").transformWithStateInPandas(_Joins(len(inputs), max_groups), "_start bigint, _end bigint, _keys string, _values array<double>", "Append", "None")
    labels = F.from_json("_keys", "struct<" + ",".join(f"_k{i}:{ATTR}" for i in range(len(group_by))) + ">") if group_by else None
    return out.select(F.col("_start").alias("start_ts_nanos"), F.col("_end").alias("ts_nanos"), *(labels[f"_k{i}"].alias(f"_k{i}") for i in range(len(group_by))), *(F.col("_values")[n].alias(f"_v{n}") for n in range(len(inputs))))


class _Deltas(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("value", T.DoubleType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        pdf = next(in_order(rows, ["value", "_monotonic", "_arrival", "_row", "_series"]))
        out, first = [], last is None
        for v, monotonic in zip(pdf["value"], pdf["_monotonic"], strict=True):
            out.append(None if last is None else v if monotonic and v < last else v - last)
            last = v
        self.last.update((last,))
        yield pdf.assign(value=out)[["_row", "value"]].iloc[int(first) :]

    def close(self) -> None:
        pass


def deltas(df: DataFrame) -> DataFrame:
    """Cumulative samples (flags ``_cumulative`` and ``_monotonic``, from sources.otlp) to deltas, each series a key. Other records pass."""
    kind = schema()
    columns = [f.name for f in kind.fields]
    arrival = F.col(ARRIVAL) if ARRIVAL in df.columns else F.lit("")
    sums = df.where("_cumulative").select("value", "_monotonic", arrival.alias("_arrival"), F.to_json(F.struct(*columns)).alias("_row"), F.to_json(F.struct(*(c.alias(f"s{i}") for i, c in enumerate(normalize.series())))).alias("_series"))
    out = sums.groupBy("_series").transformWithStateInPandas(_Deltas(), "_row string, value double", "Append", "None")
    made = out.select(F.from_json("_row", kind).alias("r"), F.col("value").alias("_delta")).select("r.*", "_delta").withColumn("value", F.col("_delta")).drop("_delta")
    return df.where("not _cumulative").select(*columns).unionByName(made)
