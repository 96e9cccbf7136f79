"""User functions over records: one in, none, one or many out.

A module is Python source with ``transform(record: dict) -> list[dict]`` and ``ABI_VERSION = 1``, from a path or file:// URI
(shipped to the executors as text), or ``package.module:function`` which they import. Records are dicts with the seven
fields; attributes are plain bools, ints, floats and strings.

A batch's columns are taken apart and put together again as a whole; only the calls go record by record. One timer runs for a
batch and stops a call that is over its time; a call that grows the worker's memory by more than ``max_memory`` is treated as
failed afterwards. This is no sandbox: a module can do what the worker's user can.

What a record becomes has its place in the order of arrival. Bounded input that is too small to be read by many tasks is dealt
to as many as there are cores first.
"""

from __future__ import annotations

import gc
import hashlib
import importlib
import resource
import signal
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.record import BOOL, DOUBLE, FIELDS, INT, SEQ, STR, schema

ABI_VERSION = 1
#: Inputs under this size are dealt to all cores: a task for each of their few files or row groups would leave most of them idle.
SMALL = 256 << 20
_ARROW_ATTR = pa.struct([("t", pa.int8()), ("b", pa.bool_()), ("i", pa.int64()), ("d", pa.float64()), ("s", pa.string())])
_ARROW = pa.schema([
    ("ts_nanos", pa.int64()), ("start_ts_nanos", pa.int64()), ("resource", pa.map_(pa.string(), _ARROW_ATTR)), ("scope", pa.string()),
    ("name", pa.string()), ("value", pa.float64()), ("attrs", pa.map_(pa.string(), _ARROW_ATTR)),
])


class UdfError(RuntimeError):
    pass


def source(module: str, sha256: str | None = None) -> tuple[str, str]:
    """("text", the source) or ("import", its name); the digest is checked here, before anything runs."""
    path = Path(module.removeprefix("file://"))
    if not path.suffix == ".py" and ":" in module and not module.startswith("file://"):
        return "import", module
    data = path.read_bytes()
    if sha256 is not None and hashlib.sha256(data).hexdigest() != sha256.lower():
        raise UdfError(f"{module}: its SHA-256 isn't {sha256}")
    return "text", data.decode()


def loaded(kind: str, text: str) -> Callable[[dict], list[dict]]:
    if kind == "import":
        name, _, function = text.partition(":")
        module = importlib.import_module(name)
        space, call = vars(module), getattr(module, function)
    else:
        space = {"__name__": "tallyrill_udf"}
        exec(compile(text, "<udf>", "exec"), space)  # noqa: S102
        call = space.get("transform")
    if not callable(call):
        raise UdfError("the module has no transform(record)")
    if space.get("ABI_VERSION", ABI_VERSION) != ABI_VERSION:
        raise UdfError(f"the module is made for version {space['ABI_VERSION']} of the interface; this is {ABI_VERSION}")
    return call


_KINDS = {bool: BOOL, int: INT, float: DOUBLE, str: STR}
_INT64 = range(-(1 << 63), 1 << 63)


def _objects(column: pa.Array) -> list:
    """A column as Python values; equal strings are one object."""
    if pa.types.is_string(column.type):
        column = column.dictionary_encode()
        if column.null_count:
            return np.array([*column.dictionary.to_pylist(), None], object)[column.indices.fill_null(len(column.dictionary)).to_numpy()].tolist()
        return np.array(column.dictionary.to_pylist(), object)[column.indices.to_numpy()].tolist() if len(column) else []
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _maps(column: pa.MapArray) -> list[dict]:
    """Maps of typed values as dicts of plain ones, without those that are null."""
    kind, b, i, d, s = column.items.flatten()
    kind = kind.fill_null(0).to_numpy()
    keys, values = _objects(column.keys), _objects(s)
    for t, plain in ((BOOL, b), (INT, i), (DOUBLE, d)):
        own = np.flatnonzero(kind == t)
        for p, v in zip(own.tolist(), _objects(plain.take(pa.array(own))), strict=True):
            values[p] = v
    at = column.offsets.to_numpy().tolist()
    if (kind == 0).any():
        return [{k: v for k, v in zip(keys[x:y], values[x:y], strict=True) if v is not None} for x, y in zip(at[:-1], at[1:], strict=True)]
    return [dict(zip(keys[x:y], values[x:y], strict=True)) for x, y in zip(at[:-1], at[1:], strict=True)]


def _records(batch: pa.RecordBatch) -> Iterator[dict]:
    columns = [_maps(batch.column(f)) if f in ("resource", "attrs") else _objects(batch.column(f)) for f in FIELDS]
    for values in zip(*columns, strict=True):
        yield dict(zip(FIELDS, values, strict=True))


def _kinds(values: list) -> list[int]:
    out = [*map(_KINDS.get, map(type, values))]
    if None in out:  # subclasses, or what has no place in a record
        out = [next((k for t, k in _KINDS.items() if isinstance(v, t)), 0) for v in values]
        if 0 in out:
            raise UdfError("attributes are bools, ints, floats or strings")
    return out


def _map(m: dict | None) -> tuple[list, list, list]:
    if not m:
        return [], [], []
    values = [*m.values()]
    return [n if type(n) is str else str(n) for n in m], values, _kinds(values)


def _checked(out: dict) -> tuple:
    """A record that was returned, in the order of FIELDS; attributes with their kinds."""
    get = out.get
    start, scope, name = get("start_ts_nanos"), get("scope"), out["name"]
    return (
        int(out["ts_nanos"]), None if start is None else int(start), _map(get("resource")), None if scope is None else str(scope),
        name if type(name) is str else str(name), float(out["value"]), _map(get("attrs")),
    )


def _fits(row: tuple) -> bool:
    """Whether all integers have 64 bits at most."""
    whole = [row[0], 0 if row[1] is None else row[1], *(v for _, values, kinds in (row[2], row[6]) for v, k in zip(values, kinds, strict=True) if k == INT)]
    return all(v in _INT64 for v in whole)


def _arrow_maps(rows: list[tuple[list, list, list]]) -> pa.Array:
    keys, values = list(chain.from_iterable(r[0] for r in rows)), np.empty(sum(len(r[1]) for r in rows), object)
    values[:] = list(chain.from_iterable(r[1] for r in rows))
    kind = np.fromiter(chain.from_iterable(r[2] for r in rows), np.int8, len(keys))
    fields = [pa.array(kind)]
    for t, arrow in ((BOOL, pa.bool_()), (INT, pa.int64()), (DOUBLE, pa.float64()), (STR, pa.string())):
        fields.append(pa.array(values, arrow, mask=kind != t) if (kind == t).any() else pa.nulls(len(keys), arrow))
    at = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r[0]) for r in rows], out=at[1:])
    return pa.MapArray.from_arrays(pa.array(at), pa.array(keys, pa.string()), pa.StructArray.from_arrays(fields, fields=list(_ARROW_ATTR)))


def _arrow(rows: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(FIELDS)
    return [_arrow_maps(list(c)) if f.name in ("resource", "attrs") else pa.array(c, f.type) for f, c in zip(_ARROW, columns, strict=True)]


@contextmanager
def _watch(seconds: float) -> Iterator[list[float]]:
    """A timer that raises in the running call when the call is over its time; the list's only item is when it began, or infinity between calls."""
    began = [float("inf")]

    def look(*_):
        if time.monotonic() - began[0] > seconds:
            raise UdfError(f"it ran for more than {seconds:g} s")

    old = signal.signal(signal.SIGALRM, look)
    signal.setitimer(signal.ITIMER_REAL, seconds / 4, seconds / 4)
    try:
        yield began
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def _called(call: Callable, batch: pa.RecordBatch, on_error: str, timeout: float, max_memory: int, node: str) -> tuple[list[tuple], list[int], list[int]]:
    """What the calls returned, the input row of each, and the rows whose calls failed."""
    rows: list[tuple] = []
    source: list[int] = []
    failed: list[int] = []
    usage, self_, clock, never = resource.getrusage, resource.RUSAGE_SELF, time.monotonic, float("inf")
    with _watch(timeout) as began, _no_collection():
        before = usage(self_).ru_maxrss
        for i, record in enumerate(_records(batch)):
            try:
                began[0] = clock()
                made = call(record)
                began[0] = never
                now = usage(self_).ru_maxrss
                grown, before = now - before, now
                if grown * 1024 > max_memory:
                    raise UdfError(f"it took more than {max_memory} bytes")
                made = [_checked(r) for r in made]
            except Exception as e:
                began[0] = never
                if on_error == "error":
                    raise UdfError(f"{node}: {e}") from e
                failed.append(i)
                continue
            rows += made
            source += [i] * len(made)
    return rows, source, failed


def _returned(call: Callable, batch: pa.RecordBatch, *limits) -> tuple[list[pa.Array], list[int], list[int]]:
    """The columns of what the calls returned, the input row of each record, and the rows whose calls failed."""
    rows, source, failed = _called(call, batch, *limits)
    try:
        return _arrow(rows), source, failed
    except OverflowError as e:
        if limits[0] == "error":
            raise UdfError(f"{limits[-1]}: an integer has 64 bits at most") from e
        bad = {i for row, i in zip(rows, source, strict=True) if not _fits(row)}
        keep = [k for k, i in enumerate(source) if i not in bad]
        return _arrow([rows[k] for k in keep]), [source[k] for k in keep], sorted({*failed, *bad})


@contextmanager
def _no_collection() -> Iterator[None]:
    """A batch makes very many objects and no cycles of its own."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def spread(df: DataFrame) -> DataFrame:
    """Small bounded input in as many parts as there are cores."""
    if df.isStreaming or not hasattr(df, "_jdf") or int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def apply(df: DataFrame, module: str, sha256: str | None = None, on_error: str = "skip", timeout: float = 0.1, max_memory: int = 64 << 20, node: str = "udf") -> DataFrame:
    kind, text = source(module, sha256)
    own = [*FIELDS, *([SEQ] if SEQ in df.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = loaded(kind, text)
        for batch in batches:
            columns, of, _ = _returned(call, batch, on_error, timeout, max_memory, node)
            order = [batch.column(SEQ).take(pa.array(of, pa.int64()))] if SEQ in own else []
            yield pa.RecordBatch.from_arrays([*columns, *order], names=own)

    return spread(df).select(own).mapInArrow(run, T.StructType([*schema().fields, *(df.schema[c] for c in own[len(FIELDS) :])]))


def dropped(df: DataFrame, module: str, sha256: str | None = None, timeout: float = 0.1, max_memory: int = 64 << 20, node: str = "udf") -> dict[str, DataFrame]:
    """The records whose calls fail; the function is called again for them."""
    kind, text = source(module, sha256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = loaded(kind, text)
        for batch in batches:
            yield batch.take(pa.array(_returned(call, batch, "skip", timeout, max_memory, node)[2], pa.int64()))

    return {"invalid": spread(df).select(*FIELDS).mapInArrow(run, schema())}


def check(module: str, sha256: str | None = None) -> None:
    """Fails if the module can't be loaded here."""
    loaded(*source(module, sha256))
