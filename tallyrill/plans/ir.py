"""The pipeline as data: sources, transforms and sinks that refer to each other by id, from YAML or JSON."""

from __future__ import annotations

import json
import warnings
from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path
from typing import Any, ClassVar

import yaml

OPS = ("count", "sum", "min", "max", "avg")
ACTIONS = ("skip", "error")
FORMATS = ("text", "json")


class ParseError(ValueError):
    pass


@dataclass
class Generator:
    type: ClassVar[str] = "generator"
    id: str
    metric: str = "demo.metric"
    interval: str = "500ms"
    services: list[str] = field(default_factory=list)
    routes: list[str] = field(default_factory=list)


@dataclass
class Stdin:
    type: ClassVar[str] = "stdin"
    id: str


@dataclass
class OtlpSource:
    type: ClassVar[str] = "otlp"
    id: str
    listen: str = "0.0.0.0:4317"
    max_recv_bytes: int = 4 * 1024 * 1024
    max_concurrent_streams: int = 256


@dataclass
class Aggregate:
    op: str
    field: str | None = None
    on_missing: str = "skip"
    on_invalid: str = "skip"


@dataclass
class Filter:
    type: ClassVar[str] = "filter"
    id: str
    input: str
    key: str
    equals: str | None = None


@dataclass
class Window:
    type: ClassVar[str] = "window"
    id: str
    input: str
    size: str
    aggregate: Aggregate
    name: str | None = None
    slide: str | None = None
    allowed_lateness: str | None = None
    idle_timeout: str | None = None
    group_by: list[str] = field(default_factory=list)
    max_groups: int | None = None


@dataclass
class Map:
    type: ClassVar[str] = "map"
    id: str
    input: str
    value: str
    name: str | None = None
    on_missing: str = "skip"
    on_invalid: str = "skip"


@dataclass
class Join:
    type: ClassVar[str] = "join"
    id: str
    inputs: list[str]
    name: str | None = None
    value: str | None = None
    max_groups: int | None = None


@dataclass
class Udf:
    """A user function over single records; ``module`` is a path, a file:// URI, or package.module:function."""

    type: ClassVar[str] = "udf"
    id: str
    input: str
    module: str
    sha256: str | None = None
    max_memory: str | None = None
    timeout: str | None = None
    on_error: str = "skip"


@dataclass
class Stdout:
    type: ClassVar[str] = "stdout"
    id: str
    input: str
    format: str = "text"


@dataclass
class OtlpSink:
    type: ClassVar[str] = "otlp"
    id: str
    input: str
    endpoint: str


Source = Generator | Stdin | OtlpSource
Transform = Filter | Window | Map | Join | Udf
Sink = Stdout | OtlpSink


@dataclass
class Pipeline:
    sources: list[Source]
    sinks: list[Sink]
    transforms: list[Transform] = field(default_factory=list)
    version: int = 0


SOURCES: dict[str, type] = {c.type: c for c in (Generator, Stdin, OtlpSource)}
TRANSFORMS: dict[str, type] = {c.type: c for c in (Filter, Window, Map, Join, Udf)} | {"wasm": Udf}
SINKS: dict[str, type] = {c.type: c for c in (Stdout, OtlpSink)}
_CHOICES = {"op": OPS, "on_missing": ACTIONS, "on_invalid": ACTIONS, "on_error": ACTIONS, "format": FORMATS}
_WHOLE = ("max_groups", "max_recv_bytes", "max_concurrent_streams", "version")


def inputs(node: Transform | Sink) -> list[str]:
    return list(node.inputs) if isinstance(node, Join) else [node.input]


def windows_deep(p: Pipeline) -> int:
    """The most windows on a way from a source to a sink."""
    by_id = {t.id: t for t in p.transforms}

    def deep(at: str) -> int:
        t = by_id.get(at)
        return 0 if t is None else isinstance(t, Window) + max(map(deep, inputs(t)))

    return max((deep(s.input) for s in p.sinks), default=0)


def _made(kind: type, data: Any, where: str) -> Any:
    if not isinstance(data, dict):
        raise ParseError(f"{where}: a mapping is expected")
    known = {f.name: f for f in fields(kind)}
    extra = set(data) - set(known) - {"type"}
    if extra:
        warnings.warn(f"{where}: unknown fields {sorted(extra)}", stacklevel=2)
    values = {}
    for name, f in known.items():
        if name not in data:
            if f.default is MISSING and f.default_factory is MISSING:
                raise ParseError(f"{where}: {name} is missing")
            continue
        v = data[name]
        if name == "aggregate":
            v = _made(Aggregate, v, f"{where}.aggregate")
        elif name in _CHOICES:
            if v not in _CHOICES[name]:
                raise ParseError(f"{where}.{name}: one of {', '.join(_CHOICES[name])} is expected, not {v!r}")
        elif str(f.type).startswith("list"):
            if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
                raise ParseError(f"{where}.{name}: a list of strings is expected")
        elif name in _WHOLE:
            if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 0):
                raise ParseError(f"{where}.{name}: a whole number is expected")
        elif not (isinstance(v, str) or v is None and "None" in str(f.type)):
            raise ParseError(f"{where}.{name}: a string is expected")
        values[name] = v
    return kind(**values)


def _nodes(data: dict, part: str, kinds: dict[str, type], needed: bool) -> list:
    if part not in data and needed:
        raise ParseError(f"{part} is missing")
    out = []
    for i, x in enumerate(data.get(part) or []):
        where = f"{part}[{i}]"
        kind = x.get("type") if isinstance(x, dict) else None
        if kind not in kinds:
            raise ParseError(f"{where}.type: one of {', '.join(kinds)} is expected, not {kind!r}")
        out.append(_made(kinds[kind], x, where))
    return out


def from_dict(data: Any) -> Pipeline:
    if not isinstance(data, dict):
        raise ParseError("a mapping is expected")
    version = data.get("version", 0)
    if isinstance(version, bool) or not isinstance(version, int) or version < 0:
        raise ParseError("version: a whole number is expected")
    return Pipeline(_nodes(data, "sources", SOURCES, True), _nodes(data, "sinks", SINKS, True), _nodes(data, "transforms", TRANSFORMS, False), version)


def loads(text: str) -> Pipeline:
    """A pipeline from YAML or JSON."""
    try:
        return from_dict(yaml.safe_load(text))
    except yaml.YAMLError as e:
        raise ParseError(str(e)) from e


def load(path: str) -> Pipeline:
    return loads(Path(path).read_text())


def to_dict(p: Pipeline) -> dict:
    def plain(x: Any) -> Any:
        if hasattr(x, "__dataclass_fields__"):
            return ({"type": x.type} if hasattr(x, "type") else {}) | {f.name: plain(getattr(x, f.name)) for f in fields(x)}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return plain(p)


def json_schema() -> dict:
    """The JSON Schema of a pipeline."""

    def of(f) -> dict:
        if f.name == "aggregate":
            return {"$ref": "#/$defs/Aggregate"}
        if f.name in _CHOICES:
            return {"enum": list(_CHOICES[f.name])}
        if str(f.type).startswith("list"):
            return {"type": "array", "items": {"type": "string"}}
        kind = "integer" if f.name in _WHOLE else "string"
        return {"type": [kind, "null"] if "None" in str(f.type) else kind} | ({"minimum": 0} if kind == "integer" else {})

    def node(kind: type, name: str | None) -> dict:
        props = {"type": {"const": name}} if name else {}
        needed = ["type"] if name else []
        for f in fields(kind):
            props[f.name] = of(f)
            if f.default is MISSING and f.default_factory is MISSING:
                needed.append(f.name)
            elif f.default is not MISSING and f.default is not None:
                props[f.name] |= {"default": f.default}
        return {"type": "object", "properties": props, "required": needed} | ({"description": kind.__doc__} if name and not kind.__doc__.startswith(kind.__name__ + "(") else {})

    def any_of(kinds: dict[str, type]) -> dict:
        return {"oneOf": [node(k, name) for name, k in kinds.items()]}

    lists = {part: {"type": "array", "items": {"$ref": f"#/$defs/{name}"}} for part, name in (("sources", "Source"), ("transforms", "Transform"), ("sinks", "Sink"))}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Pipeline", "type": "object", "required": ["sources", "sinks"],
        "properties": {"version": {"type": "integer", "minimum": 0, "default": 0}} | lists,
        "$defs": {"Source": any_of(SOURCES), "Transform": any_of(TRANSFORMS), "Sink": any_of(SINKS), "Aggregate": node(Aggregate, None)},
    }


def schema_text() -> str:
    return json.dumps(json_schema(), indent=2)
