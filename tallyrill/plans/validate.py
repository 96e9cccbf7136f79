"""Static checks of a pipeline; the first that fails is raised, in the order of the functions below."""

from __future__ import annotations

from ..functions import expr
from ..functions.durations import memory_bytes, nanoseconds
from . import ir


class ValidationError(ValueError):
    """A pipeline that can't run."""

    def __init__(self, *parts: str):
        self.parts = parts
        super().__init__(self.message.format(*parts))

    message = "{0}"


class DuplicateId(ValidationError):
    message = "two nodes have the id {0}"


class UnknownInput(ValidationError):
    message = "the input {0} is no source or transform"


class MultipleConsumers(ValidationError):
    message = "{0} is the input of more than one node; an output has one consumer"


class Unreachable(ValidationError):
    message = "no source reaches {0}: it is in a cycle or reads from one"


class BadDuration(ValidationError):
    message = "{0}: {1!r} is no duration: {2}"


class InvalidWindow(ValidationError):
    message = "window {0}: {1}"


class BadExpression(ValidationError):
    message = "{0}: its expression can't be parsed: {1}"


class InvalidJoin(ValidationError):
    message = "join {0}: {1}"


class InvalidUdf(ValidationError):
    message = "udf {0}: {1}"


def validate(p: ir.Pipeline) -> None:
    _ids(p)
    for node in [*p.sources, *p.transforms]:
        _settings(node)
    _edges(p)
    _reachable(p)
    _joins(p)


def _ids(p: ir.Pipeline) -> None:
    seen: set[str] = set()
    for node in [*p.sources, *p.transforms, *p.sinks]:
        if node.id in seen:
            raise DuplicateId(node.id)
        seen.add(node.id)


def _duration(node: str, text: str | None) -> int | None:
    if text is None:
        return None
    try:
        return nanoseconds(text)
    except ValueError as e:
        raise BadDuration(node, text, str(e)) from e


def _settings(node: ir.Source | ir.Transform) -> None:
    if isinstance(node, ir.Generator):
        _duration(node.id, node.interval)
    elif isinstance(node, ir.Window):
        if node.max_groups == 0:
            raise InvalidWindow(node.id, "max_groups is at least 1")
        size = _duration(node.id, node.size)
        _duration(node.id, node.allowed_lateness)
        _duration(node.id, node.idle_timeout)
        slide = _duration(node.id, node.slide)
        if not size:
            raise InvalidWindow(node.id, "size is longer than zero")
        if slide == 0:
            raise InvalidWindow(node.id, "slide is longer than zero")
        if slide is not None and slide > size:
            raise InvalidWindow(node.id, "slide is longer than size, so records could fall between windows")
    elif isinstance(node, (ir.Map, ir.Join)) and node.value is not None:
        try:
            expr.parse(node.value)
        except expr.ExpressionError as e:
            raise BadExpression(node.id, str(e)) from e
    elif isinstance(node, ir.Udf):
        _duration(node.id, node.timeout)
        if node.module.startswith("oci://"):
            raise InvalidUdf(node.id, "modules come from a path, a file:// URI or package.module:function")
        try:
            memory_bytes(node.max_memory or "64Mi")
        except ValueError as e:
            raise InvalidUdf(node.id, f"max_memory: {e}") from e


def _edges(p: ir.Pipeline) -> None:
    outputs = {n.id for n in [*p.sources, *p.transforms]}
    consumed: set[str] = set()
    for node in [*p.transforms, *p.sinks]:
        for i in ir.inputs(node):
            if i not in outputs:
                raise UnknownInput(i)
            if i in consumed:
                raise MultipleConsumers(i)
            consumed.add(i)


def _reachable(p: ir.Pipeline) -> None:
    seen = {s.id for s in p.sources}
    more = True
    while more:
        new = {t.id for t in p.transforms if t.id not in seen and any(i in seen for i in ir.inputs(t))}
        seen |= new
        more = bool(new)
    for t in p.transforms:
        if t.id not in seen:
            raise Unreachable(t.id)


def _joins(p: ir.Pipeline) -> None:
    windows = {t.id: t for t in p.transforms if isinstance(t, ir.Window)}
    joins = {t.id: t for t in p.transforms if isinstance(t, ir.Join)}
    for j in joins.values():
        if j.max_groups == 0:
            raise InvalidJoin(j.id, "max_groups is at least 1")
        shapes = set()
        for i in j.inputs:
            if i not in windows:
                raise InvalidJoin(j.id, f"its input {i} is no window")
            w = windows[i]
            # lengths count, not how they are written
            shapes.add((tuple(w.group_by), nanoseconds(w.size), nanoseconds(w.slide or w.size)))
        if len(shapes) > 1:
            raise InvalidJoin(j.id, "its inputs differ in group_by, size or slide")
    for s in p.sinks:
        if s.input in joins and joins[s.input].value is None:
            raise InvalidJoin(s.input, "without a value it only aligns its inputs, for a transform and not a sink")
