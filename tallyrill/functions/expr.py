"""The closed numeric expression language: parsed once, then compiled to Catalyst columns.

Literals are digits with an optional fraction; names are attributes (dots belong to them) or ``value``; operators, from
loose to tight: ``+ -``, ``* / %``, unary ``-``, ``^`` (to the right). Arithmetic is IEEE 754 double arithmetic and never
fails: a zero divisor gives an infinity or NaN, which only the end result is tested for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .record import fault, lookup, numeric

MAX_TOKENS, MAX_DEPTH = 1024, 64
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>[-+*/%^()]))")
#: Levels of operators that go to the left, from loose to tight; beyond them there are negation and powers.
_LEVELS = (("+", "-"), ("*", "/", "%"))
#: The most operations of a chain that are written out (longer ones are folded), and functions with variables nested in a projection.
CHAIN, NESTED = 6, 12


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Literal:
    number: float


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Negate:
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


Node = Literal | Name | Negate | Binary


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character {text[at:].lstrip()[0]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        if len(out) > MAX_TOKENS:
            raise ExpressionError(f"more than {MAX_TOKENS} tokens")
        at = m.end()
        if m.lastgroup == "number" and text[at : at + 1] == ".":
            raise ExpressionError("a number can't end in a dot")
    return out


class _Descent:
    """Recursive descent, a method for each level. ``depth`` is how many operands, signs and parentheses enclose a place."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def next_is(self, *ops: str) -> str | None:
        """Takes the next token if it is one of the operators."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def chain(self, level: int, depth: int) -> Node:
        if level == len(_LEVELS):
            return self.signed(depth)
        out = self.chain(level + 1, depth)
        while op := self.next_is(*_LEVELS[level]):
            out = Binary(op, out, self.chain(level + 1, depth + 1))
        return out

    def signed(self, depth: int) -> Node:
        if depth > MAX_DEPTH:
            raise ExpressionError(f"nested deeper than {MAX_DEPTH}")
        if self.next_is("-"):
            return Negate(self.signed(depth + 1))
        base = self.single(depth)
        return Binary("^", base, self.signed(depth + 1)) if self.next_is("^") else base

    def single(self, depth: int) -> Node:
        if self.next_is("("):
            inner = self.chain(0, depth + 1)
            if not self.next_is(")"):
                raise ExpressionError("a closing parenthesis or an operator is missing")
            return inner
        if self.at == len(self.tokens):
            raise ExpressionError("it ends too early")
        kind, text = self.tokens[self.at]
        if kind == "op":
            raise ExpressionError(f"unexpected {text!r}")
        self.at += 1
        return Literal(float(text)) if kind == "number" else Name(text)


def parse(text: str) -> Node:
    d = _Descent(_tokens(text))
    out = d.chain(0, 0)
    if d.at < len(d.tokens):
        raise ExpressionError(f"unexpected {d.tokens[d.at][1]!r}")
    return out


def in_order(node: Node) -> Iterator[Node]:
    """All nodes, operands before their operator, the left ones first; a stack of its own, as chains are long."""
    todo: list[tuple[Node, bool]] = [(node, False)]
    while todo:
        n, ready = todo.pop()
        if ready or isinstance(n, Literal | Name):
            yield n
            continue
        todo.append((n, True))
        todo += [(n.of, False)] if isinstance(n, Negate) else [(n.right, False), (n.left, False)]


def names(node: Node) -> set[str]:
    return {n.name for n in in_order(node) if isinstance(n, Name)}


def attribute(name: str) -> tuple[Column, Column]:
    """The number that a name stands for in a record, and its fault."""
    if name == "value":
        return F.col("value"), F.lit(None).cast("string")
    a = lookup(name)
    return numeric(a), fault(a)


def _leaf(n: Node) -> bool:
    return isinstance(n, Literal | Name)


def _literal(d: float) -> str:
    return "double('Infinity')" if d == float("inf") else f"{d!r}D"


def _step(op: str, a: str, b: str) -> str:
    """An operation by IEEE 754, in SQL; the operands of a quotient or power are written down twice or more."""
    if op == "/":  # Spark has no quotient for a zero divisor; its power -1 is the infinity of its sign
        return f"coalesce(try_divide({a}, {b}), {a} * power({b}, -1D))"
    if op == "%":
        return f"coalesce(try_mod({a}, {b}), double('NaN'))"
    if op == "^":  # these are 1, but NaN in Java
        return f"CASE WHEN {a} = 1D OR ({a} = -1D AND abs({b}) = double('Infinity')) THEN 1D ELSE power({a}, {b}) END"
    return f"({a} {op} {b})"


class _Compiler:
    """SQL in which each operand is written down once unless it is a name or a literal, and whose depth grows with nesting only.

    An operand that is needed several times is the field of one array's only element; long chains are folds over an array.
    Spark resolves such functions a level at a time, so deep ones are computed by projections before.
    """

    def __init__(self, df: DataFrame, node: Node, number: dict[str, int]):
        self.df, self.count = df, 0
        # names that are read again and again are fields of one more variable, as an optimizer would write them out at each place
        often = sum(isinstance(n, Name) for n in in_order(node)) > 2 * CHAIN
        self.columns = {n: f"_names.x{i}" if often else f"_x{i}" for n, i in number.items()}
        self.fields = ", ".join(f"_x{i} AS x{i}" for i in number.values()) if often else ""

    def whole(self, sql: str) -> Column:
        return F.expr(f"transform(array(struct({self.fields})), _names -> {sql})[0]" if self.fields else sql)

    def new(self, kind: str) -> str:
        self.count += 1
        return f"_{kind}{self.count}"

    def of(self, n: Node) -> tuple[str, int]:
        """SQL and how many functions with variables are nested in it."""
        if isinstance(n, Literal):
            return _literal(n.number), 0
        if isinstance(n, Name):
            return self.columns[n.name], 0
        if isinstance(n, Negate):
            sql, high = self.of(n.of)
            return f"(- {sql})", high
        sql, high = self.powers(n) if n.op == "^" else self.chain(n)
        if high >= NESTED:
            name = self.new("s")
            self.df = self.df.withColumn(name, self.whole(sql))
            return name, 0
        return sql, high

    def bound(self, op: str, a: tuple[str, int], b: tuple[str, int]) -> tuple[str, int]:
        p = self.new("p")
        return f"transform(array(struct({a[0]} AS a, {b[0]} AS b)), {p} -> {_step(op, f'{p}.a', f'{p}.b')})[0]", max(a[1], b[1]) + 1

    def powers(self, n: Binary) -> tuple[str, int]:
        """Powers go to the right: from the last exponent to the first base, each exponent with its sign."""
        items: list[tuple[Node, int]] = []
        rest: Node = n
        while isinstance(rest, Binary) and rest.op == "^":
            base, rest, sign = rest.left, rest.right, 1
            while isinstance(rest, Negate):
                rest, sign = rest.of, -sign
            items.append((base, sign))
        if len(items) > CHAIN:
            each = [(self.of(base), sign) for base, sign in reversed(items)]
            start, high = self.of(rest)
            acc, item = self.new("a"), self.new("i")
            array = ", ".join(f"struct({sql} AS v, {sign}D AS s)" for (sql, _), sign in each)
            return f"aggregate(array({array}), CAST({start} AS DOUBLE), ({acc}, {item}) -> {_step('^', f'{item}.v', f'({acc} * {item}.s)')})", max(high, *(h for (_, h), _ in each)) + 1
        a, b = self.of(n.left), self.of(n.right)
        if isinstance(n.right, Literal) or isinstance(n.left, Literal) and n.left.number != 1:
            return f"power({a[0]}, {b[0]})", max(a[1], b[1])  # no case in which Java's power differs
        if _leaf(n.left) and _leaf(n.right):
            return _step("^", a[0], b[0]), 0
        return self.bound("^", a, b)

    def chain(self, n: Binary) -> tuple[str, int]:
        level = next(x for x in _LEVELS if n.op in x)
        chain: list[tuple[str, Node]] = []
        rest: Node = n
        while isinstance(rest, Binary) and rest.op in level:
            chain.append((rest.op, rest.right))
            rest = rest.left
        chain.reverse()
        out, leaf = self.of(rest), _leaf(rest)
        each = [(op, right, self.of(right)) for op, right in chain]
        if len(chain) > CHAIN:
            acc, item = self.new("a"), self.new("i")
            array = ", ".join(f"struct({level.index(op)} AS op, {sql} AS v)" for op, _, (sql, _) in each)
            cases = " ".join(f"WHEN {k} THEN {_step(op, acc, f'{item}.v')}" for k, op in enumerate(level))
            return f"aggregate(array({array}), CAST({out[0]} AS DOUBLE), ({acc}, {item}) -> CASE {item}.op {cases} END)", max(out[1], *(h for *_, (_, h) in each)) + 1
        for op, right, b in each:
            if op != "/" or isinstance(right, Literal) and right.number:
                out = f"({out[0]} / {b[0]})" if op == "/" else _step(op, out[0], b[0]), max(out[1], b[1])
            elif leaf and _leaf(right):
                out = _step("/", out[0], b[0]), 0
            else:
                out = self.bound("/", out, b)
            leaf = False
        return out


def evaluated(df: DataFrame, node: Node, resolve: Callable[[str], tuple[Column, Column]] = attribute) -> DataFrame:
    """``df`` with ``_new``, the result, and ``_fault``, the first fault in reading order: ``missing``, ``invalid`` (also of a result that isn't finite) or null."""
    own = list(df.columns)
    number = {n: i for i, n in enumerate(dict.fromkeys(n.name for n in in_order(node) if isinstance(n, Name)))}
    read = {n: resolve(n) for n in number}
    if number:
        df = df.withColumns({f"_x{i}": read[n][0] for n, i in number.items()} | {f"_f{i}": read[n][1] for n, i in number.items()})
    compiler = _Compiler(df, node, number)
    sql, _ = compiler.of(node)
    df = compiler.df.withColumn("_new", compiler.whole(sql))
    # not a number sorts after the infinity
    endless = F.when(~(F.abs("_new") < F.lit(float("inf"))), F.lit("invalid"))
    return df.select(*own, "_new", F.coalesce(*(F.col(f"_f{i}") for i in number.values()), endless).alias("_fault"))
