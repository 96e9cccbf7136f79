"""The record, which is the only row type, and Column expressions over its typed attributes."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A typed attribute value: t tells which field holds it, so 1 and "1" are different keys and a missing one is null.
ATTR = "struct<t:tinyint,b:boolean,i:bigint,d:double,s:string>"
BOOL, INT, DOUBLE, STR = 1, 2, 3, 4
FIELDS = ("ts_nanos", "start_ts_nanos", "resource", "scope", "name", "value", "attrs")
RECORD = f"ts_nanos bigint, start_ts_nanos bigint, resource map<string,{ATTR}>, scope string, name string, value double, attrs map<string,{ATTR}>"
#: Besides the fields of RECORD a frame may have SEQ, the order of arrival, which first names, lateness, caps and counters go by.
SEQ = "_seq"
#: In a stream, what orders the records of one micro-batch that come from several files.
ARRIVAL = "_arrival"


def attr(value: Column, kind: int) -> Column:
    """A typed value, null if the column is."""
    null = lambda t: F.lit(None).cast(t)
    fields = [
        F.lit(kind).cast("tinyint").alias("t"),
        (value if kind == BOOL else null("boolean")).alias("b"),
        (value.cast("bigint") if kind == INT else null("bigint")).alias("i"),
        (value.cast("double") if kind == DOUBLE else null("double")).alias("d"),
        (value if kind == STR else null("string")).alias("s"),
    ]
    return F.when(value.isNotNull(), F.struct(*fields))


def attr_of(value: Any) -> Column:
    kind = BOOL if isinstance(value, bool) else INT if isinstance(value, int) else DOUBLE if isinstance(value, float) else STR
    return attr(F.lit(value), kind)


def attr_map(pairs: dict[str, Column]) -> Column:
    """A map of typed values. A null one is a missing attribute: it isn't filtered out, so that reading a key reduces to its column, and unread columns aren't scanned."""
    if not pairs:
        return F.create_map().cast(f"map<string,{ATTR}>")
    return F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v)))


def entries(attrs: str) -> Column:
    """The attributes that are there, in order of their keys."""
    return F.sort_array(F.filter(F.map_entries(attrs), lambda p: p["value"].isNotNull()))


def lookup(key: str) -> Column:
    """The attribute, or the resource's one of that name, or null."""
    return F.coalesce(F.col("attrs").getItem(key), F.col("resource").getItem(key))


def numeric(a: Column) -> Column:
    """The number in a typed value; null for other types."""
    return F.when(a["t"] == INT, a["i"].cast("double")).when(a["t"] == DOUBLE, a["d"])


def fault(a: Column) -> Column:
    """``missing``, ``invalid`` (there, but no number) or null."""
    return F.when(a.isNull(), F.lit("missing")).when(~a["t"].isin(INT, DOUBLE), F.lit("invalid"))


def display_double(d: Column) -> Column:
    """A double without an exponent, and without a fraction if it has none."""
    text = F.abs(d).cast("string")
    mantissa, power = F.split_part(text, F.lit("E"), F.lit(1)), F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    n = F.length(digits)
    large = F.when(n <= power + 1, F.rpad(digits, power + 1, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.when(power.isNull(), F.regexp_replace(text, r"\.0$", "")).when(power >= 0, large).otherwise(small)
    sign = F.when(d.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.when(F.isnan(d), F.lit("NaN")).when(F.abs(d) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, plain))


def display(a: Column) -> Column:
    """A typed value as text: filters compare it and the text sink prints it."""
    return F.when(a["t"] == BOOL, a["b"].cast("string")).when(a["t"] == INT, a["i"].cast("string")).when(a["t"] == DOUBLE, display_double(a["d"])).when(a["t"] == STR, a["s"])


def record(df: DataFrame, *, ts_nanos: Column, name: Column, value: Column, attrs: dict[str, Column] | Column, seq: Column | None = None, resource: dict[str, Column] | Column | None = None, scope: Column | None = None, start_ts_nanos: Column | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Records from any frame."""
    maps = [m if isinstance(m, Column) else attr_map(m or {}) for m in (resource, attrs)]
    null = F.lit(None)
    return df.select(
        ts_nanos.cast("bigint").alias("ts_nanos"),
        (null if start_ts_nanos is None else start_ts_nanos).cast("bigint").alias("start_ts_nanos"),
        maps[0].alias("resource"),
        (null if scope is None else scope).cast("string").alias("scope"),
        name.alias("name"),
        value.cast("double").alias("value"),
        maps[1].alias("attrs"),
        *([] if seq is None else [seq.cast("bigint").alias(SEQ)]),
        *more,
    )


def to_python(a: Any) -> Any:
    """The value in a typed value's row or dict."""
    a = a if isinstance(a, dict) else a.asDict()
    return {BOOL: a["b"], INT: a["i"], DOUBLE: a["d"], STR: a["s"]}[a["t"]]


def from_python(value: Any) -> dict:
    out = dict.fromkeys("bids") | {"t": BOOL if isinstance(value, bool) else INT if isinstance(value, int) else DOUBLE if isinstance(value, float) else STR}
    out[{BOOL: "b", INT: "i", DOUBLE: "d", STR: "s"}[out["t"]]] = value
    return {k: out[k] for k in ("t", "b", "i", "d", "s")}


def schema() -> T.StructType:
    return T._parse_datatype_string(RECORD)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
