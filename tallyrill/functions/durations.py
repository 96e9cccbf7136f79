"""Durations such as ``1h 30m`` or ``250ms``, and memory sizes such as ``64Mi``."""

from __future__ import annotations

import re

_SECOND = 1_000_000_000
#: The names of the units and their nanoseconds; months and years are 30.44 and 365.25 days.
_UNITS = {
    "nanos": 1, "nsec": 1, "ns": 1, "usec": 1_000, "us": 1_000, "µs": 1_000, "millis": 1_000_000, "msec": 1_000_000, "ms": 1_000_000,
    "seconds": _SECOND, "second": _SECOND, "secs": _SECOND, "sec": _SECOND, "s": _SECOND, "minutes": 60 * _SECOND, "minute": 60 * _SECOND, "mins": 60 * _SECOND, "min": 60 * _SECOND, "m": 60 * _SECOND,
    "hours": 3600 * _SECOND, "hour": 3600 * _SECOND, "hrs": 3600 * _SECOND, "hr": 3600 * _SECOND, "h": 3600 * _SECOND, "days": 86400 * _SECOND, "day": 86400 * _SECOND, "d": 86400 * _SECOND,
    "weeks": 604800 * _SECOND, "week": 604800 * _SECOND, "wk": 604800 * _SECOND, "w": 604800 * _SECOND, "months": 2_630_016 * _SECOND, "month": 2_630_016 * _SECOND, "M": 2_630_016 * _SECOND,
    "years": 31_557_600 * _SECOND, "year": 31_557_600 * _SECOND, "y": 31_557_600 * _SECOND,
}
_PART = re.compile(r"\s*(\d+)\s*([a-zA-Zµ]+)")
_SIZE = re.compile(r"(\d+)\s*(Ki|Mi|Gi|Ti)?B?")


def nanoseconds(text: str) -> int:
    """The nanoseconds of a duration; ValueError if it isn't one."""
    text = str(text)
    if text.strip() == "0":
        return 0
    total, at = 0, 0
    while m := _PART.match(text, at):
        if m[2] not in _UNITS:
            raise ValueError(f"unknown time unit {m[2]!r}")
        total += int(m[1]) * _UNITS[m[2]]
        at = m.end()
    if not at or text[at:].strip():
        raise ValueError("a number and a unit are expected, such as 5s or 200ms")
    return total


def memory_bytes(text: str | int) -> int:
    """The bytes of a memory size, in binary units."""
    m = _SIZE.fullmatch(str(text).strip())
    if not m or not int(m[1]):
        raise ValueError("a positive number of bytes is expected, or one such as 64Mi")
    return int(m[1]) << {None: 0, "Ki": 10, "Mi": 20, "Gi": 30, "Ti": 40}[m[2]]
