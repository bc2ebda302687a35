"""Time helpers: durations as text, instants as microseconds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Microseconds per unit.
_UNIT = {
    "ns": 0.001,
    "us": 1,
    "µs": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "m": 60_000_000,
    "h": 3_600_000_000,
    "d": 86_400_000_000,
}
_PART = re.compile(r"(\d+(?:\.\d+)?|\.\d+)(ns|us|µs|ms|s|m|h|d)")


def parse_duration(text: str) -> int:
    """Microseconds in "90s", "1h30m", "2d"; a leading minus is allowed."""
    body = text.strip()
    sign = -1 if body.startswith("-") else 1
    body = body.lstrip("+-")
    if body == "0":
        return 0
    total, end = 0.0, 0
    for part in _PART.finditer(body):
        if part.start() != end:
            raise ValueError(f"not a duration: {text!r}")
        total += float(part.group(1)) * _UNIT[part.group(2)]
        end = part.end()
    if end == 0 or end != len(body):
        raise ValueError(f"not a duration: {text!r}")
    return sign * round(total)


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp column."""
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def instant(us: Column) -> Column:
    return F.timestamp_micros(us)
