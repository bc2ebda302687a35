"""Row shapes, result codes and the small configuration records operators take.

Configuration arrives as Python values, so every list here is bounded by what a
person writes down; data only ever arrives as a DataFrame.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column

ENVELOPE = (
    "batch_id string, data binary, format string, replay boolean, "
    "config_generation bigint, metadata map<string,string>, "
    "internal_labels map<string,string>"
)

# `ts` travels inside payloads as microseconds since 1970, `id` orders equal times.
POINT_JSON = (
    "struct<id:bigint,ts:bigint,name:string,value:double,labels:map<string,string>>"
)

DEAD_LETTER = (
    "batch_id string, data binary, format string, timestamp timestamp, "
    "error_code string, error_message string, fb_sender string, "
    "internal_labels map<string,string>, metadata map<string,string>"
)

HOST = (
    "hostname string, ip string, os string, architecture string, cpu_count int, "
    "total_memory bigint, processes map<int,struct<pid:int,command_line:string,"
    "user:string,start_time:timestamp,cpu_usage:double,memory_usage:bigint>>, "
    "collected_at timestamp"
)

# Result codes.
ERR_UNKNOWN = "ERR_UNKNOWN"
ERR_INVALID_INPUT = "ERR_INVALID_INPUT"
ERR_INVALID_CONFIG = "ERR_INVALID_CONFIG"
ERR_PROCESSING_FAILED = "ERR_PROCESSING_FAILED"
ERR_FORWARDING_FAILED = "ERR_FORWARDING_FAILED"
ERR_CIRCUIT_BREAKER_OPEN = "ERR_CIRCUIT_BREAKER_OPEN"
ERR_DLQ_SEND_FAILED = "ERR_DLQ_SEND_FAILED"
ERR_POISON_BATCH = "ERR_POISON_BATCH"
ERR_PII_LEAK = "ERR_PII_LEAK"
ERR_THROTTLED = "ERR_THROTTLED"
ERR_SERVICE_UNAVAILABLE = "ERR_SERVICE_UNAVAILABLE"
ERR_TIMEOUT = "ERR_TIMEOUT"

# Result states.
STATUS_UNKNOWN, STATUS_SUCCESS, STATUS_ERROR, STATUS_THROTTLED = 0, 1, 2, 3

# Fields treated as personal unless told otherwise.
DEFAULT_PII_FIELDS = ("command_line", "user_name", "email", "ip_address")

AGGREGATIONS = ("sum", "avg", "min", "max", "histogram")

# Aggregations added by the user: name to a builder from value column to aggregate column.
CUSTOM_AGGREGATIONS: dict[str, Callable[[Column], Column]] = {}


def register_aggregation(name: str, build: Callable[[Column], Column]) -> None:
    """Let rules use `name`; `build` gets the value column and returns an aggregate."""
    require(name not in AGGREGATIONS, f"{name} is a built-in aggregation")
    CUSTOM_AGGREGATIONS[name] = build


class ConfigError(ValueError):
    """A configuration value that no plan can be built from."""

    code = ERR_INVALID_CONFIG


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


@dataclass(frozen=True)
class AggRule:
    """Aggregate every point named `metric`, grouped by the listed labels."""

    metric: str
    type: str
    labels: Sequence[str] = ()
    buckets: Sequence[float] = ()

    def __post_init__(self) -> None:
        require(bool(self.metric), "aggregation rule has an empty metric name")
        require(
            self.type in AGGREGATIONS or self.type in CUSTOM_AGGREGATIONS,
            f"invalid aggregation type: {self.type}",
        )
        require(
            self.type != "histogram" or len(self.buckets) > 0,
            "a histogram rule needs buckets",
        )
        require(
            not any(math.isnan(b) for b in self.buckets), "a bucket bound is not a number"
        )

    @property
    def bounds(self) -> list[float]:
        return sorted(float(b) for b in self.buckets)


@dataclass(frozen=True)
class SampleRule:
    """Rows whose label matches `pattern` ("label=value") are kept at `rate`."""

    pattern: str
    rate: float = 1.0

    def __post_init__(self) -> None:
        require("=" in self.pattern, f"pattern is not label=value: {self.pattern}")
        require(0.0 <= self.rate <= 1.0, f"sample rate out of range: {self.rate}")

    @property
    def label(self) -> str:
        return self.pattern.split("=", 1)[0]

    @property
    def value(self) -> str:
        return self.pattern.split("=", 1)[1]


@dataclass(frozen=True)
class ClassRule:
    """Rows for which the SQL predicate holds get `category`; low priority first."""

    category: str
    predicate: str
    priority: int = 0
    labels: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Connection:
    """An edge to `target`, taken when the SQL predicate `filter` holds or is absent."""

    target: str
    filter: str | None = None


@dataclass(frozen=True)
class Endpoint:
    """A named file destination; `filter` selects its rows, `location` is its folder (the
    export's own where none is given)."""

    name: str
    format: str = "parquet"
    filter: str | None = None
    location: str | None = None

    def __post_init__(self) -> None:
        require(bool(self.name), "an export endpoint needs a name")
        require(
            self.format in ("parquet", "orc", "json"),
            f"unsupported export format: {self.format}",
        )


@dataclass(frozen=True)
class DedupConfig:
    keys: Sequence[str]
    ttl: str = "60m"
    enabled: bool = True

    def __post_init__(self) -> None:
        from gaugeworks.functions.clock import parse_duration

        require(not self.enabled or len(self.keys) > 0, "no deduplication keys")
        require(parse_duration(self.ttl) > 0, "the deduplication TTL must be positive")


@dataclass(frozen=True)
class PiiConfig:
    salt: str
    fields: Sequence[str] = DEFAULT_PII_FIELDS
    algorithm: str = "sha256"

    def __post_init__(self) -> None:
        require(bool(self.salt), "a salt is required to hash personal fields")
        require(self.algorithm == "sha256", f"unsupported hash: {self.algorithm}")
