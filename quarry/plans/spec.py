"""What a user declares about a source. Wrong declarations fail when they are made."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

KINDS = ("string", "integer", "float", "boolean")
PARSERS = ("plain", "json", "docker_json", "cri", "journal", "winlog", "otlp")
FORMATS = ("unix_s", "unix_ms", "unix_us", "unix_ns", "rfc3339")
#: Nanoseconds of one tick, by the names of the resolution.
TICKS = {"s": 10**9, "sec": 10**9, "second": 10**9, "ms": 10**6, "milli": 10**6, "millisecond": 10**6, "us": 10**3, "micro": 10**3, "microsecond": 10**3, "ns": 1, "nano": 1, "nanosecond": 1}


def expand(text: str) -> str:
    """${VAR} from the environment; an unset one is an error."""

    def value(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise ValueError(f"environment variable {m[1]} is not set")
        return os.environ[m[1]]

    return re.sub(r"\$\{(\w+)\}", value, text)


@dataclass(frozen=True)
class Filter:
    field: str
    equals: str
    drop: bool = True

    def __post_init__(self):
        if not self.field or not self.equals:
            raise ValueError("a filter needs field and equals")


@dataclass(frozen=True)
class Sample:
    rate: int
    field: str | None = None
    equals: str | None = None

    def __post_init__(self):
        if self.rate < 1 or (self.field is None) != (self.equals is None):
            raise ValueError("a sample needs a rate of at least 1, and field and equals both or neither")


@dataclass(frozen=True)
class Redact:
    field: str
    pattern: str
    replacement: str = "***"

    def __post_init__(self):
        re.compile(self.pattern)
        if re.search(r"\(\?<?[=!]", self.pattern):
            raise ValueError("patterns have no look-around")


@dataclass(frozen=True)
class Multiline:
    starts_with: str
    max_lines: int = 500
    max_bytes: int = 65_536
    timeout_ms: int = 1_000

    def __post_init__(self):
        re.compile(self.starts_with)


@dataclass(frozen=True)
class SourceSpec:
    name: str
    table: str
    parser: str = "plain"
    timestamp_field: str | None = None
    timestamp_format: str = "unix_ms"
    resolution: str = "ms"
    tags: tuple[str, ...] = ()
    tags_static: dict[str, str] = field(default_factory=dict)
    fields: dict[str, str] = field(default_factory=dict)
    visibility: str | None = None
    multiline: Multiline | None = None
    filters: tuple[Filter, ...] = ()
    samples: tuple[Sample, ...] = ()
    redactions: tuple[Redact, ...] = ()
    kubernetes: bool = False
    labels: tuple[str, ...] = ()
    batch_lines: int = 5_000
    max_bytes: int = 1 << 20

    def __post_init__(self):
        if not self.name or not self.table:
            raise ValueError("a source needs a name and a table")
        if self.parser not in PARSERS:
            raise ValueError(f"unknown parser {self.parser!r}")
        if self.timestamp_format not in FORMATS:
            raise ValueError(f"unknown timestamp format {self.timestamp_format!r}")
        if self.resolution not in TICKS:
            raise ValueError(f"unknown resolution {self.resolution!r}")
        if bad := [k for k in self.fields.values() if k not in KINDS]:
            raise ValueError(f"unknown field types {bad}")
        if self.multiline and self.parser in ("docker_json", "cri"):
            raise ValueError("container parsers frame lines themselves; they take no multiline rule")
        object.__setattr__(self, "tags_static", {k: expand(v) for k, v in self.tags_static.items()})

    @property
    def tick_ns(self) -> int:
        return TICKS[self.resolution]


@dataclass(frozen=True)
class WatermarkSpec:
    floor_ns: int = 100 * 10**6
    ceiling_ns: int = 60 * 10**9
    window: int = 4096
    least: int = 256
    quantile: float = 0.999


COLLECTORS = ("cpu", "mem", "swap", "disk", "diskio", "net", "system")


@dataclass(frozen=True)
class MetricsSpec:
    collectors: tuple[str, ...] = COLLECTORS
    interval_s: int = 10
    tags_static: dict[str, str] = field(default_factory=dict)
    fields_static: dict[str, str | int | float | bool] = field(default_factory=dict)

    def __post_init__(self):
        if bad := [c for c in self.collectors if c not in COLLECTORS]:
            raise ValueError(f"unknown collectors {bad}")


def validate(sources: list[SourceSpec]) -> list[SourceSpec]:
    """Sources as a whole: at least one, and no name twice."""
    names = [s.name for s in sources]
    if not names:
        raise ValueError("nothing is configured")
    if len(set(names)) < len(names):
        raise ValueError("source names must differ")
    return sources
