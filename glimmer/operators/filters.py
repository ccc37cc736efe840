"""Filters of records queries: conjunctive, per signal kind, absent never matches.

A filter is a frozen dataclass that builds a boolean column (never null) and its canonical bytes, which a cursor's
fingerprint is taken over. Severity can only be asked of logs: the span and point filters have no such field.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<Q", len(raw)) + raw


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class TimeRange:
    """Half-open; empty when start reaches end."""

    start: int
    end: int

    def column(self, at: Column) -> Column:
        return sure((at >= self.start) & (at < self.end))

    def canonical(self) -> bytes:
        return b"\x01" + struct.pack("<QQ", self.start, self.end)


@dataclass(frozen=True)
class Scope:
    """Exact name, and exact version with its absence: None matches only records without a version."""

    name: str
    version: str | None = None

    def column(self) -> Column:
        return sure((F.col("scope_name") == self.name) & F.col("scope_version").eqNullSafe(F.lit(self.version)))

    def canonical(self) -> bytes:
        return b"\x01" + _text(self.name) + (b"\x00" if self.version is None else b"\x01" + _text(self.version))


def time_key(kind: str) -> Column:
    return F.coalesce("ts_ns", "observed_ns") if kind == "log" else F.col("start_ns" if kind == "span" else "time_ns")


@dataclass(frozen=True)
class _Filters:
    service: str | None = None
    time: TimeRange | None = None
    scope: Scope | None = None
    kind = ""
    tag = 0

    def _parts(self) -> list[Column]:
        parts = []
        if self.service is not None:
            parts.append(sure(F.col("service_name") == self.service))
        if self.time is not None:
            parts.append(self.time.column(time_key(self.kind)))
        if self.scope is not None:
            parts.append(self.scope.column())
        return parts

    def column(self) -> Column:
        out = F.lit(True)
        for p in self._parts():
            out = out & p
        return out

    def _canonical_middle(self) -> bytes:
        return b""

    def canonical(self) -> bytes:
        """Tag and version, the kind, then each field in a fixed order with a presence byte."""
        body = b"\x00" if self.service is None else b"\x01" + _text(self.service)
        body += b"\x00" if self.time is None else self.time.canonical()
        body += self._canonical_middle()
        body += b"\x00" if self.scope is None else self.scope.canonical()
        return b"Q\x02" + bytes([self.tag]) + body


@dataclass(frozen=True)
class SpanFilters(_Filters):
    kind = "span"
    tag = 0


@dataclass(frozen=True)
class PointFilters(_Filters):
    kind = "point"
    tag = 2


@dataclass(frozen=True)
class LogFilters(_Filters):
    severity: int | None = None
    kind = "log"
    tag = 1

    def __post_init__(self):
        if self.severity is not None and not 1 <= self.severity <= 24:
            raise ValueError("a severity is a number from 1 to 24")

    def _parts(self) -> list[Column]:
        more = [] if self.severity is None else [sure(F.col("severity") >= self.severity)]
        return super()._parts() + more

    def _canonical_middle(self) -> bytes:
        return b"\x00" if self.severity is None else b"\x01" + bytes([self.severity])
