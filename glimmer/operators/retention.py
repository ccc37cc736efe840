"""Retention: what stays of a bounded resident set, and an exact sequential law for what the sets can't say."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.sources.tables import KEY


@dataclass(frozen=True)
class Ceilings:
    records: int = 2_000_000
    bytes: int = 256 << 20
    window_ns: int = 24 * 3600 * 10**9
    series: int = 100_000


def surviving(records: DataFrame, ceilings: Ceilings, now_ns: int | None = None) -> DataFrame:
    """The longest suffix in residency order within all three ceilings.

    The newest ``records + 1`` rows are taken by a top-k first, so the running totals are over a bounded number of
    rows; a stream's identity is charged at its newest point, where a suffix that holds any of its points holds it.
    ``records`` needs KEY, accounted_bytes, and where they apply stream_key and identity_bytes.
    """
    cols = records.columns
    has = "identity_bytes" in cols
    back = [F.col(c).desc() for c in KEY]
    newest = records.orderBy(*back).limit(min(ceilings.records, 2**31 - 2) + 1)
    w = Window.orderBy(*back)
    charge = F.col("accounted_bytes")
    if has:
        charge = charge + F.when(F.row_number().over(Window.partitionBy("stream_key").orderBy(*back)) == 1, F.coalesce("identity_bytes", F.lit(0))).otherwise(F.lit(0))
    charged = newest.withColumn("_charge", charge)
    running = charged.select("*", F.row_number().over(w).alias("_count"), F.sum("_charge").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_total"), F.max("admitted_at").over(Window.partitionBy(F.lit(0))).alias("_last"))
    reading = F.greatest(F.col("_last"), F.lit(now_ns if now_ns is not None else 0))
    return running.where((F.col("_count") <= ceilings.records) & (F.col("_total") <= ceilings.bytes) & (reading - F.col("admitted_at") < ceilings.window_ns)).select(*cols)


def retention_tick_s(window_s: float) -> float:
    """Half the window, held between a second and a minute."""
    return min(max(window_s / 2, 1.0), 60.0)


@dataclass
class SequentialStore:
    """The exact law, one record at a time: refusals never evict, evictions go oldest first with a named cause.

    Records are dicts with key (tuple), identity (natural key or None), payload, bytes, and for points stream,
    stream_bytes. Used where identity depends on residency, as in the streaming ingest.
    """

    ceilings: Ceilings
    resident: dict = field(default_factory=dict)  # key -> record, insertion order is residency order
    identities: dict = field(default_factory=dict)
    streams: Counter = field(default_factory=Counter)
    stream_bytes: dict = field(default_factory=dict)
    total: int = 0
    counters: Counter = field(default_factory=Counter)

    def _evict(self, key, cause: str) -> None:
        r = self.resident.pop(key)
        self.total -= r["bytes"]
        if r.get("identity") is not None:
            self.identities.pop(r["identity"], None)
        if (s := r.get("stream")) is not None:
            self.streams[s] -= 1
            if not self.streams[s]:
                del self.streams[s]
                self.total -= self.stream_bytes.pop(s)
        self.counters[f"evicted_{cause}"] += 1

    def expire(self, now_ns: int) -> None:
        while self.resident:
            key = min(self.resident)
            if len(self.resident) > self.ceilings.records:
                cause = "records"
            elif self.total > self.ceilings.bytes:
                cause = "bytes"
            elif now_ns - key[0] >= self.ceilings.window_ns:
                cause = "window"
            else:
                return
            self._evict(key, cause)

    def keep(self, r: dict) -> str:
        """admitted, collapsed, conflict, duplicate, oversized, identity_over_ceiling or series_cap."""
        identity, known = r.get("identity"), None
        if identity is not None and identity in self.identities:
            known = self.resident[self.identities[identity]]
            out = "collapsed" if known["payload"] == r["payload"] else "conflict"
            self.counters[out] += 1
            return out
        if r["key"] in self.resident:
            out = "duplicate"
        elif r["bytes"] > self.ceilings.bytes:
            out = "oversized"
        elif (s := r.get("stream")) is not None and s not in self.streams and r["bytes"] + r["stream_bytes"] > self.ceilings.bytes:
            out = "identity_over_ceiling"
        elif s is not None and s not in self.streams and len(self.streams) >= self.ceilings.series:
            out = "series_cap"
        else:
            out = "admitted"
            self.resident[r["key"]] = r
            self.total += r["bytes"]
            if identity is not None:
                self.identities[identity] = r["key"]
            if s is not None:
                if s not in self.streams:
                    self.stream_bytes[s] = r["stream_bytes"]
                    self.total += r["stream_bytes"]
                self.streams[s] += 1
            self.expire(r["key"][0])
        self.counters[out] += 1
        return out

    def run(self, records: Iterable[dict]) -> list[str]:
        return [self.keep(r) for r in records]
