"""One budgeted page over one signal kind, in residency order, as one plan.

Filters never change what a page costs: every record up to the stop is examined, so the match is a column and not a
``where``. Rows are numbered after a bounded ``orderBy(key).limit(scan + 64)`` (a top-k, no global sort of the data),
so the windows over one partition hold at most that many rows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions.cursor import Cursor, Entity, Key, fingerprint
from glimmer.sources.tables import KEY

#: Records that a walk pulls at a time; it fixes how far past its stop a page can see.
PULL = 64
MOST = 2**62


@dataclass(frozen=True)
class Budget:
    max_results: int = 1_000
    max_bytes: int = 4 << 20
    max_scan: int = 100_000
    max_aggregation_bytes: int = 4 << 20
    deadline_s: float = 30.0


@dataclass(frozen=True)
class Refused:
    dimension: str
    limit: int
    observed: int


@dataclass
class Page:
    items: list = field(default_factory=list)
    outcome: str = "complete"  # complete, degraded, refused
    dimension: str | None = None
    omitted: int = 0
    coverage: list[str] = field(default_factory=list)
    examined: int = 0
    bytes_spent: int = 0
    cursor: bytes | None = None
    refusal: Refused | None = None


def after(key: Key) -> Column:
    """Rows whose key is greater."""
    e = key.entity
    given = F.struct(F.lit(key.admitted_at).cast("long").alias("admitted_at"), F.lit(e.tag).alias("tag"), F.lit(e.trace_id).alias("trace_key"), F.lit(e.span_id).alias("span_key"), F.lit(e.serial).cast("long").alias("serial"))
    # the plain bound on the first column is implied; it is what reaches the scan
    return (F.col("admitted_at") >= key.admitted_at) & (F.struct(*KEY) > given)


def upto(key: Key) -> Column:
    return (F.col("admitted_at") <= key.admitted_at) & ~after(key)


def numbered(records: DataFrame, match: Column, max_scan: int, anchor: Key | None = None, snapshot: Key | None = None) -> DataFrame:
    """Rows in key order with n (position), m (matches so far), b (bytes of matches so far)."""
    if anchor is not None:
        records = records.where(after(anchor))
    if snapshot is not None:
        records = records.where(upto(snapshot))
    bounded = records.withColumn("match", match).orderBy(*KEY).limit(min(max_scan, MOST) + PULL if max_scan + PULL < 2**31 else 2**31 - 1)
    w = Window.orderBy(*KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bounded.select(
        "*",
        F.row_number().over(Window.orderBy(*KEY)).cast("long").alias("n"),
        F.sum(F.col("match").cast("long")).over(w).alias("m"),
        F.sum(F.when(F.col("match"), F.col("accounted_bytes")).otherwise(F.lit(0))).over(w).alias("b"),
    )


def stops(rows: DataFrame, budget: Budget) -> DataFrame:
    """``rows`` of ``numbered`` with the page's stops on each: i_r, i_b (first row over results, over bytes), total."""
    w = Window.partitionBy(F.lit(0))
    return rows.select(
        "*",
        F.coalesce(F.min(F.when(F.col("match") & (F.col("m") == budget.max_results + 1), F.col("n"))).over(w), F.lit(MOST)).alias("i_r"),
        F.coalesce(F.min(F.when(F.col("match") & (F.col("b") > budget.max_bytes), F.col("n"))).over(w), F.lit(MOST)).alias("i_b"),
        F.max("n").over(w).alias("total"),
    )


def page_rows(records: DataFrame, match: Column, budget: Budget, anchor: Key | None = None, snapshot: Key | None = None) -> DataFrame:
    """The page's items with its facts on each row: n, outcome, dimension, omitted, examined."""
    s = budget.max_scan
    rows = stops(numbered(records, match, s, anchor, snapshot), budget)
    w = Window.partitionBy(F.lit(0))
    wall = F.col("i_b") < F.col("i_r")
    omitted = F.count(F.when(F.col("match") & (F.col("n") >= F.col("i_b")) & (F.col("n") <= s), 1)).over(w)
    rows = rows.select("*", wall.alias("wall"), omitted.alias("over_wall"))
    stop_r = (F.col("i_r") <= F.col("i_b")) & (F.col("i_r") <= s)
    stop_b = F.col("wall") & (F.col("i_b") <= s)
    dimension = F.when(stop_r, "results").when(stop_b, "bytes").when(F.col("total") > s, "scan")
    examined = F.when(stop_r, F.col("i_r")).otherwise(F.least(F.col("total"), F.lit(s)))
    return (
        rows.select("*", dimension.alias("dimension"), examined.alias("examined"), F.when(stop_b, F.col("over_wall")).otherwise(F.lit(0)).alias("omitted"))
        .where(F.col("match") & (F.col("n") <= s) & (F.col("n") < F.least("i_r", "i_b")))
        .withColumn("outcome", F.when(F.col("dimension").isNull(), "complete").otherwise("degraded"))
    )


def _key(r) -> Key:
    return Key(r.admitted_at, Entity(r.tag, r.trace_key, r.span_key, r.serial))


def records_page(records: DataFrame, filters, budget: Budget, cursor: bytes | None = None, frontier: str = "resident") -> Page:
    """One page and what it spent.

    ``frontier``: "resident" fixes the snapshot at the last record resident when the first page ran; "batch" at the
    tail of the last batch of 64 that the first page pulled.
    """
    began = time.monotonic()
    mark = fingerprint(filters.canonical())
    held = Cursor.decode(cursor, mark) if cursor is not None else None
    page = Page()
    if budget.max_results == 0:
        return page
    anchor, snapshot = (held.anchor, held.snapshot) if held else (None, None)
    rows = numbered(records, filters.column(), budget.max_scan, anchor, snapshot).orderBy("n").collect()  # at most max_scan + 64
    first = None
    if snapshot is None and rows:
        if frontier == "resident":
            last = records.select(F.max(F.struct(*KEY)).alias("k")).first().k
            snapshot = _key(last)
        else:
            first = rows
    included, counting, stop = 0, False, None
    last_included = last_examined = last_counted = None
    for r in rows:
        if page.examined >= budget.max_scan:
            stop = "scan"
            break
        if time.monotonic() - began > budget.deadline_s:
            stop = "deadline"
            break
        page.examined += 1
        last_examined = r
        if not r.match:
            continue
        if counting:
            page.omitted += 1
            last_counted = r
            continue
        if included >= budget.max_results:
            stop = "results"
            break
        if page.bytes_spent + r.accounted_bytes > budget.max_bytes:
            counting, page.omitted, last_counted = True, 1, r
            continue
        page.items.append(r)
        included, last_included = included + 1, r
        page.bytes_spent += r.accounted_bytes
    if first is not None:
        n_stop = page.examined + (stop == "scan")
        at = min(len(first), PULL * -(-max(n_stop, 1) // PULL))
        snapshot = _key(first[at - 1])
    if counting:
        page.outcome, page.dimension, where = "degraded", "bytes", last_counted
        if stop in ("scan", "deadline"):
            page.coverage.append("uncounted_tail")
    elif stop == "results":
        page.outcome, page.dimension = "degraded", "results"
        where = last_included or (held.anchor if held else None) or last_examined
    elif stop in ("scan", "deadline"):
        if last_examined is None:
            page.outcome, page.refusal = "refused", Refused(stop, budget.max_scan, budget.max_scan)
            return page
        page.outcome, page.dimension, where = "degraded", stop, last_examined
    else:
        where = None
    if page.outcome == "degraded" and where is not None:
        at = where if isinstance(where, Key) else _key(where)
        page.cursor = Cursor(at, mark, snapshot).encode()
    if held is not None:
        newer = records.where(after(snapshot)).limit(1).count()
        if newer:
            page.coverage.append("snapshot_boundary")
        e = anchor.entity
        if not records.where((F.col("admitted_at") == anchor.admitted_at) & (F.col("tag") == e.tag) & (F.col("trace_key") == e.trace_id) & (F.col("span_key") == e.span_id) & (F.col("serial") == e.serial)).limit(1).count():
            page.coverage.append("eviction_gap")
    return page


def chain(records: DataFrame, filters, budget: Budget, max_pages: int = 16, max_entities: int = 10_000, **options) -> tuple[list, list[Page]]:
    """Follow cursors until complete, or until the page or entity guard stops the chain."""
    items: list = []
    pages: list[Page] = []
    cursor = None
    while len(pages) < max_pages and len(items) < max_entities:
        page = records_page(records, filters, budget, cursor, **options)
        pages.append(page)
        items += page.items
        cursor = page.cursor
        if cursor is None:
            break
    return items, pages
