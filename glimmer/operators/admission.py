"""Admission laws in batch form: duplicates and conflicts, serials, interning, caps, budgets and shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions.shared import fixed

#: Limits of what one record or export may hold.
LIMITS = {
    "attributes": 256,
    "nested_attributes": 64,
    "attribute_entry_bytes": 4_096,
    "events": 128,
    "links": 32,
    "exemplars": 4,
    "depth": 8,
    "points_per_export": 10_000,
    "records_per_export": 10_000,
    "numbers_per_point": 100_000,
}


def outcomes(deliveries: DataFrame, key: list[str], arrival: list[str], payload: str, provenance: str | None = None) -> DataFrame:
    """``deliveries`` with outcome (admitted, collapsed, conflict) and drift.

    The first arrival of a natural key stands; an equal later payload collapses into it, any other is a conflict.
    Drift is a collapse whose provenance differs from the first's. One shuffle by key; a hot key's rows stream
    through the window's running first value.
    """
    w = Window.partitionBy(*key).orderBy(*arrival)
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = deliveries.select("*", F.row_number().over(w).alias("_n"), first(payload).alias("_first"), (first(provenance) if provenance else F.lit(None)).alias("_from"))
    outcome = F.when(F.col("_n") == 1, "admitted").when(F.col(payload).eqNullSafe(F.col("_first")), "collapsed").otherwise("conflict")
    drift = (outcome == "collapsed") & ~F.col(provenance).eqNullSafe(F.col("_from")) if provenance else F.lit(False)
    return out.select(*deliveries.columns, outcome.alias("outcome"), drift.alias("drift"))


def anomalies(outcome_rows: DataFrame) -> DataFrame:
    return outcome_rows.agg(F.count(F.when(F.col("outcome") == "conflict", 1)).alias("conflicts"), F.count(F.when(F.col("drift"), 1)).alias("drifts"), F.count(F.when(F.col("outcome") == "collapsed", 1)).alias("collapsed"))


def with_serials(records: DataFrame, order: list[str], first: int = 1, to: str = "assigned") -> DataFrame:
    """Serials in arrival order without a window: rows are ranged and sorted by ``order`` and fixed in that state, so a
    row's place in its range is its running id there; each range starts where the ones before it end."""
    ranged = fixed(records.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_place", 33)
    counts = sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    begin, at = [], first
    for k, n in counts:
        begin.append((k, at))
        at += n
    begins = records.sparkSession.createDataFrame(begin, "_part long, _begin long")  # a row for each partition
    rows = ranged.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return rows.withColumn(to, F.col("_begin") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_place", "_begin")


def export_cap(records: DataFrame, export: str, cap: int) -> DataFrame:
    """Records of exports within the cap; a larger export is refused whole. Two aggregations, no window over a
    possibly huge export."""
    over = records.groupBy(export).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap).select(export)
    return records.join(over, export, "left_anti")


def partial_success(rejected: DataFrame, export: str, position: str, reason: str, most: int = 64) -> DataFrame:
    """Per export: how many were rejected, and the first positions with their reasons."""
    w = Window.partitionBy(export).orderBy(position)
    ranked = rejected.select(export, position, reason, F.row_number().over(w).alias("_n"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", F.concat(F.col(position).cast("string"), F.lit(": "), F.col(reason)).alias("t"))))), lambda x: x["t"]), "; ")
    return ranked.groupBy(export).agg(F.count(F.lit(1)).alias("rejected"), told.alias("summary"))


def first_violation(checks: list[tuple[str, Column]]) -> Column:
    """Slug of the first check that fails, else null."""
    return F.coalesce(*[F.when(bad, F.lit(slug)) for slug, bad in checks])


def shape_violation(kind: Column, shape: Column, has_start: Column, has_temporality: Column) -> Column:
    """Kind and shape agree, all but gauges have a start, and exactly sums and histograms have a temporality."""
    expected = F.when(kind.isin("Gauge", "Sum"), "Number").otherwise(kind)
    needs = kind.isin("Sum", "Histogram", "ExponentialHistogram")
    return first_violation([("shape_mismatch", shape != expected), ("start_time_missing", (kind != "Gauge") & ~has_start), ("temporality_missing", needs & ~has_temporality), ("temporality_unexpected", ~needs & has_temporality)])
