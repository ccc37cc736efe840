"""Typed relations between signals: each strategy is one declarative join.

Inputs are the frames of ``glimmer.sources.tables``. A relation row has ``type``, the two ends (kind, trace, span,
serial) and ``facts`` (``name=value`` joined by ``;``). Equi joins are left to Catalyst, which broadcasts a side only
under its own size threshold; a subject's members are one trace and small, corpus-wide runs shuffle by trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions.columns import KIND_RANK, TYPE_RANK, valid_span, valid_trace
from glimmer.functions.shared import fixed

ENDS = ["from_kind", "from_trace", "from_span", "from_serial", "to_kind", "to_trace", "to_span", "to_serial"]


def _end(side: str, kind: str, trace: Column | None = None, span: Column | None = None, serial: Column | None = None) -> list[Column]:
    none = F.lit("")
    return [F.lit(kind).alias(f"{side}_kind"), (none if trace is None else trace).alias(f"{side}_trace"), (none if span is None else span).alias(f"{side}_span"), (F.lit(0) if serial is None else serial).cast("long").alias(f"{side}_serial")]


def members(spans: DataFrame, trace_id: str | None = None) -> DataFrame:
    """Spans with a natural identity, of one trace where it is given."""
    own = spans.where(valid_trace(F.col("trace_id")) & valid_span(F.col("span_id")))
    return own if trace_id is None else own.where(F.col("trace_id") == trace_id)


def _log_side(logs: DataFrame, trace_id: str | None) -> DataFrame:
    own = logs.where("trace_id is not null")
    return (own if trace_id is None else own.where(F.col("trace_id") == trace_id)).select("trace_id", F.col("span_id").alias("log_span"), F.col("serial").alias("log_serial"))


def span_identity(spans: DataFrame, logs: DataFrame, trace_id: str | None = None) -> DataFrame:
    """Logs that name a resident span exactly."""
    m = members(spans, trace_id).select("trace_id", "span_id")
    hit = _log_side(logs, trace_id).where("log_span is not null").join(m.withColumnRenamed("span_id", "log_span"), ["trace_id", "log_span"])
    return hit.select(F.lit("span_identity").alias("type"), *_end("from", "log", serial=F.col("log_serial")), *_end("to", "span", F.col("trace_id"), F.col("log_span")), F.concat(F.lit("trace_id="), "trace_id", F.lit(";span_id="), "log_span").alias("facts"))


def trace_identity(spans: DataFrame, logs: DataFrame, trace_id: str | None = None) -> DataFrame:
    """Logs of a trace whose exact span is not resident, to every member of the trace."""
    m = members(spans, trace_id).select("trace_id", "span_id")
    rest = _log_side(logs, trace_id).join(m.withColumnRenamed("span_id", "log_span"), ["trace_id", "log_span"], "left_anti")
    hit = rest.join(m, "trace_id")
    return hit.select(F.lit("trace_identity").alias("type"), *_end("from", "log", serial=F.col("log_serial")), *_end("to", "span", F.col("trace_id"), F.col("span_id")), F.concat(F.lit("trace_id="), "trace_id").alias("facts"))


def suppressions(spans: DataFrame, logs: DataFrame, trace_id: str | None = None) -> DataFrame:
    """For each exactly attached log, how many members its trace relation would have named besides."""
    m = members(spans, trace_id).select("trace_id", "span_id", F.count(F.lit(1)).over(Window.partitionBy("trace_id")).alias("n"))
    hit = _log_side(logs, trace_id).join(m.withColumnRenamed("span_id", "log_span"), ["trace_id", "log_span"])
    return hit.select("log_serial", "trace_id", F.col("log_span").alias("span_id"), (F.col("n") - 1).alias("suppressed"))


def absent_traces(spans: DataFrame, logs: DataFrame, trace_id: str | None = None) -> DataFrame:
    """Logs whose trace has no resident member."""
    return _log_side(logs, trace_id).join(members(spans, trace_id).select("trace_id").distinct(), "trace_id", "left_anti").select("log_serial", "trace_id")


def parent_child(spans: DataFrame) -> DataFrame:
    """Every resident child to its parent in the same trace; zero and self parents do not count."""
    own = members(spans)
    child = own.where(valid_span(F.col("parent_span_id")) & (F.col("parent_span_id") != F.col("span_id"))).select("trace_id", F.col("span_id").alias("child"), F.col("parent_span_id").alias("parent"))
    hit = child.join(own.select("trace_id", F.col("span_id").alias("parent")), ["trace_id", "parent"])
    return hit.select(F.lit("parent_child").alias("type"), *_end("from", "span", F.col("trace_id"), F.col("child")), *_end("to", "span", F.col("trace_id"), F.col("parent")), F.concat(F.lit("parent_span_id="), "parent").alias("facts"))


def signal_refs(spans: DataFrame, logs: DataFrame, points: DataFrame) -> DataFrame:
    """All three kinds as ends with their scan order: spans, logs, points, each in residency order."""
    cols = ["admitted_at", "tag", "trace_key", "span_key", "serial", "resource_key"]
    parts = [df.select(F.lit(k).alias("kind"), F.lit(KIND_RANK[k]).alias("kind_rank"), *cols) for k, df in (("span", spans), ("log", logs), ("point", points))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def resource_context(spans: DataFrame, logs: DataFrame, points: DataFrame, max_relations: int) -> DataFrame:
    """Unordered pairs within a resource, the first ``max_relations`` in generation order.

    Member i of a group of n starts n-1-i pairs, so a member's first pair has a known place in generation order
    without forming any pair: groups before it, then members before it. Members that start beyond the cap are dropped,
    and so are partners beyond it, before the join, which then forms at most the capped number of pairs.
    """
    refs = signal_refs(spans, logs, points)
    order = ["kind_rank", "admitted_at", "tag", "trace_key", "span_key", "serial"]
    sizes = refs.groupBy("resource_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a group gives a pair at least, so the first of them in order are enough, and the running sum is over those only
    groups = sizes.orderBy("resource_key").limit(max_relations).withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2).withColumn("group_at", F.coalesce(F.sum("pairs").over(Window.orderBy("resource_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).where(F.col("group_at") < max_relations)
    # a member past the cap+1st of its group can neither start nor end a kept pair of the first member; keep what may
    # (a bound on the number itself, so that Spark drops the others before the shuffle)
    numbered = refs.join(groups, "resource_key").withColumn("_n", F.row_number().over(Window.partitionBy("resource_key").orderBy(*order))).where(F.col("_n") <= max_relations + 1)
    ranked = fixed(numbered.withColumn("i", F.col("_n") - 1).drop("_n"))  # both sides of the join read it
    start = F.col("group_at") + F.col("i") * F.col("n") - F.col("i") * (F.col("i") + 1) / 2
    firsts = ranked.withColumn("start", start.cast("long")).where(F.col("start") < max_relations)
    a = firsts.select("resource_key", "start", *[F.col(c).alias(f"a_{c}") for c in ("i", "kind", "trace_key", "span_key", "serial")])
    b = ranked.select("resource_key", *[F.col(c).alias(f"b_{c}") for c in ("i", "kind", "trace_key", "span_key", "serial")])
    gen = (F.col("start") + F.col("b_i") - F.col("a_i") - 1).alias("gen_ord")
    pairs = a.join(b, "resource_key").where((F.col("a_i") < F.col("b_i")) & (F.col("start") + F.col("b_i") - F.col("a_i") - 1 < max_relations))
    return pairs.select(
        F.lit("resource_context").alias("type"),
        *[F.col(f"a_{s}").alias(f"from_{t}") for s, t in (("kind", "kind"), ("trace_key", "trace"), ("span_key", "span"), ("serial", "serial"))],
        *[F.col(f"b_{s}").alias(f"to_{t}") for s, t in (("kind", "kind"), ("trace_key", "trace"), ("span_key", "span"), ("serial", "serial"))],
        F.col("resource_key").alias("facts"),
        gen,
    )


def exemplar(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points whose exemplar names a resident span."""
    m = members(spans).select("trace_id", "span_id")
    e = points.select("serial", F.explode("exemplars").alias("e")).select("serial", "e.trace_id", "e.span_id").where("trace_id is not null and span_id is not null")
    return e.join(m, ["trace_id", "span_id"]).select(F.lit("exemplar").alias("type"), *_end("from", "point", serial=F.col("serial")), *_end("to", "span", F.col("trace_id"), F.col("span_id")), F.concat(F.lit("trace_id="), "trace_id", F.lit(";span_id="), "span_id").alias("facts"))


def temporal(spans: DataFrame, points: DataFrame, start: int, end: int, trace_id: str) -> DataFrame:
    """Member spans of a subject active in the window, to the points in it.

    Both sides are cut by the window first; once they are, every pair is in reach, so the join is the product of the
    two: one trace's spans, few thousands at most, by the points of the window. That product is the answer; a caller
    bounds it by ``capped``.
    """
    s = members(spans, trace_id).where((F.col("start_ns") < end) & (F.coalesce("end_ns", "start_ns") > start)).select(F.lit(1).alias("k"), "trace_id", "span_id")
    p = points.where((F.col("time_ns") >= start) & (F.col("time_ns") < end)).select(F.lit(1).alias("k"), "serial", "time_ns")
    return p.join(s, "k").select(F.lit("temporal").alias("type"), *_end("from", "span", F.col("trace_id"), F.col("span_id")), *_end("to", "point", serial=F.col("serial")), F.concat(F.lit("time="), F.col("time_ns").cast("string")).alias("facts"))


def ordered_key() -> list[Column]:
    """Relation order: type, then both ends (kind, assigned after spans, ids, serial)."""
    rank = F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv])
    kind = F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv])
    out = [rank[F.col("type")]]
    for side in ("from", "to"):
        out += [kind[F.col(f"{side}_kind")], F.when(F.col(f"{side}_kind") == "span", 0).otherwise(1), F.col(f"{side}_trace"), F.col(f"{side}_span"), F.col(f"{side}_serial")]
    return out


def shown_after(row) -> tuple:
    """``ordered_key`` of a collected row."""
    out = [TYPE_RANK[row["type"]]]
    for side in ("from", "to"):
        kind = row[f"{side}_kind"]
        out += [KIND_RANK[kind], int(kind != "span"), row[f"{side}_trace"], row[f"{side}_span"], row[f"{side}_serial"]]
    return tuple(out)


def capped(relations: DataFrame, generation: list[Column], max_relations: int) -> DataFrame:
    """The first ``max_relations`` in generation order (a top-k), to be sorted for show by ``ordered_key``."""
    return relations.orderBy(*generation).limit(max_relations)


def resident_ends(relations: DataFrame, refs: DataFrame) -> DataFrame:
    """Relations whose two ends are both among ``refs`` (kind, trace_key, span_key, serial)."""
    ids = refs.select("kind", "trace_key", "span_key", "serial")
    out = relations
    for side in ("from", "to"):
        there = ids.select(*[F.col(a).alias(f"{side}_{b}") for a, b in (("kind", "kind"), ("trace_key", "trace"), ("span_key", "span"), ("serial", "serial"))])
        out = out.join(there, [f"{side}_{b}" for b in ("kind", "trace", "span", "serial")], "left_semi")
    return out.select(*relations.columns)
