"""Subject resolution, the breadth-first waterfall and the depth-first tree of traces."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.operators.relations import members
from glimmer.sources.tables import KEY


def effective_roots(spans: DataFrame) -> DataFrame:
    """First parentless member of each trace in residency order (a zero parent is a parent)."""
    w = Window.partitionBy("trace_id").orderBy(*KEY)
    return members(spans).where("parent_span_id is null").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("trace_id", F.col("span_id").alias("root_span"))


def resolve_subjects(spans: DataFrame) -> DataFrame:
    """For every span as a requested root: the effective root and the note that goes with it."""
    roots = effective_roots(spans)
    own = spans.select("trace_id", "span_id")
    note = (
        F.when((F.col("trace_id") == "0" * 32) | (F.col("span_id") == "0" * 16), "root_has_no_valid_trace_identity")
        .when(F.col("root_span").isNull(), "no_parentless_span_resident")
        .when(F.col("root_span") == F.col("span_id"), "requested_span_is_root")
        .otherwise("trace_rooted_at")
    )
    return own.join(roots, "trace_id", "left").select("trace_id", "span_id", F.coalesce("root_span", "span_id").alias("root_span"), note.alias("note"))


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Breadth-first from the effective root in residency order, then the members it does not reach."""
    rows = rows.sort_values(KEY, kind="stable").reset_index(drop=True)
    ids, parents = rows.span_id.tolist(), [None if pd.isna(p) else p for p in rows.parent_span_id]
    children = defaultdict(list)
    for i, p in enumerate(parents):
        if p is not None and p != ids[i]:
            children[p].append(i)
    root = next((i for i, p in enumerate(parents) if p is None), 0)
    order, depth, queue, seen = [], {}, deque([(root, 0)]), {root}
    while queue:
        i, d = queue.popleft()
        order.append(i)
        depth[i] = d
        for j in children[ids[i]]:
            if j not in seen:
                seen.add(j)
                queue.append((j, d + 1))
    rest = [i for i in range(len(ids)) if i not in seen]
    at = order + rest
    return pd.DataFrame({"trace_id": rows.trace_id.iloc[at].values, "span_id": [ids[i] for i in at], "ordinal": range(1, len(at) + 1), "depth": [depth.get(i, -1) for i in at]})


def waterfall(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, ordinal, depth (-1: not reached): all traces at once, one shuffle by trace.

    A trace is one task's group; the engine's own ceilings bound it to thousands of spans.
    """
    cols = ["trace_id", "span_id", "parent_span_id", *KEY]
    return members(spans).select(*dict.fromkeys(cols)).groupBy("trace_id").applyInPandas(_walk, "trace_id string, span_id string, ordinal long, depth int")


def waterfall_of(spans: DataFrame, trace_id: str) -> DataFrame:
    """One subject's waterfall: span_id, depth (-1: not reached), ordinal. The trace is filtered first."""
    return waterfall(spans.where(F.col("trace_id") == trace_id)).select("span_id", "depth", "ordinal")


def _tree(rows: pd.DataFrame) -> pd.DataFrame:
    """Depth-first rows; roots and children by start time; a span whose parent is missing is a root too."""
    rows = rows.sort_values(["start_ns", *KEY], kind="stable").reset_index(drop=True)
    ids, parents = rows.span_id.tolist(), [None if pd.isna(p) else p for p in rows.parent_span_id]
    known = set(ids)
    children, roots = defaultdict(list), []
    for i, p in enumerate(parents):
        if p is None or p not in known or p == ids[i]:
            roots.append(i)
        else:
            children[p].append(i)
    out, stack, seen = [], [(i, 0) for i in reversed(roots)], set()
    while stack:
        i, d = stack.pop()
        if i in seen:
            continue
        seen.add(i)
        out.append((i, d, bool(children[ids[i]])))
        stack += [(j, d + 1) for j in reversed(children[ids[i]])]
    return pd.DataFrame({"trace_id": rows.trace_id.iloc[[o[0] for o in out]].values, "span_id": [ids[o[0]] for o in out], "row": range(1, len(out) + 1), "depth": [o[1] for o in out], "has_children": [o[2] for o in out]})


def tree(spans: DataFrame) -> DataFrame:
    cols = ["trace_id", "span_id", "parent_span_id", "start_ns", *KEY]
    return members(spans).select(*dict.fromkeys(cols)).groupBy("trace_id").applyInPandas(_tree, "trace_id string, span_id string, row long, depth int, has_children boolean")


def extents(spans: DataFrame) -> DataFrame:
    """Per trace: first start and last end, an open span ending where it starts."""
    return members(spans).groupBy("trace_id").agg(F.min("start_ns").alias("start_ns"), F.max(F.coalesce("end_ns", "start_ns")).alias("end_ns"))


def bars(spans: DataFrame) -> DataFrame:
    """Offset and width of each span's bar in hundredths of a percent of its trace; a width is 0.5 % at least."""
    w = Window.partitionBy("trace_id")
    stop = F.coalesce("end_ns", "start_ns")
    total = F.greatest(F.max(stop).over(w) - F.min("start_ns").over(w), F.lit(1))
    own = members(spans).select("trace_id", "span_id", "start_ns", stop.alias("stop"), total.alias("total"), F.min("start_ns").over(w).alias("first"))
    return own.select(
        "trace_id",
        "span_id",
        F.expr("(start_ns - first) * 10000 div total").alias("offset_bp"),
        F.greatest(F.expr("(stop - start_ns) * 10000 div total"), F.lit(50)).alias("width_bp"),
        F.expr("(stop - start_ns) div 1000000").alias("duration_ms"),
    )
