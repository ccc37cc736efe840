"""One query per operator over the driver's tables, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.functions import columns as C
from glimmer.operators import admission as A
from glimmer.operators import page as P
from glimmer.operators import relations as R
from glimmer.operators import retention as T
from glimmer.operators import waterfall as W
from glimmer.operators.filters import LogFilters, Scope, SpanFilters, TimeRange
from glimmer.plans.oracle_views import VIEWS
from glimmer.sources import tables as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAY1, DAY2 = 1_704_067_200_000_000_000, 1_704_153_600_000_000_000  # 2024-01-01 and -02
SUBJECT = "0" * 31 + "5"
FROM_NS, TO_NS = DAY1, DAY1 + 3 * 86_400_000_000_000


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = VIEWS + sql
        return f

    return add


LOG_COLS = ["serial", "ts_ns", "observed_ns", "severity", "service_name", "trace_id", "span_id"]
LOGS = "serial, ts_ns, observed_ns, severity, service_name, trace_id, span_id"


# --- filters -------------------------------------------------------------------------------------------------------
@query(f"SELECT {LOGS} FROM logs WHERE service_name = 'purchase'")
def filter_service(spark: SparkSession, d: str) -> DataFrame:
    return S.logs(spark, d).where(LogFilters(service="purchase").column()).select(*LOG_COLS)


@query(f"SELECT {LOGS} FROM logs WHERE coalesce(ts_ns, observed_ns) >= {FROM_NS} AND coalesce(ts_ns, observed_ns) < {TO_NS}")
def filter_time_range(spark, d):
    return S.logs(spark, d).where(LogFilters(time=TimeRange(FROM_NS, TO_NS)).column()).select(*LOG_COLS)


@query(f"SELECT {LOGS} FROM logs WHERE severity >= 9")
def filter_severity(spark, d):
    return S.logs(spark, d).where(LogFilters(severity=9).column()).select(*LOG_COLS)


@query("SELECT trace_id, span_id, scope_name, scope_version FROM spans WHERE scope_name = 'user' AND scope_version IS NULL")
def filter_scope(spark, d):
    return S.spans(spark, d).where(SpanFilters(scope=Scope("user")).column()).select("trace_id", "span_id", "scope_name", "scope_version")


@query(f"SELECT {LOGS} FROM logs WHERE service_name = 'error' AND coalesce(ts_ns, observed_ns) >= {FROM_NS} AND coalesce(ts_ns, observed_ns) < {TO_NS} AND severity >= 13 AND scope_name = 'lib-1' AND scope_version = '1'")
def filter_conjunction(spark, d):
    f = LogFilters("error", TimeRange(FROM_NS, TO_NS), Scope("lib-1", "1"), 13)
    return S.logs(spark, d).where(f.column()).select(*LOG_COLS)


@query(f"SELECT {LOGS} FROM logs")
def filter_none(spark, d):
    return S.logs(spark, d).where(LogFilters().column()).select(*LOG_COLS)


@query(f"SELECT {LOGS} FROM logs WHERE false")
def filter_empty_range(spark, d):
    return S.logs(spark, d).where(LogFilters(time=TimeRange(TO_NS, FROM_NS)).column()).select(*LOG_COLS)


@query("SELECT serial, coalesce(ts_ns, observed_ns) AS time_key FROM logs")
def time_key_coalesce(spark, d):
    return S.logs(spark, d).select("serial", F.coalesce("ts_ns", "observed_ns").alias("time_key"))


# --- residency order and pages -------------------------------------------------------------------------------------
@query(
    """SELECT * FROM (SELECT 'span' AS kind, admitted_at, tag, trace_key, span_key, serial FROM spans UNION ALL SELECT 'log', admitted_at, tag, trace_key, span_key, serial FROM logs
    UNION ALL SELECT 'point', admitted_at, tag, trace_key, span_key, serial FROM points) ORDER BY admitted_at, tag, trace_key, span_key, serial LIMIT 200"""
)
def residency_order_topk(spark, d):
    refs = R.signal_refs(S.spans(spark, d), S.logs(spark, d), S.points(spark, d))
    return refs.select("kind", *S.KEY).orderBy(*S.KEY).limit(200)


@query(f"SELECT serial, body FROM logs WHERE admitted_at > {DAY2} ORDER BY admitted_at, serial LIMIT 500")
def scan_after_key(spark, d):
    key = P.Key(DAY2, P.Entity(1, serial=2**62))
    return S.logs(spark, d).where(P.after(key)).orderBy(*S.KEY).limit(500).select("serial", "body")


@query("SELECT serial, body, accounted_bytes FROM logs WHERE serial = 42")
def point_lookup(spark, d):
    return S.logs(spark, d).where("serial = 42").select("serial", "body", "accounted_bytes")


def _page_sql(match: str, r: int, b: int, s: int, where: str = "true") -> str:
    return f""", numbered AS (SELECT serial, accounted_bytes, {match} AS match, row_number() OVER w AS n, sum(CASE WHEN {match} THEN 1 ELSE 0 END) OVER w AS m,
      sum(CASE WHEN {match} THEN accounted_bytes ELSE 0 END) OVER w AS b FROM logs WHERE {where} WINDOW w AS (ORDER BY admitted_at, serial ROWS UNBOUNDED PRECEDING)),
    seen AS (SELECT * FROM numbered WHERE n <= {s} + 64),
    st AS (SELECT coalesce(min(CASE WHEN match AND m = {r} + 1 THEN n END), {P.MOST}) AS i_r, coalesce(min(CASE WHEN match AND b > {b} THEN n END), {P.MOST}) AS i_b, max(n) AS total FROM seen),
    facts AS (SELECT *, CASE WHEN i_r <= i_b AND i_r <= {s} THEN 'results' WHEN i_b < i_r AND i_b <= {s} THEN 'bytes' WHEN total > {s} THEN 'scan' END AS dimension,
      CASE WHEN i_r <= i_b AND i_r <= {s} THEN i_r ELSE least(total, {s}) END AS examined,
      CASE WHEN i_b < i_r AND i_b <= {s} THEN (SELECT count(*) FROM seen WHERE match AND n >= i_b AND n <= {s}) ELSE 0 END AS omitted FROM st)
    SELECT serial, n, dimension, CAST(examined AS BIGINT) AS examined, CAST(omitted AS BIGINT) AS omitted, CASE WHEN dimension IS NULL THEN 'complete' ELSE 'degraded' END AS outcome
    FROM seen, facts WHERE match AND n <= {s} AND n < least(i_r, i_b)"""


def _page(df: DataFrame) -> DataFrame:
    return df.select("serial", "n", "dimension", F.col("examined").cast("long").alias("examined"), F.col("omitted").cast("long").alias("omitted"), "outcome")


_SEVERE = LogFilters(severity=9)


@query(_page_sql("coalesce(severity >= 9, false)", 100, 4 << 20, 5000))
def page_first(spark, d):
    return _page(P.page_rows(S.logs(spark, d), _SEVERE.column(), P.Budget(100, 4 << 20, 5000)))


@query(_page_sql("coalesce(severity >= 9, false)", 100, 4 << 20, 5000, f"admitted_at > {DAY2}"))
def page_continuation(spark, d):
    return _page(P.page_rows(S.logs(spark, d), _SEVERE.column(), P.Budget(100, 4 << 20, 5000), P.Key(DAY2, P.Entity(1, serial=2**62))))


@query(_page_sql("coalesce(severity >= 9, false)", 1000, 20_000, 2000))
def page_byte_wall(spark, d):
    return _page(P.page_rows(S.logs(spark, d), _SEVERE.column(), P.Budget(1000, 20_000, 2000)))


@query(_page_sql("coalesce(severity >= 9, false)", 1000, 4 << 20, 300))
def page_scan_stop(spark, d):
    return _page(P.page_rows(S.logs(spark, d), _SEVERE.column(), P.Budget(1000, 4 << 20, 300)))


# --- relations -----------------------------------------------------------------------------------------------------
def _rel(df: DataFrame) -> DataFrame:
    return df.select("type", *R.ENDS, "facts")


_MEM = ", mem AS (SELECT * FROM spans WHERE trace_id <> repeat('0', 32) AND span_id <> repeat('0', 16))"
_SI = """SELECT 'span_identity' AS type, 'log' AS from_kind, '' AS from_trace, '' AS from_span, l.serial AS from_serial, 'span' AS to_kind, s.trace_id AS to_trace, s.span_id AS to_span, CAST(0 AS BIGINT) AS to_serial,
  'trace_id=' || s.trace_id || ';span_id=' || s.span_id AS facts FROM logs l JOIN mem s ON l.trace_id = s.trace_id AND l.span_id = s.span_id"""
_TI = """SELECT 'trace_identity' AS type, 'log' AS from_kind, '' AS from_trace, '' AS from_span, l.serial AS from_serial, 'span' AS to_kind, s.trace_id AS to_trace, s.span_id AS to_span, CAST(0 AS BIGINT) AS to_serial,
  'trace_id=' || s.trace_id AS facts FROM logs l JOIN mem s ON l.trace_id = s.trace_id WHERE NOT EXISTS (SELECT 1 FROM mem x WHERE x.trace_id = l.trace_id AND x.span_id = l.span_id)"""
_PC = """SELECT 'parent_child' AS type, 'span' AS from_kind, c.trace_id AS from_trace, c.span_id AS from_span, CAST(0 AS BIGINT) AS from_serial, 'span' AS to_kind, p.trace_id AS to_trace, p.span_id AS to_span, CAST(0 AS BIGINT) AS to_serial,
  'parent_span_id=' || p.span_id AS facts FROM mem c JOIN mem p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE c.parent_span_id <> repeat('0', 16) AND c.parent_span_id <> c.span_id"""
_EX = """SELECT 'exemplar' AS type, 'point' AS from_kind, '' AS from_trace, '' AS from_span, p.serial AS from_serial, 'span' AS to_kind, s.trace_id AS to_trace, s.span_id AS to_span, CAST(0 AS BIGINT) AS to_serial,
  'trace_id=' || s.trace_id || ';span_id=' || s.span_id AS facts FROM points p JOIN mem s ON p.ex_trace = s.trace_id AND p.ex_span = s.span_id"""


@query(f"{_MEM} {_SI}")
def rel_span_identity(spark, d):
    return _rel(R.span_identity(S.spans(spark, d), S.logs(spark, d)))


@query(f"{_MEM} {_TI}")
def rel_trace_identity(spark, d):
    return _rel(R.trace_identity(S.spans(spark, d), S.logs(spark, d)))


@query(f"{_MEM} {_SI} UNION ALL {_TI}")
def rel_identity_union(spark, d):
    s, l = S.spans(spark, d), S.logs(spark, d)
    return _rel(R.span_identity(s, l)).unionByName(_rel(R.trace_identity(s, l)))


@query(f"{_MEM}, c AS (SELECT trace_id, count(*) AS n FROM mem GROUP BY 1) SELECT l.serial AS log_serial, s.trace_id, s.span_id, c.n - 1 AS suppressed FROM logs l JOIN mem s ON l.trace_id = s.trace_id AND l.span_id = s.span_id JOIN c ON c.trace_id = s.trace_id")
def rel_suppression(spark, d):
    return R.suppressions(S.spans(spark, d), S.logs(spark, d))


@query(f"{_MEM} SELECT serial AS log_serial, trace_id FROM logs l WHERE trace_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mem s WHERE s.trace_id = l.trace_id)")
def rel_absent_trace(spark, d):
    return R.absent_traces(S.spans(spark, d), S.logs(spark, d))


@query(f"{_MEM} {_PC}")
def rel_parent_child(spark, d):
    return _rel(R.parent_child(S.spans(spark, d)))


@query(f"{_MEM} {_EX}")
def rel_exemplar(spark, d):
    return _rel(R.exemplar(S.points(spark, d), S.spans(spark, d)))


_REFS = """, refs AS (SELECT 'span' AS kind, 0 AS kr, admitted_at, tag, trace_key, span_key, serial, resource_key FROM spans UNION ALL SELECT 'log', 1, admitted_at, tag, trace_key, span_key, serial, resource_key FROM logs
  UNION ALL SELECT 'point', 2, admitted_at, tag, trace_key, span_key, serial, resource_key FROM points)"""
CAP = 5000


@query(
    f"""{_REFS}, g AS (SELECT *, row_number() OVER (PARTITION BY resource_key ORDER BY kr, admitted_at, tag, trace_key, span_key, serial) AS i FROM refs), h AS (SELECT * FROM g WHERE i <= {CAP} + 1),
    pairs AS (SELECT a.resource_key, a.i AS ai, b.i AS bi, a.kind AS ak, a.trace_key AS atr, a.span_key AS asp, a.serial AS ase, b.kind AS bk, b.trace_key AS bt, b.span_key AS bsp, b.serial AS bse
      FROM h a JOIN h b ON a.resource_key = b.resource_key AND a.i < b.i WHERE a.i <= 3 AND a.resource_key = (SELECT min(resource_key) FROM (SELECT resource_key FROM refs GROUP BY 1 HAVING count(*) > 1)))
    SELECT 'resource_context' AS type, ak AS from_kind, atr AS from_trace, asp AS from_span, ase AS from_serial, bk AS to_kind, bt AS to_trace, bsp AS to_span, bse AS to_serial, resource_key AS facts
    FROM pairs ORDER BY resource_key, ai, bi LIMIT 1000"""
)
def rel_resource_context(spark, d):
    rows = R.resource_context(S.spans(spark, d), S.logs(spark, d), S.points(spark, d), 1000)
    return _rel(rows)


@query(
    f"""{_MEM} SELECT 'temporal' AS type, 'span' AS from_kind, s.trace_id AS from_trace, s.span_id AS from_span, CAST(0 AS BIGINT) AS from_serial, 'point' AS to_kind, '' AS to_trace, '' AS to_span, p.serial AS to_serial, 'time=' || p.time_ns AS facts
    FROM (SELECT *, start_ns + {DAY1} AS s0, coalesce(end_ns, start_ns) + {DAY1} AS e0 FROM mem WHERE trace_id = '{SUBJECT}') s JOIN points p ON p.time_ns >= {DAY1} AND p.time_ns < {DAY1 + 43_200_000_000_000}
    WHERE s.s0 < {DAY1 + 43_200_000_000_000} AND s.e0 > {DAY1}"""
)
def rel_temporal(spark, d):
    shifted = S.spans(spark, d).withColumn("start_ns", F.col("start_ns") + DAY1).withColumn("end_ns", F.col("end_ns") + DAY1)
    return _rel(R.temporal(shifted, S.points(spark, d), DAY1, DAY1 + 43_200_000_000_000, SUBJECT))


@query(f"{_MEM} SELECT * FROM ({_TI}) ORDER BY from_serial, to_trace, to_span LIMIT 500")
def rel_capped(spark, d):
    return R.capped(_rel(R.trace_identity(S.spans(spark, d), S.logs(spark, d))), [F.col("from_serial"), F.col("to_trace"), F.col("to_span")], 500)


@query(
    f"""{_MEM}, u AS ({_SI} UNION ALL {_TI} UNION ALL {_PC} UNION ALL {_EX}),
    r AS (SELECT *, CASE type WHEN 'span_identity' THEN 0 WHEN 'trace_identity' THEN 1 WHEN 'parent_child' THEN 2 ELSE 4 END AS tr, CASE from_kind WHEN 'span' THEN 0 WHEN 'log' THEN 1 ELSE 2 END AS fk FROM u)
    SELECT type, from_kind, from_trace, from_span, from_serial, to_kind, to_trace, to_span, to_serial, facts FROM r ORDER BY tr, fk, from_trace, from_span, from_serial, to_trace, to_span, to_serial"""
)
def rel_ordered_union(spark, d):
    s, l, p = S.spans(spark, d), S.logs(spark, d), S.points(spark, d)
    union = _rel(R.span_identity(s, l)).unionByName(_rel(R.trace_identity(s, l))).unionByName(_rel(R.parent_child(s))).unionByName(_rel(R.exemplar(p, s)))
    return union.orderBy(*R.ordered_key())


@query(f"{_MEM}, u AS ({_SI}) SELECT u.* FROM u WHERE from_serial IN (SELECT serial FROM logs WHERE severity >= 13) AND (to_trace, to_span) IN (SELECT trace_id, span_id FROM spans WHERE flags = 1)")
def evidence_narrowing(spark, d):
    s, l = S.spans(spark, d), S.logs(spark, d)
    evidence = R.signal_refs(s.where("flags = 1"), l.where("severity >= 13"), S.points(spark, d).where("false"))
    return _rel(R.resident_ends(_rel(R.span_identity(s, l)), evidence))


@query("SELECT p.serial, s.stream_id, p.stream_key, p.value FROM points p JOIN streams s USING (stream_key)")
def point_stream_join(spark, d):
    p = S.points(spark, d)
    return p.join(S.streams(p), "stream_key").select("serial", "stream_id", "stream_key", "value")


@query(f"{_MEM} SELECT trace_id, span_id, name, start_ns FROM mem WHERE trace_id = '{SUBJECT}'")
def subject_members(spark, d):
    return R.members(S.spans(spark, d), SUBJECT).select("trace_id", "span_id", "name", "start_ns")


@query("SELECT l.serial, l.trace_id, l.span_id, s.name AS span_name FROM logs l JOIN spans s ON s.trace_id = l.trace_id AND s.span_id = l.span_id")
def log_to_trace(spark, d):
    l = S.logs(spark, d).select("serial", "trace_id", "span_id")
    return l.join(S.spans(spark, d).select("trace_id", "span_id", F.col("name").alias("span_name")), ["trace_id", "span_id"])


# --- traces --------------------------------------------------------------------------------------------------------
@query(
    f"""{_MEM}, r AS (SELECT trace_id, span_id AS root_span FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY admitted_at, span_key) AS n FROM mem WHERE parent_span_id IS NULL) WHERE n = 1)
    SELECT s.trace_id, s.span_id, coalesce(r.root_span, s.span_id) AS root_span, CASE WHEN r.root_span IS NULL THEN 'no_parentless_span_resident' WHEN r.root_span = s.span_id THEN 'requested_span_is_root' ELSE 'trace_rooted_at' END AS note
    FROM spans s LEFT JOIN r USING (trace_id)"""
)
def subject_resolution(spark, d):
    return W.resolve_subjects(S.spans(spark, d))


@query(
    f"""{_MEM}, walk AS (SELECT trace_id, span_id, 0 AS depth FROM mem WHERE parent_span_id IS NULL UNION ALL SELECT m.trace_id, m.span_id, w.depth + 1 FROM walk w JOIN mem m ON m.trace_id = w.trace_id AND m.parent_span_id = w.span_id)
    SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY depth, span_id) AS ordinal, depth FROM walk"""
)
def waterfall_bfs(spark, d):
    return W.waterfall(S.spans(spark, d))


@query(
    f"""{_MEM}, walk AS (SELECT span_id, 0 AS depth FROM mem WHERE parent_span_id IS NULL AND trace_id = '{SUBJECT}' UNION ALL SELECT m.span_id, w.depth + 1 FROM walk w JOIN mem m ON m.trace_id = '{SUBJECT}' AND m.parent_span_id = w.span_id)
    SELECT span_id, depth, row_number() OVER (ORDER BY depth, span_id) AS ordinal FROM walk"""
)
def waterfall_subject(spark, d):
    return W.waterfall_of(S.spans(spark, d), SUBJECT)


_DFS = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_ns, admitted_at, span_key) AS p FROM {spans}),
    walk AS (SELECT trace_id, span_id, [p] AS path FROM ranked r WHERE parent_span_id IS NULL OR parent_span_id = span_id OR NOT EXISTS (SELECT 1 FROM ranked x WHERE x.trace_id = r.trace_id AND x.span_id = r.parent_span_id)
      UNION ALL SELECT m.trace_id, m.span_id, list_append(w.path, m.p) FROM walk w JOIN ranked m ON m.trace_id = w.trace_id AND m.parent_span_id = w.span_id AND m.span_id <> w.span_id)
    SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY path) AS row, len(path) - 1 AS depth,
      EXISTS (SELECT 1 FROM ranked c WHERE c.trace_id = walk.trace_id AND c.parent_span_id = walk.span_id AND c.span_id <> walk.span_id) AS has_children FROM walk"""
#: Traces that branch, of the same rows: several roots, none, orphans, self parents and siblings that start in another order.
_BRANCHING = """, b AS (SELECT * EXCLUDE (parent_span_id, start_ns), CAST('0x' || span_id AS BIGINT) - 1 AS turn, CAST('0x' || trace_id AS BIGINT) AS conv FROM mem),
    branching AS (SELECT *, CASE WHEN (turn = 0 AND conv % 7 <> 3) OR turn % 6 = 5 THEN NULL WHEN turn = 0 OR turn % 5 = 4 THEN repeat('f', 16) WHEN turn % 11 = 7 THEN span_id ELSE lpad(lower(to_hex((turn - 1) // 2 + 1)), 16, '0') END AS parent_span_id,
      turn * 7 % 10 AS start_ns FROM b)"""


def _branching(spark, d):
    own = R.members(S.spans(spark, d)).withColumn("turn", F.conv("span_id", 16, 10).cast("long") - 1).withColumn("conv", F.conv("trace_id", 16, 10).cast("long"))
    turn, conv = F.col("turn"), F.col("conv")
    parent = F.when(((turn == 0) & (conv % 7 != 3)) | (turn % 6 == 5), F.lit(None).cast("string")).when((turn == 0) | (turn % 5 == 4), "f" * 16).when(turn % 11 == 7, F.col("span_id")).otherwise(S.span_hex(F.floor((turn - 1) / 2) + 1))
    return own.withColumn("parent_span_id", parent).withColumn("start_ns", turn * 7 % 10)


@query(_MEM + _DFS.replace("{spans}", "mem"))
def waterfall_tree_dfs(spark, d):
    return W.tree(S.spans(spark, d))


@query(_MEM + _BRANCHING + _DFS.replace("{spans}", "branching"))
def branching_tree_dfs(spark, d):
    return W.tree(_branching(spark, d))


@query(
    _MEM + _BRANCHING + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY admitted_at, span_key) AS p FROM branching),
    rooted AS (SELECT trace_id, coalesce(min(p) FILTER (parent_span_id IS NULL), 1) AS p FROM ranked GROUP BY 1),
    walk AS (SELECT r.trace_id, r.span_id, [r.p] AS path FROM ranked r JOIN rooted USING (trace_id, p)
      UNION ALL SELECT m.trace_id, m.span_id, list_append(w.path, m.p) FROM walk w JOIN ranked m ON m.trace_id = w.trace_id AND m.parent_span_id = w.span_id AND m.span_id <> w.span_id AND NOT list_contains(w.path, m.p)),
    every AS (SELECT r.trace_id, r.span_id, r.p, w.path FROM ranked r LEFT JOIN walk w USING (trace_id, span_id))
    SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY path IS NULL, len(path), path, p) AS ordinal, coalesce(len(path), 0) - 1 AS depth FROM every"""
)
def branching_waterfall(spark, d):
    return W.waterfall(_branching(spark, d))


@query(f"{_MEM} SELECT trace_id, min(start_ns) AS start_ns, max(coalesce(end_ns, start_ns)) AS end_ns FROM mem GROUP BY 1")
def waterfall_extent(spark, d):
    return W.extents(S.spans(spark, d))


@query(
    f"""{_MEM}, t AS (SELECT *, coalesce(end_ns, start_ns) AS stop, min(start_ns) OVER (PARTITION BY trace_id) AS first, greatest(max(coalesce(end_ns, start_ns)) OVER (PARTITION BY trace_id) - min(start_ns) OVER (PARTITION BY trace_id), 1) AS total FROM mem)
    SELECT trace_id, span_id, (start_ns - first) * 10000 // total AS offset_bp, greatest((stop - start_ns) * 10000 // total, 50) AS width_bp, (stop - start_ns) // 1000000 AS duration_ms FROM t"""
)
def bar_geometry(spark, d):
    return W.bars(S.spans(spark, d))


@query(f"SELECT serial, time_ns, value FROM points WHERE time_ns >= {FROM_NS} AND time_ns < {TO_NS}")
def metric_window(spark, d):
    return S.points(spark, d).where((F.col("time_ns") >= FROM_NS) & (F.col("time_ns") < TO_NS)).select("serial", "time_ns", "value")


@query("SELECT serial, body FROM (SELECT serial, coalesce(body, '') AS body, row_number() OVER (ORDER BY ts_ns NULLS FIRST, serial) AS n FROM logs) WHERE n BETWEEN 91 AND 130")
def viewport_slice(spark, d):
    first, visible, overscan = 100, 20, 10
    top = S.logs(spark, d).orderBy(F.col("ts_ns").asc_nulls_first(), "serial").limit(first + visible + overscan)
    n = F.row_number().over(Window.orderBy(F.col("ts_ns").asc_nulls_first(), "serial"))
    return top.withColumn("n", n).where(F.col("n").between(first - overscan + 1, first + visible + overscan)).select("serial", C.body_text(F.col("body")).alias("body"))


# --- admission -----------------------------------------------------------------------------------------------------
_OUT = """, o AS (SELECT *, row_number() OVER w AS n, first_value(payload_key) OVER w AS fp, first_value(schema_url) OVER w AS fs FROM deliveries WINDOW w AS (PARTITION BY trace_id, span_id ORDER BY arrival)),
  oo AS (SELECT *, CASE WHEN n = 1 THEN 'admitted' WHEN payload_key = fp THEN 'collapsed' ELSE 'conflict' END AS outcome FROM o)"""


def _outcomes(spark, d):
    return A.outcomes(S.deliveries(spark, d), ["trace_id", "span_id"], ["arrival"], "payload_key", "schema_url")


@query(f"{_OUT} SELECT trace_id, span_id, arrival, outcome FROM oo")
def span_dedup_outcome(spark, d):
    return _outcomes(spark, d).select("trace_id", "span_id", "arrival", "outcome")


@query(f"{_OUT} SELECT count(*) FILTER (outcome = 'conflict') AS conflicts, count(*) FILTER (outcome = 'collapsed' AND schema_url <> fs) AS drifts, count(*) FILTER (outcome = 'collapsed') AS collapsed FROM oo")
def anomaly_counts(spark, d):
    return A.anomalies(_outcomes(spark, d))


@query(f"{_OUT} SELECT export_id, count(*) FILTER (outcome = 'admitted') AS admitted, count(*) FILTER (outcome = 'conflict') AS rejected FROM oo GROUP BY 1")
def export_outcomes(spark, d):
    return _outcomes(spark, d).groupBy("export_id").agg(F.count(F.when(F.col("outcome") == "admitted", 1)).alias("admitted"), F.count(F.when(F.col("outcome") == "conflict", 1)).alias("rejected"))


@query(
    """, o AS (SELECT serial, stream_key, time_ns // 3600000000000 AS hour, CAST(round(value) AS BIGINT) AS v FROM points), w AS (SELECT *, row_number() OVER x AS n, first_value(v) OVER x AS f FROM o WINDOW x AS (PARTITION BY stream_key, hour ORDER BY serial))
    SELECT serial, stream_key, CASE WHEN n = 1 THEN 'admitted' WHEN v = f THEN 'collapsed' ELSE 'conflict' END AS outcome FROM w"""
)
def point_dedup_outcome(spark, d):
    p = S.points(spark, d).select("serial", "stream_key", F.expr("time_ns div 3600000000000").alias("hour"), F.round("value").cast("long").alias("v"))
    return A.outcomes(p, ["stream_key", "hour"], ["serial"], "v").select("serial", "stream_key", "outcome")


@query("SELECT serial, row_number() OVER (ORDER BY admitted_at, serial) AS assigned FROM logs")
def serial_assignment(spark, d):
    return A.with_serials(S.logs(spark, d).select("admitted_at", "serial"), ["admitted_at", "serial"]).select("serial", "assigned")


@query('SELECT stream_id, stream_key, kind, "references", identity_bytes FROM streams')
def stream_interning(spark, d):
    return S.streams(S.points(spark, d))


@query(", n AS (SELECT export_id FROM deliveries GROUP BY 1 HAVING count(*) <= 4) SELECT export_id, count(*) AS records FROM deliveries JOIN n USING (export_id) GROUP BY 1")
def export_cap(spark, d):
    return A.export_cap(S.deliveries(spark, d), "export_id", 4).groupBy("export_id").agg(F.count(F.lit(1)).alias("records"))


@query(
    f"""{_OUT}, b AS (SELECT export_id, arrival, row_number() OVER (PARTITION BY export_id ORDER BY arrival) AS n FROM oo WHERE outcome = 'conflict')
    SELECT export_id, count(*) AS rejected, string_agg(CASE WHEN n <= 64 THEN arrival || ': conflict' END, '; ' ORDER BY n) AS summary FROM b GROUP BY 1"""
)
def partial_success_summary(spark, d):
    bad = _outcomes(spark, d).where("outcome = 'conflict'").select("export_id", "arrival", F.lit("conflict").alias("reason"))
    return A.partial_success(bad, "export_id", "arrival", "reason")


@query(
    "SELECT trace_id, span_id, arrival, CASE WHEN n_attributes > 45 THEN 'too_many_attributes' WHEN part % 100 > 90 THEN 'too_many_events' WHEN position > 6 THEN 'too_deep' END AS violation FROM deliveries"
)
def budget_rejections(spark, d):
    rows = S.deliveries(spark, d)
    slug = A.first_violation([("too_many_attributes", F.col("n_attributes") > 45), ("too_many_events", F.col("part") % 100 > 90), ("too_deep", F.col("position") > 6)])
    return rows.select("trace_id", "span_id", "arrival", slug.alias("violation"))


@query(
    """SELECT serial, CASE WHEN shape <> CASE WHEN kind IN ('Gauge', 'Sum') THEN 'Number' ELSE kind END THEN 'shape_mismatch' WHEN kind <> 'Gauge' AND serial % 7 = 0 THEN 'start_time_missing'
      WHEN kind IN ('Sum', 'Histogram', 'ExponentialHistogram') AND serial % 3 = 0 THEN 'temporality_missing' WHEN kind NOT IN ('Sum', 'Histogram', 'ExponentialHistogram') AND serial % 3 <> 0 THEN 'temporality_unexpected' END AS violation
    FROM (SELECT serial, CASE serial % 5 WHEN 0 THEN 'Gauge' WHEN 1 THEN 'Sum' WHEN 2 THEN 'Histogram' WHEN 3 THEN 'ExponentialHistogram' ELSE 'Summary' END AS kind,
      CASE WHEN serial % 11 = 0 THEN 'Histogram' ELSE CASE serial % 5 WHEN 0 THEN 'Number' WHEN 1 THEN 'Number' WHEN 2 THEN 'Histogram' WHEN 3 THEN 'ExponentialHistogram' ELSE 'Summary' END END AS shape FROM logs)"""
)
def shape_law(spark, d):
    n = F.col("serial") % 5
    kind = F.when(n == 0, "Gauge").when(n == 1, "Sum").when(n == 2, "Histogram").when(n == 3, "ExponentialHistogram").otherwise("Summary")
    rows = S.logs(spark, d).select("serial", kind.alias("kind"))
    shape = F.when(F.col("serial") % 11 == 0, "Histogram").otherwise(C.point_shape(F.col("kind")))
    return rows.select("serial", A.shape_violation(F.col("kind"), shape, F.col("serial") % 7 != 0, F.col("serial") % 3 != 0).alias("violation"))


# --- retention and totals ------------------------------------------------------------------------------------------
@query(
    """, j AS (SELECT p.serial, p.admitted_at, p.accounted_bytes, p.stream_key, s.identity_bytes FROM points p JOIN streams s USING (stream_key)),
    c AS (SELECT *, accounted_bytes + CASE WHEN row_number() OVER (PARTITION BY stream_key ORDER BY admitted_at DESC, serial DESC) = 1 THEN identity_bytes ELSE 0 END AS charge FROM j),
    r AS (SELECT *, row_number() OVER w AS n, sum(charge) OVER w AS total, max(admitted_at) OVER () AS last FROM c WINDOW w AS (ORDER BY admitted_at DESC, serial DESC ROWS UNBOUNDED PRECEDING))
    SELECT serial, stream_key FROM r WHERE n <= 3000 AND total <= 400000 AND last - admitted_at < 864000000000000"""
)
def retention_suffix(spark, d):
    p = S.points(spark, d)
    rows = p.join(S.streams(p).select("stream_key", "identity_bytes"), "stream_key").select(*S.KEY, "accounted_bytes", "stream_key", "identity_bytes")
    return T.surviving(rows, T.Ceilings(3000, 400_000, 864_000 * 10**9)).select("serial", "stream_key")


@query(
    """SELECT (SELECT count(*) FROM spans) AS spans, (SELECT count(*) FROM logs) AS logs, (SELECT count(*) FROM points) AS points, (SELECT count(*) FROM streams) AS streams,
    CAST((SELECT sum(accounted_bytes) FROM spans) + (SELECT sum(accounted_bytes) FROM logs) + (SELECT sum(accounted_bytes) FROM points) AS BIGINT) AS record_bytes"""
)
def store_stats(spark, d):
    def of(kind, df, stream=None):
        return df.select(F.lit(kind).alias("kind"), "accounted_bytes", (F.col("stream_key") if stream else F.lit(None).cast("string")).alias("stream_key"))

    rows = of("span", S.spans(spark, d)).unionByName(of("log", S.logs(spark, d))).unionByName(of("point", S.points(spark, d), True))
    one = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return rows.agg(one("span").alias("spans"), one("log").alias("logs"), one("point").alias("points"), F.count_distinct("stream_key").alias("streams"), F.sum("accounted_bytes").alias("record_bytes"))


@query("SELECT CAST((SELECT sum(accounted_bytes) FROM points) AS BIGINT) AS record_bytes, CAST((SELECT sum(identity_bytes) FROM streams) AS BIGINT) AS identity_bytes, CAST((SELECT sum(accounted_bytes) FROM points) + (SELECT sum(identity_bytes) FROM streams) AS BIGINT) AS accounted_bytes")
def accounted_totals(spark, d):
    p = S.points(spark, d).groupBy("stream_key").agg(F.sum("accounted_bytes").alias("b"))
    return p.agg(F.sum("b").alias("record_bytes"), F.sum(250 + F.length("stream_key")).cast("long").alias("identity_bytes"), (F.sum("b") + F.sum(250 + F.length("stream_key"))).cast("long").alias("accounted_bytes"))


# --- scalar functions ----------------------------------------------------------------------------------------------
@query(
    f"""SELECT serial, trace_id <> repeat('0', 32) AND coalesce(span_id <> repeat('0', 16), false) AS natural, span_id IS NOT NULL AS pair, regexp_full_match(trace_id, '[0-9a-f]{{32}}') AS trace_hex, coalesce(regexp_full_match(span_id, '[0-9a-f]{{16}}'), false) AS span_hex FROM logs"""
)
def id_functions(spark, d):
    t, s = F.col("trace_id"), F.col("span_id")
    return S.logs(spark, d).select("serial", C.natural_identity(t, s).isNotNull().alias("natural"), C.correlation_pair(t, s).isNotNull().alias("pair"), C.is_trace_hex(t).alias("trace_hex"), C.is_span_hex(s).alias("span_hex"))


@query("SELECT trace_id, span_id, flags % 2 = 1 AS sampled, (coalesce(end_ns, start_ns) - start_ns) // 1000000 AS duration_ms, greatest(coalesce(end_ns, start_ns) - start_ns, 0) AS window_length FROM spans")
def span_functions(spark, d):
    stop = F.coalesce("end_ns", "start_ns")
    return S.spans(spark, d).select("trace_id", "span_id", C.sampled(F.col("flags")).alias("sampled"), C.duration_ms(F.col("start_ns"), F.col("end_ns")).alias("duration_ms"), C.window_length(F.col("start_ns"), stop).alias("window_length"))


@query("""SELECT serial, '{"assigned":' || serial || '}' AS log_entity, CASE WHEN span_id IS NOT NULL THEN '{"span":{"trace_id":"' || trace_id || '","span_id":"' || span_id || '"}}' END AS span_entity FROM logs""")
def entity_render(spark, d):
    none = F.lit(None).cast("long")
    return S.logs(spark, d).select("serial", C.entity_json(F.col("trace_id"), F.col("span_id"), F.col("serial")).alias("log_entity"), F.when(F.col("span_id").isNotNull(), C.entity_json(F.col("trace_id"), F.col("span_id"), none)).alias("span_entity"))


@query("SELECT serial, CASE WHEN serial % 4 = 0 THEN NULL ELSE 'k=' || serial || ',v=' || service_name END AS rebuilt FROM logs")
def tracestate_parse(spark, d):
    head = F.when(F.col("serial") % 4 == 0, F.lit("broken")).otherwise(F.concat(F.lit("k = "), F.col("serial").cast("string"), F.lit(" , v="), "service_name"))
    parsed = C.tracestate(head)
    return S.logs(spark, d).select("serial", F.when(parsed.isNotNull(), F.array_join(F.transform(parsed, lambda m: F.concat(m["vendor"], F.lit("="), m["value"])), ",")).alias("rebuilt"))


@query(
    f"""{_MEM}, ext AS (SELECT trace_id, min(start_ns) AS start_ns, max(coalesce(end_ns, start_ns)) AS end_ns, count(*) AS spans FROM mem GROUP BY 1), lg AS (SELECT trace_id, count(*) AS logs FROM logs GROUP BY 1),
    si AS (SELECT s.trace_id, count(*) AS exact FROM logs l JOIN mem s ON l.trace_id = s.trace_id AND l.span_id = s.span_id GROUP BY 1)
    SELECT e.trace_id, e.start_ns, e.end_ns, e.spans, coalesce(lg.logs, 0) AS logs, coalesce(si.exact, 0) AS exact, (coalesce(lg.logs, 0) - coalesce(si.exact, 0)) * e.spans AS by_trace FROM ext e LEFT JOIN lg USING (trace_id) LEFT JOIN si USING (trace_id)"""
)
def investigation_summary(spark, d):
    s, l = S.spans(spark, d), S.logs(spark, d)
    m = R.members(s)
    ext = m.groupBy("trace_id").agg(F.min("start_ns").alias("start_ns"), F.max(F.coalesce("end_ns", "start_ns")).alias("end_ns"), F.count(F.lit(1)).alias("spans"))
    per = l.groupBy("trace_id").agg(F.count(F.lit(1)).alias("logs"))
    exact = R.span_identity(s, l).groupBy(F.col("to_trace").alias("trace_id")).agg(F.count(F.lit(1)).alias("exact"))
    out = ext.join(per, "trace_id", "left").join(exact, "trace_id", "left").na.fill(0, ["logs", "exact"])
    return out.withColumn("by_trace", (F.col("logs") - F.col("exact")) * F.col("spans"))
