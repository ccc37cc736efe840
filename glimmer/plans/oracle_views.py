"""DuckDB SQL for the same views that ``glimmer.sources.tables`` builds; every oracle starts with it."""

VIEWS = r"""
WITH RECURSIVE spans AS (
  SELECT (conv_id + 1) * 1000 AS admitted_at, 0 AS tag, lpad(lower(to_hex(conv_id + 1)), 32, '0') AS trace_key, lpad(lower(to_hex(turn + 1)), 16, '0') AS span_key, CAST(0 AS BIGINT) AS serial,
    lpad(lower(to_hex(conv_id + 1)), 32, '0') AS trace_id, lpad(lower(to_hex(turn + 1)), 16, '0') AS span_id,
    CASE WHEN turn > 0 THEN lpad(lower(to_hex(turn)), 16, '0') END AS parent_span_id, role AS name,
    conv_id * 1000000000000 + turn * 1000000000 AS start_ns,
    CASE WHEN turn % 5 <> 4 THEN conv_id * 1000000000000 + turn * 1000000000 + length(coalesce(text, '')) * 1000000 END AS end_ns,
    conv_id % 2 AS flags, 'svc-' || (conv_id % 5) AS service_name, role AS scope_name,
    CASE WHEN conv_id % 3 > 0 THEN '1.' || (conv_id % 3) END AS scope_version, 'service.name=svc-' || (conv_id % 5) AS resource_key,
    CAST(300 + length(coalesce(text, '')) AS BIGINT) AS accounted_bytes
  FROM conversations),
logs AS (
  SELECT epoch_ns(ts) AS admitted_at, 1 AS tag, '' AS trace_key, '' AS span_key, event_id + 1 AS serial,
    CASE WHEN event_id % 50 <> 0 THEN epoch_ns(ts) END AS ts_ns, epoch_ns(ts) + 1000 AS observed_ns,
    CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 9 WHEN 'click' THEN 5 END AS severity, props AS body,
    lpad(lower(to_hex(user_id + 1)), 32, '0') AS trace_id, CASE WHEN event_type <> 'view' THEN lpad(lower(to_hex(event_id % 10 + 1)), 16, '0') END AS span_id,
    event_type AS service_name, 'lib-' || (event_id % 4) AS scope_name, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 3 AS VARCHAR) END AS scope_version,
    'service.name=svc-' || (user_id % 7) AS resource_key, CAST(200 + length(coalesce(props, '')) AS BIGINT) AS accounted_bytes
  FROM events),
points AS (
  SELECT epoch_ns(ts) AS admitted_at, 1 AS tag, '' AS trace_key, '' AS span_key, event_id + 1000000001 AS serial, event_type || '/' || (user_id % 10) AS stream_key, epoch_ns(ts) AS time_ns,
    value, CASE WHEN event_id % 4 = 0 THEN lpad(lower(to_hex(user_id + 1)), 32, '0') END AS ex_trace,
    CASE WHEN event_id % 4 = 0 AND event_id % 12 <> 0 THEN lpad(lower(to_hex(event_id % 10 + 1)), 16, '0') END AS ex_span,
    'service.name=svc-' || (user_id % 11) AS resource_key, CAST(180 AS BIGINT) AS accounted_bytes
  FROM events),
streams AS (
  SELECT row_number() OVER (ORDER BY stream_key) AS stream_id, stream_key, 'Gauge' AS kind, n AS "references", CAST(250 + length(stream_key) AS BIGINT) AS identity_bytes
  FROM (SELECT stream_key, count(*) AS n FROM points GROUP BY 1)),
deliveries AS (
  SELECT lpad(lower(to_hex(l_orderkey + 1)), 32, '0') AS trace_id, lpad(lower(to_hex(l_linenumber)), 16, '0') AS span_id, concat_ws('|', CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag) AS arrival,
    concat_ws('|', l_returnflag, l_linestatus) AS payload_key, l_linestatus AS schema_url, l_orderkey AS export_id, l_linenumber AS "position", CAST(l_quantity AS BIGINT) AS n_attributes, l_partkey AS part
  FROM lineitem)
"""
