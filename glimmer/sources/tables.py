"""The driver's tables as signals: spans, logs, points and streams.

Ids are hex strings of a number plus one, so none is all zero; nanoseconds are bigints. Every frame carries the
residency key ``(admitted_at, tag, trace_key, span_key, serial)``: spans with a natural identity sort by their ids
(tag 0), everything else by an assigned serial (tag 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.functions.columns import span_hex, trace_hex, unix_nanos

KEY = ["admitted_at", "tag", "trace_key", "span_key", "serial"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chains of spans: one trace each, a turn's parent is the turn before."""
    c = load(spark, sf_dir, "conversations")
    start = F.col("conv_id") * 1_000_000_000_000 + F.col("turn") * 1_000_000_000
    size = F.length(F.coalesce("text", F.lit("")))
    trace, span = trace_hex(F.col("conv_id") + 1), span_hex(F.col("turn") + 1)
    return c.select(
        ((F.col("conv_id") + 1) * 1000).alias("admitted_at"),
        F.lit(0).alias("tag"),
        trace.alias("trace_key"),
        span.alias("span_key"),
        F.lit(0).cast("long").alias("serial"),
        trace.alias("trace_id"),
        span.alias("span_id"),
        F.when(F.col("turn") > 0, span_hex(F.col("turn"))).alias("parent_span_id"),
        F.col("role").alias("name"),
        start.alias("start_ns"),
        F.when(F.col("turn") % 5 != 4, start + size * 1_000_000).alias("end_ns"),
        (F.col("conv_id") % 2).alias("flags"),
        F.concat(F.lit("svc-"), (F.col("conv_id") % 5).cast("string")).alias("service_name"),
        F.col("role").alias("scope_name"),
        F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("1."), (F.col("conv_id") % 3).cast("string"))).alias("scope_version"),
        F.concat(F.lit("service.name=svc-"), (F.col("conv_id") % 5).cast("string")).alias("resource_key"),
        (300 + size).cast("long").alias("accounted_bytes"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    ns = unix_nanos(F.col("ts"))
    kind = F.col("event_type")
    return e.select(
        ns.alias("admitted_at"),
        F.lit(1).alias("tag"),
        F.lit("").alias("trace_key"),
        F.lit("").alias("span_key"),
        (F.col("event_id") + 1).alias("serial"),
        F.when(F.col("event_id") % 50 != 0, ns).alias("ts_ns"),
        (ns + 1000).alias("observed_ns"),
        F.when(kind == "error", 17).when(kind == "purchase", 13).when(kind == "signup", 9).when(kind == "click", 5).alias("severity"),
        F.col("props").alias("body"),
        trace_hex(F.col("user_id") + 1).alias("trace_id"),
        F.when(kind != "view", span_hex(F.col("event_id") % 10 + 1)).alias("span_id"),
        kind.alias("service_name"),
        F.concat(F.lit("lib-"), (F.col("event_id") % 4).cast("string")).alias("scope_name"),
        F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 3).cast("string")).alias("scope_version"),
        F.concat(F.lit("service.name=svc-"), (F.col("user_id") % 7).cast("string")).alias("resource_key"),
        (200 + F.length(F.coalesce("props", F.lit("")))).cast("long").alias("accounted_bytes"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge points; every fourth carries an exemplar, some of these without a span."""
    e = load(spark, sf_dir, "events")
    ns = unix_nanos(F.col("ts"))
    exemplar = F.struct(trace_hex(F.col("user_id") + 1).alias("trace_id"), F.when(F.col("event_id") % 12 != 0, span_hex(F.col("event_id") % 10 + 1)).alias("span_id"))
    return e.select(
        ns.alias("admitted_at"),
        F.lit(1).alias("tag"),
        F.lit("").alias("trace_key"),
        F.lit("").alias("span_key"),
        (F.col("event_id") + 1_000_000_001).alias("serial"),
        F.concat_ws("/", "event_type", (F.col("user_id") % 10).cast("string")).alias("stream_key"),
        ns.alias("time_ns"),
        F.col("value").alias("value"),
        F.lit(0).alias("flags"),
        F.when(F.col("event_id") % 4 == 0, F.array(exemplar)).otherwise(F.array().cast("array<struct<trace_id:string,span_id:string>>")).alias("exemplars"),
        F.concat(F.lit("service.name=svc-"), (F.col("user_id") % 11).cast("string")).alias("resource_key"),
        F.lit(180).cast("long").alias("accounted_bytes"),
    )


def streams(points_frame: DataFrame) -> DataFrame:
    """Interned stream identities: one row per distinct identity, numbered in identity order.

    The identities are a dimension of bounded size (a series cap holds in the engine), so the one global order here is
    over distinct identities after a map-side combine, never over points.
    """
    distinct = points_frame.groupBy("stream_key").agg(F.count(F.lit(1)).alias("references"))
    numbered = distinct.selectExpr("stream_key", "references", "row_number() over (order by stream_key) as stream_id")
    return numbered.select(F.col("stream_id").cast("long").alias("stream_id"), "stream_key", F.lit("Gauge").alias("kind"), "references", (250 + F.length("stream_key")).cast("long").alias("identity_bytes"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as span deliveries: (order, line) repeats, so some collapse and some conflict."""
    l = load(spark, sf_dir, "lineitem")
    return l.select(
        trace_hex(F.col("l_orderkey") + 1).alias("trace_id"),
        span_hex(F.col("l_linenumber").cast("long")).alias("span_id"),
        F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag").alias("arrival"),
        F.concat_ws("|", F.col("l_returnflag"), F.col("l_linestatus")).alias("payload_key"),
        F.col("l_linestatus").alias("schema_url"),
        F.col("l_orderkey").alias("export_id"),
        F.col("l_linenumber").alias("position"),
        F.col("l_quantity").cast("long").alias("n_attributes"),
        F.col("l_partkey").alias("part"),
    )
