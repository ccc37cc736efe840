"""Scalar functions over signal columns, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TRACE, NO_SPAN = "0" * 32, "0" * 16
MOST_NANOS = 2**63 - 1


def trace_hex(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n)), 32, "0")


def span_hex(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n)), 16, "0")


def valid_trace(trace_id: Column) -> Column:
    """Present and not all zero."""
    return F.coalesce(trace_id != NO_TRACE, F.lit(False))


def valid_span(span_id: Column) -> Column:
    return F.coalesce(span_id != NO_SPAN, F.lit(False))


def natural_identity(trace_id: Column, span_id: Column) -> Column:
    """struct<trace_id, span_id> when both ids are valid, else null."""
    return F.when(valid_trace(trace_id) & valid_span(span_id), F.struct(trace_id.alias("trace_id"), span_id.alias("span_id")))


def correlation_pair(trace_id: Column, span_id: Column) -> Column:
    """struct when both are present; validity is not asked for."""
    return F.when(trace_id.isNotNull() & span_id.isNotNull(), F.struct(trace_id.alias("trace_id"), span_id.alias("span_id")))


def is_trace_hex(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{32}$"), F.lit(False))


def is_span_hex(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{16}$"), F.lit(False))


def sampled(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(1)) == 1


no_recorded_value = sampled  # bit 0 of a point's flags says so, as bit 0 of a span's says sampled


def unix_nanos(ts: Column) -> Column:
    """Nanoseconds of a zone-less timestamp; independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) * 1000


def clock_value(nanos: Column) -> Column:
    """An unsigned reading, held at the largest signed one."""
    return F.when(nanos.isNotNull(), F.least(nanos, F.lit(MOST_NANOS).cast("decimal(20,0)")).cast("long"))


def window_length(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0))


def point_shape(kind: Column) -> Column:
    return F.when(kind.isin("Gauge", "Sum"), "Number").otherwise(kind)


def requires_start_time(kind: Column) -> Column:
    return kind != "Gauge"


def duration_ms(start_ns: Column, end_ns: Column) -> Column:
    return F.floor((F.coalesce(end_ns, start_ns) - start_ns) / 1_000_000)


def tier_of(relation: Column) -> Column:
    """The tier of a relation type."""
    return (
        F.when(relation.isin("span_identity", "trace_identity"), "identity")
        .when(relation.isin("parent_child", "resource_context"), "structural")
        .when(relation == "exemplar", "attachment")
        .when(relation == "temporal", "temporal")
        .otherwise("inferred")
    )


#: Order in which relation types stand.
TYPE_RANK = {"span_identity": 0, "trace_identity": 1, "parent_child": 2, "resource_context": 3, "exemplar": 4, "temporal": 5, "inferred": 6}
#: Order of the signal kinds of a relation's end.
KIND_RANK = {"span": 0, "log": 1, "point": 2}


def tracestate(header: Column, most_bytes: int = 512, most_members: int = 32) -> Column:
    """array<struct<vendor,value>> of a W3C tracestate, null where it is malformed or over a cap."""
    members = F.split(header, ",")
    parsed = F.transform(members, lambda m: F.struct(F.trim(F.substring_index(m, "=", 1)).alias("vendor"), F.trim(F.substring(m, F.instr(m, "=") + 1, F.length(m))).alias("value")))
    whole = F.forall(members, lambda m: F.instr(m, "=") > 0)
    return F.when(header == "", F.array().cast("array<struct<vendor:string,value:string>>")).when((F.octet_length(header) <= most_bytes) & (F.size(members) <= most_members) & whole, parsed)


def entity_json(trace_id: Column, span_id: Column, serial: Column) -> Column:
    return F.when(serial.isNotNull(), F.to_json(F.struct(serial.alias("assigned")))).otherwise(F.to_json(F.struct(F.struct(trace_id.alias("trace_id"), span_id.alias("span_id")).alias("span"))))


def body_text(body: Column) -> Column:
    return F.coalesce(body, F.lit(""))
