"""OTLP export payloads to flat signal rows.

Payloads land as rows ``(export_id, received_ns, signal, payload)``. The protobuf wire format is read by a small
decoder over tables of the public OTLP field numbers, inside ``mapInPandas``; a payload over the size gate or one
that can't be read is refused whole, a record that can't be represented is refused alone, and everything comes out
flat with its position in document order.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.functions import values as V
from glimmer.operators.admission import LIMITS

MOST_PAYLOAD = 4 << 20


# --- wire format ---------------------------------------------------------------------------------------------------
class Unreadable(ValueError):
    pass


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise Unreadable("varint")
        b = raw[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out & (2**64 - 1), at


def fields(raw: bytes) -> dict[int, list]:
    """Field number to its raw values in order: ints for varints, bytes for the rest."""
    out: dict[int, list] = {}
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        number, kind = tag >> 3, tag & 7
        if not number:
            raise Unreadable("field 0")
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            raise Unreadable("wire type")
        if at > len(raw):
            raise Unreadable("cut off")
        out.setdefault(number, []).append(value)
    return out


def _one(m: dict, n: int, default=None):
    return m[n][-1] if n in m else default


def _text(m: dict, n: int) -> str:
    v = _one(m, n, b"")
    try:
        return v.decode()
    except (UnicodeDecodeError, AttributeError):
        raise Unreadable("text") from None


def _u64(m: dict, n: int) -> int:
    v = _one(m, n)
    return 0 if v is None else v if isinstance(v, int) else int.from_bytes(v, "little")


def _f64(m: dict, n: int) -> float | None:
    v = _one(m, n)
    return None if v is None else struct.unpack("<d", v)[0]


def _int(v: int) -> int:
    return v - 2**64 if v >= 2**63 else v


def _i32(m: dict, n: int) -> int:
    v = _int(_one(m, n, 0)) & 0xFFFFFFFF
    return v - 2**32 if v >= 2**31 else v


def _zigzag(m: dict, n: int) -> int:
    v = _one(m, n, 0)
    return (v >> 1) ^ -(v & 1)


def _packed(m: dict, n: int, fmt: str) -> list:
    out = []
    for v in m.get(n, []):
        if isinstance(v, int):
            out.append(v)
        elif fmt == "v":
            at = 0
            while at < len(v):
                x, at = _varint(v, at)
                out.append(x)
        else:
            out += struct.unpack(f"<{len(v) // 8}{fmt}", v)
    return out


# --- values --------------------------------------------------------------------------------------------------------
def _any(raw: bytes | None, where: str, empty_ok: bool = False):
    m = fields(raw) if raw is not None else {}
    if not m:
        if empty_ok:
            return None
        raise V.Refused("missing_value", where)
    n = next(reversed(m))
    v = m[n][-1]
    if n == 1:
        return {"s": v.decode()}
    if n == 2:
        return {"t": bool(v)}
    if n == 3:
        return {"i": str(_int(v))}
    if n == 4:
        return {"d": V.double_bits(struct.unpack("<d", v)[0])}
    if n == 5:
        return V.array_value([_any(x, where) for x in fields(v).get(1, [])])
    if n == 6:
        return V.pairs_value(_pairs(fields(v).get(1, []), where))
    if n == 7:
        return {"b": v.hex()}
    raise V.Refused("missing_value", where)


def _pairs(raws: list[bytes], where: str) -> list:
    out = []
    for raw in raws:
        m = fields(raw)
        out.append((_text(m, 1), _any(_one(m, 2), where)))
    return out


def _attributes(raws: list[bytes], where: str, most: int) -> dict:
    out = V.attributes(_pairs(raws, where))
    if len(out) > most:
        raise V.Refused("too_many_attributes", where)
    for k, v in out.items():
        if V.entry_size(k, v) - V.ENTRY > LIMITS["attribute_entry_bytes"]:
            raise V.Refused("attribute_too_large", where)
        if V.depth(v) > LIMITS["depth"]:
            raise V.Refused("too_deep", where)
    return out


def _id(raw: bytes | None, size: int, where: str, empty_ok: bool) -> str | None:
    raw = raw or b""
    if not raw and empty_ok:
        return None
    if len(raw) != size:
        raise V.Refused("id_length", f"{where} {len(raw)}")
    return raw.hex()


def tracestate(text: str) -> list[list[str]]:
    if not text:
        return []
    if len(text.encode()) > 512:
        raise V.Refused("tracestate_over_cap")
    members = text.split(",")
    if len(members) > 32:
        raise V.Refused("tracestate_over_cap")
    out = []
    for x in members:
        vendor, eq, value = x.partition("=")
        if not eq:
            raise V.Refused("tracestate", x)
        out.append([vendor.strip(), value.strip()])
    return out


def _enum(value: int, names: list[str], where: str) -> str:
    if not 0 <= value < len(names):
        raise V.Refused("unknown_enum", f"{where} {value}")
    return names[value]


KINDS = ["Unspecified", "Internal", "Server", "Client", "Producer", "Consumer"]
STATUSES = ["Unset", "Ok", "Error"]
TEMPORALITIES = [None, "Delta", "Cumulative"]


# --- envelopes -----------------------------------------------------------------------------------------------------
def _resource(raw: bytes | None, schema_url: str) -> dict:
    m = fields(raw) if raw is not None else {}
    if 3 in m:
        raise V.Refused("entity_refs")
    attrs = _attributes(m.get(1, []), "resource", LIMITS["attributes"])
    return {"attributes": attrs, "schema_url": schema_url or None, "dropped": _one(m, 2, 0)}


def _scope(raw: bytes | None, schema_url: str) -> dict:
    m = fields(raw) if raw is not None else {}
    return {"name": _text(m, 1), "version": _text(m, 2) or None, "attributes": _attributes(m.get(3, []), "scope", LIMITS["attributes"]), "schema_url": schema_url or None, "dropped": _one(m, 4, 0)}


def _envelope_columns(resource: dict, scope: dict) -> dict:
    service = resource["attributes"].get("service.name", {}).get("s")
    return {
        "resource_key": V.canonical(resource["attributes"]),
        "resource_schema_url": resource["schema_url"],
        "service_name": service,
        "scope_name": scope["name"],
        "scope_version": scope["version"],
        "scope_key": V.canonical(scope),
    }


def _envelope_size(resource: dict, scope: dict) -> int:
    return 2 * V.STRUCT + V.map_size(resource["attributes"]) + V.text_size(resource["schema_url"]) + V.text_size(scope["name"]) + V.text_size(scope["version"]) + V.map_size(scope["attributes"]) + V.text_size(scope["schema_url"])


def span_record(raw: bytes) -> dict:
    m = fields(raw)
    status = fields(_one(m, 15, b""))
    events, links = m.get(11, []), m.get(13, [])
    attrs = _attributes(m.get(9, []), "span", LIMITS["attributes"])
    made_events, made_links = [], []
    if len(events) > LIMITS["events"]:
        raise V.Refused("too_many_events")
    for e in map(fields, events):
        made_events.append({"time": _u64(e, 1) or None, "name": _text(e, 2), "attributes": _attributes(e.get(3, []), "event", LIMITS["nested_attributes"]), "dropped": _one(e, 4, 0)})
    if len(links) > LIMITS["links"]:
        raise V.Refused("too_many_links")
    for k in map(fields, links):
        made_links.append({"trace_id": _id(_one(k, 1), 16, "link", False), "span_id": _id(_one(k, 2), 8, "link", False), "tracestate": tracestate(_text(k, 3)), "attributes": _attributes(k.get(4, []), "link", LIMITS["nested_attributes"]), "dropped": _one(k, 5, 0), "flags": _u64(k, 6)})
    out = {
        "trace_id": _id(_one(m, 1), 16, "trace_id", False),
        "span_id": _id(_one(m, 2), 8, "span_id", False),
        "parent_span_id": _id(_one(m, 4), 8, "parent_span_id", True),
        "name": _text(m, 5),
        "kind": _enum(_i32(m, 6), KINDS, "kind"),
        "start_ns": _u64(m, 7),
        "end_ns": _u64(m, 8) or None,
        "flags": _u64(m, 16),
        "status_code": _enum(_i32(status, 3), STATUSES, "status"),
        "status_message": _text(status, 2),
        "detail": V.canonical({"tracestate": tracestate(_text(m, 3)), "events": made_events, "links": made_links, "dropped": [_one(m, n, 0) for n in (10, 12, 14)]}),
        "attrs_key": V.canonical(attrs),
    }
    size = V.STRUCT + V.text_size(out["name"]) + V.text_size(out["status_message"]) + V.map_size(attrs)
    size += sum(2 * V.SLOT + V.text_size(e["name"]) + V.map_size(e["attributes"]) for e in made_events) + sum(2 * V.SLOT + 24 + V.map_size(k["attributes"]) for k in made_links)
    out["_size"] = size
    return out


def log_record(raw: bytes) -> dict:
    m = fields(raw)
    severity = _i32(m, 2)
    if not 0 <= severity <= 24:
        raise V.Refused("severity_out_of_range", str(severity))
    body = _any(_one(m, 5), "body", empty_ok=True)
    if body is not None and V.depth(body) > LIMITS["depth"]:
        raise V.Refused("too_deep", "body")
    attrs = _attributes(m.get(6, []), "log", LIMITS["attributes"])
    out = {
        "ts_ns": _u64(m, 1) or None,
        "observed_ns": _u64(m, 11) or None,
        "severity": severity or None,
        "severity_text": _text(m, 3) or None,
        "body": None if body is None else V.canonical(body),
        "trace_id": _id(_one(m, 9), 16, "trace_id", True),
        "span_id": _id(_one(m, 10), 8, "span_id", True),
        "flags": _u64(m, 8) or None,
        "event_name": _text(m, 12) or None,
        "dropped": _one(m, 7, 0),
        "attrs_key": V.canonical(attrs),
    }
    out["_size"] = V.STRUCT + V.text_size(out["severity_text"]) + (V.value_size(body) if body else 0) + V.text_size(out["event_name"]) + V.map_size(attrs)
    return out


def _exemplars(raws: list[bytes]) -> list[dict]:
    if len(raws) > LIMITS["exemplars"]:
        raise V.Refused("too_many_exemplars")
    out = []
    for m in map(fields, raws):
        value = {"i": str(_int(int.from_bytes(_one(m, 6), "little")))} if 6 in m else {"d": V.double_bits(_f64(m, 3))} if 3 in m else None
        if value is None:
            raise V.Refused("missing_value", "exemplar")
        out.append({"value": value, "time": _u64(m, 2), "trace_id": _id(_one(m, 5), 16, "exemplar", True), "span_id": _id(_one(m, 4), 8, "exemplar", True), "attributes": _attributes(m.get(7, []), "exemplar", LIMITS["nested_attributes"])})
    return out


def _bits(x: float | None) -> str | None:
    return None if x is None else V.double_bits(x)


def _point(kind: str, raw: bytes) -> dict:
    m = fields(raw)
    attrs_at, flags_at, exemplars_at = {"Histogram": (9, 10, 8), "ExponentialHistogram": (1, 10, 11), "Summary": (7, 8, None)}.get(kind, (7, 8, 5))
    attrs = _attributes(m.get(attrs_at, []), "point", LIMITS["attributes"])
    exemplars = _exemplars(m.get(exemplars_at, [])) if exemplars_at else []
    flags = _u64(m, flags_at)
    payload: dict = {}
    value_int = value_double = None
    numbers = 0
    if kind in ("Gauge", "Sum"):
        shape = "Number"
        if 6 in m:
            value_int = _int(int.from_bytes(_one(m, 6), "little"))
            payload["value"] = {"i": str(value_int)}
        elif 4 in m:
            value_double = _f64(m, 4)
            payload["value"] = {"d": V.double_bits(value_double)}
        elif not flags & 1:
            raise V.Refused("missing_value", "point")
    elif kind == "Histogram":
        shape = kind
        counts, bounds = _packed(m, 6, "Q"), _packed(m, 7, "d")
        payload = {"count": str(_u64(m, 4)), "sum": _bits(_f64(m, 5)), "min": _bits(_f64(m, 11)), "max": _bits(_f64(m, 12)), "counts": [str(c) for c in counts], "bounds": [_bits(b) for b in bounds]}
        numbers = len(counts) + len(bounds)
    elif kind == "ExponentialHistogram":
        shape = kind

        def buckets(n: int):
            b = fields(_one(m, n, b""))
            return {"offset": _zigzag(b, 1), "counts": [str(c) for c in _packed(b, 2, "v")]}

        payload = {"count": str(_u64(m, 4)), "sum": _bits(_f64(m, 5)), "scale": _zigzag(m, 6), "zero_count": str(_u64(m, 7)), "positive": buckets(8), "negative": buckets(9), "min": _bits(_f64(m, 12)), "max": _bits(_f64(m, 13)), "zero_threshold": _bits(_f64(m, 14))}
        numbers = len(payload["positive"]["counts"]) + len(payload["negative"]["counts"])
    else:
        shape = "Summary"
        total = _f64(m, 5)
        # proto3 can't tell an absent sum from +0.0, but -0.0 was written
        payload = {"count": str(_u64(m, 4)), "sum": None if total is None or V.double_bits(total) == "0" * 16 else V.double_bits(total), "quantiles": [[_bits(_f64(q, 1) or 0.0), _bits(_f64(q, 2) or 0.0)] for q in map(fields, m.get(6, []))]}
        numbers = 2 * len(payload["quantiles"])
    if numbers > LIMITS["numbers_per_point"]:
        raise V.Refused("too_many_numbers")
    return {
        "shape": shape,
        "start_ns": _u64(m, 2) or None,
        "time_ns": _u64(m, 3),
        "flags": flags,
        "value_int": value_int,
        "value_double": value_double,
        "payload_key": V.canonical(payload | {"exemplars": exemplars}),
        "exemplars": json.dumps([[e["trace_id"], e["span_id"]] for e in exemplars]),
        "attrs_key": V.canonical(attrs),
        "_size": V.STRUCT + 8 + V.SLOT * numbers + V.map_size(attrs) + sum(2 * V.SLOT + V.map_size(e["attributes"]) for e in exemplars),
    }


def _metric(raw: bytes) -> tuple[dict, list[bytes]]:
    """(stream columns, raw points); an empty metric is refused."""
    m = fields(raw)
    kinds = {5: "Gauge", 7: "Sum", 9: "Histogram", 10: "ExponentialHistogram", 11: "Summary"}
    n = next((x for x in reversed(m) if x in kinds), None)
    if n is None:
        raise V.Refused("empty_metric")
    data = fields(m[n][-1])
    temporality = _enum(_i32(data, 2), TEMPORALITIES, "temporality") if n in (7, 9, 10) else None
    stream = {
        "stream_name": _text(m, 1),
        "description": _text(m, 2) or None,
        "unit": _text(m, 3) or None,
        "metadata_key": V.canonical(_attributes(m.get(12, []), "metadata", LIMITS["attributes"])),
        "stream_kind": kinds[n],
        "monotonic": bool(_one(data, 3, 0)) if n == 7 else None,
        "temporality": temporality,
    }
    return stream, data.get(1, [])


def _shape_refusal(stream: dict, point: dict) -> str | None:
    if stream["stream_kind"] != "Gauge" and point["start_ns"] is None:
        return "start_time_missing"
    needs = stream["stream_kind"] in ("Sum", "Histogram", "ExponentialHistogram")
    if needs and stream["temporality"] is None:
        return "temporality_missing"
    return None


def flatten(signal: str, payload: bytes) -> Iterator[dict]:
    """Records of one export in document order; a refused one has ``rejection``. Raises Unreadable for the whole."""
    for raw in fields(payload).get(1, []):
        block = fields(raw)
        try:
            resource, refused = _resource(_one(block, 1), _text(block, 3)), None
        except V.Refused as e:
            resource, refused = None, e
        for raw_scope in block.get(2, []):
            inner = fields(raw_scope)
            why = refused
            scope = None
            if why is None:
                try:
                    scope = _scope(_one(inner, 1), _text(inner, 3))
                except V.Refused as e:
                    why = e
            common = {} if why else _envelope_columns(resource, scope)
            base = 0 if why else _envelope_size(resource, scope)
            for item in inner.get(2, []):
                if signal != "metrics":
                    try:
                        if why:
                            raise why
                        record = (span_record if signal == "traces" else log_record)(item)
                        yield record | common | {"accounted_bytes": base + record.pop("_size"), "rejection": None}
                    except V.Refused as e:
                        yield {"rejection": str(e)}
                    continue
                try:
                    if why:
                        raise why
                    stream, points = _metric(item)
                except V.Refused as e:
                    m = fields(item)
                    count = sum(len(fields(m[n][-1]).get(1, [])) for n in (5, 7, 9, 10, 11) if n in m)
                    for _ in range(max(1, count)):
                        yield {"rejection": str(e)}
                    continue
                identity = V.canonical([common["resource_key"], common["scope_key"], *stream.values()])
                collapse = V.canonical([common["resource_key"], common["scope_key"], stream["stream_name"], stream["stream_kind"], stream["monotonic"], stream["temporality"]])
                for raw_point in points:
                    try:
                        point = _point(stream["stream_kind"], raw_point)
                        if slug := _shape_refusal(stream, point):
                            raise V.Refused(slug)
                        yield point | stream | common | {"identity_key": identity, "collapse_key": collapse, "identity_bytes": base + V.text_size(stream["stream_name"]) + V.text_size(stream["description"]) + V.text_size(stream["unit"]), "accounted_bytes": point.pop("_size"), "rejection": None}
                    except V.Refused as e:
                        yield {"rejection": str(e)}


_HEAD = "export_id long, received_ns long, position long, rejection string, accounted_bytes long, resource_key string, resource_schema_url string, service_name string, scope_name string, scope_version string, scope_key string, attrs_key string, "
SCHEMAS = {
    "traces": _HEAD + "trace_id string, span_id string, parent_span_id string, name string, kind string, start_ns decimal(20,0), end_ns decimal(20,0), flags long, status_code string, status_message string, detail string",
    "logs": _HEAD + "ts_ns decimal(20,0), observed_ns decimal(20,0), severity int, severity_text string, body string, trace_id string, span_id string, flags long, event_name string, dropped long",
    "metrics": _HEAD
    + "shape string, start_ns decimal(20,0), time_ns decimal(20,0), flags long, value_int long, value_double double, payload_key string, exemplars string, stream_name string, description string, unit string, metadata_key string, stream_kind string, monotonic boolean, temporality string, identity_key string, collapse_key string, identity_bytes long",
}


def decode(payloads: DataFrame, signal: str) -> DataFrame:
    """Flat records of all payloads of a signal, refused ones included with their reason and position.

    A payload that is too large, unreadable or holds too many records gives one row at position -1.
    """
    schema = SCHEMAS[signal]
    names = [x.split()[0] for x in schema.split(", ")]
    cap = LIMITS["points_per_export" if signal == "metrics" else "records_per_export"]
    from decimal import Decimal

    wide = {x.split()[0] for x in schema.split(", ") if "decimal" in x}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for export, received, payload in zip(b.export_id, b.received_ns, b.payload):
                head = {"export_id": export, "received_ns": received}
                if len(payload) > MOST_PAYLOAD:
                    out.append(head | {"position": -1, "rejection": "payload_too_large"})
                    continue
                try:
                    records = list(flatten(signal, bytes(payload)))
                except (Unreadable, UnicodeDecodeError, struct.error, TypeError, AttributeError):
                    out.append(head | {"position": -1, "rejection": "malformed"})
                    continue
                if len(records) > cap:
                    out.append(head | {"position": -1, "rejection": "too_many_records"})
                    continue
                for i, r in enumerate(records):
                    out.append(head | {"position": i} | {k: Decimal(v) if k in wide and v is not None else v for k, v in r.items()})
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in out], dtype=object) for n in names})

    return payloads.where(F.col("signal") == signal).select("export_id", "received_ns", "payload").mapInPandas(run, schema)
