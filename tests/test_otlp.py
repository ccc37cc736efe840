import json

import pytest
import wire as w

from glimmer.functions import values as V
from glimmer.sources import otlp

T, S1, S2 = b"\x01" * 16, b"\x00" * 7 + b"\x01", b"\x00" * 7 + b"\x02"


def only(signal, *items, **k):
    return list(otlp.flatten(signal, w.export(items, **k)))


def test_a_span_comes_out_flat_with_its_service():
    (r,) = only("traces", w.span(T, S1, name="get", a={"b": 1, "a": "x"}))
    assert (r["trace_id"], r["span_id"], r["parent_span_id"], r["name"], r["kind"]) == (T.hex(), S1.hex(), None, "get", "Server")
    assert r["service_name"] == "svc" and json.loads(r["attrs_key"]) == {"a": {"s": "x"}, "b": {"i": "1"}}
    assert r["accounted_bytes"] > V.MAP and r["rejection"] is None


@pytest.mark.parametrize(
    "item,slug",
    [
        (w.span(T[:4], S1), "id_length"),
        (w.span(T, S1, kind=9), "unknown_enum"),
        (w.span(T, S1, a=[("a", 1), ("a", 2)]), "duplicate_key"),
        (w.span(T, S1, a={"a": [1, "x"]}), "mixed_array"),
        (w.span(T, S1, a={str(i): 1 for i in range(257)}), "too_many_attributes"),
        (w.span(T, S1, a={"a": "x" * 5000}), "attribute_too_large"),
        (w.span(T, S1, a={"a": [[[[[[[[[1]]]]]]]]]}), "too_deep"),
        (w.span(T, S1, more=w.msg(3, "novalue")), "tracestate"),
        (w.span(T, S1, more=w.msg(3, ",".join(f"k{i}=v" for i in range(33)))), "tracestate_over_cap"),
        (w.span(T, S1, more=b"".join(w.msg(11, w.msg(2, "e")) for _ in range(129))), "too_many_events"),
        (w.span(T, S1, more=b"".join(w.msg(13, w.msg(1, T) + w.msg(2, S1)) for _ in range(33))), "too_many_links"),
    ],
)
def test_refused_spans_name_why(item, slug):
    good, bad = only("traces", w.span(T, S2), item)
    assert good["rejection"] is None and bad["rejection"].startswith(slug)


def test_logs_keep_absence_apart_from_zero():
    a, b, c = only("logs", w.log(), w.log(5, 17, {"k": [1, 2]}, T, S1), w.log(sev=25))
    assert a["ts_ns"] is a["severity"] is a["body"] is a["trace_id"] is None
    assert b["severity"] == 17 and V.plain(json.loads(b["body"])) == {"k": [1, 2]}
    assert c["rejection"].startswith("severity_out_of_range")


def test_points_follow_the_shape_law():
    rows = list(otlp.flatten("metrics", w.export([w.gauge("g", [w.number(5, 1.5), w.number(6, -3)]), w.total("s", [w.number(5, 1), w.number(5, 1, start=2)]), w.total("t", [w.number(5, 1, start=2)], temporality=0), w.msg(1, "empty")])))
    assert [r["rejection"] and r["rejection"].split(":")[0] for r in rows] == [None, None, "start_time_missing", None, "temporality_missing", "empty_metric"]
    assert rows[0]["value_double"] == 1.5 and rows[1]["value_int"] == -3 and rows[3]["monotonic"] is True


def test_histograms_exponential_histograms_and_summaries_are_read():
    hist = w.msg(1, "h") + w.msg(9, w.msg(1, w.fix(2, 1) + w.fix(3, 9) + w.fix(4, 2**64 - 1) + w.dbl(5, 2.0) + w.msg(6, w.struct.pack("<2Q", 1, 2)) + w.msg(7, w.struct.pack("<d", 0.5))) + w.num(2, 1))
    exp = w.msg(1, "e") + w.msg(10, w.msg(1, w.fix(2, 1) + w.fix(3, 9) + w.fix(4, 3) + w.num(6, 3) + w.msg(8, w.num(1, 2) + w.msg(2, w.varint(1) + w.varint(300)))) + w.num(2, 2))
    summ = w.msg(1, "q") + w.msg(11, w.msg(1, w.fix(2, 1) + w.fix(3, 9) + w.fix(4, 3) + w.dbl(5, -0.0) + w.msg(6, w.dbl(1, 0.5) + w.dbl(2, 7.0))))
    h, e, q = only("metrics", hist, exp, summ)
    assert json.loads(h["payload_key"])["count"] == str(2**64 - 1) and json.loads(h["payload_key"])["counts"] == ["1", "2"]
    e = json.loads(e["payload_key"])
    assert e["scale"] == -2 and e["positive"] == {"offset": 1, "counts": ["1", "300"]}
    assert json.loads(q["payload_key"])["sum"] == "8" + "0" * 15


def test_a_broken_resource_refuses_every_record_beneath():
    raw = w.msg(1, w.msg(1, w.attrs(1, [("a", 1), ("a", 1)])) + w.msg(2, w.msg(2, w.log()) + w.msg(2, w.log())))
    assert [r["rejection"] for r in otlp.flatten("logs", raw)] == ["duplicate_key"] * 2


def test_decode_refuses_whole_payloads(spark):
    rows = [(1, 1, "logs", bytearray(w.export([w.log(1)]))), (2, 2, "logs", bytearray(b"\xff\xff")), (3, 3, "logs", bytearray(b"\x0a" + w.varint((4 << 20) + 1) + b"x" * ((4 << 20) + 1))), (4, 4, "logs", bytearray(w.export([w.log(1)] * 10_001)))]
    df = spark.createDataFrame(rows, "export_id long, received_ns long, signal string, payload binary")
    got = {(r.export_id, r.position): r.rejection for r in otlp.decode(df, "logs").collect()}
    assert got == {(1, 0): None, (2, -1): "malformed", (3, -1): "payload_too_large", (4, -1): "too_many_records"}


def test_doubles_are_equal_by_their_bits():
    assert V.double_bits(0.0) != V.double_bits(-0.0)
    assert V.plain({"d": V.double_bits(1.5)}) == 1.5
