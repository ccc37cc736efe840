"""Build OTLP payloads by hand for tests."""

import struct


def varint(n):
    n &= 2**64 - 1
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def num(field, n):
    return varint(field << 3) + varint(n)


def fix(field, n):
    return varint(field << 3 | 1) + struct.pack("<Q", n)


def dbl(field, x):
    return varint(field << 3 | 1) + struct.pack("<d", x)


def msg(field, raw):
    raw = raw.encode() if isinstance(raw, str) else raw
    return varint(field << 3 | 2) + varint(len(raw)) + raw


def anyvalue(v):
    if isinstance(v, bool):
        return num(2, int(v))
    if isinstance(v, str):
        return msg(1, v)
    if isinstance(v, int):
        return num(3, v)
    if isinstance(v, float):
        return dbl(4, v)
    if isinstance(v, bytes):
        return msg(7, v)
    if isinstance(v, list):
        return msg(5, b"".join(msg(1, anyvalue(x)) for x in v))
    return msg(6, b"".join(msg(1, msg(1, k) + msg(2, anyvalue(x))) for k, x in v.items()))


def attrs(field, d):
    pairs = d.items() if isinstance(d, dict) else d
    return b"".join(msg(field, msg(1, k) + msg(2, anyvalue(v))) for k, v in pairs)


def span(trace, sid, parent=b"", name="op", start=1, end=2, a=None, kind=2, more=b""):
    return msg(1, trace) + msg(2, sid) + (msg(4, parent) if parent else b"") + msg(5, name) + num(6, kind) + fix(7, start) + (fix(8, end) if end else b"") + attrs(9, a or {}) + more


def log(ts=0, sev=0, body=None, trace=b"", sid=b"", a=None):
    return (fix(1, ts) if ts else b"") + (num(2, sev) if sev else b"") + (msg(5, anyvalue(body)) if body is not None else b"") + attrs(6, a or {}) + (msg(9, trace) if trace else b"") + (msg(10, sid) if sid else b"")


def gauge(name, points):
    return msg(1, name) + msg(5, b"".join(msg(1, p) for p in points))


def total(name, points, temporality=2, monotonic=1):
    return msg(1, name) + msg(7, b"".join(msg(1, p) for p in points) + num(2, temporality) + num(3, monotonic))


def number(time, value, start=0, a=None, more=b""):
    v = dbl(4, value) if isinstance(value, float) else fix(6, value & (2**64 - 1))
    return (fix(2, start) if start else b"") + fix(3, time) + v + attrs(7, a or {}) + more


def export(items, resource=None, scope="lib", url=""):
    res = attrs(1, resource if resource is not None else {"service.name": "svc"})
    return msg(1, msg(1, res) + msg(2, msg(1, msg(1, scope)) + b"".join(msg(2, i) for i in items)) + (msg(3, url) if url else b""))
