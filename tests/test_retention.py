import random

from glimmer.operators.retention import Ceilings, SequentialStore, retention_tick_s, surviving

SCHEMA = "admitted_at long, tag int, trace_key string, span_key string, serial long, accounted_bytes long, stream_key string, identity_bytes long"


def test_the_suffix_is_what_the_sequential_law_keeps(spark):
    rng = random.Random(3)
    for _ in range(5):
        rows, at = [], 0
        for i in range(1, rng.randint(5, 40)):
            at += rng.randint(0, 30)
            s = rng.choice("abc")
            rows.append((at, 1, "", "", i, rng.randint(1, 20), s, 10 + ord(s) % 3))
        c = Ceilings(rng.randint(3, 20), rng.randint(60, 300), rng.randint(50, 400), 10)
        store = SequentialStore(c)
        store.run({"key": r[:5], "identity": None, "payload": "", "bytes": r[5], "stream": r[6], "stream_bytes": r[7]} for r in rows)
        got = surviving(spark.createDataFrame(rows, SCHEMA), c).collect()
        assert sorted(r.serial for r in got) == sorted(k[4] for k in store.resident)


def test_refusals_never_evict_and_causes_are_counted():
    s = SequentialStore(Ceilings(2, 100, 1000, 1))
    r = lambda i, size=10, stream=None, at=None, **k: {"key": (at or i, 1, "", "", i), "identity": k.get("identity"), "payload": k.get("payload", ""), "bytes": size, "stream": stream, "stream_bytes": 5}
    assert s.run([r(1, stream="a"), r(2, 200), r(3, stream="b"), r(4, 98, stream="b"), r(4), r(5)]) == ["admitted", "oversized", "series_cap", "identity_over_ceiling", "admitted", "admitted"]
    assert s.counters["evicted_records"] == 1 and s.total == 20
    assert s.keep(r(5)) == "duplicate"
    s.expire(2000)
    assert not s.resident and s.counters["evicted_window"] == 2


def test_identity_ends_with_residency():
    s = SequentialStore(Ceilings(1, 1000, 1000, 1))
    r = lambda i, ident, p: {"key": (i, 0, "t", str(i), 0), "identity": ident, "payload": p, "bytes": 1}
    assert s.run([r(1, "x", "p"), r(2, "x", "p"), r(3, "x", "q"), r(4, "y", "p"), r(5, "x", "q")]) == ["admitted", "collapsed", "conflict", "admitted", "admitted"]


def test_tick():
    assert [retention_tick_s(x) for x in (0.5, 20, 3600)] == [1.0, 10.0, 60.0]
