import pytest
import wire as w

from glimmer.operators.retention import Ceilings
from glimmer.streaming.ingest import PAYLOAD_SCHEMA, TelemetryStore

T, S = b"\x01" * 16, lambda n: n.to_bytes(8, "big")


def land(spark, path, rows):
    spark.createDataFrame([(e, e, s, bytearray(p)) for e, s, p in rows], PAYLOAD_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_ingest_dedups_across_batches_and_reopens(spark, tmp_path):
    landing, check, path = (str(tmp_path / n) for n in ("landing", "check", "store"))
    land(spark, landing, [(1, "traces", w.export([w.span(T, S(1)), w.span(T, S(2), S(1)), w.span(T, S(1)), w.span(bytes(16), S(9)), w.span(bytes(16), S(9))])), (2, "logs", w.export([w.log(5, 9, "x"), w.log(5, 9, "x")]))])
    store = TelemetryStore(spark, path)
    store.start(landing, check).awaitTermination()
    counters = store.manifest()["counters"]["0"]
    assert counters == {"traces.admitted": 4, "traces.collapsed": 1, "logs.admitted": 2}
    land(spark, landing, [(3, "traces", w.export([w.span(T, S(1)), w.span(T, S(2), S(1), name="other"), w.span(T, S(3), S(2))], url="http://x")), (4, "metrics", w.export([w.gauge("g", [w.number(5, 1.0), w.number(5, 1.0, start=3), w.number(5, 2.0)])])), (5, "logs", b"\xff")])
    again = TelemetryStore(spark, path)
    again.start(landing, check).awaitTermination()
    got = again.manifest()["counters"]["1"]
    assert got == {"traces.admitted": 1, "traces.collapsed": 1, "traces.conflict": 1, "traces.provenance_drift": 1, "metrics.admitted": 1, "metrics.collapsed": 1, "metrics.conflict": 1, "logs.rejected": 1}
    spans = again.resident("traces").collect()
    assert len(spans) == 5 and len({r.admitted_at for r in spans}) == 2
    serials = [r.serial for s in ("traces", "logs", "metrics") for r in again.resident(s).collect() if r.tag == 1]
    assert sorted(serials) == [1, 2, 3, 4, 5]


def test_a_batch_is_admitted_once_and_retention_holds(spark, tmp_path):
    store = TelemetryStore(spark, str(tmp_path / "s"), Ceilings(records=3))
    batch = spark.createDataFrame([(1, 1, "logs", bytearray(w.export([w.log(i) for i in range(1, 6)])))], PAYLOAD_SCHEMA)
    assert store.admit(batch, 0) == store.admit(batch, 0) == {"logs.admitted": 5}
    assert sorted(r.serial for r in store.resident("logs").collect()) == [3, 4, 5]


def test_ceilings_hold_for_all_kinds_together(spark, tmp_path):
    store = TelemetryStore(spark, str(tmp_path / "s"), Ceilings(records=4))
    store.admit(spark.createDataFrame([(1, 1, "traces", bytearray(w.export([w.span(T, S(i)) for i in range(1, 4)])))], PAYLOAD_SCHEMA), 0)
    store.admit(spark.createDataFrame([(2, 2, "logs", bytearray(w.export([w.log(i) for i in range(1, 4)])))], PAYLOAD_SCHEMA), 1)
    assert [store.resident(k).count() for k in ("traces", "logs")] == [1, 3]
    assert store.manifest()["evicted"] == {"traces": 2} and store.manifest(0)["evicted"] == {}


def test_a_crash_between_any_two_steps_loses_nothing(spark, tmp_path, monkeypatch):
    batch = lambda i: spark.createDataFrame([(i, i, "logs", bytearray(w.export([w.log(i)])))], PAYLOAD_SCHEMA)

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    for step in ("_oldest_kept", "_commit", "_clean"):
        store = TelemetryStore(spark, str(tmp_path / step))
        store.admit(batch(1), 0)
        with monkeypatch.context() as m:
            m.setattr(TelemetryStore, step, crash)
            with pytest.raises(Crash):
                store.admit(batch(2), 1)
        again = TelemetryStore(spark, str(tmp_path / step))
        assert sorted(r.serial for r in again.resident("logs").collect()) == ([1, 2] if step == "_clean" else [1])
        assert again.admit(batch(2), 1) == {"logs.admitted": 1}
        assert sorted(r.serial for r in again.resident("logs").collect()) == [1, 2]
        (tmp_path / step / "manifest" / f"{2:020d}.writing").write_text("{")  # a commit that did not come to its rename
        assert again.manifest()["batch"] == 1


def test_files_that_no_batch_needs_are_deleted(spark, tmp_path):
    store = TelemetryStore(spark, str(tmp_path / "s"))
    for i in range(4):
        store.admit(spark.createDataFrame([(i, i, "logs", bytearray(w.export([w.log(i + 1)])))], PAYLOAD_SCHEMA), i)
    at = tmp_path / "s"
    assert sorted(p.name for p in (at / "resident/logs").iterdir()) == ["2", "3"]
    assert not any((at / "staged").iterdir()) and not any((at / "judged").iterdir())
    assert store.resident("logs").count() == 4
