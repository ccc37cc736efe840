import random

import pytest

from glimmer.functions.cursor import Cursor, CursorError, Entity, Key, fingerprint
from glimmer.operators.filters import LogFilters, Scope, SpanFilters, TimeRange
from glimmer.operators.page import Budget, chain, page_rows, records_page

SCHEMA = "admitted_at long, tag int, trace_key string, span_key string, serial long, severity int, service_name string, ts_ns long, observed_ns long, scope_name string, scope_version string, accounted_bytes long"


def store(spark, rows):
    return spark.createDataFrame([(100 * i, 1, "", "", i, sev, "s", i, None, "l", None, size) for i, (sev, size) in enumerate(rows, 1)], SCHEMA).coalesce(1)


def law(rows, r, b, s):
    """The page law one record at a time."""
    items, used, omitted, examined, counting, stop = [], 0, 0, 0, False, None
    for serial, (sev, size) in enumerate(rows, 1):
        if examined >= s:
            stop = "scan"
            break
        examined += 1
        if sev < 9:
            continue
        if counting:
            omitted += 1
        elif len(items) >= r:
            stop = "results"
            break
        elif used + size > b:
            counting, omitted = True, 1
        else:
            items.append(serial)
            used += size
    return items, "bytes" if counting else stop, omitted, examined


def test_page_plan_and_walk_agree_with_the_law(spark):
    rng = random.Random(5)
    for _ in range(6):
        rows = [(rng.choice([5, 9, 17]), rng.randint(1, 9)) for _ in range(rng.randint(1, 40))]
        r, b, s = rng.randint(1, 12), rng.randint(5, 60), rng.randint(1, 45)
        df = store(spark, rows)
        items, dimension, omitted, examined = law(rows, r, b, s)
        page = records_page(df, LogFilters(severity=9), Budget(r, b, s))
        assert ([x.serial for x in page.items], page.dimension, page.omitted, page.examined) == (items, dimension, omitted, examined)
        got = page_rows(df, LogFilters(severity=9).column(), Budget(r, b, s)).orderBy("n").collect()
        assert [x.serial for x in got] == items
        if got:
            assert (got[0].dimension, got[0].omitted, got[0].examined) == (dimension, omitted, examined)


def test_pages_walk_to_exhaustion_and_name_their_snapshot(spark):
    df = store(spark, [(9, 1)] * 5)
    items, pages = chain(df, LogFilters(), Budget(max_results=2))
    assert [x.serial for x in items] == [1, 2, 3, 4, 5] and pages[-1].outcome == "complete"
    more = store(spark, [(9, 1)] * 7)
    second = records_page(more, LogFilters(), Budget(), pages[0].cursor)
    assert [x.serial for x in second.items] == [3, 4, 5] and second.coverage == ["snapshot_boundary"]
    gone = more.where("serial <> 2")
    assert "eviction_gap" in records_page(gone, LogFilters(), Budget(), pages[0].cursor).coverage


def test_the_batch_frontier_hides_what_lies_past_the_pulled_batch(spark):
    df = store(spark, [(9, 1)] * 70)
    first = records_page(df, LogFilters(), Budget(max_results=10), frontier="batch")
    assert Cursor.decode(first.cursor).snapshot == Key(6400, Entity(1, serial=64))


def test_empty_and_refused_pages(spark):
    df = store(spark, [(9, 1)] * 3)
    assert records_page(df, LogFilters(), Budget(max_results=0)).outcome == "complete"
    assert records_page(df, LogFilters(), Budget(max_scan=0)).outcome == "refused"


def test_cursors_are_strict_and_bound_to_their_query():
    c = Cursor(Key(7, Entity(0, "ab" * 16, "cd" * 8)), fingerprint(LogFilters().canonical()), Key(9, Entity(1, serial=3)))
    raw = c.encode()
    assert len(raw) == 16 + 25 + 8 + 9 and Cursor.decode(raw) == c
    for bad in (raw[:-1], raw + b"\x00", raw[:16] + b"\x02" + raw[17:], b""):
        with pytest.raises(CursorError):
            Cursor.decode(bad)
    with pytest.raises(CursorError):
        Cursor.decode(raw, fingerprint(SpanFilters().canonical()))


def test_fingerprints_tell_filters_apart():
    many = [LogFilters(), SpanFilters(), LogFilters(service=""), LogFilters(service="a"), LogFilters(time=TimeRange(0, 1)), LogFilters(severity=1), LogFilters(scope=Scope("a")), LogFilters(scope=Scope("a", ""))]
    assert len({f.canonical() for f in many}) == len({fingerprint(f.canonical()) for f in many}) == len(many)
    assert fingerprint(b"") == 0xCBF29CE484222325 and fingerprint(b"a") == 0xAF63DC4C8601EC8C
    with pytest.raises(ValueError):
        LogFilters(severity=25)
