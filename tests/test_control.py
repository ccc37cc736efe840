from pyspark.sql import functions as F

from glimmer.functions import columns as C
from glimmer.functions import values as V
from glimmer.functions.budget import BoundedQueue, Refusal, Spend


def test_traversal_grants_what_fits_and_aggregation_does_not():
    s = Spend({"scan": 5, "aggregation_bytes": 10})
    assert s.traverse("scan", 3) == (3, None)
    assert s.traverse("scan", 3) == (2, Refusal("scan", 5, 5))
    assert s.aggregate("aggregation_bytes", 11) == Refusal("aggregation_bytes", 10, 11)
    assert s.aggregate("aggregation_bytes", 10) is None
    assert s.aggregate("aggregation_bytes", 0) == Refusal("aggregation_bytes", 10, 10)


def test_exports_go_in_whole():
    q = BoundedQueue(100)
    assert q.offer(1, [40, 20]) and not q.offer(2, [30], [20]) and q.offer(3, [30], [10])
    assert q.pump() == 1 and q.offer(2, [30], [20]) and q.counters == {"taken": 3, "refused": 1}
    assert q.drain(1) == 1 and q.used == 0


def test_tiers_clock_and_values(spark):
    df = spark.createDataFrame([("span_identity", "18446744073709551615", '{"b":"00ff"}'), ("temporal", "5", '{"a":[{"i":"1"}]}'), ("resource_context", None, None)], "t string, n string, v string")
    got = df.select(C.tier_of(F.col("t")).alias("tier"), C.clock_value(F.col("n").cast("decimal(20,0)")).alias("n"), V.plain_json("v").alias("v")).collect()
    assert [tuple(r) for r in got] == [("identity", 2**63 - 1, "00ff".join('""')), ("temporal", 5, "[1]"), ("structural", None, None)]


def test_value_sizes_and_depth():
    v = {"k": [["a", {"a": [{"i": "1"}, {"i": "2"}]}]]}
    assert V.depth(v) == 2 and V.value_size(v) == V.ENTRY + 1 + 2 * (2 * V.SLOT + 8)
    assert V.map_size({}) == 0 and V.map_size({"ab": {"s": "xyz"}}) == V.MAP + V.ENTRY + 5
