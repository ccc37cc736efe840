"""What several operators of this subpackage need: shared tables, connected components, table loading."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:  # workers that need no pandas don't load it
    import pandas as pd


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster: ``spark.checkpoint.dir``, or one of our own where that is unset and all runs in
    one process (tests); on a cluster without the setting this fails."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="glimmer-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glimmer-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._glimmer_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    path = getattr(df, "_glimmer_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]):
    """What ``make`` gives, kept in this process from task to task until ``let_go``."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Drop what other operators keep; Spark hands a Python worker on from operator to operator."""
    _KEPT.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; texts go to Python in batches of 16 MB, so that a worker's memory does not follow them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to so many edges (16 bytes each) the components are worked out in one task; beyond it, round by round.
EDGES_IN_ONE_TASK = 2_000_000


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pandas as pd

    edges = [b for b in batches if len(b)]
    if not edges:
        return
    a, b = (np.concatenate([e[c].to_numpy(np.int64) for e in edges]) for c in ("a", "b"))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root != root[root]).any():
            root = root[root]
    yield pd.DataFrame({"id": ids, "component": ids[root]})


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", most_rounds: int = 60, one_task: int = EDGES_IN_ONE_TASK) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge, itself included.

    Up to ``one_task`` distinct edges are joined in one task. Beyond that, alternating large-star and small-star steps
    run over edges that are kept as written tables, so each round is two shuffles with map-side minima and lineage
    stays short. Both give the same rows. Self loops and nulls have no effect.
    """
    flat = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where("a < b").distinct()
    now = materialize(flat)
    if now.limit(one_task + 1).count() <= one_task:
        return now.coalesce(1).mapInPandas(_in_one_task, "id long, component long")
    for _ in range(most_rounds):
        both = now.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(now.select(F.col("a").alias("u"), F.col("b").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = (
            large.join(low, large.b == low.u)
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a < b").distinct()
        )
        new = materialize(small)
        # a forest of stars has every larger end once and no end on both sides
        ends = new.groupBy(F.col("b").alias("x")).agg(F.count(F.lit(1)).alias("n")).select("x", "n", F.lit(0).alias("root"))
        roots = new.select(F.col("a").alias("x")).distinct().select("x", F.lit(0).cast("long").alias("n"), F.lit(1).alias("root"))
        bad = ends.unionByName(roots).groupBy("x").agg(F.sum("n").alias("n"), F.max("root").alias("root")).where("n > 1 or (n = 1 and root = 1)").limit(1).count()
        discard(now)
        now = new
        if not bad:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
