"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are projected on the leading principal directions of a bounded sample (a projection never lengthens a
distance, so any fit prunes safely) and sorted by grid cells of side epsilon, where ``epsilon^2 = 2 - 2 * cosine``.
The sorted sequence is cut into blocks; intervals of blocks are joined recursively: a pair of intervals whose bounding
boxes lie over epsilon apart is dropped with all that it holds, and the others are replaced by the pairs of their
parts. Only surviving block pairs compare vectors, by the exact double-precision cosine.

Exact copies are one class before the join, so a large group of copies costs one row. A block pair gives back, per
vector, a number of links and a spanning forest, never its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors
of different length link with nothing either; a null vec_id keeps its row with a null component, not kept; rows that
share a vec_id are one node; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, table

COSINE = 0.95
_SLACK = 1e-9  # bounds are let out by this much, far over rounding and far under what matters


def _clean(v) -> np.ndarray | None:
    if v is None or not len(v):
        return None
    x = np.array([np.nan if e is None else e for e in v], float) if getattr(v, "dtype", None) == object or isinstance(v, list) else np.asarray(v, float)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top  # so that squares neither vanish nor overflow
    return x / np.sqrt(x @ x)


def _raw(v, unit: np.ndarray) -> bytes:
    """Bytes of the vector as it was given, in single precision where that loses nothing."""
    x = np.asarray(v, float)
    small = x.astype(np.float32)
    return small.tobytes() if (small.astype(float) == x).all() else x.tobytes()


def _units(raws, dims: int) -> np.ndarray:
    """Unit vectors in double precision, a row for each of ``_raw``'s bytes."""
    x = np.array([np.frombuffer(r, np.float32 if len(r) == 4 * dims else float).astype(float) for r in raws]).reshape(-1, dims)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def unit_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, dims, raw (bytes; null where the vector links with nothing), digest of the unit vector."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b.vec:
                u = _clean(v)
                out.append((0, None, None) if u is None else (len(u), _raw(v, u), hashlib.md5((u + 0.0).tobytes()).digest()))
            made = pd.DataFrame(out, columns=["dims", "raw", "digest"])
            made.insert(0, "vec_id", b.vec_id.astype("Int64").values)
            yield made

    return rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).mapInPandas(make, "vec_id long, dims int, raw binary, digest binary")


def principal_directions(units: DataFrame, dims: int, most_rows: int, directions: int) -> np.ndarray:
    """Rows are directions; from at most about ``most_rows`` vectors, chosen by a hash of their content."""
    total = max(units.count(), 1)
    drawn = units.where(F.pmod(F.xxhash64("digest"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most_rows / total)))
    x = _units([bytes(r.raw) for r in drawn.select("raw").toLocalIterator()] or [np.ones(dims).tobytes()], dims)
    if len(x) < 2:
        return np.eye(dims)[:directions]
    x = x - x.mean(0)
    _, vectors = np.linalg.eigh(x.T @ x)
    return vectors.T[::-1][:directions].copy()


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> list[tuple[int, int]]:
    parent = list(range(size))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        ri, rj = find(i), find(j)
        if ri != rj:
            parent[max(ri, rj)] = min(ri, rj)
            out.append((i, j))
    return out


def near_links(units: DataFrame, dims: int, cosine: float, directions: int = 16, most_sample: int = 20_000, block: int | None = None, fan: int = 8) -> DataFrame:
    """For class representatives (vec_id, many, raw, digest) of one length: rows (vec_id, other, links).

    Rows with ``links`` carry a share of a vector's number of links (copies of linked classes counted); rows with
    ``other`` are edges of spanning forests.
    """
    spark = units.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    axes = principal_directions(units, dims, most_sample, min(directions, dims))
    k = len(axes)
    cells = min(4, k)
    # a task holds two intervals of `fan` blocks: about 16 MB in double precision, whatever the vectors' length
    block = block or max(16, min(1024, (1 << 17) // dims))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = _units(b.raw, dims) @ axes.T
                out = b[["vec_id", "many", "raw"]].copy()
                for i in range(cells):
                    out[f"c{i}"] = np.floor(p[:, i] / max(eps, 1e-6)).astype(np.int64)
                out["rest"] = p[:, cells] if k > cells else 0.0
                yield out

    names = [f"c{i}" for i in range(cells)] + ["rest"]
    ordered = materialize(units.select("vec_id", "many", "raw").mapInPandas(project, "vec_id long, many long, raw binary, " + ", ".join(f"{c} long" for c in names[:-1]) + ", rest double"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at, number, held = TaskContext.get().partitionId(), 0, []

        def made(rows: pd.DataFrame) -> pd.DataFrame:
            p = _units(rows.raw, dims) @ axes.T
            return pd.DataFrame({"block": [(at << 32) + number], "ids": [rows.vec_id.to_numpy(np.int64).tobytes()], "many": [rows.many.to_numpy(np.int64).tobytes()], "vectors": [rows.raw.tolist()], "low": [p.min(0).tolist()], "high": [p.max(0).tolist()]})

        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= block:
                now = pd.concat(held, ignore_index=True)
                yield made(now.iloc[:block])
                number += 1
                held = [now.iloc[block:]]
        if sum(map(len, held)):
            yield made(pd.concat(held, ignore_index=True))

    blocks = materialize(ordered.repartitionByRange(parts, *names).sortWithinPartitions(*names).mapInPandas(cut, "block long, ids binary, many binary, vectors array<binary>, low array<double>, high array<double>"))
    boxes = blocks.select("block", "low", "high")

    # positions in the sequence, then intervals of `fan` parts level by level; only boxes move, never vectors
    firsts = boxes.groupBy(F.shiftright("block", 32).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row per partition
    offset, begin = 0, []
    for r in firsts:
        begin.append((r.part, offset))
        offset += r.n
    if not offset:
        return spark.createDataFrame([], "vec_id long, other long, links long")
    starts = spark.createDataFrame(begin, "part long, begin long")
    level = boxes.join(F.broadcast(starts), F.shiftright("block", 32) == F.col("part")).select((F.col("begin") + F.col("block").bitwiseAND(F.lit(2**32 - 1))).alias("at"), "block", "low", "high")
    levels = [materialize(level)]
    count = offset
    while count > 1 or len(levels) == 1:
        up = levels[-1].groupBy(F.floor(F.col("at") / fan).alias("at")).agg(*[F.min(F.col("low")[i]).alias(f"l{i}") for i in range(k)], *[F.max(F.col("high")[i]).alias(f"h{i}") for i in range(k)])
        levels.append(materialize(up.select("at", F.array(*[f"l{i}" for i in range(k)]).alias("low"), F.array(*[f"h{i}" for i in range(k)]).alias("high"))))
        count = -(-count // fan)

    pairs = spark.createDataFrame([(0, 0)], "a long, b long")
    for boxes_here in reversed(levels[1:-1]):
        part = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(fan - 1)), lambda i: F.col(c) * fan + i))
        pairs = pairs.select(part("a").alias("a"), "b").select("a", part("b").alias("b")).where("a <= b")
        x = boxes_here.select(F.col("at").alias("a"), F.struct("low", "high").alias("x"))
        y = boxes_here.select(F.col("at").alias("b"), F.struct("low", "high").alias("y"))
        zipped = pairs.join(x, "a").join(y, "b")
        gap = F.aggregate(
            F.sequence(F.lit(0), F.lit(k - 1)),
            F.lit(0.0),
            lambda s, i: s + F.pow(F.greatest(F.col("x.low")[i] - F.col("y.high")[i], F.col("y.low")[i] - F.col("x.high")[i], F.lit(0.0)), 2),
        )
        pairs = materialize(zipped.where(gap <= (eps + _SLACK) ** 2).select("a", "b"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """The last level of the recursion: blocks of two intervals, each sent once for all its partners there."""
        rows = rows.sort_values("at", kind="stable")
        made = [(int(r.at), int(r.at) // fan, np.frombuffer(r.ids, np.int64), np.frombuffer(r.many, np.int64), _units(r.vectors, dims), np.array(r.low), np.array(r.high)) for r in rows.itertuples()]
        ga, gb = int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
        ids, counts, edges = [], [], []
        for x in made:
            for y in made:
                if x[1] != ga or y[1] != gb or x[0] > y[0]:
                    continue
                apart = np.maximum(np.maximum(x[5] - y[6], y[5] - x[6]), 0)
                if apart @ apart > (eps + _SLACK) ** 2:
                    continue
                same = x[0] == y[0]
                hit = x[4] @ y[4].T >= cosine
                if same:
                    np.fill_diagonal(hit, False)
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                ids.append(x[2])
                counts.append(np.bincount(i, y[3][j], len(x[2])))
                if same:
                    edges += [(x[2][p], x[2][q]) for p, q in _forest(i[i < j], j[i < j], len(x[2]))]
                else:
                    ids.append(y[2])
                    counts.append(np.bincount(j, x[3][i], len(y[2])))
                    edges += [(x[2][p], y[2][q - len(x[2])]) for p, q in _forest(i, j + len(x[2]), len(x[2]) + len(y[2]))]
        out = pd.DataFrame({"vec_id": np.concatenate(ids) if ids else np.zeros(0, np.int64), "links": np.concatenate(counts) if counts else np.zeros(0)})
        out = out[out.links > 0].groupby("vec_id", as_index=False).links.sum()
        joined = pd.DataFrame(edges, columns=["vec_id", "other"]).drop_duplicates()
        both = pd.concat([out, joined], ignore_index=True)
        return pd.DataFrame({"vec_id": both.vec_id.astype("int64"), "other": (both.other if "other" in both else pd.Series(index=both.index)).astype("Int64"), "links": both.links.fillna(0).astype("int64")})

    data = levels[0].select("at", "block", "low", "high").join(blocks.select("block", "ids", "many", "vectors"), "block").drop("block").withColumn("interval", F.floor(F.col("at") / fan))
    of = lambda side: pairs.withColumn("interval", F.col(side)).join(data, "interval").drop("interval")
    sent = of("a").unionByName(of("b").where("a <> b"))
    return sent.groupBy("a", "b").applyInPandas(compare, "vec_id long, other long, links long")


def embedding_components(rows: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", **knobs) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    spark = rows.sparkSession
    units = materialize(unit_vectors(rows, key, vector))
    good = units.where("raw is not null and vec_id is not null")
    classes = materialize(good.groupBy("digest", "dims").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"), F.first("raw").alias("raw")))
    found = None
    for r in sorted(x.dims for x in classes.select("dims").distinct().collect()):  # one row per vector length
        now = near_links(classes.where(F.col("dims") == r).select(F.col("rep").alias("vec_id"), "many", "raw", "digest"), r, cosine, **knobs)
        found = now if found is None else found.unionByName(now)
    if found is None:
        found = spark.createDataFrame([], "vec_id long, other long, links long")
    found = materialize(found)
    comps = materialize(connected_components(found.where("other is not null").select(F.col("vec_id").alias("u"), F.col("other").alias("v"))))
    links = found.where("other is null").groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    known = classes.select("digest", "rep", "many").join(links, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("digest", "rep", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = units.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(known, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))
