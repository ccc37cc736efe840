"""N-gram Jaccard join: which documents share at least a given part of their word shingles.

The document by n-gram incidence matrix is multiplied with its own transpose in blocks, without ever holding the
product. Rows are classes of equal sets (``node``); columns are shingle hashes in one global order: frequent columns
after all others, and by hash within both. Frequent means held by more than ``hot_run`` documents, or by more where
over a million columns are; the frequencies are counted over all documents for the half of the columns whose hashes
come first, and travel as a bitmap of 1 MB (two columns may share a bit: the order stays one order, so results do not
depend on it).

1. *Prefixes.* Two sets that reach the threshold share one of their first ``n - ceil(t*n) + 1`` columns in that order,
   so only those columns enter the product. A passage that many texts share comes last and is in few prefixes.
2. *Columns of up to* ``hot_run`` *rows* are multiplied where they meet: overlap counts of each pair are added up in the
   block, then over blocks; pairs outside the length bound, or whose count leaves too little for the rest of their sets
   to make up, are discarded. The others meet in groups, where whole sets are multiplied.
3. *Hot columns* belong to large families of copies. Their rows are cut into blocks of about 256 sets, and each block
   multiplies its whole sets in its own task: exact overlaps, of which a forest of true links leaves it. Twice every
   row goes to one block, by its first and by its last hot column; then labels are joined.
4. *Settling.* Only hot columns that hold several labels are left. Each of their rows has one home block; blocks of a
   large label hold no other. A row visits the blocks with which it shares such a column, rows of the smaller label
   those of the larger, and never a block of its own label; visitors are multiplied with the block. Every pair of
   different labels in a hot column so meets once, and each visit gives one link at most.

No step lists the pairs inside a label, and no pair leaves a task but as a link or as a candidate of step 2, which each
row has fewer than ``hot_run`` of in a column.

Defined results: null and empty texts, and texts without words, have n_shingles 0 and link with nothing; a null doc_id
keeps its row with a null component and links with nothing; rows that share a doc_id are one document, with the links
of all their texts; repeated rows all come back; empty tables give empty results; extra columns are ignored; whole
texts are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, let_go, materialize, table

WORDS, PERCENT = 5, 75
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Beyond so many ids a semi join is no longer a broadcast (40 bytes each) but a shuffle.
BROADCAST_IDS = 1_000_000
#: A column of the product with more rows than this is hot.
HOT_RUN = 32
#: Rows, and members of their sets, that a block of a hot column holds about.
BLOCK_ROWS, BLOCK_MEMBERS = 256, 1_000_000
#: A group of candidates whose sets have more members than this together (8 bytes each) is taken by several tasks.
GROUP_MEMBERS = 4_000_000
#: Bits of the bitmap of frequent columns, and how many of those it is to tell apart.
_BITS, _MOST_FREQUENT = 1 << 23, 1_000_000


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; A-Z are lowered, ASCII white space parts."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = hash_array(np.array(tokens, dtype=object), categorize=False)
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def set_key(members: np.ndarray) -> bytes:
    return hashlib.md5(members.tobytes()).digest()


def _least(total, percent: int):
    """Smallest overlap of two sets of ``total`` members together: 100 * o >= percent * (total - o)."""
    return -(-percent * total // (100 + percent))


def _bit(gram: np.ndarray) -> np.ndarray:
    return (gram & np.uint64(_BITS - 1)).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent_columns(docs: DataFrame, words: int, more_than: int) -> np.ndarray:
    """Bitmap (packed) of the columns that more than ``more_than`` documents hold, over all documents.

    Columns of the upper half of the hash range are never marked. Where more than a million columns are frequent, the
    floor doubles until no more are, so the bitmap stays sparse at any size.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        held, size = [], 0
        for b in batches:
            for text in b.text:
                s = shingle_hashes(text, words)
                held.append(s[: np.searchsorted(s, np.uint64(1 << 63))])
                size += len(held[-1])
                if size > 1_000_000:
                    gram, c = np.unique(np.concatenate(held), return_counts=True)
                    yield pd.DataFrame({"gram": gram.view(np.int64), "c": c})
                    held, size = [], 0
        if size:
            gram, c = np.unique(np.concatenate(held), return_counts=True)
            yield pd.DataFrame({"gram": gram.view(np.int64), "c": c})

    often = materialize(_texts(docs).select("text").mapInPandas(counted, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).where(F.col("c") > more_than))
    floor, by_size = more_than, often.groupBy(F.floor(F.log2("c")).alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()
    while sum(r.n for r in by_size if 2 ** (r.power + 1) > floor + 1) > _MOST_FREQUENT:
        floor *= 2
    at = F.col("gram").bitwiseAND(F.lit(_BITS - 1)) + 1
    chunks = often.where(F.col("c") > floor).select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(_BITS // 8, np.uint8)
    for r in chunks.collect():  # at most 256 rows of 4 KB
        out[(r.chunk - 1) * 4096 : r.chunk * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    discard(often)
    return out


def in_order(members: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A set's columns in the global order: those not marked frequent first, by hash within both."""
    at = _bit(members)
    late = ((frequent[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & (members < np.uint64(1 << 63))
    return np.concatenate([members[~late], members[late]])


def sketches(docs: DataFrame, frequent: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, set_key and the prefix of each text's set."""
    bits = docs.sparkSession.sparkContext.broadcast(frequent)  # 1 MB

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for b in batches:
            out = []
            for text in b.text:
                s = shingle_hashes(text, words)
                n = len(s)
                take = n - -(-percent * n // 100) + 1 if n else 0
                out.append((n, set_key(s) if n else None, in_order(s, bits.value)[:take].view(np.int64)))
            made = pd.DataFrame(out, columns=["n", "set_key", "prefix"])
            made.insert(0, "doc_id", b.doc_id.astype("Int64").values)
            yield made

    return _texts(docs).mapInPandas(make, "doc_id long, n long, set_key binary, prefix array<long>")


def scan_runs(percent: int, hot: int = HOT_RUN, flush: int = 250_000):
    """Over rows (gram, n, node) sorted so: the block's product, and the rows of hot runs.

    A run of 2 to ``hot`` rows gives its pairs within the length bound, whose counts are added up for the whole block
    before they leave; a longer run's rows are passed on as they come. Holds at most ``hot`` rows of an open run and
    ``flush`` pairs.
    """
    none = {"u": "Int64", "v": "Int64", "nu": "Int64", "nv": "Int64", "c": "Int64", "gram": "Int64", "n": "Int64", "node": "Int64"}

    def product(n, d, starts, sizes) -> list[pd.DataFrame]:
        out = []
        for m in np.unique(sizes):
            i, j = np.triu_indices(m, 1)
            at = starts[sizes == m]
            step = max(1, flush // len(i))
            for k in range(0, len(at), step):
                a, b = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
                ok = 100 * n[a] >= percent * n[b]
                a, b = a[ok], b[ok]
                swap = d[a] > d[b]
                u, v = np.where(swap, b, a), np.where(swap, a, b)
                out.append(added(pd.DataFrame({"u": d[u], "v": d[v], "nu": n[u], "nv": n[v], "c": 1})))
        return out

    def added(pairs: pd.DataFrame) -> pd.DataFrame:
        return pairs.groupby(["u", "v", "nu", "nv"], sort=False, as_index=False)["c"].sum()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, hot_gram = None, None
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            g, n, d = (b[c].to_numpy(np.int64) for c in ("gram", "n", "node"))
            if rest is not None:
                g, n, d = np.append(rest[0], g), np.append(rest[1], n), np.append(rest[2], d)
            cuts = np.append(0, np.flatnonzero(g[1:] != g[:-1]) + 1)
            sizes = np.diff(np.append(cuts, len(g)))
            burning = sizes > hot
            if hot_gram is not None and g[0] == hot_gram:
                burning[0] = True
            closed = np.ones(len(cuts), bool)
            closed[-1] = False
            if burning.any():
                rows = np.repeat(burning, sizes)
                yield pd.DataFrame({"gram": g[rows], "n": n[rows], "node": d[rows]}).reindex(columns=[*none]).astype(none)
            hot_gram = g[-1] if burning[-1] else None
            last = cuts[-1]
            rest = None if burning[-1] else (g[last:], n[last:], d[last:])
            small = closed & ~burning & (sizes > 1)
            held += product(n, d, cuts[small], sizes[small])
            if sum(map(len, held)) > flush:
                held = [added(pd.concat(held, ignore_index=True))]
                if len(held[0]) > flush // 2:
                    yield held.pop().reindex(columns=[*none]).astype(none)
        if rest is not None and len(rest[0]) > 1:
            held += product(rest[1], rest[2], np.array([0]), np.array([len(rest[0])]))
        if held:
            yield added(pd.concat(held, ignore_index=True)).reindex(columns=[*none]).astype(none)

    return scan


class Labels:
    """Union-find over labels that a task has seen."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        p, q = self.root(x), self.root(y)
        self.parent[p] = q
        return p != q


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None, wide: int = 8192) -> np.ndarray:
    """Overlap counts of all sets of ``left`` with all of ``right``, or among themselves: the incidence matrix of the
    block, without columns that one set alone holds, times its transpose, some columns at a time."""
    sets = left + (right or [])
    grams = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, held = np.unique(grams, return_inverse=True, return_counts=True)
    shared = held[column] > 1
    rows, column = rows[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    out = np.zeros((len(left), len(right) if right else len(left)), np.int64)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        i, j = np.searchsorted(column, [k, k + wide])
        x = np.zeros((len(sets), wide), np.float32)  # counts stay exact under 2^24
        x[rows[i:j], column[i:j] - k] = 1
        out += (x[: len(left)] @ (x[len(left) :] if right else x).T).astype(np.int64)
    return out


def block_links(percent: int):
    """Over rows (kind, key, part, role, node, label, members) sorted so: a forest of the true links in each block.

    Role 0 are the block's own sets, which are multiplied with each other unless the block is of one label (kind 0);
    role 1 are visitors, multiplied with the block as they come.
    """

    def forest(ids, labels, sets, others, other_labels, other_sets, seen: Labels) -> list[tuple[int, int]]:
        n = np.array([len(s) for s in sets])
        m = n if others is None else np.array([len(s) for s in other_sets])
        total = n[:, None] + m[None, :]
        ok = overlaps(sets, None if others is None else other_sets) >= _least(total, percent)
        ok &= np.array(labels)[:, None] != np.array(labels if others is None else other_labels)[None, :]
        out = []
        for i in np.flatnonzero(ok.any(1)):
            for j in np.flatnonzero(ok[i]):
                if others is None:
                    if i < j and seen.join(labels[i], labels[j]):
                        out.append((ids[i], ids[j]))
                elif seen.join(labels[i], other_labels[j]):
                    out.append((ids[i], others[j]))
        return out

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, home, guests, seen = None, ([], [], []), ([], [], []), Labels()
        closed = False

        def close() -> list[tuple[int, int]]:
            """The block's own sets are complete."""
            return forest(*home, None, None, None, seen) if now is not None and now[0] and len(home[0]) > 1 else []

        def receive() -> list[tuple[int, int]]:
            found = forest(*home, *guests, seen) if home[0] and guests[0] else []
            for x in guests:
                x.clear()
            return found

        for b in batches:
            out = []
            for kind, key, part, role, node, label, raw in zip(b.kind.tolist(), b["key"].tolist(), b.part.tolist(), b.role.tolist(), b.node.tolist(), b.label.tolist(), b.members):
                if (kind, key, part) != now:
                    out += receive() if closed else close()
                    now, home, guests, seen, closed = (kind, key, part), ([], [], []), ([], [], []), Labels(), False
                if role and not closed:
                    out += close()
                    closed = True
                to = guests if role else home
                for x, value in zip(to, (node, label, np.frombuffer(raw, np.uint64))):
                    x.append(value)
                if role and len(guests[0]) >= BLOCK_ROWS:
                    out += receive()
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])
        if out := receive() if closed else close():
            yield pd.DataFrame(out, columns=["u", "v"])

    return scan


def group_links(percent: int):
    """Over rows (group, part, step, node, label, v, order, members) sorted so: first the sets of a group, then its
    candidates; a forest of those that are true links. Candidates that are joined already are passed over."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, have, seen = None, {}, Labels()
        for b in batches:
            out = []
            for group, part, step, u, v, lu, lv, raw in zip(b.group.tolist(), b.part.tolist(), b.step.tolist(), b.node.tolist(), b.v.tolist(), b.lu.tolist(), b.lv.tolist(), b.members):
                if (group, part) != now:
                    now, have, seen = (group, part), {}, Labels()
                if step == 0:
                    have[u] = np.frombuffer(raw, np.uint64)
                    continue
                v, lu, lv = int(v), int(lu), int(lv)
                if seen.root(lu) == seen.root(lv):
                    continue
                x, y = have[u], have[v]
                least = _least(len(x) + len(y), percent)
                if min(len(x), len(y)) < least:
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                if int((x[at] == y).sum()) >= least and seen.join(lu, lv):
                    out.append((u, v))
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])

    return scan


def whole_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, members) of the wanted nodes, made again from their texts."""
    asked = materialize(wanted.distinct().join(nodes.select("node", "rep", "set_key"), "node"))
    few = asked.count() <= BROADCAST_IDS
    texts = _texts(docs).where("doc_id is not null").join(F.broadcast(asked.withColumnRenamed("rep", "doc_id")) if few else asked.withColumnRenamed("rep", "doc_id"), "doc_id").select("node", "set_key", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [shingle_hashes(t, words) for t in b.text]
            same = np.array([set_key(s) == bytes(k) for s, k in zip(made, b.set_key)], bool)
            yield pd.DataFrame({"node": b.node, "members": [s.tobytes() for s in made]})[same]

    out = materialize(texts.mapInPandas(sets, "node long, members binary"))
    discard(asked)
    return out


def _blocks(rows: Column, members: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(members / BLOCK_MEMBERS)).cast("long")


def _labelled(df: DataFrame, comps: DataFrame, columns: dict[str, str]) -> DataFrame:
    for c, label in columns.items():
        df = df.join(comps.select(F.col("id").alias(c), F.col("component").alias(label)), c, "left").withColumn(label, F.coalesce(label, c))
    return df


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hot_run: int = HOT_RUN, group_members: int = GROUP_MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), one row per input row."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(sketches(docs, frequent_columns(docs, words, hot_run), words, percent))
    light = rows.select("doc_id", "n", "set_key")
    nodes = rows.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    grams = nodes.select(F.explode("prefix").alias("gram"), "n", "node").repartition(parts, "gram").sortWithinPartitions("gram", "n", "node")
    found = materialize(grams.mapInPandas(scan_runs(percent, hot_run), "u long, v long, nu long, nv long, c long, gram long, n long, node long"))
    hot = found.where("gram is not null").select("gram", "n", "node")

    # every pair that shares no hot column has its whole count of shared prefix columns here, so the bound on what
    # the rest of the two sets can add holds; pairs that share a hot column are taken up with the hot rows as well
    def rest(n: str) -> Column:
        return F.ceil(F.lit(percent) * F.col(n) / 100) - 1

    share = F.col("c") / (F.least(F.col("nu") - rest("nu"), F.col("nv") - rest("nv")))
    counted = found.where("u is not null").groupBy("u", "v", "nu", "nv").agg(F.sum("c").alias("c"))
    counted = counted.where(F.col("c") + F.greatest(rest("nu"), rest("nv")) >= F.ceil(F.lit(percent) * (F.col("nu") + F.col("nv")) / (100 + percent)))
    pairs = materialize(counted.select("u", "v", "nu", "nv", share.alias("rank")))

    # whole sets travel for rows of hot columns and of candidates only
    ends = materialize(hot.groupBy("node", "n").agg(F.min("gram").alias("first"), F.max("gram").alias("last")))
    sets = whole_sets(docs, nodes, ends.select("node").unionByName(pairs.select(F.explode(F.array("u", "v")).alias("node"))), words)
    links = None
    comps = docs.sparkSession.createDataFrame([], "id long, component long")

    def product(homes: DataFrame, visits: DataFrame | None = None) -> DataFrame:
        """Links of blocks: ``homes`` and ``visits`` have (kind, key, part, node, label)."""
        sent = homes.withColumn("role", F.lit(0))
        sent = sent if visits is None else sent.unionByName(visits.withColumn("role", F.lit(1)))
        sent = sent.join(sets, "node").select("kind", "key", "part", "role", "node", "label", "members")
        dealt = sent.repartition(parts, "kind", "key", "part").sortWithinPartitions("kind", "key", "part", "role", "node")
        return materialize(dealt.mapInPandas(block_links(percent), "u long, v long"))

    def take_up(new: DataFrame) -> None:
        nonlocal links, comps
        links = new if links is None else materialize(links.unionByName(new))
        comps = materialize(connected_components(links))

    any_hot = bool(ends.limit(1).count())
    for turn, gram in enumerate(("first", "last") if any_hot else ()):
        now = _labelled(ends.select("node", "n", F.col(gram).alias("key")), comps, {"node": "label"})
        cut = now.groupBy("key").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        homes = now.join(cut, "key").select(F.lit(1).alias("kind"), "key", F.pmod(F.xxhash64("node", F.lit(turn)), "blocks").alias("part"), "node", "label")
        take_up(product(homes))

    # candidates of the columns that are not hot, group by group
    if pairs.limit(1).count():
        apart = _labelled(pairs, comps, {"u": "lu", "v": "lv"}).where("lu <> lv")
        asked = materialize(apart.join(connected_components(pairs).select(F.col("id").alias("u"), F.col("component").alias("group")), "u"))
        weight = asked.groupBy("group").agg(F.sum(F.col("nu") + F.col("nv")).alias("members"))
        asked = asked.join(weight, "group").withColumn("part", F.pmod(F.xxhash64("u"), F.ceil(F.col("members") / group_members).cast("long")))
        needed = asked.select("group", "part", F.explode(F.array("u", "v")).alias("node")).distinct().join(sets, "node")
        known = needed.select("group", "part", F.lit(0).alias("step"), "node", *(F.lit(None).cast("long").alias(c) for c in ("v", "lu", "lv")), F.lit(0.0).alias("order"), "members")
        asked = asked.select("group", "part", F.lit(1).alias("step"), F.col("u").alias("node"), "v", "lu", "lv", (-F.col("rank")).alias("order"), F.lit(None).cast("binary").alias("members"))
        sent = known.unionByName(asked).repartition(parts, "group", "part").sortWithinPartitions("group", "part", "step", "order", "node", "v")
        take_up(materialize(sent.mapInPandas(group_links(percent), "u long, v long")))

    # hot columns that still hold several labels
    if any_hot:
        now = _labelled(hot, comps, {"node": "label"})
        several = now.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("gram")
        mixed = materialize(now.join(several, "gram", "left_semi"))
        if mixed.limit(1).count():
            take_up(product(*settling(mixed, percent)))

    twins = materialize(light.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b"), F.count("set_key").alias("k"), F.count(F.lit(1)).alias("m")).where("a < b or (0 < k and k < m)").select("doc_id"))
    if twins.limit(1).count():  # the texts of one document are linked, whatever they say
        texts = light.join(twins, "doc_id", "left_semi").join(nodes.select("set_key", "node"), "set_key").select("doc_id", "node").distinct()
        first = texts.groupBy("doc_id").agg(F.min("node").alias("u"))
        take_up(texts.join(first, "doc_id").where("u < node").select("u", F.col("node").alias("v")))
    named = _labelled(nodes.select("node", "set_key", "rep"), comps, {"node": "label"})
    named = named.join(named.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("set_key", "component_id")
    out = light.join(named, "set_key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    if twins.limit(1).count():  # also for their texts without words
        least = out.join(twins, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    for spent in (found, pairs, sets):
        discard(spent)
    return out


def settling(mixed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(homes, visits) over rows (gram, n, node, label) of hot columns that hold several labels.

    A row's home is a block of its label, where that has over ``BLOCK_ROWS`` rows here, else a block of its first
    column. It visits the blocks with which it shares a column and that stand later in one order of blocks (small
    labels and mixed blocks first), unless all in there have its label or no length there fits.
    """
    at_home = mixed.groupBy("node", "n", "label").agg(F.min("gram").alias("first"))
    size = at_home.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    large = F.col("size") > BLOCK_ROWS
    placed = at_home.join(size, "label").select("node", "n", "label", F.when(large, 0).otherwise(1).alias("kind"), F.when(large, F.col("label")).otherwise(F.col("first")).alias("key"), F.when(large, F.col("size")).otherwise(0).alias("size"))
    cut = placed.groupBy("kind", "key").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    homes = materialize(placed.join(cut, ["kind", "key"]).select("node", "n", "label", "kind", "key", F.pmod(F.xxhash64("node", F.lit(7)), "blocks").alias("part"), "size"))
    block = F.struct("size", "kind", "key", "part")
    rows = mixed.select("gram", "node").join(homes, "node")
    lengths = homes.groupBy("kind", "key", "part").agg(F.min("n").alias("shortest"), F.max("n").alias("longest"))
    blocks = rows.select("gram", "kind", "key", "part", "size", block.alias("block")).distinct().join(lengths, ["kind", "key", "part"])
    most = rows.groupBy("gram").agg(F.max(F.when(F.col("kind") == 0, F.struct("size", "key"))).alias("most"))
    # rows of a column's largest label are only visited
    guests = rows.select("gram", "node", "n", "label", block.alias("own"), (F.col("kind") == 0).alias("pure"), F.struct("size", "key").alias("mine")).join(most, "gram").where(~(F.col("pure") & F.coalesce(F.col("mine") == F.col("most"), F.lit(False))))
    met = guests.select("gram", "node", "n", "label", "own").join(blocks, "gram").where(F.col("own") < F.col("block")).where("not (kind = 0 and key = label)")
    met = met.where((100 * F.col("n") >= percent * F.col("shortest")) & (100 * F.col("longest") >= percent * F.col("n")))
    visits = met.select("kind", "key", "part", "node", "label").distinct()
    return homes.select("kind", "key", "part", "node", "label"), visits


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
