"""I-Match fingerprints (native): terms of a document-frequency band, hashed by several randomised lexicon subsets.

The lexicon is the set of terms whose document frequency over the whole corpus lies in a band of inverse document
frequency: common words say nothing, and terms of a single document can't be met again. Frequencies are kept per hash
bucket of a term (2^20 of them), so the lexicon is a bitmap of fixed size, 128 KB, whatever the corpus.

A text's distinct in-band terms are sorted and filtered by lexicon subsets: at each level a quarter of the level
before, and within a level sixteen disjoint random subsets; each subset's terms are hashed. Small subsets survive
edits, large ones tell texts apart, and the levels make this work for short and long texts alike. The likeness of two
fingerprints is the best level's share of equal subsets among those that hold a term of either, counted over four at
least; equal fingerprints have likeness 1.

Defined results: null texts are empty; a text with fewer than four in-band terms uses all its terms; texts without
terms have the fingerprint of no subsets; equal texts have equal fingerprints; null doc_ids come last in descending
order, ties are ordered by text; repeated rows stay; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

LEVELS, SUBSETS, BUCKETS = 7, 16, 1 << 20


def term_hashes(text: Column) -> Column:
    """Sorted distinct 64-bit hashes of the lower-cased words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def build_lexicon(docs: DataFrame, text: str = "text", least_idf: float = 1.5, most_idf: float = math.inf, least_df: int = 2) -> DataFrame:
    """One row: a bitmap (array of longs) of the buckets whose idf = ln(documents / df) is in the band.

    ``least_df`` keeps the band's rare end at terms of two documents whatever the size of the corpus.
    """
    spark = docs.sparkSession
    total = docs.count()
    terms = docs.select(F.explode(F.array_distinct(F.transform(term_hashes(F.col(text)), lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")))).alias("b"))
    df = terms.groupBy("b").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(float(max(total, 1))) / F.col("df"))
    kept = df.where((F.col("df") >= least_df) & (idf >= least_idf) & (idf <= most_idf))
    words = kept.groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, b & 63)")).alias("bits"))
    found = {r.at: r.bits for r in words.collect()}  # at most BUCKETS / 64 rows
    return spark.createDataFrame([([found.get(i, 0) for i in range(BUCKETS // 64)],)], "bits array<bigint>")


def _subset_hash(terms: str, level: int):
    """Hash of the terms of random subset k at a level; 0 without terms."""

    def of(h: Column) -> Column:
        return F.shiftrightunsigned(h, 34 + 4 * level).bitwiseAND(F.lit(SUBSETS - 1).cast("long"))

    def hashed(k: Column) -> Column:
        mine = F.filter(F.col(terms), lambda h: of(h) == k)
        return F.when(F.size(mine) > 0, F.xxhash64(mine).bitwiseOR(F.lit(1).cast("long")).bitwiseAND(F.lit(2**31 - 1).cast("long")).cast("int")).otherwise(F.lit(0))

    return hashed


def with_fingerprint(df: DataFrame, text: Column, lexicon: DataFrame, to: str) -> DataFrame:
    """``df`` with the subset hashes array<int> (0: no term), level by level."""
    keep = df.columns
    t = f"_{to}_t"

    def in_band(h: Column) -> Column:
        bucket = h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
        word = F.element_at(F.col("_lexicon"), F.shiftright(bucket, 6) + 1)
        return F.call_function("shiftright", word, bucket.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1

    # a scalar subquery: the bitmap is a constant of each task, and no plan's text holds it
    df = df.withColumn(t, term_hashes(text)).withColumn("_lexicon", lexicon.scalar()).withColumn(f"{t}b", F.filter(t, in_band)).drop("_lexicon")
    df = df.withColumn(f"{t}0", F.when(F.size(f"{t}b") >= 4, F.col(f"{t}b")).otherwise(F.col(t)))
    parts = []
    for level in range(LEVELS):
        now = f"{t}{level}"
        if level:
            df = df.withColumn(now, F.filter(f"{t}{level - 1}", lambda h: F.shiftrightunsigned(h, 18 + 2 * level).bitwiseAND(F.lit(3).cast("long")) == 0))
        df = df.withColumn(f"{to}_{level}", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SUBSETS - 1).cast("long")), _subset_hash(now, level)))
        parts.append(f"{to}_{level}")
    return df.select(*keep, F.concat(*parts).alias(to))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two arrays of subset hashes."""
    marks = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(0)).when(x == y, F.lit(65537)).otherwise(F.lit(1)))

    def level(i: Column) -> Column:
        total = F.aggregate(F.slice(marks, i * SUBSETS + 1, F.lit(SUBSETS)), F.lit(0), lambda s, x: s + x)
        return F.shiftright(total, 16) / F.greatest(total.bitwiseAND(F.lit(65535)), F.lit(4)).cast("double")

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), level))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0)))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds under doc_id, by a binary search in a literal; null ids stand lowest."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    literal = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    size = len(bounds)
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, s: F.when((at + s <= size) & F.coalesce(F.element_at(literal, F.least(at + s, F.lit(size))) < doc_id, F.lit(False)), at + s).otherwise(at),
    )


def with_next(df: DataFrame, columns: list[str], order: list[Column], key: str = "doc_id") -> DataFrame:
    """``df`` with next_<column>: the values of the next row in descending order of ``key``, after the last the first's.

    Rows are dealt once, to ranges of the key with about equal counts, and each range also gets the first row of the
    range that follows.
    """
    spark = df.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.select(F.percentile_approx(key, F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)]), 100 * ranges)).first()[0] if ranges > 1 else []
    bounds = sorted(set(bounds or []))
    placed = df.withColumn("_range", _bucket(F.col(key), bounds))
    tops = {r[0]: r[1] for r in placed.groupBy("_range").agg(F.max(key)).collect()}  # one row per range
    filled = sorted(tops, reverse=True)
    # the first rows of a range also go, as a sentinel, to the range before it
    before = dict(zip(filled[1:] + filled[:1], filled))
    top = F.element_at(F.from_json(F.lit(json.dumps({str(a): tops[a] for a in filled})), "map<string,bigint>"), F.col("_range").cast("string"))
    to = F.element_at(F.from_json(F.lit(json.dumps({str(a): before[a] for a in filled})), "map<string,int>"), F.col("_range").cast("string"))
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("s"))
    dealt = placed.withColumn("_place", F.explode(F.when(F.col(key).eqNullSafe(top), F.array(own, F.struct(to.alias("r"), F.lit(1).alias("s")))).otherwise(F.array(own))))
    w = Window.partitionBy("_place.r").orderBy("_place.s", F.col(key).desc_nulls_last(), *order)
    ranked = dealt.withColumn("_next", F.lead(F.struct(*columns)).over(w)).where("_place.s = 0")
    return ranked.select(*df.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lexicon = build_lexicon(docs)
    made = with_fingerprint(docs, F.col("text"), lexicon, "fp")
    pairs = with_next(made, ["text", "fp"], [F.col("text").desc()])
    n = F.length("text")
    m = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - m), F.substring(F.col("next_text"), F.lit(1), m))
    pairs = pairs.select("doc_id", "fp", "next_fp", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    both = with_fingerprint(pairs, F.col("edited"), lexicon, "efp")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
