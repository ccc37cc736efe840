"""A corpus pipeline over `documents`: toxicity, quality, near duplicates, packing. Part of subpackage llm.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.

Defined results: null and empty texts are scored as such, and stay unless a model rejects them; rows without a doc_id
are nobody's duplicates; rows that share a doc_id are one document, of which the near-duplicate stage keeps the row
with the least text; an empty table goes through as an empty one; extra columns stay, whatever their names, but the
last stage returns pieces only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.common import materialize, table
from glimmer.llm.ngram_join import BROADCAST_IDS, jaccard_components
from glimmer.llm.packing import pack_pieces, token_pieces
from glimmer.llm.quality import score_quality, train_quality
from glimmer.llm.toxicity import crc_fold, score_toxicity, train_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict toxic; it learns from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train_toxicity(docs.select("doc_id", "text"), labels, crc_fold(F.col("doc_id")))
    return score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality model keeps."""
    return score_quality(docs, train_quality(docs.select("doc_id", "text"))).where("kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    found = materialize(jaccard_components(docs.select("doc_id", "text")))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    shared = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if not shared.limit(1).count():
        return kept
    several = kept.join(shared, "doc_id", "left_semi").select(*docs.columns)
    one = several.groupBy("doc_id").agg(F.min_by(F.struct(*several.columns), F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*several.columns))).alias("row")).select("row.*")
    return kept.join(shared, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens placed in sequences."""
    import public_tokenizers

    return pack_pieces(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: No stage but the third can be said in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
