"""The pipeline stage by stage, and its contracts."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline

from glimmer.llm.common import table


@pytest.fixture(scope="module")
def kept(spark):
    sf = "/root/testdata/sf0.01"
    docs, out = table(spark, sf, "documents"), {}
    out["documents"] = docs.cache()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        out[name] = docs
    return out


def test_stages_keep_columns_and_only_drop(kept):
    before = None
    for name, df in kept.items():
        if name == "packing":
            continue
        assert df.columns == kept["documents"].columns
        ids = {r.doc_id for r in df.select("doc_id").collect()}
        assert before is None or ids <= before
        before = ids


def test_decisions_take_effect(spark, kept):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    toxic = labels.where("toxic = 1")
    assert kept["toxicity"].join(toxic, "doc_id").count() < 0.6 * toxic.count()
    clean = labels.where("toxic = 0 and quality = 1")
    assert kept["quality"].join(clean, "doc_id").count() > 0.97 * clean.count()
    low = kept["toxicity"].join(labels.where("quality = 0"), "doc_id").count()
    assert kept["quality"].join(labels.where("quality = 0"), "doc_id").count() < 0.2 * low


def test_no_two_kept_texts_are_near_duplicates(kept):
    from test_llm_operators import groups, shingles, similar

    sets = {r.doc_id: shingles(r.text) for r in kept["quality"].collect()}
    want = {i for i, c in groups(similar(sets), sets).items() if i == c}
    assert {r.doc_id for r in kept["near_duplicates"].collect()} == want
    assert {r.doc_id for r in kept["packing"].collect()} == want


def test_stages_let_go_of_the_tokenizers_words(spark):
    import time

    import pandas as pd
    import public_tokenizers
    from pyspark.sql import functions as F

    from glimmer.llm import common, packing, quality, toxicity
    from glimmer.llm.ngram_join import sketches

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = spark.range(0, 32, 1, 32).select(F.col("id").alias("doc_id"), F.lit("some words to keep").alias("text"))

    def fill(batches):
        for b in batches:
            packing.tokenizer_for(path).encode("some words to keep")
            time.sleep(0.02)
            yield b

    def kept(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(common._KEPT)]})

    def left():
        return texts.mapInPandas(kept, "n int").agg(F.sum("n")).first()[0]

    for stage in (
        lambda: toxicity.score_toxicity(texts, toxicity.ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 0.0)).agg(F.sum("score")).collect(),
        lambda: quality.train_quality(texts),
        lambda: sketches(texts, np.zeros(1 << 20, np.uint8)).agg(F.max("set_key")).collect(),
    ):
        texts.mapInPandas(fill, texts.schema).agg(F.count("text")).collect()
        assert left() > 0
        stage()
        assert left() == 0
