"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples (P) and unlabelled text (U, drawn from all training rows whatever their label) train a
linear scorer on word presence. With the class prior p taken from the training labels, the risk is
``p*E_P[l(g)] + max(0, E_U[l(-g)] - p*E_P[l(-g)])`` with the logistic loss; where the bracket turns negative its
gradient is reversed, as in the published non-negative estimator.

Defined results: a null or empty text has no words and gets the intercept's score; a null doc_id counts as not held
out and has no label; without labels, or with no toxic example among them, every score is 0; doubled label rows
count once, toxic if any says so; repeated documents are scored alike; extra columns are ignored; texts may be of
any length and are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, table

_WORD = re.compile(r"[^\W\d_]+")
_DIMS = 1 << 20


@dataclass
class ToxicityModel:
    features: np.ndarray  # sorted hashed words
    weights: np.ndarray
    intercept: float
    empty: bool = False

    def scores(self, texts, at_once: int = 256) -> np.ndarray:
        """Scores of whole texts; the words of ``at_once`` of them are held at a time."""
        if self.empty:
            return np.zeros(len(texts))
        parts = [self._scores(texts[i : i + at_once]) for i in range(0, len(texts), at_once)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _scores(self, texts) -> np.ndarray:
        g = np.full(len(texts), self.intercept)
        at, words = [], []
        for i, t in enumerate(texts):
            if t:
                ws = set(_WORD.findall(t.lower()))
                words.extend(ws)
                at.append((i, len(ws)))
        if words and len(self.features):
            h = hashed(words)
            k = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
            # one word may share a bucket with another of the same text: presence counts once
            rows = np.repeat([i for i, _ in at], [n for _, n in at])
            hit = self.features[k] == h
            pairs = np.unique(rows[hit].astype(np.int64) * len(self.features) + k[hit])
            g += np.bincount(pairs // len(self.features), self.weights[pairs % len(self.features)], len(texts))
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def hashed(words: list[str]) -> np.ndarray:
    return (hash_array(np.array(words, dtype=object), categorize=False) % _DIMS).astype(np.int64)


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, most_features: int = 20_000, least_docs: int = 3, steps: int = 400, rate: float = 0.1, decay: float = 2e-4, slack: float = 0.0) -> ToxicityModel:
    """Full-batch Adam on the non-negative risk; words are screened by how much commoner they are in P than in U."""
    if not positive or not unlabelled or not 0 < prior < 1:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -40.0, empty=not positive)

    def counts(docs):
        return np.bincount(np.concatenate(docs) if docs else np.zeros(0, np.int32), minlength=_DIMS)

    np_, nu = len(positive), len(unlabelled)
    cp, cu = counts(positive), counts(unlabelled)
    a, b = (cp + 0.1) / (np_ + 0.2), (cu + 0.1) / (nu + 0.2)
    pooled = (cp + cu + 0.2) / (np_ + nu + 0.4)
    z = (a - b) / np.sqrt(pooled * (1 - np.minimum(pooled, 1 - 1e-9)) * (1 / np_ + 1 / nu))
    z[(cp < least_docs) | (z < 2.5)] = 0
    keep = np.sort(np.argsort(-z, kind="stable")[:most_features])
    keep = keep[z[keep] > 0]
    scale = np.minimum(z[keep], 20) / 20  # surer words move faster; the weight decay holds the rest back

    def sparse(docs):
        at = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        k = np.minimum(np.searchsorted(keep, at), max(len(keep) - 1, 0))
        hit = keep[k] == at if len(keep) else np.zeros(len(at), bool)
        return row[hit], k[hit]

    (rp, kp), (ru, ku) = sparse(positive), sparse(unlabelled)
    w, c = np.zeros(len(keep)), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1), 0
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    soft = lambda x: np.logaddexp(0, x)
    for _ in range(steps):
        ws = w * scale
        gp = c + np.bincount(rp, ws[kp], np_)
        gu = c + np.bincount(ru, ws[ku], nu)
        negative = soft(gu).mean() - prior * soft(gp).mean()
        dp_pos, dp_neg, du = -prior * sig(-gp) / np_, -prior * sig(gp) / np_, sig(gu) / nu
        if negative < -slack:  # the estimate of a loss can't be negative: undo what made it so
            dp, du = -dp_neg, -du
        else:
            dp = dp_pos + dp_neg
        grad = np.append((np.bincount(kp, dp[rp], len(keep)) + np.bincount(ku, du[ru], len(keep))) * scale + decay * w, dp.sum() + du.sum())
        t += 1
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        c -= step[-1]
    return ToxicityModel(keep, w * scale, c)


def train_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, most_positive: int = 6_000, most_unlabelled: int = 14_000) -> ToxicityModel:
    """Fit on documents that are not held out.

    ``most_positive`` and ``most_unlabelled`` bound the expected sizes of the two samples (chosen by a hash of
    doc_id); only word hashes of these come to the driver. ``held_out`` is a boolean over doc_id.
    """
    mine = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("doc_id is not null").where(~held_out)
    n, toxic = mine.agg(F.count("toxic"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -40.0, empty=True)
    prior = min(max(toxic / n, 1e-6), 1 - 1e-6)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_000))
    chosen = mine.where("toxic = 1").where(draw < int(1_000_000 * min(1.0, most_positive / toxic))).select("doc_id", F.lit(True).alias("positive"))
    rows = docs.where("doc_id is not null").where(~held_out).select("doc_id", "text")
    total = rows.count()
    other = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(12)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most_unlabelled / max(total, 1)))
    # broadcast: at most about most_positive ids
    picked = rows.join(F.broadcast(chosen), "doc_id", "left").withColumn("unlabelled", other).where("positive or unlabelled")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for b in batches:
            yield pd.DataFrame({"positive": b.positive.eq(True), "unlabelled": b.unlabelled.astype(bool), "words": [np.unique(hashed([*set(_WORD.findall(t.lower()))])).astype(np.int32).tobytes() if t else b"" for t in b.text]})

    p, u = [], []
    for r in picked.select("positive", "unlabelled", "text").mapInPandas(features, "positive boolean, unlabelled boolean, words binary").toLocalIterator():
        x = np.frombuffer(bytes(r.words), np.int32)
        if r.positive:
            p.append(x)
        if r.unlabelled:
            u.append(x)
    return fit_nnpu(p, u, prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted, from the text alone; other columns pass through (ours win a name clash)."""
    docs = docs.drop("score", "predicted")

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        let_go()
        return pd.Series(model.scores(text.tolist()))

    return docs.withColumn("score", score(F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def crc_fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = crc_fold(F.col("doc_id"))
    model = train_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), fold)
    return score_toxicity(docs, model).select("doc_id", fold.alias("held_out"), "score", "predicted")
