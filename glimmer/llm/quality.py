"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the
counts of vote patterns (all documents; at most 3^labellers patterns, so a bounded table) estimates each labeller's
class-conditional accuracies, and the posteriors of a bounded document sample train a linear scorer over hashed word
shapes, which then scores every document.

Defined results: for null and empty texts, and texts without a word, the first labeller votes bad and the others
abstain; an empty table gives an empty result; repeated rows are treated alike; extra columns pass through
``score_quality`` (ours win a name clash); whole texts of any length are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, let_go, materialize, table

_DIMS = 1 << 16
_SHAPE = bytes(ord("X") if 65 <= i <= 90 else ord("x") if 97 <= i <= 122 or i >= 128 else ord("9") if 48 <= i <= 57 else i for i in range(256))
_RUN = re.compile(rb"x{2,}|X{2,}|9{2,}")
_COMMON = frozenset(b"the of and to in is that it for with as was on are be this by an at from der die das und ist ein eine in zu den von mit auf le la les et de des un une est que pour dans en el los las una es por con del se".split())
LABELLERS = ("words", "symbols", "common_words", "line_repeats", "word_length", "sentences", "defects")


def measures(text: str | None) -> tuple[list[int], Counter]:
    """(votes: 1 good, -1 bad, 0 abstain, in the order of LABELLERS; counts of word shapes) of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    shape = raw.translate(_SHAPE)
    words = shape.split()
    n = len(words)
    shapes = Counter(_RUN.sub(lambda m: m[0][:1] + b"+", shape).split())
    plain = raw.split()
    stutter = sum(a == b for a, b in zip(plain, plain[1:]))
    if stutter:
        shapes[b"again"] = stutter  # no shape has small letters but x
    if not n:
        return [-1] + [0] * (len(LABELLERS) - 1), shapes
    small, large, digits = shape.count(b"x"), shape.count(b"X"), shape.count(b"9")
    size = sum(map(len, words))
    symbols = size - small - large - digits
    runs = shape.count(b"!!") + shape.count(b"***") + shape.count(b"###") + shape.count(b"$$$") + shape.count(b"%%%") + shape.count(b"&&&")
    common = sum(w in _COMMON for w in raw.lower().split())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines)
    bars = words.count(b"|")
    ends = shape.count(b".") + shape.count(b"?") + shape.count(b"!")

    def vote(bad: bool, good: bool) -> int:
        return -1 if bad else 1 if good else 0

    letters = small + large
    # one labeller for the plain defects: apart, each would be outvoted by the others, which it has no bearing on
    defects = runs > 0.2 * n or bars > 0.15 * n or (n >= 10 and stutter > 0.1 * n) or (letters > 0 and large > 0.5 * letters)
    votes = [
        vote(False, n >= 20),
        vote(symbols > 0.2 * size, symbols < 0.08 * size),
        vote(n >= 20 and common < 0.02 * n, common > 0.1 * n),
        vote(len(lines) >= 4 and repeated > 0.5, len(lines) >= 4 and repeated < 0.1),
        vote(size > 15 * n or size < 2 * n, 3 * n <= size <= 10 * n),
        vote(n >= 40 and ends < 0.003 * n, 0.01 * n <= ends <= 0.4 * n),
        vote(defects and n >= 3, not defects and n >= 10),
    ]
    return votes, shapes


def hashed_shapes(shapes: Counter) -> tuple[np.ndarray, np.ndarray]:
    if not shapes:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    h = (hash_array(np.array([*shapes], dtype=object), categorize=False) % _DIMS).astype(np.int64)
    c = np.sqrt(np.array([*shapes.values()], float))
    u, inverse = np.unique(h, return_inverse=True)
    x = np.bincount(inverse, c)
    return u.astype(np.int32), (x / np.sqrt((x * x).sum())).astype(np.float32)


@dataclass
class LabelModel:
    prior: float
    likelihood: np.ndarray  # [class, labeller, vote + 1]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of class good for rows of votes."""
        at = np.arange(votes.shape[1])
        bad, good = (np.log(self.likelihood[y][at, votes + 1]).sum(1) for y in (0, 1))
        return 1 / (1 + np.exp(np.clip(bad - good + np.log((1 - self.prior) / self.prior), -500, 500)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, smoothing: float = 1.0) -> LabelModel:
    """EM that starts from the bad votes, which are rare and meant to be sure; each labeller's table keeps a weak
    prior towards voting right."""
    k = votes.shape[1]
    model = LabelModel(0.5, np.full((2, k, 3), 1 / 3))
    q = 1 / (1 + np.exp(-(0.5 + 0.2 * (votes > 0).sum(1) - 6.0 * (votes < 0).sum(1))))
    nudge = np.array([[[2, 1, 0.2]] * k, [[0.2, 1, 2]] * k]) * smoothing
    for _ in range(rounds):
        for y, weight in ((0, (1 - q) * counts), (1, q * counts)):
            for v in (-1, 0, 1):
                model.likelihood[y, :, v + 1] = weight @ (votes == v)
            model.likelihood[y] += nudge[y]
            model.likelihood[y] /= model.likelihood[y].sum(1, keepdims=True)
        model.prior = float(np.clip((q * counts).sum() / max(counts.sum(), 1e-9), 1e-4, 1 - 1e-4))
        new = model.posterior(votes)
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return model


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    intercept: float

    def score(self, shapes: Counter) -> float:
        u, x = hashed_shapes(shapes)
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[u] @ x, -40, 40))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, full-batch Adam."""
    if not rows:
        return np.zeros(_DIMS), 0.0
    at = np.concatenate([r[0] for r in rows]).astype(np.int64)
    x = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used, k = np.unique(at, return_inverse=True)
    balance = np.full(len(rows), 1 / len(rows))
    w, c, m, v = np.zeros(len(used)), 0.0, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(c + np.bincount(row, w[k] * x, len(rows)), -40, 40)))
        d = balance * (p - target)
        g = np.append(np.bincount(k, d[row] * x, len(used)) + decay * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        s = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, c = w - s[:-1], c - s[-1]
    weights = np.zeros(_DIMS)
    weights[used] = w
    return weights, float(c)


def train_quality(docs: DataFrame, most_rows: int = 30_000) -> QualityModel:
    """``most_rows`` bounds the expected sample that trains the scorer; vote patterns are counted over all documents."""
    total = max(docs.count(), 1)
    drawn = F.pmod(F.xxhash64("text", F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most_rows / total))

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for b in batches:
            out, counted = [], Counter()
            for text, draw in zip(b.text, b.drawn):
                votes, shapes = measures(text)
                key = "".join("-0+"[v + 1] for v in votes)
                counted[key] += 1
                if draw:
                    u, x = hashed_shapes(shapes)
                    out.append((key, 0, u.tobytes(), x.tobytes()))
            yield pd.DataFrame(out + [(k, n, None, None) for k, n in counted.items()], columns=["pattern", "n", "at", "x"])

    seen = materialize(docs.select("text", drawn.alias("drawn")).mapInPandas(patterns, "pattern string, n long, at binary, x binary"))
    # bounded: one row for each pattern, and the sample
    counted = {r.pattern: r.n for r in seen.where("n > 0").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    sample = [(r.pattern, np.frombuffer(bytes(r.at), np.int32), np.frombuffer(bytes(r.x), np.float32)) for r in seen.where("n = 0").select("pattern", "at", "x").collect()]
    discard(seen)
    keys = sorted(counted)
    as_votes = lambda ks: np.array([["-0+".index(c) - 1 for c in k] for k in ks], int).reshape(-1, len(LABELLERS))
    labels = fit_label_model(as_votes(keys), np.array([counted[k] for k in keys], float))
    q = labels.posterior(as_votes([s[0] for s in sample])) if sample else np.zeros(0)
    return QualityModel(labels, *fit_scorer([s[1:] for s in sample], q))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with quality (chance of good by the scorer), posterior (by the labellers alone) and kept: the scorer's
    chance reaches ``threshold``."""
    weights = model

    @F.pandas_udf("struct<quality double, posterior double, kept boolean>")
    def judged(text: pd.Series) -> pd.DataFrame:
        let_go()
        quality, votes = np.zeros(len(text)), np.zeros((len(text), len(LABELLERS)), int)
        for i, t in enumerate(text):
            votes[i], shapes = measures(t)
            quality[i] = weights.score(shapes)
        return pd.DataFrame({"quality": quality, "posterior": weights.labels.posterior(votes), "kept": quality >= threshold})

    docs = docs.drop("quality", "posterior", "kept")
    return docs.withColumn("_judged", judged(F.col("text"))).select(*docs.columns, "_judged.quality", "_judged.posterior", "_judged.kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, train_quality(docs)).select("doc_id", "quality", "posterior", "kept")
