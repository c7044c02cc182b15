"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are used. With prior ``pi`` of toxic text, a scorer ``g`` and a
loss ``l(margin)``, the risk is ``pi * P[l(g)] + max(0, U[l(-g)] - pi * P[l(-g)])``: the unlabelled mean counts as
negative after the share of hidden positives is taken out, and the difference is not allowed below zero, where a
flexible model would only be fitting noise. The scorer is linear over the presence of selected words and word beginnings.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import map_columns
from foliospark.sources.scratch import written

WORD = re.compile(r"\w+")
#: Beginnings of words that are features besides the words, so that inflected and compounded forms are met.
BEGINNINGS = (3, 4, 5)
#: Bounds of the training sample (rows with the smallest id hashes) and of the word list of the model.
MAX_POSITIVE, MAX_UNLABELLED, MAX_WORDS = 4000, 12000, 768
#: A word enters the model if it is in this many sample documents and commoner among toxic ones by this many standard errors.
MIN_DOCUMENTS, MIN_Z = 4, 3.5
CUT = 0.3


def features(text: str | None) -> set[str]:
    """Distinct lower-case words of the whole text and, after ``^``, the beginnings of longer ones."""
    words = set(WORD.findall((text or "").lower()))
    return words.union(*[{"^" + w[:n] for w in words if len(w) > n} for n in BEGINNINGS])


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    prior: float

    def score(self, text: str | None) -> float:
        found = self.weights.keys() & features(text)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + sum(self.weights[w] for w in sorted(found))))))


def nn_pu_fit(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss, by full-batch Adam.

    ``x`` holds positive and unlabelled rows, told apart by ``positive``. When the corrected negative part falls
    below zero, a step only raises it again, as in the published method.
    """
    xp, xu = x[positive], x[~positive]
    weights, bias = np.zeros(x.shape[1], np.float32), np.float32(math.log(prior / (1 - prior)))
    moment, square, b_moment, b_square = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    for step in range(1, steps + 1):
        gp, gu = xp @ weights + bias, xu @ weights + bias
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up, uu = prior * sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)
        if negative >= 0:
            cp, cu = -prior * sigmoid(-gp) / len(gp) - up, uu
        else:
            cp, cu = up, -uu
        grad = cp @ xp + cu @ xu + decay * weights
        b_grad = cp.sum() + cu.sum()
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        b_moment, b_square = 0.9 * b_moment + 0.1 * b_grad, 0.99 * b_square + 0.01 * b_grad * b_grad
        mc, sc = 1 - 0.9 ** step, 1 - 0.99 ** step
        weights = weights - (rate * (moment / mc) / (np.sqrt(square / sc) + 1e-8)).astype(np.float32)
        bias = bias - rate * (b_moment / mc) / (math.sqrt(b_square / sc) + 1e-8)
    return weights, float(bias)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, may_learn: Column, prior: float | None = None,
          max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_words: int = MAX_WORDS) -> Model:
    """Fit a model on rows for which ``may_learn`` (a column over ``doc_id``) holds.

    Positives are rows labelled toxic; unlabelled rows are drawn from all documents whatever their label. Both samples are the
    rows with the smallest id hashes, up to the stated bounds, so only bounded id lists are broadcast and only word
    statistics of the sample reach the driver. The class prior defaults to the toxic share of the labelled rows that may be learnt from.
    Without any positive the model scores every text 0.
    """
    seen = labels.where(may_learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = seen.where("toxic = 1").select("doc_id")
    if prior is None:
        total, ones = seen.agg(F.count("*"), F.sum("toxic")).first()
        if not ones:
            return Model({}, -60.0, 0.0)
        prior = min(0.9, max(0.001, ones / total))
    order = F.xxhash64("doc_id")
    ids = (toxic.orderBy(order, "doc_id").limit(max_positive).withColumn("positive", F.lit(True))
           .unionByName(docs.where(may_learn & F.col("doc_id").isNotNull()).select("doc_id").orderBy(order, "doc_id").limit(max_unlabelled).withColumn("positive", F.lit(False))))

    def words(ids, flags, texts):
        return {"doc_id": ids, "positive": flags, "words": [sorted(features(t)) for t in texts]}

    rows = map_columns(docs.join(F.broadcast(ids), "doc_id").select("doc_id", "positive", "text"), words, "doc_id long, positive boolean, words array<string>")
    rows = written(spark, rows, "toxicity-sample")
    counts = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model({}, -60.0, prior)
    p, u = (F.sum(F.when(F.col("positive") == flag, 1).otherwise(0)) / counts[flag] for flag in (True, False))
    spread = F.sqrt(F.col("p") * (1 - F.col("p")) / counts[True] + F.col("u") * (1 - F.col("u")) / counts[False]) + 1e-4
    best = (rows.select("positive", F.explode("words").alias("word")).groupBy("word").agg(p.alias("p"), u.alias("u"), F.count("*").alias("n"))
            .where(F.col("n") >= MIN_DOCUMENTS).withColumn("z", (F.col("p") - F.col("u")) / spread).where(F.col("z") >= MIN_Z)
            .orderBy(F.desc("z"), "word").limit(max_words).select("word").collect())
    vocabulary = {r["word"]: i for i, r in enumerate(best)}

    chosen = F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary])) if vocabulary else F.array().cast("array<string>")
    sample = rows.select("doc_id", "positive", chosen.alias("words")).orderBy("positive", "doc_id").collect()
    x = np.zeros((len(sample), len(vocabulary)), np.float32)
    for i, r in enumerate(sample):
        x[i, [vocabulary[w] for w in r["words"]]] = 1
    weights, bias = nn_pu_fit(x, np.array([r["positive"] for r in sample]), prior)
    return Model({w: float(weights[i]) for w, i in vocabulary.items()}, bias, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs(doc_id, text)``; one narrow pass over whole texts.

    Null and empty texts get the score of a text without any known word. Repeated rows repeat their result, a null
    id stays null, other columns are ignored.
    """
    def run(ids, texts):
        return {"doc_id": ids, "score": [model.score(t) for t in texts]}

    return (map_columns(docs.select("doc_id", "text"), run, "doc_id long, score double")
            .withColumn("predicted", (F.col("score") >= CUT).cast("int")))
