"""Trained representations: word vectors, topics, components, t-SNE."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import PCA, CountVectorizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotara.functions import text as T


#: More terms than a vector has places: CountVectorizer then takes as many as it counts.
ALL_TERMS = 2**31 - 1


def word_vectors(docs: DataFrame, text: str, size: int = 100, window: int = 5, min_count: int = 5, seed: int = 7) -> DataFrame:
    """(word, v) of skip-gram vectors."""
    m = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, inputCol="t", outputCol="o", maxIter=1).fit(docs.select(T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")))
    return m.getVectors().select("word", vector_to_array("vector").alias("v"))


def topics(docs: DataFrame, key: str, text: str, k: int = 10, vocab: int = ALL_TERMS, seed: int = 7) -> DataFrame:
    """(doc, cluster, u): topic mixture of every document, over all its terms
    unless vocab names how many of the most frequent ones are to be used."""
    toks = docs.select(F.col(key).alias("doc"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    x = CountVectorizer(inputCol="t", outputCol="features", vocabSize=vocab).fit(toks).transform(toks)
    d = LDA(k=k, maxIter=5, seed=seed).fit(x).transform(x)
    return d.select("doc", F.posexplode(vector_to_array("topicDistribution")).alias("cluster", "u"))


def principal(rows: DataFrame, key: str, vec: str, k: int = 2) -> DataFrame:
    """(id, v) on the first k principal components."""
    x = rows.select(F.col(key).alias("id"), array_to_vector(F.transform(vec, lambda y: y.cast("double"))).alias("f"))
    return PCA(k=k, inputCol="f", outputCol="o").fit(x).transform(x).select("id", vector_to_array("o").alias("v"))


def _affinities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Row-wise affinities whose entropy is log(perplexity), by bisection."""
    n = len(d)
    p = np.zeros((n, n))
    goal = np.log(perplexity)
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        row = np.delete(d[i], i)
        for _ in range(50):
            e = np.exp(-(row - row.min()) * beta)
            s = e.sum()
            h = np.log(s) + beta * ((row - row.min()) * e).sum() / s
            if abs(h - goal) < 1e-5:
                break
            lo, hi = (beta, hi) if h > goal else (lo, beta)
            beta = beta * 2 if np.isinf(hi) else (lo + hi) / 2
        p[i, np.arange(n) != i] = e / s
    return p


def tsne(x: np.ndarray, dims: int = 2, perplexity: float = 30.0, rounds: int = 500, seed: int = 7) -> np.ndarray:
    """t-SNE of a few thousand points held on the driver (not distributed: it is
    for display, and its input is bounded by the caller)."""
    n = len(x)
    s = (x**2).sum(1)
    p = _affinities(np.maximum(s[:, None] + s[None] - 2 * x @ x.T, 0), min(perplexity, max(2.0, (n - 1) / 3)))
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    y, dy = rng.normal(0, 1e-4, (n, dims)), np.zeros((n, dims))
    for t in range(rounds):
        sy = (y**2).sum(1)
        q = 1 / (1 + sy[:, None] + sy[None] - 2 * y @ y.T)
        np.fill_diagonal(q, 0)
        w = (p * (4 if t < 100 else 1) - np.maximum(q / q.sum(), 1e-12)) * q
        g = 4 * (np.diag(w.sum(1)) - w) @ y
        dy = (0.5 if t < 250 else 0.8) * dy - 200 * g
        y = y + dy
        y -= y.mean(0)
    return y
