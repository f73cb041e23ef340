"""Vectorisation and feature scoring on long-form (doc, term, value) tables.

Everything is groupBy, join and window; no dense matrix is ever formed. The
contingency of a feature and a label comes from one joint count and marginals.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotara.functions import text as T
from annotara.session import partitions


def token_rows(docs: DataFrame, key: str, text: str, pattern: str = T.TOKEN) -> DataFrame:
    """(doc, pos, term) of every token."""
    return docs.select(F.col(key).alias("doc"), F.posexplode(T.tokens(F.col(text), pattern)).alias("pos", "term"))


def term_counts(toks: DataFrame) -> DataFrame:
    """(doc, term, tf)."""
    return toks.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def ngrams(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(doc, term): the n-grams of a text, words joined by a blank."""
    toks = T.tokens(F.col(text))
    grams = F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, n), " ")))
    return docs.select(F.col(key).alias("doc"), F.explode(grams).alias("term"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df) of (doc, term, ...) with one row per pair."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def frequent_terms(counts: DataFrame, n_docs: int, min_df: int = 1, max_share: float = 1.0, binary: bool = False) -> DataFrame:
    """Counts limited to terms within bounds of document frequency."""
    kept = document_frequency(counts).filter((F.col("df") >= min_df) & (F.col("df") <= max_share * n_docs)).select("term")
    out = counts.join(kept, "term", "left_semi")
    return out.withColumn("tf", F.lit(1).cast("bigint")) if binary else out


def tfidf(counts: DataFrame, n_docs: int, sublinear: bool = False) -> DataFrame:
    """(doc, term, w): smooth idf ln((1+N)/(1+df))+1, rows of unit length."""
    df = document_frequency(counts)
    tf = F.col("tf").cast("double")
    tf = F.log(tf) + 1.0 if sublinear else tf
    w = counts.join(df, "term").select("doc", "term", (tf * (F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return w.select("doc", "term", (F.col("w") / norm).alias("w"))


def top_terms(weights: DataFrame, k: int) -> DataFrame:
    """(doc, rank, term, w): the k heaviest terms, ties by term."""
    order = Window.partitionBy("doc").orderBy(F.desc(F.round("w", 9)), "term")
    return weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("doc", "rank", "term", F.round("w", 4).alias("w"))


#: Labels of a block on average: what a term meets at once.
LABEL_BLOCK = 1000


def _margins(labels: DataFrame) -> tuple[DataFrame, int]:
    """(block, salt, margins array<struct<label, ny>>) of every label, and how
    many blocks there are; each block is there once for every salt, so that the
    terms that meet it are spread over all tasks."""
    ny = labels.groupBy("label").agg(F.count(F.lit(1)).alias("ny"))
    blocks = ceil(ny.count() / LABEL_BLOCK)
    block = F.pmod(F.xxhash64("label"), F.lit(max(blocks, 1))).cast("int").alias("block")
    rows = ny.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("label", "ny"))).alias("margins"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(partitions(labels.sparkSession) - 1))).alias("salt")
    return rows.select("block", salts, "margins"), blocks


def _with_margins(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, nx, margins): every term with the margins of every block."""
    nx = features.groupBy("term").agg(F.count(F.lit(1)).alias("nx"))
    margins, blocks = _margins(labels)
    salt = F.pmod(F.xxhash64("term"), F.lit(partitions(labels.sparkSession))).cast("int").alias("salt")
    each = nx.select("term", "nx", salt, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)) if blocks else F.array().cast("array<int>")).alias("block"))
    return each.join(margins, ["block", "salt"]).select("term", "nx", "margins")


def met(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, label, n11) of the pairs that meet in a document."""
    return features.join(labels, "doc").groupBy("term", "label").agg(F.count(F.lit(1)).alias("n11"))


def contingency(features: DataFrame, labels: DataFrame, n_docs: int) -> DataFrame:
    """(term, label, n11, n10, n01, n00) of every feature and every label, from
    distinct (doc, term) and (doc, label); n10 has the feature only, n01 the
    label only. A pair that never meets has n11 = 0, and its row counts.

    The rows asked for are features x labels; they are expanded from the terms'
    margins and blocks of the labels' margins, and no documents are paired.
    """
    every = _with_margins(features, labels).select("term", "nx", F.explode("margins").alias("m")).select("term", "nx", "m.label", "m.ny")
    rows = every.join(met(features, labels), ["term", "label"], "left").withColumn("n11", F.coalesce("n11", F.lit(0).cast("bigint")))
    return rows.select(
        "term", "label", "n11", (F.col("nx") - F.col("n11")).alias("n10"), (F.col("ny") - F.col("n11")).alias("n01"),
        (F.lit(n_docs) - F.col("nx") - F.col("ny") + F.col("n11")).alias("n00"),
    )


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def _cells(a: Column, b: Column, c: Column, e: Column) -> SimpleNamespace:
    """The cells n11, n10, n01, n00 and the margins of a contingency row."""
    return SimpleNamespace(N11=a, N10=b, N01=c, N00=e, N=a + b + c + e, NY=a + c, NN=b + e, NX=a + b, NZ=c + e)


def _score(how: str, n11: Column, nx: Column, ny: Column, n_docs: int) -> Column:
    """A scorer of n11 and the margins; undefined ratios count as 0."""
    a, x, y = n11.cast("double"), nx.cast("double"), ny.cast("double")
    return F.coalesce(SCORERS[how](_cells(a, x - a, y - a, F.lit(float(n_docs)) - x - y + a)), F.lit(0.0))


def _gu(c: SimpleNamespace) -> Column:
    p = F.try_divide(c.N10 + c.N11, c.N)
    z = F.try_divide(c.N11 - c.N10, F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) * (F.try_divide(F.lit(1.0), c.NY) + F.try_divide(F.lit(1.0), c.NN))))
    return F.abs(z) * F.try_divide(c.N11 * c.NN, c.NY * c.N10)


def _fisher(c: SimpleNamespace) -> Column:
    m1, m0 = F.try_divide(c.N11, c.NY), F.try_divide(c.N10, c.NN)
    s1 = (c.N11 * (1 - m1) * (1 - m1) + (c.N - c.N11) * m1 * m1) / c.N
    s0 = (c.N10 * (1 - m0) * (1 - m0) + (c.N - c.N10) * m0 * m0) / c.N
    return F.try_divide((m1 - m0) * (m1 - m0), s1 + s0)


def _gain(c: SimpleNamespace) -> Column:
    px, py, pn = c.NX / c.N, c.NY / c.N, c.NN / c.N
    j, a, b = F.try_divide(c.N11, c.NX), F.try_divide(c.N01, c.N01 + c.N10), F.try_divide(c.N00, c.N01 + c.N10)
    return -_plogp(py) + _plogp(pn) - px * (-_plogp(j) - _plogp(pn)) + (1 - px) * (-_plogp(a) - _plogp(b))


def _gain_standard(c: SimpleNamespace) -> Column:
    px, py = c.NX / c.N, c.NY / c.N
    with_x, without = F.try_divide(c.N11, c.NX), F.try_divide(c.N01, c.NZ)
    h = lambda p: -_plogp(p) - _plogp(1 - p)
    return h(py) - px * h(with_x) - (1 - px) * F.coalesce(h(without), F.lit(0.0))


#: Scorers by name: an expression on one contingency row.
SCORERS: dict[str, Callable[[SimpleNamespace], Column]] = {
    "gu": _gu,
    "fisher": _fisher,
    "odds_ratio": lambda c: F.try_divide(c.N11 * c.N00, c.N01 * c.N10),
    "ngl": lambda c: F.try_divide(F.sqrt(c.N) * (c.N11 * c.N00 - c.N01 * c.N10), F.sqrt(c.NY * c.NN * c.NX * c.NZ)),
    "gss": lambda c: c.N11 * c.N00 - c.N01 * c.N10,
    "mutual_info": lambda c: F.try_divide(c.N * c.N11, c.NY * c.NX),
    "mutual_info_log": lambda c: F.log2(F.try_divide(c.N * c.N11, c.NY * c.NX)),
    "info_gain": _gain,
    "info_gain_standard": _gain_standard,
}


def scores(table: DataFrame, how: str, per_label: bool = False, scaled: bool = False) -> DataFrame:
    """(term[, label], score): a scorer summed over labels; undefined ratios
    count as 0. scaled is min-max over features, a constant giving 0."""
    s = F.coalesce(SCORERS[how](_cells(_d("n11"), _d("n10"), _d("n01"), _d("n00"))), F.lit(0.0))
    each = table.select("term", "label", s.alias("score"))
    if per_label:
        return each
    out = each.groupBy("term").agg(F.sum("score").alias("score"))
    return min_max(out) if scaled else out


def summed_scores(features: DataFrame, labels: DataFrame, n_docs: int, how: str, scaled: bool = False) -> DataFrame:
    """(term, score): scores(contingency(...), how) without its rows. A term's
    sum over all labels is first taken as if it met none, from the margins
    alone; the pairs that do meet then add what they differ by."""
    every = _with_margins(features, labels)
    zero = F.lit(0)
    base = F.aggregate("margins", F.lit(0.0), lambda t, m: t + _score(how, zero, F.col("nx"), m["ny"], n_docs))
    none = every.select("term", base.alias("score"))
    nx = features.groupBy("term").agg(F.count(F.lit(1)).alias("nx"))
    ny = labels.groupBy("label").agg(F.count(F.lit(1)).alias("ny"))
    pairs = met(features, labels).join(nx, "term").join(ny, "label")
    more = pairs.select("term", (_score(how, F.col("n11"), F.col("nx"), F.col("ny"), n_docs) - _score(how, zero, F.col("nx"), F.col("ny"), n_docs)).alias("score"))
    out = none.unionByName(more).groupBy("term").agg(F.sum("score").alias("score"))
    return min_max(out) if scaled else out


def min_max(scored: DataFrame) -> DataFrame:
    """Scores brought to 0..1 over features, a constant giving 0."""
    bounds = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if bounds.lo is None:
        return scored
    width = bounds.hi - bounds.lo
    return scored.select("term", ((F.col("score") - bounds.lo) / width if width else F.lit(0.0)).alias("score"))


def k_best(scored: DataFrame, k: int) -> DataFrame:
    """The k best features, ties by name."""
    return scored.orderBy(F.desc(F.round("score", 9)), "term").limit(k)


def over_value(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.filter(F.col("score") > threshold)


def union_top(per_label: DataFrame, n: int) -> DataFrame:
    """Per label the n best features; their kept scores summed by feature."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("score", 9)), "term"))
    return per_label.withColumn("r", rank).filter(F.col("r") <= n).groupBy("term").agg(F.sum("score").alias("score"))


def keep_features(current: DataFrame, reference: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """Features also in reference; with original, only those lost from original
    to reference go."""
    if original is None:
        return current.join(reference.select("term"), "term", "left_semi")
    lost = original.select("term").join(reference.select("term"), "term", "left_anti")
    return current.join(lost, "term", "left_anti")


def label_weights(labels: DataFrame, n_docs: int) -> DataFrame:
    """(label, inverse, balanced): 1 - mean and 1 / (mean x labels)."""
    per = labels.groupBy("label").agg((F.count(F.lit(1)).cast("double") / n_docs).alias("mean"))
    k = per.count()
    return per.select("label", (1 - F.col("mean")).alias("inverse"), F.try_divide(F.lit(1.0), F.col("mean") * k).alias("balanced"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (classes x n of the class)."""
    per = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    tot = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return per.select("label", (F.lit(float(tot.n or 0)) / (F.lit(float(tot.k or 1)) * F.col("n"))).alias("weight"))


def dependency_codes(edges: DataFrame) -> DataFrame:
    """(rel, code): codes from 1 in the order of the relation's name."""
    names = edges.select("rel").distinct()
    return names.select("rel", F.dense_rank().over(Window.orderBy("rel")).alias("code"))


def orient(edges: DataFrame, shape: str = "symm") -> DataFrame:
    """Edges (head, dep, rel) both ways, top down or bottom up."""
    up = edges.select(F.col("dep").alias("head"), F.col("head").alias("dep"), "rel")
    return {"symm": edges.select("head", "dep", "rel").unionByName(up).distinct(), "top_down": edges.select("head", "dep", "rel"), "bottom_up": up}[shape]


def count_matrix(counts: DataFrame, terms: list[str]) -> DataFrame:
    """One row per document and one 0/1 column per term of a stated, short list."""
    few = counts.filter(F.col("term").isin(terms))
    return few.groupBy("doc").pivot("term", terms).agg(F.max(F.lit(1))).na.fill(0)


def weight_summary(weights: DataFrame) -> DataFrame:
    """(feat, mean, std) of (fold, feat, w) after min-max scaling within folds."""
    w = Window.partitionBy("fold")
    lo, hi = F.min("w").over(w), F.max("w").over(w)
    scaled = weights.select("feat", F.coalesce(F.try_divide(F.col("w") - lo, hi - lo), F.lit(0.0)).alias("s"))
    return scaled.groupBy("feat").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"))


def analyzed(tokens: Column, steps: list[Callable[[Column], Column]], keep_orig: bool = False) -> Column:
    """Tokens taken through steps (array to array); keep_orig appends only the
    forms that are new to what was there before a step."""
    for step in steps:
        new = step(tokens)
        tokens = F.concat(tokens, F.array_except(new, tokens)) if keep_orig else new
    return tokens


def enriched(tokens: DataFrame, near: DataFrame) -> DataFrame:
    """(doc, text): each document's tokens (doc, pos, term) followed by the near
    words (term, rank, word) of those in the vocabulary, in order."""
    more = tokens.join(near, "term").select("doc", F.struct(F.lit(1).alias("part"), "pos", "rank", F.col("word").alias("w")).alias("x"))
    own = tokens.select("doc", F.struct(F.lit(0).alias("part"), "pos", F.lit(0).alias("rank"), F.col("term").alias("w")).alias("x"))
    both = own.unionByName(more.select("doc", F.struct("x.part", "x.pos", F.col("x.rank").cast("int").alias("rank"), "x.w").alias("x")))
    return both.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda s: s["w"]), " ").alias("text"))


def all_weights(weights: DataFrame, features: DataFrame) -> DataFrame:
    """(model, feat, w) of every feature (feat) for every model: those a model
    did not select stand one below its least weight."""
    least = weights.groupBy("model").agg((F.min("w") - 1).alias("least"))
    n = partitions(weights.sparkSession)
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    every = features.select("feat", F.pmod(F.xxhash64("feat"), F.lit(n)).cast("int").alias("salt")).distinct().join(spread, "salt")
    return every.join(weights, ["model", "feat"], "left").select("model", "feat", F.coalesce("w", "least").alias("w"))
