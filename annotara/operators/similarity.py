"""Distances and nearest neighbours as pair tables (i, j, d) with i < j.

Pairs are only formed in blocks: the rows of a table are dealt into B blocks by
hash, each pair of blocks is one group of a co-located equi-join, so no task
holds more than two blocks and the shuffle is B copies of the vectors. For
approximate neighbours at scale see the clustered index of the package.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block on average, and of a part of one key's rows.
BLOCK_ROWS, KEY_ROWS = 1000, 2000


def squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, in double precision."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


METRICS = {"euclidean": lambda a, b: F.sqrt(squared(a, b)), "sqeuclidean": squared, "manhattan": manhattan, "cosine": cosine}


def _blocked(rows: DataFrame, key: str, vec: str, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Left and right copies that meet once for every pair of blocks."""
    b = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    all_b = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select(F.col(key).alias("i"), F.col(vec).alias("vi"), b.alias("bi"), all_b.alias("bj"))
    right = rows.select(F.col(key).alias("j"), F.col(vec).alias("vj"), b.alias("bj"), all_b.alias("bi"))
    return left, right


def pair_distances(rows: DataFrame, key: str, vec: str, metric: str = "euclidean", within: float | None = None) -> DataFrame:
    """(i, j, d) with i < j of all pairs, or of those within a distance."""
    n = rows.count()
    left, right = _blocked(rows, key, vec, max(1, ceil(n / BLOCK_ROWS)))
    out = left.join(right, ["bi", "bj"]).filter("i < j").select("i", "j", METRICS[metric](F.col("vi"), F.col("vj")).alias("d"))
    return out if within is None else out.filter(F.col("d") <= within)


def exact_neighbours(queries: DataFrame, rows: DataFrame, key: str, vec: str, k: int, metric: str = "euclidean") -> DataFrame:
    """(i, rank, j, d): the k nearest rows of each query but itself, ties by id.

    The stated queries are met with all rows in blocks; each block keeps its own
    k before the final ranking, so what is ranked is k per query and block.
    """
    n = rows.count()
    blocks = max(1, ceil(n / BLOCK_ROWS))
    b = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    q = queries.select(F.col(key).alias("i"), F.col(vec).alias("vi"), b)
    r = rows.select(F.col(key).alias("j"), F.col(vec).alias("vj"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))
    pairs = q.join(r, "b").filter("i <> j").select("i", "j", "b", METRICS[metric](F.col("vi"), F.col("vj")).alias("d"))
    local = F.row_number().over(Window.partitionBy("i", "b").orderBy("d", "j"))
    few = pairs.withColumn("r", local).filter(F.col("r") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).filter(F.col("rank") <= k).select("i", "rank", "j", "d")


def group_distances(queries: DataFrame, rows: DataFrame, key: str, groups: dict[str, tuple[str, float]], k: int) -> DataFrame:
    """Neighbours by a weighted sum of Euclidean distances of feature groups
    {name: (column, weight)}."""
    n = rows.count()
    blocks = max(1, ceil(n / BLOCK_ROWS))
    b = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    q = queries.select(F.col(key).alias("i"), b, *[F.col(c).alias(f"q_{g}") for g, (c, _) in groups.items()])
    r = rows.select(F.col(key).alias("j"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"), *[F.col(c).alias(f"r_{g}") for g, (c, _) in groups.items()])
    d = sum((F.lit(w) * F.sqrt(squared(F.col(f"q_{g}"), F.col(f"r_{g}"))) for g, (_, w) in groups.items()), F.lit(0.0))
    pairs = q.join(r, "b").filter("i <> j").select("i", "j", "b", d.alias("d"))
    local = F.row_number().over(Window.partitionBy("i", "b").orderBy("d", "j"))
    few = pairs.withColumn("r", local).filter(F.col("r") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).filter(F.col("rank") <= k).select("i", "rank", "j", "d")


def scale_pairs(pairs: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Min-max scaling of a pair table; a constant one becomes all ones."""
    lo, hi = pairs.agg(F.min("d"), F.max("d")).first()
    if lo is None or lo == hi:
        return pairs.withColumn("d", F.lit(1.0))
    return pairs.withColumn("d", F.lit(low) + (F.col("d") - F.lit(float(lo))) / F.lit(float(hi - lo)) * (high - low))


def constraint_distances(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(i, j, d): |delta f(10 cov) delta'| with f(x) = exp(-x) below 0, else 1,
    from the sample covariance of the constraint features (a few)."""
    long = rows.select(F.col(key).alias("id"), F.posexplode(vec).alias("f", "x"))
    other = long.select("id", F.col("f").alias("g"), F.col("x").alias("y"))
    cov = long.join(other, "id").groupBy("f", "g").agg(F.covar_samp(F.col("x").cast("double"), F.col("y").cast("double")).alias("c"))
    w = F.when(F.col("c") < 0, F.exp(-10 * F.col("c"))).otherwise(1.0)
    m = cov.select("f", "g", w.alias("w")).collect()  # features squared, not rows
    size = max((r.f for r in m), default=-1) + 1
    table = [[1.0] * size for _ in range(size)]
    for r in m:
        table[r.f][r.g] = r.w
    weights = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in table]) if size else F.array()
    left, right = _blocked(rows, key, vec, max(1, ceil(rows.count() / BLOCK_ROWS)))
    delta = F.zip_with("vi", "vj", lambda a, b: a.cast("double") - b.cast("double"))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = left.join(right, ["bi", "bj"]).filter("i < j").withColumn("delta", delta)
    total = F.aggregate(F.zip_with("delta", weights, lambda x, row: x * dot(row, F.col("delta"))), F.lit(0.0), lambda s, x: s + x)
    return both.select("i", "j", F.abs(total).alias("d"))


def blend_pairs(base: DataFrame, others: list[DataFrame], weights: list[float] | float) -> DataFrame:
    """(1 - sum a) norm(base) + sum a_i norm(other_i): weights are padded with
    the last, cut, and scaled to sum 0.99 where they reach 1."""
    if isinstance(weights, (int, float)):
        weights = [weights / max(1, len(others))] * len(others)
    weights = [*weights, *[weights[-1]] * (len(others) - len(weights))][: len(others)]
    if sum(weights) >= 1:
        weights = [w * 0.99 / sum(weights) for w in weights]
    out = scale_pairs(base).select("i", "j", (F.col("d") * (1 - sum(weights))).alias("d"))
    for o, w in zip(others, weights):
        out = out.unionByName(scale_pairs(o).select("i", "j", (F.col("d") * w).alias("d")))
    return out.groupBy("i", "j").agg(F.sum("d").alias("d"))


def _meetings(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right joined on key, each frame with one row per member of the
    key; a key's rows are dealt into parts of KEY_ROWS at most on average, and
    each pair of parts is a group of the join, so a key that a third of all rows
    share is no hot task."""
    parts = left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / KEY_ROWS).cast("int").alias("_parts"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.col("_parts")).cast("int").alias(own)
        return rows.join(parts, key).select(*rows.columns, part, every.alias(other))

    return dealt(left, "_p", "_q").join(dealt(right, "_q", "_p"), [key, "_p", "_q"]).drop("_p", "_q")


def correlations(long: DataFrame, n_docs: int | None = None) -> DataFrame:
    """(a, b, r) Pearson correlation of features of (doc, feat, val), one row
    per pair, a < b; null where a feature does not vary.

    With n_docs, rows are dense: a document without a feature holds 0, and all
    pairs of features come out, also those that never meet. Without it, a pair
    is taken over the documents that hold both.
    """
    x = long.select("doc", F.col("feat").alias("a"), F.col("val").cast("double").alias("x"))
    y = long.select("doc", F.col("feat").alias("b"), F.col("val").cast("double").alias("y"))
    j = _meetings(x, y, "doc").filter("a < b")
    if n_docs is None:
        return j.groupBy("a", "b").agg(F.corr("x", "y").alias("r"))
    met = j.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    margin = x.groupBy("a").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    left, right = _blocked(margin.select(F.col("a").alias("f"), F.struct("s", "ss").alias("m")), "f", "m", max(1, ceil(margin.count() / BLOCK_ROWS)))
    every = left.join(right, ["bi", "bj"]).filter("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("vi").alias("p"), F.col("vj").alias("q"))
    n = F.lit(float(n_docs))
    spread = lambda m: n * F.col(f"{m}.ss") - F.col(f"{m}.s") * F.col(f"{m}.s")
    over = n * F.coalesce("xy", F.lit(0.0)) - F.col("p.s") * F.col("q.s")
    return every.join(met, ["a", "b"], "left").select("a", "b", F.try_divide(over, F.sqrt(spread("p") * spread("q"))).alias("r"))


def top_k(pairs: DataFrame, k: int, descend: bool = False) -> DataFrame:
    """(i, rank, j, d): the k least (or greatest) of every row."""
    order = [F.desc("d") if descend else F.asc("d"), "j"]
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(*order))).filter(F.col("rank") <= k).select("i", "rank", "j", "d")


def both_ways(pairs: DataFrame) -> DataFrame:
    """The symmetric form of a pair table."""
    return pairs.select("i", "j", "d").unionByName(pairs.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def dot_products(long: DataFrame) -> DataFrame:
    """(i, j, s) inner products of sparse rows (doc, feat, val), i < j; a
    feature is met once per pair that shares it, a hot one in parts."""
    left = long.select(F.col("doc").alias("i"), "feat", F.col("val").alias("x"))
    both = _meetings(left, long.select(F.col("doc").alias("j"), "feat", F.col("val").alias("y")), "feat").filter("i < j")
    return both.groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("s"))


def unique_cells(cells: DataFrame, merge: str = "del") -> DataFrame:
    """(row, col, val) with repeated names merged: summed, or the first kept."""
    if merge == "sum":
        return cells.groupBy("row", "col").agg(F.sum("val").alias("val"))
    return cells.groupBy("row", "col").agg(F.min_by("val", "pos").alias("val"))


def axis_indices(rows: DataFrame, array: str, axes: int) -> DataFrame:
    """(i, j, ... up to axes, v): the elements of a nested array with their
    0-based place on every axis."""
    names = "ijklm"[:axes]
    out = rows.select(F.col(array).alias("v"))
    for n, x in enumerate(names):
        out = out.select(*names[:n], F.posexplode("v").alias(x, "v"))
    return out
