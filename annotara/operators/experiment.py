"""Folds, sampling, rebalancing and the model loop."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotara.operators import ordered


def hashed(c: Column, seed: int = 0) -> Column:
    """A number in [0, 2^32) from a key: the same on every engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint")


def folds(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """A fold column 0..k-1 from the key's hash; no shuffle."""
    return rows.withColumn("fold", F.pmod(hashed(F.col(key), seed), F.lit(k)).cast("int"))


def stratified_folds(rows: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """Folds that deal each label evenly, in the order of the hash."""
    w = Window.partitionBy(label).orderBy(hashed(F.col(key), seed), key)
    return rows.withColumn("fold", F.pmod(F.row_number().over(w) - 1, F.lit(k)).cast("int"))


def sample(rows: DataFrame, key: str, n: int | None = None, frac: float | None = None, by: str | None = None, seed: int = 0) -> DataFrame:
    """n rows or a share of them, overall or per value of by: those of least hash."""
    h = hashed(F.col(key), seed)
    if frac is not None:
        return rows.filter(h < F.lit(frac * 2**32))
    if by is None:
        return rows.orderBy(h, key).limit(n)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(h, key))).filter(F.col("_r") <= n).drop("_r")


def rebalance(rows: DataFrame, key: str, label: str, ratio: float, seed: int = 0) -> DataFrame:
    """If positives are under 1 / (ratio + 1) of the rows: all negatives and the
    positives that int(negatives / ratio) draws with replacement meet at least
    once; draws are hashes, so the outcome is the same each time."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p")).first()
    pos = int(n.p or 0)
    if not n.n or not pos or pos / n.n >= 1 / (ratio + 1):
        return rows
    draws = int((n.n - pos) / ratio)
    numbered = ordered.numbered(rows.filter(F.col(label) == 1), [F.col(key)], "_i").withColumn("_i", F.col("_i").cast("int"))
    drawn = rows.sparkSession.range(draws).select(F.pmod(hashed(F.col("id"), seed), F.lit(pos)).cast("int").alias("_i")).distinct()
    return rows.filter(F.col(label) != 1).unionByName(numbered.join(drawn, "_i", "left_semi").drop("_i"))


def cross_validate(rows: DataFrame, models: Callable[[], Iterable[tuple[str, object]]], k: int = 5, features: str = "features", label: str = "label") -> DataFrame:
    """(fold, model, doc, y, p, score) predictions of every model on every held
    out fold; only the loop over folds and models runs on the driver."""
    from pyspark.ml.functions import vector_to_array

    out = None
    for i in range(k):
        train, test = rows.filter(F.col("fold") != i), rows.filter(F.col("fold") == i)
        for name, est in models():
            pred = Pipeline(stages=[est]).fit(train).transform(test)
            part = pred.select(F.lit(i).alias("fold"), F.lit(name).alias("model"), "doc", F.col(label).alias("y"), F.col("prediction").cast("int").alias("p"), vector_to_array("probability")[1].alias("score"))
            out = part if out is None else out.unionByName(part)
    return out


def grid(rows: DataFrame, make: Callable[..., object], params: dict[str, list], k: int = 3) -> DataFrame:
    """(params, mean, std) accuracy of every combination over the folds."""
    names = sorted(params)
    out = None
    for combo in product(*[params[n] for n in names]):
        kw = dict(zip(names, combo))
        pred = cross_validate(rows, lambda kw=kw: [("m", make(**kw))], k)
        per = pred.groupBy("fold").agg(F.avg(F.when(F.col("y") == F.col("p"), 1.0).otherwise(0.0)).alias("acc"))
        m = F.create_map(*[F.lit(str(x)) for n in names for x in (n, kw[n])])
        part = per.agg(F.avg("acc").alias("mean"), F.stddev_pop("acc").alias("std")).select(m.alias("params"), "mean", "std")
        out = part if out is None else out.unionByName(part)
    return out


def slice_of_grid(cube: DataFrame, name: str) -> DataFrame:
    """(value, mean, std) along one parameter at the best values of the others."""
    best = cube.orderBy(F.desc("mean"), F.to_json("params")).first()
    for k, v in (best.params if best else {}).items():
        if k != name:
            cube = cube.filter(F.col("params")[k] == v)
    return cube.select(F.col("params")[name].alias("value"), "mean", "std").orderBy(F.col("value").cast("double"))


def fold_summary(values: DataFrame) -> DataFrame:
    """(model, metric, mean, std) of (fold, model, metric, value)."""
    return values.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def split_sizes(n: int, parts: int) -> list[int]:
    """n tasks in parts, the first ones one larger."""
    return [n // parts + (i < n % parts) for i in range(parts)]


def histogram(rows: DataFrame, c: str, bins: int) -> DataFrame:
    """(bin, n, cumulative) of equal bins between the least and the greatest."""
    lo, hi = rows.agg(F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))).first()
    if lo is None:
        return rows.select(F.lit(0).alias("bin"), F.lit(0).alias("n"), F.lit(0).alias("cumulative")).filter("false")
    at = F.least(F.floor((F.col(c).cast("double") - lo) / ((hi - lo) / bins if hi > lo else 1.0)), F.lit(bins - 1)).cast("int")
    per = rows.filter(F.col(c).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("cumulative", F.sum("n").over(Window.orderBy("bin")))


def distribution(rows: DataFrame, by: str, c: str, shares: list[float]) -> DataFrame:
    """(by, n, mean, std, quantiles) of a column within groups, what a violin or
    a box is drawn from; exact quantiles by linear interpolation."""
    v = F.col(c).cast("double")
    return rows.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.percentile(v, F.array(*[F.lit(x) for x in shares])).alias("quantiles"))
