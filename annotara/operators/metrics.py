"""Evaluation of classifiers and clusterings from prediction tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotara.operators import ordered
from annotara.session import partitions

EPS = 2.220446049250313e-16


def confusion(pred: DataFrame, y: str, p: str) -> DataFrame:
    """(y, p, n)."""
    return pred.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def report(pred: DataFrame, y: str, p: str) -> DataFrame:
    """(label, precision, recall, f1, support) of every class, 0 for 0/0."""
    c = confusion(pred, y, p)
    tp = c.groupBy(F.col("y").alias("label")).agg(F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("support"))
    pp = c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    z = lambda x: F.coalesce(x, F.lit(0))
    d = lambda x: z(F.col(x)).cast("double")
    out = tp.join(pp, "label", "full")
    prec, rec = F.coalesce(F.try_divide(d("tp"), d("predicted")), F.lit(0.0)), F.coalesce(F.try_divide(d("tp"), d("support")), F.lit(0.0))
    return out.select("label", prec.alias("precision"), rec.alias("recall"), F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"), z(F.col("support")).alias("support"))


def averages(rep: DataFrame) -> DataFrame:
    """(precision, recall, f1) macro averaged, and accuracy as micro."""
    return rep.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"))


def binary_scores(pred: DataFrame, y: str, p: str) -> DataFrame:
    """(precision, recall, f1) of 0/1 columns with an epsilon below."""
    t = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    tp, pp, yy = t((F.col(y) == 1) & (F.col(p) == 1)), t(F.col(p) == 1), t(F.col(y) == 1)
    one = pred.agg((tp / (pp + EPS)).alias("precision"), (tp / (yy + EPS)).alias("recall"))
    return one.select("precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"))


def _cumulated(at: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """c_x (sum up to the threshold, from the highest) and t_x (sum of all) of
    the columns x within by, however many thresholds there are."""
    run = ordered.running(at, [*[F.col(b) for b in by], F.desc("threshold")], {f"c_{c}": c for c in cols})
    bounds = [F.min(F.col(f"c_{c}") - F.col(c)).alias(f"b_{c}") for c in cols] + [F.sum(c).alias(f"t_{c}") for c in cols]
    if by:
        run = run.join(run.groupBy(*by).agg(*bounds), by)
    else:
        one = run.agg(*bounds).first()
        for k, v in one.asDict().items():
            run = run.withColumn(k, F.lit(v))
    for c in cols:
        run = run.withColumn(f"c_{c}", F.col(f"c_{c}") - F.col(f"b_{c}"))
    return run


def roc(pred: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by..., threshold, fpr, tpr, step_fpr, step_tpr) at every distinct score,
    from the highest; the steps are what a threshold adds.

    Counts are pre-aggregated by score, and the running sums are distributed.
    """
    by = by or []
    pos = F.sum(F.when(F.col(y) == 1, 1).otherwise(0))
    at = pred.groupBy(*by, F.col(score).alias("threshold")).agg(pos.alias("p"), (F.count(F.lit(1)) - pos).alias("n"))
    run = _cumulated(at, by, ["p", "n"])
    part = lambda x, c: F.try_divide(F.col(x).cast("double"), F.col(f"t_{c}").cast("double"))
    return run.select(*by, "threshold", part("c_n", "n").alias("fpr"), part("c_p", "p").alias("tpr"), part("n", "n").alias("step_fpr"), part("p", "p").alias("step_tpr"))


def auc(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., auc) by trapezoids from the origin."""
    area = F.col("step_fpr") * (F.col("tpr") - F.col("step_tpr") / 2)
    return curve.groupBy(*(by or [])).agg(F.sum(area).alias("auc"))


def precision_recall(pred: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by..., threshold, precision, recall) at every distinct score."""
    by = by or []
    pos = F.sum(F.when(F.col(y) == 1, 1).otherwise(0))
    at = pred.groupBy(*by, F.col(score).alias("threshold")).agg(pos.alias("p"), F.count(F.lit(1)).alias("m"))
    run = _cumulated(at, by, ["p", "m"])
    d = lambda x: F.col(x).cast("double")
    return run.select(*by, "threshold", (d("c_p") / d("c_m")).alias("precision"), F.try_divide(d("c_p"), d("t_p")).alias("recall"))


def on_grid(curve: DataFrame, by: list[str], points: int = 100) -> DataFrame:
    """(by..., fpr, tpr) of ROC curves interpolated at equal steps of fpr."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_step")
    g = curve.select(*by).distinct().select(*by, grid).select(*by, (F.col("_step") / F.lit(float(points - 1))).alias("x"), F.lit(None).cast("double").alias("tpr"))
    best = curve.groupBy(*by, F.col("fpr").alias("x")).agg(F.max("tpr").alias("tpr"))
    both = best.unionByName(g)
    back = Window.partitionBy(*by).orderBy("x", F.col("tpr").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    # Read backwards, so that this frame too runs from its first row on.
    ahead = Window.partitionBy(*by).orderBy(F.desc("x"), F.desc(F.col("tpr").isNull())).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("tpr").isNotNull(), F.col("x"))
    x0, y0 = F.coalesce(F.last(known, True).over(back), F.lit(0.0)), F.coalesce(F.last("tpr", True).over(back), F.lit(0.0))
    x1, y1 = F.coalesce(F.last(known, True).over(ahead), F.lit(1.0)), F.coalesce(F.last("tpr", True).over(ahead), F.lit(1.0))
    filled = both.select(*by, "x", F.col("tpr").isNull().alias("asked"), F.when(x1 > x0, y0 + (y1 - y0) * (F.col("x") - x0) / (x1 - x0)).otherwise(y0).alias("v"))
    return filled.filter("asked").select(*by, F.col("x").alias("fpr"), F.col("v").alias("tpr"))


def example_based(rows: DataFrame, truth: str, pred: str, beta: float = 1.0) -> DataFrame:
    """(accuracy, precision, recall, fscore) of label sets held as arrays."""
    tp = F.size(F.array_intersect(truth, pred)).cast("double")
    u = F.size(F.array_union(truth, pred)).cast("double")
    one = rows.agg(F.avg(tp / (EPS + u)).alias("accuracy"), F.avg(tp / (EPS + F.size(pred))).alias("precision"), F.avg(tp / (EPS + F.size(truth))).alias("recall"))
    b = beta * beta
    return one.select("*", F.coalesce(F.try_divide((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall")), F.lit(0.0)).alias("fscore"))


def overlaps(pred: DataFrame, models: list[str], truth: str) -> DataFrame:
    """(subset, n, n_right): Venn counts of 0/1 predictions of several models.

    Rows are first counted by their pattern of predictions, of which there are
    at most 2^m, and the subsets are derived from those counts.
    """
    pattern = F.concat_ws("", *[F.col(m).cast("string") for m in models])
    per = pred.groupBy(pattern.alias("bits"), F.col(truth).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    arms = []
    for mask in range(1, 2 ** len(models)):
        ins = [i for i in range(len(models)) if mask >> i & 1]
        rest = [i for i in range(len(models)) if i not in ins]
        bit = lambda i: F.substring("bits", i + 1, 1).cast("int")
        si, sr = reduce(lambda a, b: a + b, [bit(i) for i in ins]), reduce(lambda a, b: a + b, [bit(i) for i in rest], F.lit(0))
        ok = si.isin(0, len(ins)) & sr.isin(0, len(rest)) & (si + sr).isin(len(ins), len(rest))
        name = "&".join(models[i] for i in ins)
        arms.append(F.struct(F.lit(name).alias("subset"), ok.alias("ok"), (bit(ins[0]) == F.col("t")).alias("right")))
    each = per.select("n", F.explode(F.array(*arms)).alias("a")).filter("a.ok")
    return each.groupBy(F.col("a.subset").alias("subset")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a.right"), F.col("n")).otherwise(0)).alias("n_right"))


def average_rank(rows: DataFrame, c: str) -> DataFrame:
    """(value, rank): average ranks of the distinct values; counts first, so a
    value that a third of all rows share is one row."""
    per = rows.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    run = ordered.running(per, [F.col("value")], {"upto": "n"})
    return run.select("value", ((F.col("upto") - F.col("n")).cast("double") + (F.col("n").cast("double") + 1) / 2).alias("rank"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(rho): rank correlation with average ranks."""
    ra, rb = average_rank(rows, a).withColumnRenamed("rank", "ra"), average_rank(rows, b).withColumnRenamed("rank", "rb")
    j = rows.join(ra.withColumnRenamed("value", a), a).join(rb.withColumnRenamed("value", b), b)
    return j.agg(F.corr("ra", "rb").alias("rho"))


def cluster_table(rows: DataFrame, c: str, k: str) -> DataFrame:
    """(c, k, n): how often class and cluster meet."""
    return rows.groupBy(F.col(c).alias("c"), F.col(k).alias("k")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def _entropy(t: DataFrame, by: str) -> DataFrame:
    total = t.agg(F.sum("n")).first()[0] or 0.0
    p = F.col("n") / F.lit(total or 1.0)
    return t.groupBy(by).agg(F.sum("n").alias("n")).agg(F.coalesce(-F.sum(p * F.log(p)), F.lit(0.0)).alias("h"))


def cluster_scores(table: DataFrame, beta: float = 1.0) -> DataFrame:
    """One row: homogeneity, completeness, v_measure, mutual_info, nmi, purity,
    rand, adjusted_rand and fowlkes_mallows of (c, k, n), n >= 0."""
    total = float(table.agg(F.sum("n")).first()[0] or 0.0)
    tot = F.lit(total)
    a = table.groupBy("c").agg(F.sum("n").alias("a"))
    b = table.groupBy("k").agg(F.sum("n").alias("b"))
    j = table.filter("n > 0").join(a, "c").join(b, "k")
    x = F.col("n")
    pairs = lambda v: v * (v - 1) / 2
    core = j.agg(
        F.sum(x / tot * F.log(x * tot / (F.col("a") * F.col("b")))).alias("mi"),
        (-F.sum(x / tot * F.log(x / F.col("b")))).alias("h_ck"), (-F.sum(x / tot * F.log(x / F.col("a")))).alias("h_kc"), F.sum(pairs(x)).alias("s"),
    )
    ha = a.agg((-F.sum(F.col("a") / tot * F.log(F.col("a") / tot))).alias("h_c"), F.sum(pairs(F.col("a"))).alias("sa"))
    hb = b.agg((-F.sum(F.col("b") / tot * F.log(F.col("b") / tot))).alias("h_k"), F.sum(pairs(F.col("b"))).alias("sb"))
    pure = table.groupBy("k").agg(F.max("n").alias("m")).agg((F.sum("m") / tot).alias("purity"))
    key = F.lit(1).alias("one")  # one row each: joined by a constant key
    r = core.select(key, "*").join(ha.select(key, "*"), "one").join(hb.select(key, "*"), "one").join(pure.select(key, "*"), "one")
    h = F.when(F.col("h_c") == 0, 1.0).otherwise(1 - F.col("h_ck") / F.col("h_c"))
    c = F.when(F.col("h_k") == 0, 1.0).otherwise(1 - F.col("h_kc") / F.col("h_k"))
    all_pairs = F.lit(pairs(total))
    expected = F.try_divide(F.col("sa") * F.col("sb"), all_pairs)
    zero = F.lit(0.0)
    return r.select(
        h.alias("homogeneity"), c.alias("completeness"), F.coalesce(F.try_divide((1 + beta) * h * c, beta * h + c), zero).alias("v_measure"), F.col("mi").alias("mutual_info"),
        F.coalesce(F.try_divide(2 * F.col("mi"), F.col("h_c") + F.col("h_k")), F.lit(1.0)).alias("nmi"), "purity",
        F.coalesce(F.try_divide(all_pairs + 2 * F.col("s") - F.col("sa") - F.col("sb"), all_pairs), F.lit(1.0)).alias("rand"),
        F.coalesce(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0)).alias("adjusted_rand"),
        F.coalesce(F.try_divide(F.col("s"), F.sqrt(F.col("sa") * F.col("sb"))), zero).alias("fowlkes_mallows"),
    )


def fuzzy_table(labels: DataFrame, members: DataFrame) -> DataFrame:
    """(c, k, n): classes against soft memberships (doc, cluster, u)."""
    return labels.join(members, "doc").groupBy(F.col("label").alias("c"), F.col("cluster").alias("k")).agg(F.sum("u").alias("n"))


def filter_clusters(rows: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(doc, cluster) of (doc, cluster, feat, val) with clusters whose mean
    population deviation per feature is over threshold turned into -1."""
    spread = rows.filter("cluster <> -1").groupBy("cluster", "feat").agg(F.stddev_pop("val").alias("s")).groupBy("cluster").agg(F.avg("s").alias("s"))
    docs = rows.select("doc", "cluster").distinct().join(spread, "cluster", "left")
    return docs.select("doc", F.when(F.col("s") > threshold, -1).otherwise(F.col("cluster")).alias("cluster"))


def weighted_log_loss(y: Column, p: Column, w: Column | float = 1.0) -> Column:
    """Weighted binary cross-entropy of one prediction."""
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q)) * w


def silhouette(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, s) silhouettes from a symmetric pair table (i, j, d) and (id, label):
    mean distance to the own cluster against that to the nearest other; 0 for
    a cluster of one. Pairs are summed by (row, cluster) before anything else."""
    lab = labels.select(F.col("id").alias("j"), F.col("label").alias("k"))
    mean = pairs.join(lab, "j").groupBy("i", "k").agg(F.avg("d").alias("m"))
    own = mean.join(labels.select(F.col("id").alias("i"), F.col("label").alias("own")), "i")
    per = own.groupBy("i").agg(F.max(F.when(F.col("k") == F.col("own"), F.col("m"))).alias("a"), F.min(F.when(F.col("k") != F.col("own"), F.col("m"))).alias("b"))
    return per.select(F.col("i").alias("id"), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("s"))


def interpolated_macro(curve: DataFrame, by: str, points: int = 100) -> DataFrame:
    """(fpr, tpr): the mean of the curves of every class on a common grid."""
    return on_grid(curve, [by], points).groupBy("fpr").agg(F.avg("tpr").alias("tpr"))


def precision_at(ranked: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(k, precision, recall) of ranked lists (query, rank, relevant) averaged
    over queries; recall against the relevant items listed."""
    ks = F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("k")
    total = ranked.groupBy("query").agg(F.sum("relevant").cast("double").alias("r"))
    hit = ranked.select("query", "rank", "relevant", ks).filter("rank <= k").groupBy("query", "k").agg(F.sum("relevant").cast("double").alias("h"))
    j = hit.join(total, "query")
    return j.groupBy("k").agg(F.avg(F.col("h") / F.col("k")).alias("precision"), F.avg(F.coalesce(F.try_divide(F.col("h"), F.col("r")), F.lit(0.0))).alias("recall"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of x >= 1, by Stirling's series from
    x + 8 on and the step down to x; right to about 1e-13 of its size."""
    z = x + 8.0
    inv = 1 / z
    square = inv * inv
    series = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + inv * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return series - np.log(reduce(lambda t, i: t * (x + i), range(1, 8), x))


#: Terms of the expected mutual information that one row sums.
TERMS = 1_000_000
#: Terms taken at once: a few arrays of so many numbers.
AT_ONCE = 50_000


def _expected(n: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, b, m, from, to) to (e): m times the sum of their terms, all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, m, first, last in zip(*[c.to_pylist() for c in batch.columns]):
                same = _log_gamma(np.array([a + 1, b + 1, n - a + 1, n - b + 1])).sum() - _log_gamma(np.array([n + 1]))[0]
                e = 0.0
                for lo in range(first, last + 1, AT_ONCE):
                    v = np.arange(lo, min(lo + AT_ONCE, last + 1), dtype=np.float64)
                    odds = same - _log_gamma(v + 1) - _log_gamma(a - v + 1) - _log_gamma(b - v + 1) - _log_gamma(n - a - b + v + 1)
                    e += float((v / n * np.log(n * v / (a * b)) * np.exp(odds)).sum())
                out.append(m * e)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["e"])

    return run


def adjusted_mutual_info(table: DataFrame) -> DataFrame:
    """(ami) of (c, k, n) counts: mutual information less what chance gives,
    over the mean of the two entropies less the same; 1 where both are constant.

    The expected value sums over all counts a pair of margins can have; they are
    dealt into rows of TERMS terms, summed within a row in arrays and added up.
    """
    total = float(table.agg(F.sum("n")).first()[0] or 0.0)
    n = F.lit(total)
    a = table.groupBy("c").agg(F.sum("n").alias("a"))
    b = table.groupBy("k").agg(F.sum("n").alias("b"))
    x = F.col("n")
    mi = table.filter("n > 0").join(a, "c").join(b, "k").agg(F.coalesce(F.sum(x / n * F.log(x * n / (F.col("a") * F.col("b")))), F.lit(0.0)).alias("mi"))
    h = lambda t, c: t.agg(F.coalesce(-F.sum(F.col(c) / n * F.log(F.col(c) / n)), F.lit(0.0)).alias(f"h_{c}"))
    # Equal margins give equal terms: pairs of distinct margins, with how many there are.
    ma, mb = a.groupBy("a").agg(F.count(F.lit(1)).alias("na")), b.groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    blocks = partitions(table.sparkSession)
    left = ma.select("a", "na", F.pmod(F.hash("a"), F.lit(blocks)).alias("g"))
    right = mb.select("b", "nb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("g"))
    low, high = F.greatest(F.lit(1.0), F.col("a") + F.col("b") - n), F.least("a", "b")
    rows = left.join(right, "g").select("a", "b", (F.col("na") * F.col("nb")).alias("m"), low.alias("low"), high.alias("high")).filter("low <= high")
    begins = F.explode(F.sequence(F.col("low").cast("bigint"), F.col("high").cast("bigint"), F.lit(TERMS).cast("bigint"))).alias("from")
    dealt = rows.select("a", "b", F.col("m").cast("double").alias("m"), begins, F.col("high").cast("bigint").alias("high")).withColumn("to", F.least(F.col("from") + TERMS - 1, "high")).drop("high")
    part = dealt.repartition(blocks, "a", "b", "from").mapInArrow(_expected(total), "e double")
    key = F.lit(1).alias("one")
    r = mi.select(key, "mi").join(h(a, "a").select(key, "h_a"), "one").join(h(b, "b").select(key, "h_b"), "one").join(part.agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("e")).select(key, "e"), "one")
    span = (F.col("h_a") + F.col("h_b")) / 2 - F.col("e")
    return r.select(F.when(F.greatest("h_a", "h_b") == 0, 1.0).otherwise(F.coalesce(F.try_divide(F.col("mi") - F.col("e"), span), F.lit(1.0))).alias("ami"))
