"""Clustering: fuzzy c-means, cuts of graphs, and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotara.operators import experiment, graph, ordered
from annotara.session import cut


def fuzzy_means(rows: DataFrame, key: str, vec: str, k: int, m: float = 2.0, rounds: int = 20, error: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """((doc, cluster, u), (cluster, centre)) by fuzzy c-means.

    A round is one pass: distances to the k centres (which are literals, k x dim
    numbers), memberships, and weighted sums pre-aggregated by cluster. Starts
    from the rows of least hash; rows must share one dimension.
    """
    base = rows.select(F.col(key).alias("doc"), F.transform(vec, lambda x: x.cast("double")).alias("v")).filter(F.col("v").isNotNull())
    start = base.orderBy(experiment.hashed(F.col("doc")), "doc").limit(k).collect()
    centres = [list(r.v) for r in start]
    exponent = 1.0 / (m - 1)

    def members(cs: list[list[float]]) -> DataFrame:
        lits = F.array(*[F.struct(F.lit(i).alias("cluster"), F.array(*[F.lit(float(x)) for x in c]).alias("c")) for i, c in enumerate(cs)])
        each = base.select("doc", "v", F.transform(lits, lambda s: F.struct(s["cluster"].alias("cluster"), F.greatest(F.aggregate(F.zip_with("v", s["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x), F.lit(1e-12)).alias("d"))).alias("ds"))
        total = F.aggregate(F.transform("ds", lambda s: F.pow(s["d"], F.lit(-exponent))), F.lit(0.0), lambda t, x: t + x)
        return each.withColumn("total", total).select("doc", "v", F.explode("ds").alias("s"), "total").select("doc", "v", "s.cluster", (F.pow("s.d", F.lit(-exponent)) / F.col("total")).alias("u"))

    for _ in range(rounds):
        w = members(centres).select("cluster", F.pow("u", F.lit(m)).alias("w"), "v")
        dim = len(centres[0])
        sums = w.groupBy("cluster").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col("v")[i]).alias(f"s{i}") for i in range(dim)]).collect()
        new = [list(c) for c in centres]
        for r in sums:
            new[r.cluster] = [r[f"s{i}"] / r.w for i in range(dim)]
        shift = max(abs(a - b) for x, y in zip(new, centres) for a, b in zip(x, y))
        centres = new
        if shift < error:
            break
    spark = rows.sparkSession
    return members(centres).select("doc", "cluster", "u"), spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "cluster int, centre array<double>")


def crisp(members: DataFrame) -> DataFrame:
    """(doc, cluster) of the greatest membership, ties to the first cluster."""
    return members.groupBy("doc").agg(F.max_by("cluster", F.struct("u", -F.col("cluster"))).alias("cluster"))


def cut_values(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(cluster, size, volume, inside, cut, mincut, ratio, norm) of a vertex
    partition (id, cluster) over undirected edges (a, b, w), each stored once."""
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    j = both.join(parts.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), "a").join(parts.select(F.col("id").alias("b"), F.col("cluster").alias("cb")), "b")
    per = j.groupBy(F.col("ca").alias("cluster")).agg(
        F.sum("w").alias("volume"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum(F.when(F.col("ca") != F.col("cb"), F.col("w")).otherwise(0.0)).alias("cut")
    )
    size = parts.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = size.join(per, "cluster", "left").select("cluster", "size", z("volume").alias("volume"), z("inside").alias("inside"), z("cut").alias("cut"))
    zero = F.lit(0.0)
    return out.select("*", (F.col("cut") / 2).alias("mincut"), (F.col("cut") / F.col("size") / 2).alias("ratio"), F.coalesce(F.try_divide(F.col("cut"), F.col("volume")) / 2, zero).alias("norm"))


def conductance(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(cluster, conductance): twice the halved cut over the lesser of the
    weights inside and outside the cluster (each edge counted from both its
    ends, none that is cut); if one weight is 0 the other counts, 0 if both are."""
    c = cut_values(edges, parts)
    total = float(c.agg(F.sum("volume")).first()[0] or 0.0)
    rest = F.lit(total) - F.col("inside") - 2 * F.col("cut")
    base = F.when(F.least(F.col("inside"), rest) > 0, F.least(F.col("inside"), rest)).otherwise(F.greatest(F.col("inside"), rest))
    return c.select("cluster", F.coalesce(F.try_divide(2 * F.col("mincut"), base), F.lit(0.0)).alias("conductance"))


def closeness(edges: DataFrame, parts: DataFrame, e: float = 1.0) -> DataFrame:
    """(i, j, score): relative interconnectivity times relative closeness^e of
    cluster pairs joined by an edge, i < j.

    Interconnectivity: the weight between the two over the mean of their cuts.
    Closeness: the mean weight between the two over the size-weighted mean of
    cut by number of edges, an edge counted at each of its ends in the cluster.
    """
    where = lambda v, c: parts.select(F.col("id").alias(v), F.col("cluster").alias(c))
    j = edges.select("a", "b", "w").join(where("a", "ca"), "a").join(where("b", "cb"), "b")
    ends = j.select(F.col("ca").alias("cluster"), "w", (F.col("ca") != F.col("cb")).alias("out")).unionByName(j.select(F.col("cb").alias("cluster"), "w", (F.col("ca") != F.col("cb")).alias("out")))
    side = ends.groupBy("cluster").agg(F.sum(F.when(F.col("out"), F.col("w")).otherwise(0.0)).alias("cut"), F.count(F.lit(1)).alias("n"))
    side = parts.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(side, "cluster")
    cross = j.filter("ca <> cb").groupBy(F.least("ca", "cb").alias("i"), F.greatest("ca", "cb").alias("j")).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("m"))
    left, right = (side.select(*[F.col(x).alias(f"{x}_{y}") for x in side.columns]) for y in "ij")
    t = cross.join(left, F.col("i") == F.col("cluster_i")).join(right, F.col("j") == F.col("cluster_j"))
    ri = F.try_divide(2 * F.col("w"), F.col("cut_i") + F.col("cut_j"))
    own = lambda y: F.col(f"size_{y}") / (F.col("size_i") + F.col("size_j")) * F.col(f"cut_{y}") / F.col(f"n_{y}")
    rc = F.try_divide(F.col("w") / F.col("m"), own("i") + own("j"))
    return t.select("i", "j", F.coalesce(ri * F.pow(rc, F.lit(e)), F.lit(0.0)).alias("score"))


def inconsistent_edges(edges: DataFrame, coarse: float) -> DataFrame:
    """Edges that stay: one goes when it is over (1 + coarse) times the least
    edge of one end and the other end has a shorter one too."""
    both = edges.select(F.col("a").alias("v"), "w").unionByName(edges.select(F.col("b").alias("v"), "w"))
    least = both.groupBy("v").agg(F.min("w").alias("m"))
    t = edges.join(least.select(F.col("v").alias("a"), F.col("m").alias("ma")), "a").join(least.select(F.col("v").alias("b"), F.col("m").alias("mb")), "b")
    over = lambda m: F.coalesce(F.try_divide(F.col("w") - F.col(m), F.col(m)), F.lit(0.0)) > coarse
    bad = (over("ma") & (F.col("mb") < F.col("w"))) | (over("mb") & (F.col("ma") < F.col("w")))
    return t.filter(~bad).select("a", "b", "w")


def tree_clusters(edges: DataFrame, vertices: DataFrame, cut_share: float = 0.1, coarse: float = 1.0, merge_over: float | None = None) -> DataFrame:
    """(id, cluster): graph clustering by a minimum spanning forest.

    The longest cut_share of the forest's edges are cut, inconsistent ones after
    them; the components are the clusters (named by their least vertex), and
    those whose closeness is over merge_over are merged. Single vertices are
    noise, -1.
    """
    forest = cut(graph.minimum_forest(edges))
    n = forest.count()
    order = ordered.numbered(forest, [F.col("w"), F.col("a"), F.col("b")], "r")
    kept = inconsistent_edges(order.filter(F.col("r") <= (1 - cut_share) * max(n - 1, 1)).select("a", "b", "w"), coarse)
    comp = cut(graph.components(kept)).select("id", F.col("root").alias("cluster"))
    if merge_over is not None:
        near = closeness(edges, comp).filter(F.col("score") > merge_over).select(F.col("i").alias("a"), F.col("j").alias("b"))
        roots = cut(graph.components(near)).select(F.col("id").alias("cluster"), "root")
        comp = comp.join(roots, "cluster", "left").select("id", F.coalesce("root", "cluster").alias("cluster"))
    return vertices.select("id").join(comp, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
