"""Trees as parent tables: building, listing, searching, merging in pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotara.operators import hierarchy, ordered
from annotara.session import cut


def from_children(nodes: DataFrame, node: str, children: str) -> DataFrame:
    """(node, parent, nth) of rows that list their children in order."""
    return nodes.select(F.col(node).alias("parent"), F.posexplode(children).alias("nth", "node")).select("node", "parent", "nth")


def preorder(edges: DataFrame) -> DataFrame:
    """(root, node, depth, path) of (node, parent); sorting by (root, path) lists
    each tree in pre-order, children by their name. The path joins names by a
    sign below every letter, so a parent sorts before what is below it."""
    solved = hierarchy.solve(edges.select(F.lit("tree").alias("link"), F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent")), with_path=True)
    return solved.filter("depth >= 0").select("root", "node", "depth", F.array_join("path", "\x01").alias("path"))


def search(listing: DataFrame, wanted: Column, stop_found: bool = False) -> DataFrame:
    """(root, node) that satisfy a predicate on the listing's columns; with
    stop_found only the first on each path from the root."""
    hits = listing.filter(wanted).select("root", "node", "path")
    if not stop_found:
        return hits.select("root", "node")
    above = hits.select("node", "root", F.explode(F.split("path", "\x01")).alias("above")).filter("above <> node")
    inner = above.join(hits.select("root", F.col("node").alias("above")), ["root", "above"], "left_semi").select("root", "node").distinct()
    return hits.select("root", "node").join(inner, ["root", "node"], "left_anti")


def merge_pairs(leaves: DataFrame, order: str) -> DataFrame:
    """(id, parent, level) of a binary tree made by merging neighbours in order,
    an odd one going up alone, until one node is left. Ids count on by level.

    Neighbours are found by position, so each level is arithmetic on a dense
    position column; only the number of leaves reaches the driver.
    """
    n = leaves.count()
    at = cut(ordered.numbered(leaves.select(order), [F.col(order)], "pos").select("pos"))
    out = None
    base, level = 0, 0
    while True:
        width = (n + (1 << level) - 1) >> level
        up = F.lit(None).cast("bigint") if width <= 1 else F.lit(base + width) + F.floor(F.col("p") / 2)
        rows = at.filter(F.pmod("pos", F.lit(1 << level)) == 0).select(F.shiftright("pos", level).alias("p"))
        rows = rows.select((F.lit(base) + F.col("p")).cast("bigint").alias("id"), up.cast("bigint").alias("parent"), F.lit(level).alias("level"))
        out = rows if out is None else out.unionByName(rows)
        if width <= 1:
            return out
        base, level = base + width, level + 1


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """A batch column: size rows each in order, the rest in the last."""
    return ordered.numbered(rows, [F.col(order)], "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("bigint"))


def modify(listing: DataFrame, wanted: Column, **columns: Column) -> DataFrame:
    """listing with columns changed where a predicate holds, the rest as it is."""
    return listing.withColumns({k: F.when(wanted, v).otherwise(F.col(k)) for k, v in columns.items()})
