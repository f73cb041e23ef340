"""Parent-child links to full hierarchies.

Method: hash splitters are chosen among the nodes, every node is walked to its
next splitter (pointer doubling, so the number of rounds is the logarithm of
the longest walk), the reduced graph of splitters is solved the same way, and
depths, roots and paths are expanded from it. Cycles without a splitter are
found when a doubling round finishes no node, and solved separately.

Every step is an equi-join or an aggregation; nodes are numbered once, in the
order of their names, and walks are of numbers. No row set is collected to the
driver (only counts are); rounds are written tables, of which only what is
finished is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotara.session import discard, folder, put, stored

#: One node in SPLIT is a splitter: walks have SPLIT steps on average.
SPLIT = 16


def clean_id(c: Column) -> Column:
    """An identifier in the notation PREFIX:digits.

    Accepts surrounding blanks and angle brackets, a URI in front, an
    underscore for the colon and a prefix in lower case. Blank gives null.
    """
    bare = F.regexp_replace(F.regexp_replace(c, r"^[\s<]+|[\s>]+$", ""), r"^.*[/#]", "")
    parted = F.regexp_replace(bare, r"^([A-Za-z]+)_(?=[0-9A-Za-z]+$)", "$1:")
    upper = F.when(
        parted.rlike(r"^[A-Za-z]+:"),
        F.concat(F.upper(F.split(parted, ":", 2)[0]), F.lit(":"), F.split(parted, ":", 2)[1]),
    ).otherwise(parted)
    # Most are written so already: one look instead of all of the above.
    return F.when(c.rlike(r"^[A-Z]+:[0-9A-Za-z]+$"), c).otherwise(F.when(F.length(bare) > 0, upper))


def links(rows: DataFrame, node: str, parents: dict[str, str]) -> DataFrame:
    """(link, node, parent): the links that rows name.

    parents maps a link name to the column that holds the parent. Nulls and
    blanks in either column are no link. Of a node with several different
    parents solve() takes the least, so the result does not depend on row order.
    """
    arms = F.explode(F.array(*[F.struct(F.lit(k).alias("link"), clean_id(F.col(c)).alias("parent")) for k, c in parents.items()]))
    own = rows.filter(F.coalesce(*[F.col(c) for c in parents.values()]).isNotNull()).withColumn("_node", clean_id(F.col(node)))
    e = own.select(F.col("_node").alias("node"), arms.alias("x")).select("x.link", "node", "x.parent")
    return e.filter("node is not null and parent is not null")


def _double(state: DataFrame, extra: list[str]) -> tuple[DataFrame, DataFrame | None, str]:
    """Pointer doubling of (id, ptr, dist, least, done[, seg]) until all are done,
    or until a round finishes none: then the rest runs in circles.

    done is 0 while walking, 1 at a splitter, 2 at a root. Returns the finished
    rows, the rest, if any, and the folder of both; the rest is carried on until
    each of its pointers lies on its circle and each least covers the whole circle.

    A folder holds what is finished, by round, and of the walking rows only the
    last round's, so it does not grow with the rounds.
    """
    spark, base, r, stuck = state.sparkSession, folder(state.sparkSession), 0, False
    state = state.select("id", "ptr", "dist", "least", *extra, "done")
    kinds = state.schema
    put(state, f"{base}/round=0", ["done"])
    now = spark.read.schema(kinds).option("basePath", base).parquet(base)
    left, reach = now.filter("done = 0").count(), 1
    while left:
        active = now.filter("done = 0")
        known = active if stuck else now
        ahead = known.select(F.col("id").alias("ptr"), *[F.col(c).alias(c + "_2") for c in ("ptr", "dist", "least", "done", *extra)])
        new = active.join(ahead, "ptr").select(
            "id", F.col("ptr_2").alias("ptr"), (F.col("dist") + F.col("dist_2")).alias("dist"), F.least("least", "least_2").alias("least"),
            *[("seg" if stuck else F.concat("seg", "seg_2").alias("seg")) for _ in extra], F.col("done_2").alias("done"),
        )
        r += 1
        put(new, f"{base}/round={r}", ["done"])
        discard(spark, f"{base}/round={r - 1}/done=0")
        now = spark.read.schema(kinds).option("basePath", base).parquet(base)
        reach *= 2
        n = now.filter("done = 0").count()
        stuck = n == left
        if stuck and reach >= left:
            return now.filter("done > 0"), now.filter("done = 0"), base
        left = n
    return now, None, base


def solve(edges: DataFrame, with_path: bool = False, split: int = SPLIT) -> DataFrame:
    """(link, node, root, depth[, path]) for every node of (link, node, parent).

    A root has depth 0. A node whose links run into a circle has depth -1 and,
    as root, the least node of the circle; its path is null. path runs from the
    root to the node, both included. Empty input gives no rows.
    """
    spark, extra = edges.sparkSession, ["seg"] if with_path else []
    none = [F.lit(None).cast("array<string>").alias(x) for x in extra]
    # Every node once, numbered in the order of the names: what walks are numbers.
    ends = F.explode(F.array(F.struct("node", "parent"), F.struct(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"))))
    each = edges.select("link", ends.alias("x")).select("link", "x.node", "x.parent").filter("node is not null").distinct()
    once = each.repartitionByRange("link", "node").groupBy("link", "node").agg(F.min("parent").alias("parent")).sortWithinPartitions("link", "node")
    named = stored(once.withColumn("id", F.monotonically_increasing_id()))

    def chosen(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(split)) == 0

    up = named.select("link", F.col("node").alias("parent"), F.col("id").alias("ptr"), F.col("parent").isNull().alias("top"))
    first = named.filter("parent is not null").join(up, ["link", "parent"]).select(
        "id", "ptr", F.lit(1).cast("bigint").alias("dist"), F.col("id").alias("least"),
        F.when(F.col("top"), 2).when(chosen("ptr"), 1).otherwise(0).alias("done"), *[F.array("node").alias(x) for x in extra],
    )
    walked, rest, at_walked = _double(first, extra)
    # Nodes that meet neither splitter nor root: their circle has no splitter.
    loops = None
    if rest is not None:
        on = rest.select(F.col("id").alias("ptr"), F.col("least").alias("root"))
        loops = stored(rest.select("id", "ptr").join(on, "ptr").select("id", "root"))
    # The reduced graph: each splitter points at the next, at a root, or into a loop.
    red = walked.filter(chosen("id"))
    if loops is not None:
        ends = loops.filter(chosen("id")).select(F.col("id").alias("ptr"), F.lit(True).alias("looped"))
        red = red.join(ends, "ptr", "left").withColumn("done", F.when(F.col("looped"), 1).when(F.col("done") == 2, 2).otherwise(0))
    else:
        red = red.withColumn("done", F.when(F.col("done") == 2, 2).otherwise(0))
    ends2, rest2, _ = _double(red, extra)
    solved = ends2.filter("done = 2").select("id", F.col("ptr").alias("root"), F.col("dist").alias("depth"), *extra)
    minus = F.lit(-1).cast("bigint").alias("depth")
    if loops is not None:
        at = loops.select(F.col("id").alias("ptr"), "root")
        solved = solved.unionByName(ends2.filter("done = 1").join(at, "ptr").select("id", "root", minus, *none))
        solved = solved.unionByName(loops.filter(chosen("id")).select("id", "root", minus, *none))
    if rest2 is not None:
        on = rest2.select(F.col("id").alias("ptr"), F.col("least").alias("root"))
        solved = solved.unionByName(rest2.select("id", "ptr").join(on, "ptr").select("id", "root", minus, *none))
    # Expansion: a walk ended at a root or at a splitter; the loops are solved.
    at = solved.select(F.col("id").alias("ptr"), F.col("root").alias("root_2"), F.col("depth").alias("depth_2"), *[F.col(x).alias("seg_2") for x in extra])
    out = walked.filter("done = 2").select("id", F.col("ptr").alias("root"), F.col("dist").alias("depth"), *extra)
    out = out.unionByName(
        walked.filter("done = 1").join(at, "ptr").select(
            "id", F.col("root_2").alias("root"), F.when(F.col("depth_2") < 0, F.lit(-1)).otherwise(F.col("dist") + F.col("depth_2")).alias("depth"),
            *[F.concat("seg", "seg_2").alias(x) for x in extra],
        )
    )
    if loops is not None:
        out = out.unionByName(loops.select("id", "root", minus, *none))
    # Names again: those of roots are met first, then each node's own.
    roots = named.select(F.col("id").alias("root"), F.col("node").alias("top"))
    led = stored(out.join(roots, "root").select("id", F.col("top").alias("root"), "depth", *extra))
    discard(spark, at_walked)
    got = named.select("link", "node", "id").join(led, "id").select("link", "node", "root", "depth", *extra)
    tops = named.filter("parent is null")
    got = got.unionByName(tops.select("link", "node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), *[F.array().cast("array<string>").alias(x) for x in extra]))
    if with_path:
        got = got.select("link", "node", "root", "depth", F.when(F.col("depth") >= 0, F.concat(F.array("root"), F.reverse("seg"))).alias("path"))
    return got


def descendants(solved: DataFrame) -> DataFrame:
    """(link, node, descendant, distance) from the paths of solve(): one row per
    pair, none gathered in a group, so a root over all rows is no hot task."""
    at = solved.filter("depth > 0").select("link", F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("level", "node"))
    return at.filter("level < depth").select("link", "node", "descendant", (F.col("depth") - F.col("level")).alias("distance"))
