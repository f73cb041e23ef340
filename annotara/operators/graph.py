"""Ontology graph queries over triples (s, p, o, o_lang, o_is_literal)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotara.operators import ordered
from annotara.session import cut


def facts(triples: DataFrame) -> DataFrame:
    """The graph as a set: exact repeats dropped, rows without subject or object too."""
    return triples.select("s", "p", "o", "o_lang", "o_is_literal").filter("s is not null and o is not null").distinct()


def _lang(lang: str) -> Column:
    return F.lower(F.col("o_lang")) == lang.lower() if lang else F.lit(True)


def ids_by_label(triples: DataFrame, pattern: str, label_preds: list[str], lang: str = "") -> DataFrame:
    """(id) of subjects one of whose labels matches, whatever the case."""
    hit = F.col("p").isin(label_preds) & F.rlike("o", F.lit(f"(?i){pattern}")) & _lang(lang)
    return triples.filter(hit).filter("s is not null").select(F.col("s").alias("id")).distinct()


def labels_of(triples: DataFrame, ids: DataFrame, label_preds: list[str], lang: str = "") -> DataFrame:
    """(id, label) of the given ids."""
    lab = triples.filter(F.col("p").isin(label_preds) & _lang(lang)).select(F.col("s").alias("id"), F.col("o").alias("label"))
    return lab.join(ids.select("id"), "id", "left_semi").distinct()


def references(triples: DataFrame, ref_preds: list[str], reverse: bool = False) -> DataFrame:
    """(id, ref), or (ref, id) for looking ids up by reference."""
    out = triples.filter(F.col("p").isin(ref_preds)).filter("s is not null and o is not null").select(F.col("s").alias("id"), F.col("o").alias("ref")).distinct()
    return out.select("ref", "id") if reverse else out


def predicates(triples: DataFrame, label_preds: list[str], id_pattern: str | None = None) -> DataFrame:
    """(p) of subjects that have a label."""
    lab = triples.filter(F.col("p").isin(label_preds)).select("s")
    t = triples if id_pattern is None else triples.filter(F.rlike("s", F.lit(id_pattern)))
    return t.join(lab, "s", "left_semi").select("p").distinct()


def objects(triples: DataFrame, preds: list[str], label_preds: list[str], id_pattern: str | None = None, with_labels: bool = True) -> DataFrame:
    """(id, label, p, object[, object_label]) of the chosen predicates."""
    t = facts(triples).filter(F.col("p").isin(preds)).select(F.col("s").alias("id"), "p", F.col("o").alias("object"))
    if id_pattern:
        t = t.filter(F.rlike("id", F.lit(id_pattern)))
    lab = triples.filter(F.col("p").isin(label_preds)).select(F.col("s").alias("id"), F.col("o").alias("label")).dropna().distinct()
    out = t.join(lab, "id")
    if with_labels:
        out = out.join(lab.select(F.col("id").alias("object"), F.col("label").alias("object_label")), "object").select("id", "label", "p", "object", "object_label")
    return out.distinct()


def annotations(triples: DataFrame, prop_label: str, label_preds: list[str], source: str, prop: str, target: str) -> DataFrame:
    """(source, label, target) of axiom nodes annotated by a property found by
    its label: source, prop and target name the axiom's predicates."""
    lab = triples.filter(F.col("p").isin(label_preds)).select(F.col("s").alias("id"), F.col("o").alias("label")).dropna().distinct()
    props = lab.filter(F.col("label") == prop_label).select(F.col("id").alias("o"))
    nodes = triples.filter(F.col("p") == prop).join(props, "o", "left_semi").select(F.col("s").alias("node")).distinct()
    src = triples.filter(F.col("p") == source).select(F.col("s").alias("node"), F.col("o").alias("source"))
    tgt = triples.filter(F.col("p") == target).select(F.col("s").alias("node"), F.col("o").alias("target"))
    return nodes.join(src, "node").join(tgt, "node").join(lab.withColumnRenamed("id", "source"), "source").select("source", "label", "target").distinct()


def annotation_values(triples: DataFrame, prop_label: str, label_preds: list[str]) -> DataFrame:
    """(id, value, label) for the predicates that carry a label themselves."""
    lab = triples.filter(F.col("p").isin(label_preds)).select(F.col("s").alias("id"), F.col("o").alias("label")).dropna().distinct()
    props = lab.filter(F.col("label") == prop_label).select(F.col("id").alias("p"))
    vals = triples.join(props, "p", "left_semi").select(F.col("s").alias("id"), F.col("o").alias("value"))
    return vals.join(lab, "id").distinct()


def undirected(triples: DataFrame, preds: list[str] | None) -> DataFrame:
    """(a, b) both ways, loops and repeats dropped; None takes any predicate."""
    e = triples.filter(F.col("p").isNotNull() if preds is None else F.col("p").isin(preds)).filter("s is not null and o is not null and s <> o").select(F.col("s").alias("a"), F.col("o").alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def similar_terms(triples: DataFrame, label_preds: list[str], preds: list[str]) -> DataFrame:
    """(label, similar): labels one step apart in either direction."""
    lab = triples.filter(F.col("p").isin(label_preds)).select(F.col("s").alias("id"), F.col("o").alias("label")).dropna().distinct()
    e = undirected(triples, preds)
    out = lab.join(e, lab.id == e.a).select("label", "b").join(lab.select(F.col("id").alias("b"), F.col("label").alias("similar")), "b")
    return out.select("label", "similar").distinct()


def neighbours_by_label(triples: DataFrame, asked: DataFrame, label_preds: list[str], how: str = "exact", lang: str = "", preds: list[str] | None = None) -> DataFrame:
    """(x): labels of what stands one step, in either direction, from a subject
    with a label asked for (asked: one column, label). exact: the label itself;
    fuzzy: a pattern met anywhere in it, whatever the case. preds narrows the
    predicates; blank nodes are left out."""
    lab = triples.filter(F.col("p").isin(label_preds)).filter("s is not null and o is not null and not startswith(s, '_:')")
    near = lab.select(F.col("s").alias("id"), F.col("o").alias("x")).distinct()
    own = lab.filter(_lang(lang)).select(F.col("s").alias("id"), F.col("o").alias("label")).distinct()
    seeds = own.join(asked.select("label").distinct(), "label") if how == "exact" else _like(own, "label", asked)
    e = undirected(triples, preds)
    return seeds.select(F.col("id").alias("a")).distinct().join(e, "a").select(F.col("b").alias("id")).join(near, "id").select("x").distinct()


def neighbours_by_node(triples: DataFrame, asked: DataFrame, how: str = "exact", preds: list[str] | None = None) -> DataFrame:
    """(x): nodes one step, in either direction, from the nodes asked for
    (asked: one column, label), by the node's own text; no labels are used."""
    e = undirected(triples, preds)
    e = e.filter("not startswith(a, '_:') and not startswith(b, '_:')")
    hit = e.join(asked.select(F.col("label").alias("a")).distinct(), "a") if how == "exact" else _like(e, "a", asked)
    return hit.select(F.col("b").alias("x")).distinct()


#: Patterns that one call of a fuzzy search takes.
MAX_PATTERNS = 1000


def _like(rows: DataFrame, c: str, asked: DataFrame) -> DataFrame:
    """Rows whose column meets one of a stated, short list of patterns."""
    patterns = [r[0] for r in asked.select("label").distinct().limit(MAX_PATTERNS + 1).collect() if r[0]]
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    hit = F.lit(False)
    for x in patterns:
        hit = hit | F.rlike(c, F.lit(f"(?i){x}"))
    return rows.filter(hit)


def shortest(edges: DataFrame, sources: DataFrame, max_length: int = 100, follow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(src, dst, d): least hops from each source (id) to all it reaches within
    max_length, by breadth first rounds; a frontier is deduplicated and rid of
    what was seen, and each round is cut. follow may filter a frontier."""
    seen = cut(sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("d")))
    parts, frontier = [seen], seen
    for d in range(1, max_length + 1):
        step = frontier.join(edges, F.col("dst") == F.col("a")).select("src", F.col("b").alias("dst")).distinct()
        for p in parts[-2:] if d > 1 else parts:  # undirected: a hop leads back two rounds at most
            step = step.join(p.select("src", "dst"), ["src", "dst"], "left_anti")
        if follow:
            step = follow(step)
        frontier = cut(step.select("src", "dst", F.lit(d).alias("d")))
        if frontier.isEmpty():
            break
        parts.append(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def closure_among(edges: DataFrame, vertices: DataFrame, max_length: int = 100) -> DataFrame:
    """(i, j, d) hop distances among the given vertices (id), i < j."""
    reach = shortest(edges, vertices, max_length)
    other = vertices.select(F.col("id").alias("dst"))
    return reach.filter("src < dst").join(other, "dst", "left_semi").select(F.col("src").alias("i"), F.col("dst").alias("j"), "d")


def closure_with_discovered(edges: DataFrame, vertices: DataFrame, min_length: int = 1, max_length: int = 5, keep: Column | None = None) -> DataFrame:
    """(src, dst, d) from the vertices to everything found on the way."""
    reach = shortest(edges, vertices, max_length).filter((F.col("d") >= min_length) & (F.col("d") <= max_length))
    return reach if keep is None else reach.filter(keep)


def neighbours_outside(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id): neighbours of a vertex set that are not in it."""
    v = vertices.select(F.col("id").alias("a"))
    out = edges.join(v, "a", "left_semi").select(F.col("b").alias("id")).distinct()
    return out.join(vertices.select("id"), "id", "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): connected components, root the least id. Stars alternate
    large and small until nothing changes; rounds grow with the logarithm of a
    component's size, each cut, and only a change count reaches the driver."""
    e = edges.select("a", "b").filter("a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # Large star: neighbours above a node are tied to its least neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: neighbours below a node, and itself, are tied to the least.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = cut(new)
        same = new.join(e, ["u", "v"], "left_anti").isEmpty() and e.join(new, ["u", "v"], "left_anti").isEmpty()
        e = new
        if same:
            break
    out = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return out.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()


def minimum_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w): minimum spanning forest of weighted edges by Boruvka rounds;
    ties by the edge's ends, so it is unique. Each round takes the least edge
    of every component and merges components along them."""
    e = cut(edges.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w")))
    comp = None
    chosen: list[DataFrame] = []
    cur = e.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
    while True:
        tag = F.struct("w", "a", "b")
        side = cur.select(F.col("ca").alias("c"), tag.alias("t")).unionByName(cur.select(F.col("cb").alias("c"), tag.alias("t")))
        pick = cut(side.groupBy("c").agg(F.min("t").alias("t")).select("t.w", "t.a", "t.b").distinct())
        if pick.isEmpty():
            break
        chosen.append(pick)
        links = cur.join(pick.select("a", "b"), ["a", "b"], "left_semi").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        comp = cut(components(links))
        ra, rb = comp.select(F.col("id").alias("ca"), F.col("root").alias("ra")), comp.select(F.col("id").alias("cb"), F.col("root").alias("rb"))
        nxt = cur.join(ra, "ca", "left").join(rb, "cb", "left").select("a", "b", "w", F.coalesce("ra", "ca").alias("ca"), F.coalesce("rb", "cb").alias("cb"))
        cur = cut(nxt.filter("ca <> cb"))
    out = e.filter("false").select("a", "b", "w")
    for c in chosen:
        out = out.unionByName(c.select("a", "b", "w"))
    return out.distinct()


def heap_order(rows: DataFrame, index: str = "idx") -> DataFrame:
    """(idx, rank): post-order places of the nodes of a heap-numbered binary
    tree (children 2i+1, 2i+2), from the path of each node alone."""
    depth = F.floor(F.log2(F.col(index) + 1)).cast("int")
    bits = F.expr(f"lpad(conv(cast({index} + 1 as string), 10, 2), 64, '0')")
    turns = F.substr(bits, F.lit(65) - depth, depth)
    # A node comes after all below it: its path ends with a sign above both turns.
    path = F.concat(F.when(depth > 0, turns).otherwise(F.lit("")), F.lit("2"))
    out = ordered.numbered(rows.select(index, path.alias("_path")), [F.col("_path")], "rank")
    return out.select(index, (F.col("rank") + 1).alias("rank"))
