import random

from pyspark.sql import functions as F

from annotara.operators import features, metrics, ordered, trees
from annotara.sources import payloads, readers


def test_numbers_and_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, rng.randrange(50)]), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, v int, w int").repartition(7)
    got = {r.id: r.n for r in ordered.numbered(df, [F.col("v"), F.col("id")], "n").collect()}
    assert got == {x[0]: i for i, x in enumerate(sorted(rows, key=lambda x: (x[1], x[0])))}
    at, want = 0, {}
    for x in sorted(rows, key=lambda x: (-x[1], x[0])):
        at += x[2]
        want[x[0]] = at
    assert {r.id: r.s for r in ordered.running(df, [F.desc("v"), F.col("id")], {"s": "w"}).collect()} == want
    assert ordered.numbered(df.limit(0), [F.col("v")], "n").count() == 0


def test_trees(spark):
    nodes = spark.createDataFrame([("a", ["b", "c"]), ("b", ["d"]), ("c", []), ("d", None)], "node string, kids array<string>")
    edges = trees.from_children(nodes, "node", "kids")
    listing = trees.preorder(edges)
    assert [r.node for r in listing.orderBy("root", "path").collect()] == ["a", "b", "d", "c"]
    assert {r.node for r in trees.search(listing, F.col("node").isin("b", "d", "c"), True).collect()} == {"b", "c"}
    m = {r.id: r.parent for r in trees.merge_pairs(spark.range(5), "id").collect()}
    assert m == {0: 5, 1: 5, 2: 6, 3: 6, 4: 7, 5: 8, 6: 8, 7: 9, 8: 10, 9: 10, 10: None}
    assert trees.batches(spark.range(7), "id", 3).groupBy("batch").count().count() == 3


def test_silhouette_and_features(spark):
    p = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (1, 3, 4.0), (3, 1, 4.0), (2, 3, 2.0), (3, 2, 2.0)], "i int, j int, d double")
    lab = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id int, label int")
    assert {r.id: r.s for r in metrics.silhouette(p, lab).collect()} == {1: 0.75, 2: 0.5, 3: 0.0}
    e = spark.createDataFrame([(1, 2, "x"), (0, 1, "y")], "head int, dep int, rel string")
    assert features.orient(e).count() == 4 and {r.rel: r.code for r in features.dependency_codes(e).collect()} == {"x": 1, "y": 2}
    toks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc int, pos int, term string")
    near = spark.createDataFrame([("b", 0, "bb"), ("b", 1, "bbb")], "term string, rank int, word string")
    assert features.enriched(toks, near).first().text == "a b bb bbb"


def test_more_sources(spark):
    x = spark.createDataFrame([('<M><Sample iid="S1"><Title>t</Title><Type>RNA</Type><Platform-Ref ref="P"/><Channel><Organism>o</Organism><Characteristics tag="tissue">liver</Characteristics></Channel><Internal-Data>a\t1\nb\t</Internal-Data></Sample></M>',)], "value string")
    s = readers.sample_rows(x).first()
    assert (s.id, s.platform, s.tissue, s.data) == ("S1", "P", "liver", [["a", "1"], ["b", "0"]])
    d = readers.database_info(spark.createDataFrame([("<r><DbInfo><DbName>n</DbName><Count>5</Count><LastUpdate>u</LastUpdate></DbInfo></r>",)], "value string")).first()
    assert tuple(d) == ("n", 5, "u")
    sp = payloads.span_lists(spark.createDataFrame([(1, "C1", "1^8;20/3", 10)], "d int, i string, p string, o int"), "d", "i", "p", "o").collect()
    assert {(r.start, r.end) for r in sp} == {(10, 18), (29, 32)}
    body = '{"1": {"OFFICIAL_SYMBOL_A": "a", "OFFICIAL_SYMBOL_B": "b", "ORGANISM_A": 9606, "ORGANISM_B": 9606}, "2": {"OFFICIAL_SYMBOL_A": "a", "OFFICIAL_SYMBOL_B": "c", "ORGANISM_A": 9606, "ORGANISM_B": 1}}'
    assert [tuple(r) for r in payloads.interactions(spark.createDataFrame([(body,)], "b string"), "b", [9606]).collect()] == [("a", "b", 1)]
    soft = spark.createDataFrame([("^SERIES = G1", "p", 0), ("!title = T = 1", "p", 1), ("^SAMPLE = S", "p", 2), ("!title = U", "p", 3)], "value string, path string, pos int")
    assert {(r.entity, r.name, r.key, r.value) for r in readers.soft_rows(soft).collect()} == {("series", "G1", "title", "T = 1"), ("sample", "S", "title", "U")}
    g = readers.genes(spark.createDataFrame([("<Entrezgene><Gene-track><Gene-track_geneid>7</Gene-track_geneid></Gene-track><Gene-ref><Gene-ref_locus>L</Gene-ref_locus><Gene-ref_syn><Gene-ref_syn_E>x</Gene-ref_syn_E></Gene-ref_syn></Gene-ref><OrgName_lineage>A; B</OrgName_lineage></Entrezgene>",)], "value string")).first()
    assert (g.id, g.symbol, g.synonyms, g.lineage) == ("7", "L", ["x"], ["A", "B"])
