from pyspark.sql import functions as F

from annotara.functions import stem
from annotara.functions import text as T
from annotara.operators import annotate, experiment, graph, metrics


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def arr(*x):
    return F.array(*[F.lit(v) for v in x])


def test_arrays(spark):
    assert one(spark, T.windows(arr("1", "2", "3"), 1, F.lit("0"))) == [["0", "1", "2"], ["1", "2", "3"], ["2", "3", "0"]]
    assert one(spark, T.align_lists(arr("a", "b", "c"), arr("c", "x", "a"))) == ["c", "a", "b"]
    assert one(spark, T.pad_list(arr("1", "2"), 4)) == ["1", "2", "", ""] and one(spark, T.pad_list(arr("1", "2"), 1)) == ["1"]
    assert sorted(map(tuple, one(spark, T.subsets(arr("a", "b"), 1)))) == [("a",), ("a", "b"), ("b",)]
    c = one(spark, T.context(arr("a", "b", "c", "d"), F.lit(1), F.lit(1)))
    assert c.left == ["a", "b"] and c.right == ["d", "c", "b"]
    assert one(spark, T.chunks(arr("a", "b", "c"), 2, F.lit("_"))) == [["a", "b"], ["c", "_"]]
    assert [one(spark, T.signed_label(F.lit(x))) for x in (0.7, -0.6, 0.2)] == [1, -1, 0]
    assert one(spark, T.drop_punctuation(arr("a", "()", "...", ""))) == ["a", "..."]
    m = one(spark, T.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))))
    assert m == {"a": 1, "b": 3}
    assert one(spark, T.sorted_entries(F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(1))))[0].key == "b"
    assert one(spark, T.index_gather(arr("a", "b", "c"), arr(2, 0))) == ["c", "a"]


def test_strings(spark):
    assert one(spark, T.query_clean(F.lit("++a?b|$"))) == "ab"
    assert one(spark, T.passage_clean(F.lit("nullnulla\tbéc"))) == "a b c" and one(spark, T.passage_clean(F.lit("ab"))) is None
    assert one(spark, T.nfc_clean(F.lit("éx"))) == " x"
    assert abs(one(spark, T.similarity(F.lit("abcd"), F.lit("bcde"))) - 0.75) < 1e-9


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "agreed": "agre", "happy": "happi", "sky": "sky", "controlling": "control", "generalization": "gener"}
    assert {w: stem.porter(w) for w in pairs} == pairs


def test_spans(spark):
    d = spark.createDataFrame([(1, "a bb  a bb"), (2, None), (3, "")], "id bigint, text string")
    s = annotate.spans_of_tokens(d, "id", "text").collect()
    assert [(r.str, r.start, r.end) for r in s] == [("a", 0, 1), ("bb", 2, 4), ("a", 6, 7), ("bb", 8, 10)]
    loc = annotate.locate_tokens(d, "id", "text").collect()
    assert [(r.start, r.end) for r in loc] == [(2, 4), (8, 10)]
    a = spark.createDataFrame([(1, "x", 5, 6)], "doc bigint, id string, start int, end int")
    b = spark.createDataFrame([(1, "p", 0, 5), (1, "q", 5, 9), (1, "r", 4, 6)], "doc bigint, id string, start int, end int")
    assert {r.b for r in annotate.overlapping(a, b).collect()} == {"q", "r"}
    toks = spark.createDataFrame([(1, i, "t", 3 * i, 3 * i + 2) for i in range(5)], "doc bigint, i int, str string, start int, end int")
    ann = spark.createDataFrame([(1, 0, 4, 8), (1, 1, 0, 2), (1, 2, 12, 99)], "doc bigint, annot int, start int, end int")
    got = {}
    for r in annotate.align(ann, toks).collect():
        got.setdefault(r.annot, set()).add(r.i)
    assert got == {0: {1, 2}, 1: {0}, 2: {4}}
    terms = spark.createDataFrame([(1, "bb a"), (2, "bb"), (3, None)], "id bigint, term string")
    hit = annotate.match_dictionary(d, "id", "text", terms).orderBy("start").collect()
    assert [(r.id, r.start, r.end) for r in hit] == [(1, 2, 7), (2, 8, 10)]


def test_graph(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (3, 8), (5, 9), (0, 6), (0, 7)], "a int, b int")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    v = spark.createDataFrame([(0,), (2,), (5,)], "id int")
    assert {(r.i, r.j, r.d) for r in graph.closure_among(both, v).collect()} == {(0, 2, 2), (2, 5, 3), (0, 5, 5)}
    more = e.unionByName(spark.createDataFrame([(20, 21)], "a int, b int"))
    comp = {r.id: r.root for r in graph.components(more).collect()}
    assert {comp[i] for i in range(10)} == {0} and comp[21] == 20
    w = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 3.0), (3, 4, 1.0)], "a int, b int, w double")
    assert {(r.a, r.b) for r in graph.minimum_forest(w).collect()} == {(1, 2), (2, 3), (3, 4)}
    heap = graph.heap_order(spark.range(7).select(F.col("id").alias("idx"))).orderBy("rank").collect()
    assert [r.idx for r in heap] == [3, 4, 1, 5, 6, 2, 0]
    assert graph.components(both.limit(0)).count() == 0


def test_roc_is_monotone(spark):
    p = spark.createDataFrame([(i % 3 == 0, float(i % 7)) for i in range(50)], "y boolean, s double").select(F.col("y").cast("int").alias("y"), "s")
    c = metrics.roc(p, "y", "s").orderBy(F.desc("threshold")).collect()
    assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(c, c[1:])) and c[-1].fpr == c[-1].tpr == 1.0
    assert experiment.split_sizes(10, 3) == [4, 3, 3]
