import pytest
from pyspark.sql import functions as F

from annotara import session
from annotara.operators import language as L


def test_tokens_and_sentences(spark):
    texts = ['He said "no," and didn\'t go.', "Mean 3.5 mg (n = 12). It rose! Did it?", "", " ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(L.treebank_tokens(F.col("t"))).collect()]
    assert got[0] == ["He", "said", "``", "no", ",", "''", "and", "did", "n't", "go", "."]
    assert got[2] == got[3] == [] and got[4] is None
    assert df.select(L.sentence_list(F.col("t"))).collect()[1][0] == ["Mean 3.5 mg (n = 12).", "It rose!", "Did it?"]
    assert df.select(L.word_tokens(F.col("t"))).collect()[1][0][-2:] == ["it", "?"]


def test_lemmas_take_the_first_form_known(spark):
    toks = spark.createDataFrame([(1, i, w) for i, w in enumerate(["cells", "boxes", "bodies", "wolves", "gas", "zzs", "cells"])], "doc int, pos int, term string")
    known = spark.createDataFrame([(w,) for w in ["cell", "box", "body", "wolf", "gas", "ga"]], "word string")
    got = {r.pos: r.lemma for r in L.lemmas(toks, known).collect()}
    assert got == {0: "cell", 1: "box", 2: "body", 3: "wolf", 4: "gas", 5: "zzs", 6: "cell"}
    assert L.lemmas(toks.limit(0), known).count() == 0


def test_label_hits_anywhere_in_a_label(spark):
    toks = spark.createDataFrame([("Kin",), ("ase b",), ("",), (None,), ("kin",)], "token string")
    labels = spark.createDataFrame([("1", "Some kinase B"), ("2", "akin"), ("3", None), ("4", "x")], "id string, label string")
    assert sorted((r.token, r.id) for r in L.label_hits(toks, labels).collect()) == [("Kin", "1"), ("Kin", "2"), ("ase b", "1"), ("kin", "1"), ("kin", "2")]


def test_a_cluster_must_name_its_shared_folder():
    class Set:
        @staticmethod
        def isDefined():
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: Set)}))})

        @staticmethod
        def getConf():
            return {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(type("Session", (), {"sparkContext": Context}))


def test_sentence_alignment_moves_nothing(spark, data):
    """Tokens and annotations of a document went through nine shuffles."""
    import __spark_entry__ as entry

    plan = entry.queries()["sentence_alignment"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_lists_are_aligned_as_places_are(spark):
    import random

    from annotara.operators import annotate, language

    rng, toks, annots = random.Random(8), [], []
    for doc in range(7):
        at = 0
        for i in range(24):
            at += rng.randrange(4)
            toks.append((doc, i // 5, i % 5, at, at := at + rng.randrange(1, 6)))
        annots += [(doc, n // 4, n % 4, s, s + rng.randrange(1, 15)) for n, s in enumerate(rng.randrange(0, 110) for _ in range(20))]
    kinds = "doc int, sent int, i int, start int, end int"
    a, t = spark.createDataFrame([*annots, (8, 0, 0, 1, 2)], kinds), spark.createDataFrame([*toks, (9, 0, 0, 0, 3)], kinds)
    flat = lambda x, by, c: x.selectExpr("doc", f"sent * {by} + i as {c}", "start", "end")
    for error in (0, 2):
        want = sorted((r.doc, r.annot, r.i) for r in annotate.align(flat(a, 4, "annot"), flat(t, 5, "i"), error).collect())
        got = sorted((r.doc, r.asent * 4 + r.annot, r.tsent * 5 + r.tok) for r in language.align_lists(a, t, error).collect())
        assert got == want and got
    assert language.align_lists(a.limit(0), t).count() == 0 and language.align_lists(a, t.limit(0)).count() == 0
