from pyspark.sql import functions as F

import __spark_entry__ as entry
from annotara.operators import annotate
from annotara.session import table


def test_every_token_of_three_characters_is_aligned(spark, data):
    toks = annotate.spans_of_tokens(table(spark, data, "documents"), "doc_id", "text")
    want = {(r.doc, r.i) for r in toks.filter(F.length("str") >= 3).collect()}
    got = {(r.doc, r.annot) for r in entry.queries()["annotation_alignment"](spark, data).collect()}
    assert got == want


def test_brackets_go_from_texts_of_any_length(spark, data):
    rows = entry.queries()["drop_bracketed"](spark, data).collect()
    assert len(rows) == table(spark, data, "documents").count() and max(len(r.v or "") for r in rows) > 200


def test_against_brute_force_with_a_tolerance(spark):
    import random

    rng = random.Random(3)
    toks, annots = [], []
    for doc in range(6):
        at = 0
        for i in range(25):
            at += rng.randrange(4)
            end = at + rng.randrange(1, 6)
            toks.append((doc, i, "x", at, end))
            at = end
        annots += [(doc, n, s, s + rng.randrange(1, 15)) for n, s in enumerate(rng.randrange(0, 110) for _ in range(30))]
    a = spark.createDataFrame([*annots, annots[0]], "doc int, annot int, start int, end int")
    t = spark.createDataFrame([*toks, (9, 0, "x", 0, 3)], "doc int, i int, str string, start int, end int")
    for error in (0, 1, 3):
        want = set()
        for doc, n, s, e in annots:
            own = [x for x in toks if x[0] == doc]
            first = next((i for _, i, _, ts, te in own if abs(ts - s) <= error or ts < s < te), None)
            if first is not None:
                last = next((i for _, i, _, ts, te in own if i >= first and (abs(te - e) <= error or e < te)), own[-1][1])
                want |= {(doc, n, i) for i in range(first, last + 1)}
        got = [(r.doc, r.annot, r.i) for r in annotate.align(a, t, error).collect()]
        assert set(got) == want and len(got) == len(want)
    assert annotate.align(a.limit(0), t).count() == 0 and annotate.align(a, t.limit(0)).count() == 0
