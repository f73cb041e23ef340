import math
from collections import defaultdict

import pytest

from annotara.operators import features, metrics, similarity

DOCS = {1: ({"a", "b"}, {"x"}), 2: ({"a"}, {"x", "y"}), 3: ({"b", "c"}, set()), 4: (set(), {"z"}), 5: ({"c"}, {"z"}), 6: ({"a", "c"}, {"x"})}


@pytest.fixture(scope="module")
def frames(spark):
    terms = spark.createDataFrame([(d, t) for d, (ts, _) in DOCS.items() for t in ts], "doc int, term string")
    labels = spark.createDataFrame([(d, y) for d, (_, ys) in DOCS.items() for y in ys], "doc int, label string")
    return terms, labels


def dense():
    out = {}
    for t in "abc":
        for y in "xyz":
            cell = defaultdict(int)
            for ts, ys in DOCS.values():
                cell[t in ts, y in ys] += 1
            out[t, y] = (cell[True, True], cell[True, False], cell[False, True], cell[False, False])
    return out


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_pairs_that_never_meet_count(frames, monkeypatch, block):
    monkeypatch.setattr(features, "LABEL_BLOCK", block)
    got = {(r.term, r.label): (r.n11, r.n10, r.n01, r.n00) for r in features.contingency(*frames, len(DOCS)).collect()}
    assert got == dense()
    gss = {r.term: r.score for r in features.summed_scores(*frames, len(DOCS), "gss").collect()}
    assert gss == {t: sum(a * e - b * c for (u, _), (a, b, c, e) in dense().items() if u == t) for t in "abc"}


@pytest.mark.parametrize("how", list(features.SCORERS))
def test_sums_by_margins_equal_sums_over_rows(frames, how):
    slow = {r.term: r.score for r in features.scores(features.contingency(*frames, len(DOCS)), how).collect()}
    fast = {r.term: r.score for r in features.summed_scores(*frames, len(DOCS), how).collect()}
    assert slow.keys() == fast.keys() and all(math.isclose(slow[t], fast[t], abs_tol=1e-9) for t in slow)


def test_empty_tables(frames):
    terms, labels = frames
    assert features.contingency(terms.limit(0), labels, 0).count() == 0
    assert features.contingency(terms, labels.limit(0), 6).count() == 0
    assert features.summed_scores(terms, labels.limit(0), 6, "gss").count() == 0


def test_hot_keys_are_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(similarity, "KEY_ROWS", 3)
    rows = [(d, "hot", d + 1) for d in range(20)] + [(d, f"f{d % 7}", 2 * d + 1) for d in range(20)]
    df = spark.createDataFrame(rows, "doc int, feat string, val int")
    want = defaultdict(float)
    for d, f, v in rows:
        for e, g, w in rows:
            if f == g and d < e:
                want[d, e] += v * w
    assert {(r.i, r.j): r.s for r in similarity.dot_products(df).collect()} == want
    pairs = {(r.a, r.b): r.r for r in similarity.correlations(df, 20).collect()}
    assert len(pairs) == 8 * 7 // 2 and all(-1.0 <= v <= 1.0 for v in pairs.values())


def test_adjusted_mutual_information(spark):
    rows = lambda x: spark.createDataFrame(x, "c string, k string, n double")
    ami = lambda x: metrics.adjusted_mutual_info(rows(x)).first()[0]
    assert math.isclose(ami([("a", "1", 5.0), ("b", "2", 5.0)]), 1.0, abs_tol=1e-9)
    assert ami([("a", "1", 7.0)]) == 1.0
    assert abs(ami([("a", "1", 500.0), ("a", "2", 500.0), ("b", "1", 500.0), ("b", "2", 500.0)])) < 0.01


def test_adjusted_mutual_information_of_many_rows(spark):
    """Millions of terms: each was interpreted, with 36 logarithms, which took minutes."""
    import time
    from math import exp, lgamma, log

    cells = {("a", "1"): 900, ("a", "2"): 700, ("b", "1"): 650, ("b", "2"): 800}
    for times in (1, 5000):
        rows = [(c, k, float(v * times)) for (c, k), v in cells.items()]
        began = time.time()
        got = metrics.adjusted_mutual_info(spark.createDataFrame(rows, "c string, k string, n double")).first()[0]
        took = time.time() - began
        n = sum(r[2] for r in rows)
        at = lambda i, v: sum(r[2] for r in rows if r[i] == v)
        h = lambda i: -sum(at(i, v) / n * log(at(i, v) / n) for v in {r[i] for r in rows})
        mi, e = sum(v / n * log(v * n / (at(0, c) * at(1, k))) for c, k, v in rows), 0.0
        if times == 1:
            for a in (at(0, "a"), at(0, "b")):
                for b in (at(1, "1"), at(1, "2")):
                    for x in range(int(max(1, a + b - n)), int(min(a, b)) + 1):
                        odds = sum(lgamma(v + 1) for v in (a, b, n - a, n - b)) - sum(lgamma(v + 1) for v in (n, x, a - x, b - x, n - a - b + x))
                        e += x / n * log(n * x / (a * b)) * exp(odds)
            assert math.isclose(got, (mi - e) / ((h(0) + h(1)) / 2 - e), rel_tol=1e-7)
        else:
            assert math.isclose(got, (mi - 0.5 / n) / ((h(0) + h(1)) / 2 - 0.5 / n), rel_tol=1e-5) and took < 60
