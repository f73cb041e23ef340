import random

from pyspark.sql import functions as F

from annotara.operators import hierarchy as H


def brute(parent):
    out = {}
    nodes = set(parent) | set(parent.values())
    for x in nodes:
        seen, at = [], x
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        out[x] = (at, len(seen)) if at not in parent else (min(seen[seen.index(at) :]), -1)
    return out


def solve(spark, rows, **kw):
    df = spark.createDataFrame(rows, "node string, up string, link string, seg string, done string")
    return H.solve(H.links(df, "node", {"up": "up"}), **kw)


def test_random_forests_with_loops(spark):
    for seed, split in ((1, 2), (2, 5), (3, 1000)):
        rng = random.Random(seed)
        ids = [f"A:{i:04d}" for i in range(120)]
        parent = {x: rng.choice(ids[: i + 1]) if rng.random() < 0.85 else rng.choice(ids) for i, x in enumerate(ids) if rng.random() < 0.9}
        rows = [(k, v, "x", "y", "z") for k, v in parent.items()] + [(k, v, "x", "y", "z") for k, v in list(parent.items())[:10]]
        got = solve(spark, rows, with_path=True, split=split).collect()
        assert {r.node: (r.root, r.depth) for r in got} == brute(parent)
        assert len(got) == len({r.node for r in got})
        for r in got:
            if r.depth >= 0:
                assert r.path[0] == r.root and r.path[-1] == r.node and len(r.path) == r.depth + 1
                assert all(parent[b] == a for a, b in zip(r.path, r.path[1:]))
            else:
                assert r.path is None


def test_long_chain_and_descendants(spark):
    ids = [f"B:{i:04d}" for i in range(400)]
    rows = [(b, a, None, None, None) for a, b in zip(ids, ids[1:])]
    got = solve(spark, rows, with_path=True)
    assert got.agg(F.max("depth")).first()[0] == 399
    d = H.descendants(got)
    assert d.count() == 400 * 399 // 2
    assert d.filter(f"node = '{ids[0]}'").count() == 399


def test_nulls_notations_empty(spark):
    rows = [(None, "A:1", None, None, None), ("A:1", None, None, None, None), ("A:2", " ", None, None, None), (" a_3", "<http://x.y/obo/A_0>", None, None, None), ("A:4", "A:4", None, None, None)]
    got = {(r.node, r.root, r.depth) for r in solve(spark, rows).collect()}
    assert got == {("A:3", "A:0", 1), ("A:0", "A:0", 0), ("A:4", "A:4", -1)}
    assert solve(spark, []).count() == 0
