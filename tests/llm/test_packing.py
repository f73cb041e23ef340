import random
from collections import defaultdict

from annotara.llm import packing as P


def check(rows, sizes, caps):
    by = defaultdict(int)
    total = defaultdict(int)
    seen = set()
    for r in rows:
        by[(r.pack_name, r.bin_id)] += r.size
        total[(r.pack_name, r.doc_id)] += r.size
        assert (r.pack_name, r.doc_id, r.piece) not in seen
        seen.add((r.pack_name, r.doc_id, r.piece))
        if sizes[r.doc_id] <= caps[r.pack_name]:
            assert r.piece == 0
    assert all(v <= caps[k[0]] for k, v in by.items())
    assert all(total[(p, i)] == s for p in caps for i, s in sizes.items())
    assert {d for _, d, _ in seen} == set(sizes)
    return {p: sum(k[0] == p for k in by) for p in caps}


def test_packs(spark):
    rng = random.Random(3)
    sizes = {i: rng.choice([0, 5, 20, 33, 50, 64, 90, 250]) for i in range(700)}
    caps = {"a": 100, "b": 256}
    df = spark.createDataFrame([(k, v, "x") for k, v in sizes.items()], "doc_id bigint, size bigint, shard string")
    packs = spark.createDataFrame(list(caps.items()), "pack_name string, capacity int")
    for items in (10_000, 100):
        bins = check(P.pack(df, packs, items).collect(), sizes, caps)
        for p, c in caps.items():
            least = P.bound(c, [s % c for s in sizes.values() if s % c]) + sum(s // c for s in sizes.values())
            assert least <= bins[p] <= least * 1.08 + 2
    assert P.pack(df.limit(0), packs).count() == 0
    assert {r.size for r in P.pack(spark.createDataFrame([(1, None)], "doc_id bigint, size bigint"), packs).collect()} == {0}


def test_operators_keep_all_items():
    rng = random.Random(4)
    size = [rng.randrange(0, 60) for _ in range(200)]
    a = P.best_fit(100, size)
    b = P.mutate(a, size, rng)
    for x in (b, P.cross(a, b, size, rng)):
        assert sorted(i for its in x.bins for i in its) == list(range(200))
        assert all(sum(size[i] for i in its) == 100 - f and f >= 0 for its, f in zip(x.bins, x.free))
    assert P.evolve(100, [60, 60, 40, 40], 1) in ([0, 1, 0, 1], [0, 1, 1, 0])
    assert P.evolve(100, [0, 0], 1) == [0, 0] and P.evolve(100, [], 1) == []


def _triplets(m, cap, rng):
    """Sizes that fill m bins exactly, three to a bin."""
    out = []
    for _ in range(m):
        a = rng.randrange(380, 490)
        b = rng.randrange(250, (cap - a) // 2)
        out += [a, b, cap - a - b]
    rng.shuffle(out)
    return out


def test_the_genetic_algorithm_needs_fewer_bins_than_best_fit():
    rng = random.Random(1)
    for m in (20, 40, 130):
        size = _triplets(m, 1000, rng)
        plain, evolved = len(P.best_fit(1000, size).bins), len(set(P.evolve(1000, size, 1, P.POOL_GENERATIONS)))
        assert m <= evolved < plain and evolved - m <= max(1, 0.2 * (plain - m))
        assert len(set(P.evolve(1000, size, 1))) < plain


def _slow_bound(cap, sizes):
    best = -(-sum(sizes) // cap)
    for k in range(cap // 2 + 1):
        lone = [s for s in sizes if s > cap - k]
        mid = [s for s in sizes if 2 * s > cap and s <= cap - k]
        small = sum(s for s in sizes if k <= s and 2 * s <= cap)
        best = max(best, len(lone) + len(mid) + max(0, -(-(small - (len(mid) * cap - sum(mid))) // cap)))
    return best


def test_the_bound_takes_every_size_however_many():
    rng = random.Random(6)
    for n in (5, 40, 401, 900):
        size = [rng.choice([3, 20, 34, 51, 66, 90, 100]) for _ in range(n)]
        assert P.bound(100, size) == _slow_bound(100, size)
