import random
from collections import defaultdict

import numpy as np

from annotara.llm import spans as S


def brute(docs, n):
    where = defaultdict(set)
    for k, t in docs:
        for i in range(len(t or "") - n + 1):
            where[t[i : i + n]].add(k)
    out = set()
    for k, t in docs:
        s = e = None
        for i in range(len(t or "") - n + 1):
            if len(where[t[i : i + n]]) > 1:
                if s is None:
                    s, e = i, i + n
                elif i <= e:
                    e = i + n
                else:
                    out.add((k, s, e))
                    s, e = i, i + n
        if s is not None:
            out.add((k, s, e))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdé 日🙂") for _ in range(n))
    shared = [word(m) for m in (39, 40, 41, 90, 200)]
    docs = [(i, word(rng.randrange(80)) + rng.choice(shared) + word(rng.randrange(50)) + rng.choice(shared)) for i in range(60)]
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, "a" * 300), (103, "a" * 120), (104, None), (105, ""), (106, shared[3] + shared[4] + word(10) + shared[3])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, tid int")
    got = {tuple(r) for r in S.shared_spans(df, "doc_id", "text", span=40, phrase=24).collect()}
    assert got == brute(docs, 40)
    share = {r.doc_id: r for r in S.shared_share(df, "doc_id", "text", S.shared_spans(df, "doc_id", "text", span=40, phrase=24)).collect()}
    assert share[100].share == 1.0 and share[104].n_chars == 0 and len(share) == len(docs)
    assert S.shared_spans(df.limit(0), "doc_id", "text").count() == 0


def _small():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [word(m) for m in (60, 120, 700)]
    return [(i, word(rng.randrange(200)) + rng.choice(shared) + word(rng.randrange(50)) + shared[2][: rng.randrange(700)]) for i in range(50)]


def test_hot_shards_and_routed_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "ROUTE", 64)
    monkeypatch.setattr(S, "SHARD_PHRASES", 5)
    monkeypatch.setattr(S, "TASK_CHARS", 500)
    docs = _small()
    got = S.shared_spans(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", span=40, phrase=24)
    assert {tuple(r) for r in got.collect()} == brute(docs, 40)


def test_the_automaton_decides():
    text = "the passage that stands in both of them " * 3
    codes = S.code_points(text)
    h, m = S.least(codes, 40, 24)
    places = np.flatnonzero(np.isin(h, m))
    every = list(S.segments(codes, places, 40, 24, S.ROUTE))
    assert min(x for x, _, _ in every) == 0 and max(y for _, y, _ in every) == len(text)
    assert list(S.segments(codes, places[:0], 40, 24, S.ROUTE)) == []
    fewer = list(S.segments(codes, places[places < 30], 40, 24, S.ROUTE))
    assert max(y for _, y, _ in fewer) < len(text)


def test_blocks_cover_each_window_once(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 100)
    x = np.arange(1234, dtype=np.uint32)
    starts = [at + i for at, c in S.blocks(x, 40) for i in range(len(c) - 39)]
    assert starts == list(range(1234 - 39))


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 50, 97).astype(np.uint64)
    for w in (1, 2, 7, 97):
        assert S.slide(x, w, np.minimum, 1 << 63).tolist() == [x[i : i + w].min() for i in range(97 - w + 1)]
