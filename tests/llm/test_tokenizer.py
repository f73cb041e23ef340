import random

import pytest
import tiktoken

from annotara.llm import tokenizer as T

TEXTS = ["", " ", "\n\n \t x", "Hello world, it's 2024!!", "naïve café — “quoted”", "老齢マウス の抗体。", "ยังไม่ทราบ", "👩‍🔬🙂", "<|endoftext|> is text", "a" * 5000, "thathprilurea " * 50, "\u0000\u0001é́"]


@pytest.fixture(scope="module")
def pair():
    t = T.Transducer(T.read_vocab())
    return t, tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=t.rank, special_tokens={})


def test_same_as_library(pair):
    t, lib = pair
    for x in TEXTS:
        assert t.encode(x) == lib.encode_ordinary(x)
        assert T.decode(t, t.encode(x)) == x
    assert t.encode(None) == []


def test_small_tables_start_anew(pair, monkeypatch):
    t, lib = pair
    monkeypatch.setattr(T, "MAX_STATES", 50)
    monkeypatch.setattr(T, "MAX_PIECES", 10)
    for x in TEXTS:
        assert t.encode(x + " more words here") == lib.encode_ordinary(x + " more words here")


def test_streaming_decode():
    data = "aé€🙂z".encode()
    for cut in range(len(data)):
        u = T.Utf8()
        assert u.feed(data[:cut]) + u.feed(data[cut:]) + u.end() == "aé€🙂z"
    for bad in (b"\xff", b"\xe2\x82", b"\xed\xa0\x80", b"\xc0\xaf", b"a\xf0\x9f\x98"):
        u = T.Utf8()
        assert u.feed(bad) + u.end() == bad.decode("utf-8", "replace")


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (3, "hi", "x")], "doc_id bigint, text string, ids string")
    got = {(r.doc_id, tuple(r.ids)) for r in T.encode(df, "doc_id", "text").collect()}
    assert (1, ()) in got and (2, ()) in got and len(got) == 4
    assert {(r.doc_id, r.size) for r in T.lengths(df, "doc_id", "text").collect()} >= {(1, 0), (2, 0)}
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0


def test_tokens_come_after_a_bounded_lookahead(pair):
    t, lib = pair
    text = ("thathprilurea" * 77_000 + "abababab")[:1_000_000]
    read = 0

    def fed():
        nonlocal read
        for b in text.encode():
            read += 1
            yield b

    ids, behind, given = [], 0, 0
    for i in t.stream(fed()):
        ids.append(i)
        given += t.size[i]
        behind = max(behind, read - given)
    assert behind <= 2 * T.LOOK  # never more than a short end is held
    assert b"".join(t.bytes[i] for i in ids).decode() == text
    assert ids[:1000] == lib.encode_ordinary(text[:6000])[:1000]


def test_random_pieces_and_bounded_pairs(pair, monkeypatch):
    t, lib = pair
    monkeypatch.setattr(T, "MAX_PAIRS", 20)
    t.pairs.clear()
    rng, toks = random.Random(0), list(t.rank)
    for _ in range(500):
        piece = b"".join(rng.choice(toks) for _ in range(rng.randrange(1, 9)))
        assert list(t.run(piece)) == lib._encode_single_piece(piece)
        assert len(t.pairs) <= 20
