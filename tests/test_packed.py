from annotara.operators import packed as P

WORDS = ["alpha", "beta two", "3,8-gamma", "D/E ratio", "ep; silon"]


def test_split_field():
    assert P.split_field('"a; b"; c;; d ;', (";",), True) == ["a; b", "c", "d"]
    assert P.split_field('"the ""X"" allele, Y", z', (",",), True) == ['the "X" allele, Y', "z"]
    assert P.split_field("a\\, b;c", (",", ";"), True) == ["a, b", "c"]
    assert P.split_field("'x", (";",), True) == ["'x"]
    assert P.split_field(" ; ;", (";",), True) == []


def test_keyword_paragraphs():
    text = "Keywords: not, these\nA sentence.\nKey words = a; b.\nKEYWORDS: c\n"
    assert P.keyword_paragraphs(text) == ["a; b", "c"]
    assert P.keyword_paragraphs("Keywords were set by hand.") == [] and P.keyword_paragraphs(None) == []


def test_cheapest_dialect(spark):
    rows = []
    for i in range(60):
        w = [WORDS[(i + j) % 5] for j in range(3)]
        q = [f'"{x}"' if ";" in x else x for x in w]
        rows.append((i, "k", 0, "; ".join(q)))
        rows.append((i, "k", 1, " | ".join(w)))
        rows.append((i, "k", 2, WORDS[i % 5]))
    rows += [(100, "k", 0, None), (100, "k", 1, " "), (101, "k", 0, "alpha ;"), (102, "k", 0, "alpha\t" + "beta two"), (0, "j", 0, "alpha")]
    df = spark.createDataFrame(rows, "row_no bigint, src string, nth int, field string")
    got = {}
    for r in P.unpack(df, ["row_no", "src"]).orderBy("row_no", "src", "pos").collect():
        got.setdefault((r.row_no, r.src), []).append(r.val)
    for i in range(60):
        w = [WORDS[(i + j) % 5] for j in range(3)]
        assert got[(i, "k")] == [*w, *w, WORDS[i % 5]]
    assert (100, "k") not in got and got[(101, "k")] == ["alpha"] and got[(102, "k")] == ["alpha", "beta two"] and got[(0, "j")] == ["alpha"]
    assert P.unpack(df.limit(0), ["row_no", "src"]).count() == 0


def test_very_long_field(spark):
    long = ";".join(["alpha", "beta two"] * 3000)
    df = spark.createDataFrame([(1, "k", 0, long), (2, "k", 0, "alpha"), (3, "k", 0, "beta two")], "row_no bigint, src string, nth int, field string")
    assert P.unpack(df, ["row_no", "src"]).filter("row_no = 1").count() == 6000


def test_three_delimiters_and_hot_values(spark):
    words = ["alpha", "beta two", "gamma", "delta", "epsilon"]
    rows = [(i, "k", 0, words[i % 5]) for i in range(50)] + [(i, "k", 1, f"{words[i % 5]}; {words[(i + 1) % 5]}") for i in range(50)]
    rows += [(i, "k", 2, f"{words[(i + 2) % 5]} | {words[i % 5]}, {words[(i + 3) % 5]}") for i in range(50)]
    rows += [(1000 + i, "k", 0, "alpha") for i in range(200)]
    rows += [(100, "k", 0, "delta; alpha | gamma, beta two"), (101, "k", 0, "beta two; delta | alpha, gamma\tepsilon")]
    df = spark.createDataFrame(rows, "row_no bigint, src string, nth int, field string")
    got = {}
    for r in P.unpack(df, ["row_no", "src"]).orderBy("row_no", "pos").collect():
        got.setdefault(r.row_no, []).append(r.val)
    assert got[100] == ["delta", "alpha", "gamma", "beta two"]
    assert got[101] == ["beta two", "delta", "alpha", "gamma", "epsilon"]
    assert all(got[1000 + i] == ["alpha"] for i in range(200)) and len(got) == 252


def test_plain_split_equals_the_walk(monkeypatch):
    text = " a;; b ,c|d ; e , "
    for d in ((), (";",), (",", ";"), (";;", ","), ("|", ";", ",")):
        plain = P.split_field(text, d, False)
        assert plain == P.split_field(text, d, True)
