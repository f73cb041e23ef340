import duckdb

import __spark_entry__ as entry
from annotara.operators import annotate


def test_ids_and_lengths(spark):
    d = spark.createDataFrame([(1, "Foo bar  baz qux, foo")], "id bigint, text string")
    terms = spark.createDataFrame([("x", "foo bar"), ("y", "Foo  Bar"), ("x", "foo bar"), ("z", "foo"), ("w", "bar baz qux")], "id string, term string")
    hit = annotate.match_dictionary(d, "id", "text", terms)
    assert {(r.id, r.start, r.end, r.text) for r in hit.collect()} == {("x", 0, 7, "Foo bar"), ("y", 0, 7, "Foo bar"), ("w", 4, 16, "bar  baz qux"), ("z", 18, 21, "foo")}
    assert hit.count() == 4


def test_whole_labels_are_matched(spark, data):
    """Against a plain search of every label in every text."""
    labels: dict[str, set[str]] = {}
    for i, lb in duckdb.sql(f"select node_id, trim(lb) from '{data}/concepts.parquet' where trim(lb) <> ''").fetchall():
        labels.setdefault(" ".join(lb.lower().split()), set()).add(i)
    longest, want = max(len(x.split()) for x in labels), []
    for tbl, sql in (("documents", f"select doc_id, text from '{data}/documents.parquet'"), ("triples", f"select null, o from '{data}/triples.parquet' where o_is_literal")):
        for k, t in duckdb.sql(sql).fetchall():
            places = annotate._word_places(t or "")
            for x in range(len(places)):
                got = [y for y in range(x, min(x + longest, len(places))) if " ".join(w[0].lower() for w in places[x : y + 1]) in labels]
                if got:
                    a, b = places[x][1], places[got[-1]][2]
                    want += [(tbl, k, i, a, b, t[a:b]) for i in labels[" ".join(w[0].lower() for w in places[x : got[-1] + 1])]]
    rows = entry.queries()["dictionary_match"](spark, data).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.tbl, r.doc, r.id, r.start, r.end, r.text) for r in rows), key=key) == sorted(want, key=key)
    assert any(" " in r.text for r in rows)
