import json

from annotara.operators import nested as N

A, W = frozenset(N.OMIM_ARRAYS), frozenset(N.OMIM_WRAPPERS)


def test_triples_keep_positions():
    text = json.dumps({"omim": {"entryList": [None, {"entry": {"mimNumber": 7, "referenceList": {"reference": {"pubmedID": "9"}}}}, {"mimNumber": "8"}]}})
    got = list(N.triples(text, A, W))
    assert ("entryList[]", (1,), None) in got and ("entryList[].mimNumber", (1,), "7") in got
    assert ("entryList[].referenceList[].pubmedID", (1, 0), "9") in got
    assert ("entryList[].mimNumber", (2,), "8") in got


def test_array_as_text_escapes_and_broken():
    inner = json.dumps([{"mimNumber": 'a"é\n'}])
    got = list(N.triples(json.dumps({"entryList": inner}), A, W))
    assert ("entryList[].mimNumber", (0,), 'a"é\n') in got
    assert list(N.triples(None, A, W)) == [] and list(N.triples("", A, W)) == []
    assert ("entryList[].mimNumber", (0,), "1") in list(N.triples('{"entryList": [{"mimNumber": 1}, {"mim', A, W))
    assert list(N.triples('{"omim": null}', A, W)) == []


def test_flat_records(spark, data):
    schema = "row_no bigint, extra string, passages array<struct<offset:int,infons:struct<section_type:string>,annotations:array<struct<id:string,infons:struct<concept:string>>>>>"
    bioc = spark.createDataFrame([(1, "x", [None, (5, None, [(None, None), None, ("q", ("C",))])]), (2, "x", None), (3, "x", []), (1, "x", None)], schema)
    omim = spark.createDataFrame([(9, '{"omim": {"referenceLists": {"referenceList": [null, {"pubmedID": null}]}}}', "z"), (10, None, "z")], "response_id bigint, omim string, kind string")
    got = {tuple(r) for r in N.flat_records(omim, bioc).collect()}
    assert got == {("list_ref", 9, 0, 1, ""), ("passage", 1, 1, -1, "5"), ("annotation", 1, 1, 0, ""), ("annotation", 1, 1, 2, "C")}
    assert N.flat_records(omim.limit(0), bioc.limit(0)).count() == 0


def test_deep_and_long():
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    assert len(list(N.triples(deep, A, W))) == 1
    many = json.dumps({"entryList": [{"mimNumber": i} for i in range(20000)]})
    assert sum(p == "entryList[].mimNumber" for p, _, _ in N.triples(many, A, W)) == 20000


def test_tables_from_the_paths(spark):
    body = '{"a": 1, "rows": [{"x": "p", "in": {"y": 2, "tags": ["s", null, "t"]}}, null, {"x": null, "subs": [{"z": 3}, {}]}], "a": 0}'
    df = spark.createDataFrame([(7, body, "clash"), (8, None, None), (9, "", "x"), (10, "[", "x"), (11, '{"rows": {"x": "lone"}}', "x")], "id bigint, body string, path string")
    got = {(r.tbl, r.rec_id, tuple(r.ordinals)): (None if r.parent is None else tuple(r.parent), dict(r.fields)) for r in N.derive(N.shred(df, "id", "body", None, ["rows"], [])).collect()}
    assert got == {
        ("", 7, ()): (None, {"a": "1"}),
        ("rows[]", 7, (0,)): ((), {"x": "p", "in.y": "2"}),
        ("rows[].in.tags[]", 7, (0, 0)): ((0,), {"": "s"}),
        ("rows[].in.tags[]", 7, (0, 2)): ((0,), {"": "t"}),
        ("rows[]", 7, (2,)): ((), {}),
        ("rows[].subs[]", 7, (2, 0)): ((2,), {"z": "3"}),
        ("rows[].subs[]", 7, (2, 1)): ((2,), {}),
        ("rows[]", 11, (0,)): ((), {"x": "lone"}),
    }
    assert N.derive(N.shred(df.limit(0), "id", "body", None, ["rows"], [])).count() == 0
