import gzip
import json

import numpy as np
from pyspark.sql import functions as F

from annotara.sources import payloads, readers, sinks
from annotara.streaming import windows

ARTICLE = """<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText></Abstract></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D1">M</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>"""


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_text_and_json(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("")
    got = {r.path[-5:]: (r.n, r.first, r["last"]) for r in readers.first_last_lines(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == (2, "one", "two")
    (tmp_path / "j.json").write_text('{"k": [{"x": 1}, {"x": 2}, {"x": 3}]}')
    assert [r.x for r in readers.read_json_array(spark, str(tmp_path / "j.json"), "k", "x int", 1, 1).collect()] == [2]
    assert readers.repair_json_text('{"a": "x "y" z"}') == '{"a": "x \\"y\\" z"}'
    assert rows(spark, '{"a": "x "y" z"}', None).select(readers.repair_json(F.col("value")).alias("v")).filter("v is not null").count() == 1
    (tmp_path / "c.csv").write_text("a,b\n1,2\n3,4\n5,6\n")
    assert [r.a for r in readers.read_csv(spark, str(tmp_path / "c.csv"), 1, 1).collect()] == ["3"]


def test_xml(spark, tmp_path):
    a = readers.articles(rows(spark, ARTICLE)).first()
    assert (a.pmid, a.title, a.abs, a.mesh[0].ui) == ("12", "T", "a\nb", "D1")
    with gzip.open(tmp_path / "x.xml.gz", "wt") as f:
        f.write(f"<PubmedArticleSet>{ARTICLE}{ARTICLE}</PubmedArticleSet>")
    assert readers.read_articles(spark, str(tmp_path / "x.xml.gz")).count() == 2
    fields = {r.field: r.text for r in readers.article_fields(readers.articles(rows(spark, ARTICLE))).collect()}
    assert fields["mesh"] == "D1:M"
    s = readers.series_rows(rows(spark, '<M><Series iid="G1"><Title>t</Title><Summary>\nText.\nKeywords: a, b\n</Summary></Series></M>')).first()
    assert (s.id, s.summary, s.keywords) == ("G1", "Text.", ["a, b"])
    d = readers.drugs(rows(spark, "<r><drugGroup><name>n</name><conceptGroup><tty>X</tty><conceptProperties><rxcui>1</rxcui><name>d</name></conceptProperties></conceptGroup></drugGroup></r>")).first()
    assert (d.name, d.tty, d.rxcui, d.drug) == ("n", "X", "1", "d")


def test_tool_outputs(spark):
    b = readers.annotator_blocks(rows(spark, "r1\n01\tx\t0\t1\n02\ty\t2\t3\n\nr2\n")).collect()
    assert [(r.rec, r.id, r.end) for r in b] == [("r1", "HP_01", 1), ("r1", "HP_02", 3)]
    p = readers.piped_rows(rows(spark, "00|a|b", "x|y", "ERROR|z"), 4).collect()
    assert [r.cols for r in p] == [["00", "a", "b", " "], [" ", " ", "x", "y"]]
    t = readers.candidate_terms(rows(spark, "  861 Name (Other) [Type]", "  700 F [Finding]", "Phrase: x"))
    assert [r.term for r in t.collect()] == ["Name"]
    n = readers.ntriples(rows(spark, '<a:s> <a:p> "x"@en .', "<a:s> <a:p> <a:o> .", "# no", '<a:s> <a:p> "x"@en .'))
    assert {(r.o, r.o_lang, r.o_is_literal) for r in n.collect()} == {("x", "en", True), ("a:o", None, False)}


def test_npz_and_sinks(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 2.0), (2, 0, 3.0)], "row bigint, col bigint, val double")
    path = str(tmp_path / "m.npz")
    sinks.write_npz(cells, path, (3, 2))
    assert {tuple(r) for r in readers.read_npz(spark, path).collect()} == {(0, 1, 2.0), (2, 0, 3.0)}
    np.savez(tmp_path / "d.npz", data=np.array([[0, 5.0]]), col=np.array(["a", "b"]))
    assert [tuple(r) for r in readers.read_npz(spark, str(tmp_path / "d.npz")).collect()] == [(0, 1, 5.0)]
    assert readers.npz_names(str(tmp_path / "d.npz")) == {"col": ["a", "b"]}
    sinks.write_json(cells, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_payloads(spark):
    body = '[{"annotatedClass": {"@id": "http://x/HP_1"}, "annotations": [{"from": 1, "to": 8, "matchType": "P", "text": "abc"}]}]'
    r = payloads.concept_json(spark.createDataFrame([(1, body), (2, None)], "d bigint, b string"), "d", "b").collect()
    assert [(x.id, x.start, x.end) for x in r] == [("HP_1", 0, 8)]
    e = payloads.entity_rows(spark.createDataFrame([(1, ["tumour|a:1:DISO;b:2:GENE|4"])], "d bigint, e array<string>"), "d", "e").collect()
    assert {(x.type, x.start, x.end) for x in e} == {("DISO", 4, 10), ("GENE", 4, 10)}
    h = payloads.html_spans(spark.createDataFrame([(1, 'a <span data-scigraph="X,HP:1">bc</span> d')], "d bigint, h string"), "d", "h").first()
    assert (h.mark, h.start, h.end, h.text) == ("X,HP:1", 2, 4, "bc")
    a = payloads.associations(spark.createDataFrame([('{"associations": [{"subject": {"id": "s"}, "object": {"id": "o"}, "evidence_graph": {"edges": [{"sub": "M1"}, {"sub": "M1"}, {"sub": "x"}]}}]}',)], "b string"), "b", "M").first()
    assert (a.subject, a.object, a.n) == ("s", "o", 1)


def test_streams(spark, data, tmp_path):
    src = str(tmp_path / "ev")
    ev = spark.read.parquet(f"{data}/events.parquet")
    ev.write.parquet(src)
    st = windows.event_stream(spark, src, ev.schema)
    windows.once(windows.tumbling(st, "ts", "1 hour", "1 day", "event_type"), "tumbled", str(tmp_path / "c1"), "complete")
    assert spark.sql("select sum(n) as n from tumbled").first().n == ev.count()
    windows.once(windows.sessions(st, "ts", "30 minutes", "1 day", "user_id"), "sess", str(tmp_path / "c2"))
    assert spark.sql("select count(*) as n from sess").first().n > 0
    windows.once(windows.deduplicated(st, "ts", "1 day", ["event_id"]), "dedup", str(tmp_path / "c3"))
    assert spark.sql("select count(*) as n from dedup").first().n == ev.select("event_id").distinct().count()


def test_array_objects_in_chunks_of_any_size():
    doc = '{"a": {"rows": 1}, "rows" : [{"x": "}]\\""}, {"y": {"z": [1, {"w": 2}]}} , {}], "b": [{"no": 1}]}'
    want = [{"x": '}]"'}, {"y": {"z": [1, {"w": 2}]}}, {}]
    for n in (1, 2, 7, 1000):
        chunks = [doc[i : i + n] for i in range(0, len(doc), n)]
        assert [json.loads(x) for x in readers.array_objects(chunks, "rows")] == want
    assert list(readers.array_objects(['{"rows": []}'], "rows")) == [] and list(readers.array_objects(["{}"], "rows")) == []
