"""Row mappings of remote annotation services, over saved payloads.

No service is called: a connector reads what was fetched before (a column of
JSON, TSV or HTML) and maps it to annotation rows (doc, id, start, end, text).
Fetching is done elsewhere; ids already seen are left out by an anti join, and
input order and multiplicity come back by joining the ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unseen(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Distinct, non-blank ids that were not fetched yet."""
    fresh = ids.select(F.trim(F.col(key).cast("string")).alias(key)).filter(f"{key} is not null and {key} not in ('', '0')").distinct()
    return fresh.join(done.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_anti")


def in_input_order(ids: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """Fetched rows once per asked id, as often as it was asked."""
    return ids.join(fetched.dropDuplicates([key]), key, "left")


def concept_json(rows: DataFrame, doc: str, body: str) -> DataFrame:
    """Class annotations: id is the last part of the class's address, the span
    is (from - 1, to)."""
    s = "array<struct<annotatedClass: struct<`@id`: string>, annotations: array<struct<`from`: int, `to`: int, matchType: string, text: string>>>>"
    x = rows.select(F.col(doc).alias("doc"), F.explode(F.from_json(body, s)).alias("c"))
    y = x.select("doc", F.col("c.annotatedClass.`@id`").alias("url"), F.explode("c.annotations").alias("a"))
    return y.select("doc", F.substring_index("url", "/", -1).alias("id"), "url", (F.col("a.from") - 1).alias("start"), F.col("a.to").alias("end"), F.col("a.text").alias("text"), F.col("a.matchType").alias("mtype"))


def length_json(rows: DataFrame, doc: str, body: str) -> DataFrame:
    """Annotations with a start and a length, and whether they are negated."""
    s = "array<struct<id: string, start: int, length: int, text: string, negated: boolean>>"
    x = rows.select(F.col(doc).alias("doc"), F.explode(F.from_json(body, s)).alias("a"))
    return x.select("doc", "a.id", "a.start", (F.col("a.start") + F.col("a.length")).alias("end"), "a.text", F.coalesce("a.negated", F.lit(False)).alias("negated"))


def entity_rows(rows: DataFrame, doc: str, entities: str) -> DataFrame:
    """'word|uid;uid|offset' entities to (doc, type, id, start, end, text); the
    type is the last part of a uid 'source:code:type'."""
    x = rows.select(F.col(doc).alias("doc"), F.explode(entities).alias("e")).select("doc", F.split("e", r"\|").alias("p")).filter(F.size("p") >= 3)
    y = x.select("doc", F.element_at("p", 1).alias("text"), F.explode(F.split(F.element_at("p", 2), ";")).alias("id"), F.element_at("p", 3).cast("int").alias("start"))
    return y.select("doc", F.element_at(F.split("id", ":"), -1).alias("type"), "id", "start", (F.col("start") + F.length("text")).alias("end"), "text")


def associations(rows: DataFrame, body: str, prefix: str) -> DataFrame:
    """(subject, object, n): associations with the number of distinct pieces of
    evidence whose source begins with prefix."""
    s = "associations array<struct<subject: struct<id: string>, object: struct<id: string>, evidence_graph: struct<edges: array<struct<sub: string>>>>>"
    x = rows.select(F.explode(F.from_json(body, s)["associations"]).alias("a"))
    ev = F.size(F.array_distinct(F.filter(F.transform(F.coalesce("a.evidence_graph.edges", F.array().cast("array<struct<sub:string>>")), lambda e: e["sub"]), lambda v: v.startswith(prefix))))
    return x.select(F.col("a.subject.id").alias("subject"), F.col("a.object.id").alias("object"), ev.alias("n"))


def with_prefix(annots: DataFrame, prefixes: list[str]) -> DataFrame:
    """Annotations of the wanted ontologies, ids written with an underscore."""
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col("id").startswith(p)
    return (annots.filter(keep) if prefixes else annots).withColumn("id", F.replace(F.col("id"), F.lit(":"), F.lit("_")))


def approved_symbols(asked: DataFrame, table: DataFrame, kinds: list[str], match_case: bool = False) -> DataFrame:
    """(asked, symbol, kind) by a table (name, symbol, kind) of symbols and
    aliases, restricted to kinds."""
    a = asked.select("asked", (F.col("asked") if match_case else F.lower("asked")).alias("k"))
    t = table.filter(F.col("kind").isin(kinds)).select((F.col("name") if match_case else F.lower("name")).alias("k"), "symbol", "kind")
    return a.join(t, "k").select("asked", "symbol", "kind").distinct()


class _Spans(HTMLParser):
    """Text with the places of marked spans in it."""

    def __init__(self, attr: str) -> None:
        super().__init__()
        self.attr, self.at, self.open, self.out = attr, 0, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "span":
            self.open.append((dict(attrs).get(self.attr), self.at, []))

    def handle_data(self, data: str) -> None:
        for o in self.open:
            o[2].append(data)
        self.at += len(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "span" and self.open:
            mark, start, parts = self.open.pop()
            if mark:
                self.out.append((mark, start, self.at, "".join(parts)))


def html_spans(rows: DataFrame, doc: str, html: str, attr: str = "data-sciGraph") -> DataFrame:
    """(doc, mark, start, end, text) of span elements that carry attr."""
    name = attr.lower()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for d, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = _Spans(name)
                p.feed(h or "")
                out += [(str(d), *x) for x in p.out]
            cols = list(zip(*out)) if out else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["doc", "mark", "start", "end", "text"])

    return rows.select(F.col(doc).cast("string"), F.col(html)).mapInArrow(run, "doc string, mark string, start int, end int, text string")


def json_path(c: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(c), path, kind)


def span_lists(rows: DataFrame, doc: str, ident: str, spans: str, offset: str | None = None) -> DataFrame:
    """(doc, id, start, end) of 'start/length;start/length' position lists,
    1-based, moved by the sentence's offset."""
    x = rows.select(F.col(doc).alias("doc"), F.col(ident).alias("id"), (F.col(offset) if offset else F.lit(0)).alias("o"), F.explode(F.regexp_extract_all(spans, F.lit(r"\d+[/^]\d+"), F.lit(0))).alias("p"))
    p = x.select("doc", "id", "o", F.split("p", r"[/^]").alias("p"))
    start = F.element_at("p", 1).cast("int") + F.col("o") - 1
    return p.select("doc", "id", start.alias("start"), (start + F.element_at("p", 2).cast("int")).alias("end"))


def cached(texts: DataFrame, text: str, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, asked): texts with an answer in a cache (md5, answer), and the
    distinct texts without one."""
    keyed = texts.withColumn("md5", F.md5(F.coalesce(F.col(text), F.lit(""))))
    hit = keyed.join(cache.dropDuplicates(["md5"]), "md5")
    return hit, keyed.join(cache, "md5", "left_anti").select("md5", text).dropDuplicates(["md5"])


def interactions(rows: DataFrame, body: str, taxa: list[int]) -> DataFrame:
    """(a, b, n) symbol pairs of interaction records within the wanted taxa."""
    s = "map<string, struct<OFFICIAL_SYMBOL_A: string, OFFICIAL_SYMBOL_B: string, ORGANISM_A: int, ORGANISM_B: int>>"
    x = rows.select(F.explode(F.map_values(F.from_json(body, s))).alias("r")).select("r.*")
    keep = x.filter(F.col("ORGANISM_A").isin(taxa) & F.col("ORGANISM_B").isin(taxa))
    return keep.groupBy(F.col("OFFICIAL_SYMBOL_A").alias("a"), F.col("OFFICIAL_SYMBOL_B").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def scored_matches(rows: DataFrame, doc: str, body: str) -> DataFrame:
    """(doc, id, start, end, conf) of [start, end, id, confidence] matches."""
    x = rows.select(F.col(doc).alias("doc"), F.explode(F.from_json(body, "array<array<string>>")).alias("m"))
    at = lambda i: F.try_element_at("m", F.lit(i))
    return x.select("doc", F.replace(at(3), F.lit(":"), F.lit("_")).alias("id"), at(1).cast("int").alias("start"), at(2).cast("int").alias("end"), at(4).cast("double").alias("conf"))


def phenotype_table(rows: DataFrame, doc: str, body: str, common: DataFrame | None = None) -> DataFrame:
    """(doc, id, name, n, text) of tables by tabs with a header: id, name, number
    of occurrences, example, then more. Ids of common (id) are left out."""
    x = rows.select(F.col(doc).alias("doc"), F.posexplode(F.split(body, r"\r?\n")).alias("line", "v")).filter("line > 0 and trim(v) <> ''").select("doc", F.split("v", "\t").alias("c"))
    at = lambda i: F.try_element_at("c", F.lit(i))
    if common is not None:
        x = x.withColumn("id", at(1)).join(common.select("id").distinct(), "id", "left_anti")
    return x.select("doc", F.replace(at(1), F.lit(":"), F.lit("_")).alias("id"), at(2).alias("name"), at(3).cast("int").alias("n"), F.try_element_at("c", F.lit(-1)).alias("text"))


def numbered_lines(rows: DataFrame, order: str, text: str) -> DataFrame:
    """(i, line): the lines of all texts, in the order of a key, numbered on."""
    from annotara.operators import ordered

    lines = rows.select(order, F.posexplode(F.split(text, "\n")).alias("_n", "line"))
    return ordered.numbered(lines, [F.col(order), F.col("_n")], "i").select("i", "line")


def evidence_nodes(rows: DataFrame, body: str, prefix: str, ontologies: list[str] | None = None) -> DataFrame:
    """(subject, object, n): associations with the number of distinct nodes of
    evidence whose id begins with prefix; ontologies keeps objects of theirs."""
    s = "associations array<struct<subject: struct<id: string>, object: struct<id: string>, evidence_graph: struct<nodes: array<struct<id: string>>>>>"
    x = rows.select(F.explode(F.from_json(body, s)["associations"]).alias("a"))
    ids = F.transform(F.coalesce("a.evidence_graph.nodes", F.array().cast("array<struct<id:string>>")), lambda e: e["id"])
    out = x.select(F.col("a.subject.id").alias("subject"), F.col("a.object.id").alias("object"), F.size(F.array_distinct(F.filter(ids, lambda v: v.startswith(prefix)))).alias("n"))
    keep = F.lit(not ontologies)
    for o in ontologies or []:
        keep = keep | F.startswith("object", F.lit(o.upper()))
    return out.filter(keep)


class _Grid(HTMLParser):
    """The cells of the rows of a table with an id, row by row."""

    def __init__(self, ident: str) -> None:
        super().__init__()
        self.ident, self.inside, self.cell, self.rows = ident, False, False, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.inside = dict(attrs).get("id") == self.ident
        elif self.inside and tag == "tr":
            self.rows.append([])
        elif self.inside and tag in ("td", "th") and self.rows:
            self.cell = True
            self.rows[-1].append("")

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.rows[-1][-1] += data

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.cell = False
        elif tag == "table":
            self.inside = False


def html_grid(rows: DataFrame, doc: str, html: str, ident: str = "resultgrid") -> DataFrame:
    """(doc, row, cells) of the result grid of a page: its rows but the header
    and those that say that nothing matched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, r, c = [], [], []
            for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = _Grid(ident)
                p.feed(h or "")
                for i, cells in enumerate(p.rows[1:]):
                    if cells and not re.match("No .* match", cells[0].strip()):
                        d.append(k)
                        r.append(i)
                        c.append([x.strip() for x in cells])
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.string()), pa.array(r, pa.int32()), pa.array(c, pa.list_(pa.string()))], names=["doc", "row", "cells"])

    return rows.select(F.col(doc).cast("string"), F.col(html)).mapInArrow(run, "doc string, row int, cells array<string>")
