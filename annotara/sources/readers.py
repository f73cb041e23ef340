"""Readers and row mappings: text, JSON, CSV, npz, XML, tool outputs.

Files are read by Spark's own sources wherever one exists (so splitting,
codecs and pushdown come with them); what needs Python is a Python Data Source
or an Arrow batch function.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Control characters that XML can't hold.
CONTROLS = r"[\x00-\x08\x0b-\x0c\x0e-\x1f]"


def read_text(spark: SparkSession, paths: str | list[str], whole: bool = False, pattern: str | None = None, recursive: bool = False, encoding: str | None = None) -> DataFrame:
    """(value, path) of lines, or of whole files."""
    if encoding and encoding.lower() not in ("utf-8", "utf8"):
        raw = spark.read.format("binaryFile").load(paths)
        body = F.decode("content", encoding)
        if whole:
            return raw.select(body.alias("value"), "path")
        return raw.select(F.explode(F.split(body, r"\r?\n")).alias("value"), "path")
    lines = spark.read.text(paths, wholetext=whole, recursiveFileLookup=recursive, pathGlobFilter=pattern)
    return lines.select("value", F.input_file_name().alias("path"))


def first_last_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, n, first, last) of every file; an empty file has n = 0."""
    whole = read_text(spark, paths, whole=True)
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    n = F.when(F.length("value") > 0, F.size(lines)).otherwise(0)
    return whole.select("path", n.alias("n"), F.try_element_at(lines, F.lit(1)).alias("first"), F.try_element_at(lines, F.lit(-1)).alias("last"))


def read_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.option("multiLine", True).json(paths)


def array_objects(chunks: Iterable[str], key: str) -> Iterator[str]:
    """The objects, as text, of the one array under key of a JSON document that
    comes in chunks; no more is held than one object and a chunk."""
    buf, at, inside = "", 0, False
    depth, start, quoted, escaped = 0, -1, False, False
    head = re.compile(r'"' + re.escape(key) + r'"\s*:\s*\[')
    for chunk in chunks:
        buf += chunk
        if not inside:
            m = head.search(buf)
            if not m:
                buf = buf[-len(key) - 64 :]
                continue
            inside, at = True, m.end()
        while at < len(buf):
            c = buf[at]
            at += 1
            if quoted:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c == "{":
                depth += 1
                if depth == 1:
                    start = at - 1
            elif c == "}":
                depth -= 1
                if not depth:
                    yield buf[start:at]
                    start = -1
            elif c == "]" and not depth:
                return
        cut = start if start >= 0 else at
        buf, at, start = buf[cut:], at - cut, 0 if start >= 0 else -1


class _ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.key, self.first, self.most = options["path"], options["key"], int(options["first"]), int(options["most"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            for n, item in enumerate(array_objects(iter(lambda: f.read(1 << 20), ""), self.key)):
                if n >= self.first + self.most:
                    return
                if n >= self.first:
                    yield n, item


class JsonArraySource(DataSource):
    """One big JSON array as (pos, item), streamed in chunks."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "pos bigint, item string"

    def reader(self, schema: object) -> DataSourceReader:
        return _ArrayReader(self.options)


def read_json_array(spark: SparkSession, path: str, key: str, schema: str, offset: int = 0, maxnum: int | None = None) -> DataFrame:
    """The objects of the one top-level array {key: [...]} of a file, from
    offset on, no more than maxnum; pos is their place in the array. The file
    is streamed: neither it nor the array is ever held as a whole."""
    spark.dataSource.register(JsonArraySource)
    raw = spark.read.format("json_array").option("path", path.removeprefix("file://").removeprefix("file:")).option("key", key).option("first", str(offset)).option("most", str(1 << 62 if maxnum is None else maxnum)).load()
    return raw.select("pos", F.from_json("item", schema).alias("item")).select("pos", "item.*")


def read_csv(spark: SparkSession, path: str, offset: int = 0, maxnum: int | None = None, **options: str) -> DataFrame:
    """A CSV file with a header; offset counts rows, never the header."""
    out = spark.read.options(header=True, **options).csv(path)
    if offset:
        out = out.offset(offset)
    return out.limit(maxnum) if maxnum is not None else out


def repair_json_text(text: str | None, tries: int = 20) -> str | None:
    """Valid JSON, escaping stray quotes: on an error the last quote before it
    and the next one are escaped; null if that doesn't help."""
    if text is None:
        return None
    for _ in range(tries):
        try:
            json.loads(text)
            return text
        except json.JSONDecodeError as e:
            a = text.rfind('"', 0, e.pos)
            b = text.find('"', e.pos)
            if a <= 0 or b < 0:
                return None
            text = text[:a] + '\\"' + text[a + 1 : b] + '\\"' + text[b + 1 :]
    return None


@F.pandas_udf(StringType())
def _repair(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield s.map(repair_json_text)


def repair_json(c: Column) -> Column:
    """Repaired JSON; what parses already never leaves the JVM's view of it."""
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(_repair(c))


class _NpzReader(DataSourceReader):
    def __init__(self, path: str, member: str) -> None:
        self.path, self.member = path, member

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with np.load(partition.value, allow_pickle=False) as z:
            if "indptr" in z:
                ptr, idx, data = z["indptr"], z["indices"], z["data"]
                for r in range(len(ptr) - 1):
                    for k in range(ptr[r], ptr[r + 1]):
                        yield int(r), int(idx[k]), float(data[k])
            else:
                x = np.atleast_2d(z[self.member])
                for r, c in zip(*np.nonzero(x)):
                    yield int(r), int(c), float(x[r, c])


class NpzSource(DataSource):
    """npz matrices as (row, col, val): sparse (data, indices, indptr) or dense."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "row bigint, col bigint, val double"

    def reader(self, schema: object) -> DataSourceReader:
        return _NpzReader(self.options["path"], self.options.get("member", "data"))


def read_npz(spark: SparkSession, path: str, member: str = "data") -> DataFrame:
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").option("path", path).option("member", member).load()


def npz_names(path: str) -> dict[str, list[str]]:
    """The row and column names stored beside a matrix (idx, col), if any."""
    with zipfile.ZipFile(path) as z:
        return {n: np.load(io.BytesIO(z.read(f"{n}.npy")), allow_pickle=False).astype(str).tolist() for n in ("idx", "col") if f"{n}.npy" in z.namelist()}


def clean_xml(c: Column) -> Column:
    return F.regexp_replace(c, CONTROLS, "")


#: Schemas of the XML records read here.
ARTICLE = (
    "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>>, "
    "KeywordList: struct<Keyword: array<string>>, MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: struct<_UI: string, _VALUE: string>>>>, "
    "ChemicalList: struct<Chemical: array<struct<NameOfSubstance: struct<_UI: string, _VALUE: string>>>>>"
)


def _article_columns(a: DataFrame) -> DataFrame:
    named = lambda arr, f: F.transform(arr, lambda h: F.struct(h[f]["_UI"].alias("ui"), h[f]["_VALUE"].alias("name")))
    return a.select(
        F.col("PMID").alias("pmid"), F.col("Article.ArticleTitle").alias("title"), F.array_join("Article.Abstract.AbstractText", "\n").alias("abs"), F.col("KeywordList.Keyword").alias("kws"),
        named(F.col("MeshHeadingList.MeshHeading"), "DescriptorName").alias("mesh"), named(F.col("ChemicalList.Chemical"), "NameOfSubstance").alias("chem"),
    )


def articles(xml: DataFrame, col: str = "value") -> DataFrame:
    """(pmid, title, abs, kws, mesh, chem) of article elements held as text."""
    return _article_columns(xml.select(F.from_xml(clean_xml(F.col(col)), ARTICLE).alias("x")).select("x.MedlineCitation.*"))


def read_articles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Articles of .xml and .xml.gz archives, split by file and row tag."""
    return _article_columns(spark.read.option("rowTag", "PubmedArticle").schema(ARTICLE).xml(paths).select("MedlineCitation.*"))


def article_fields(arts: DataFrame) -> DataFrame:
    """(pmid, field, text): one row per article and field; pairs joined by a
    colon, lists by a line break."""
    join = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["ui"], x["name"])), "\n")
    wide = arts.select("pmid", F.col("title").alias("title"), F.col("abs").alias("abs"), F.array_join("kws", "\n").alias("kws"), join("mesh").alias("mesh"), join("chem").alias("chem"))
    return wide.unpivot("pmid", ["title", "abs", "kws", "mesh", "chem"], "field", "text")


def _strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def path_text(c: Column, path: str) -> Column:
    """The texts at an XPath, e.g. 'eList/e/text()'."""
    return F.xpath(clean_xml(c), F.lit(path))


def genes(xml: DataFrame, col: str = "value") -> DataFrame:
    """(id, symbol, fullname, type, status, organism, synonyms, lineage)."""
    c = clean_xml(F.col(col))
    one = lambda p: F.xpath_string(c, F.lit(p))
    return xml.select(
        one("//Gene-track_geneid").alias("id"), one("//Gene-ref_locus").alias("symbol"), one("//Gene-ref_desc").alias("fullname"), one("//Entrezgene_type/@value").alias("type"),
        one("//Gene-track_status/@value").alias("status"), one("//Org-ref_taxname").alias("organism"), F.xpath(c, F.lit("//Gene-ref_syn_E/text()")).alias("synonyms"),
        F.transform(F.split(one("//OrgName_lineage"), ";"), lambda x: F.trim(x)).alias("lineage"),
    )


def drugs(xml: DataFrame, col: str = "value") -> DataFrame:
    """(name, tty, rxcui, drug): concept groups flattened twice."""
    s = "drugGroup struct<name: string, conceptGroup: array<struct<tty: string, conceptProperties: array<struct<rxcui: string, name: string>>>>>"
    x = xml.select(F.from_xml(clean_xml(F.col(col)), s).alias("x")).select("x.drugGroup.*")
    g = x.select("name", F.explode("conceptGroup").alias("g"))
    return g.select("name", "g.tty", F.explode("g.conceptProperties").alias("p")).select("name", "tty", F.col("p.rxcui").alias("rxcui"), F.col("p.name").alias("drug"))


def series_rows(xml: DataFrame, col: str = "value") -> DataFrame:
    """(id, title, summary, keywords) of series elements; keyword paragraphs at
    the end of the summary are peeled off it."""
    c = clean_xml(F.col(col))
    body = F.regexp_replace(F.xpath_string(c, F.lit("//Summary")), r"^\s+|\s+$", "")
    paras = F.transform(F.split(body, r"\s*\n\s*"), lambda x: F.trim(x))
    base = xml.select(F.xpath_string(c, F.lit("//Series/@iid")).alias("id"), F.xpath_string(c, F.lit("//Title")).alias("title"), paras.alias("paras"))
    is_kw = lambda x: F.rlike(x, F.lit("^Keywords[:=]"))
    return base.select(
        "id", "title", F.array_join(F.filter("paras", lambda x: ~is_kw(x)), "\n").alias("summary"),
        F.transform(F.filter("paras", is_kw), lambda x: F.trim(F.regexp_replace(x, "^Keywords[:=]", ""))).alias("keywords"),
    )


def sample_table(text: Column) -> Column:
    """array<array<string>> of a tab separated data table; blank cells are 0."""
    cells = lambda line: F.transform(F.split(line, "\t"), lambda x: F.when(F.trim(x) == "", "0").otherwise(F.trim(x)))
    return F.transform(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), cells)


def soft_rows(lines: DataFrame) -> DataFrame:
    """(path, entity, name, key, value) of SOFT text lines (value, path, pos):
    '^SERIES = x' opens an entity, '!key = value' lines belong to the last."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("value").startswith("^"), F.col("value"))
    t = lines.withColumn("head", F.last(head, True).over(w)).filter(F.col("value").startswith("!"))
    part = lambda c, i: F.trim(F.element_at(F.split(c, " = ", 2), i))
    return t.select("path", F.lower(F.substr(part(F.col("head"), 1), F.lit(2))).alias("entity"), part(F.col("head"), 2).alias("name"), F.substr(part(F.col("value"), 1), F.lit(2)).alias("key"), F.trim(F.try_element_at(F.split("value", " = ", 2), F.lit(2))).alias("value"))


def annotator_blocks(whole: DataFrame, prefix: str = "HP_") -> DataFrame:
    """(rec, id, text, start, end) of output in blank-line separated blocks: a
    record id, then id, text, start and end by tabs."""
    blocks = whole.select(F.explode(F.split("value", r"\r?\n\s*\r?\n")).alias("b")).select(F.filter(F.split(F.trim("b"), r"\r?\n"), lambda x: F.trim(x) != "").alias("l")).filter(F.size("l") > 0)
    rows = blocks.select(F.element_at("l", 1).alias("rec"), F.explode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(1)))).alias("r")).select("rec", F.split("r", "\t").alias("c")).filter(F.size("c") >= 4)
    return rows.select("rec", F.concat(F.lit(prefix), F.element_at("c", 1)).alias("id"), F.element_at("c", 2).alias("text"), F.element_at("c", 3).cast("int").alias("start"), F.element_at("c", 4).cast("int").alias("end"))


def piped_rows(lines: DataFrame, width: int = 9) -> DataFrame:
    """Pipe rows brought to width columns: padded on the right if the first
    field begins with 0, else on the left; rows with ERROR are dropped."""
    parts = F.split("value", r"\|")
    fill = F.array_repeat(F.lit(" "), F.greatest(F.lit(width) - F.size(parts), F.lit(0)))
    full = F.when(F.element_at(parts, 1).startswith("0"), F.concat(parts, fill)).otherwise(F.concat(fill, parts))
    return lines.filter(~F.col("value").contains("ERROR")).select(F.slice(full, 1, width).alias("cols"))


def candidate_terms(lines: DataFrame) -> DataFrame:
    """(term) of candidate lines '  861 Name (Other) [Type]' of a concept mapper:
    headers and findings are skipped, the score goes, distinct."""
    t = lines.filter(F.col("value").rlike(r"^\s*\d+\s") & ~F.col("value").contains("[Finding]"))
    return t.select(F.trim(F.regexp_extract("value", r"^\s*\d+\s+([^(\[]+)", 1)).alias("term")).filter("term <> ''").distinct()


def ntriples(lines: DataFrame) -> DataFrame:
    """(s, p, o, o_lang, o_is_literal) of N-Triples lines; a graph is a set."""
    x = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<[^>]*>)?)\s*\.\s*$'
    g = lambda i: F.regexp_extract("value", x, i)
    t = lines.filter(F.col("value").rlike(x))
    literal = F.col("value").rlike(r'^\s*\S+\s+<[^>]*>\s+"')
    return t.select(F.regexp_replace(g(1), r"[<>]", "").alias("s"), g(2).alias("p"), F.when(literal, g(5)).otherwise(F.concat(g(3), g(4))).alias("o"), F.nullif(g(6), F.lit("")).alias("o_lang"), literal.alias("o_is_literal")).distinct()


def sample_rows(xml: DataFrame, col: str = "value") -> DataFrame:
    """(id, platform, title, type, organism, tissue, trait, data) of sample
    elements; traits are the characteristics, data the cells of a data table."""
    c = clean_xml(F.col(col))
    one = lambda p: _strip(F.xpath_string(c, F.lit(p)))
    traits = F.transform(F.xpath(c, F.lit("//Characteristics/text()")), _strip)
    return xml.select(
        one("//Sample/@iid").alias("id"), one("//Platform-Ref/@ref").alias("platform"), one("//Title").alias("title"), one("//Sample/Type").alias("type"), one("//Organism").alias("organism"),
        one("//Characteristics[@tag='tissue']").alias("tissue"), traits.alias("trait"), sample_table(F.xpath_string(c, F.lit("//Internal-Data"))).alias("data"),
    )


def platform_rows(xml: DataFrame, col: str = "value") -> DataFrame:
    """(id, title, tech, organism, manufacturer, col_desc) of platform elements."""
    c = clean_xml(F.col(col))
    one = lambda p: _strip(F.xpath_string(c, F.lit(p)))
    desc = F.transform(F.xpath(c, F.lit("//Column/Description/text()")), _strip)
    return xml.select(one("//Platform/@iid").alias("id"), one("//Title").alias("title"), one("//Technology").alias("tech"), one("//Organism").alias("organism"), one("//Manufacturer").alias("manufacturer"), desc.alias("col_desc"))


def database_info(xml: DataFrame, col: str = "value") -> DataFrame:
    """(name, number, last_update) of a database information record."""
    c = clean_xml(F.col(col))
    one = lambda p: F.xpath_string(c, F.lit(p))
    return xml.select(one("//DbName").alias("name"), one("//Count").cast("bigint").alias("number"), one("//LastUpdate").alias("last_update"))


def listed(xml: DataFrame, path: str, col: str = "value") -> DataFrame:
    """(pos, item): the texts at an XPath, one per row."""
    return xml.select(F.posexplode(path_text(F.col(col), path)).alias("pos", "item"))


def renamed(rows: DataFrame, names: dict[str, str], fields: str = "fields") -> DataFrame:
    """Columns by a map of old to new keys from map<string, array<string>>:
    missing keys give '', lists of one their element, longer ones joined."""
    pick = lambda k: F.coalesce(F.array_join(F.try_element_at(fields, F.lit(k)), ";;"), F.lit(""))
    return rows.select(*[pick(k).alias(v) for k, v in names.items()])


def reference_ids(xml: DataFrame, key: str, col: str = "value") -> DataFrame:
    """(rec, pos, pmid) of reference lists held as XML: the references that have
    a number, in order."""
    lists = F.xpath(clean_xml(F.col(col)), F.lit("//referenceList/reference/pubmedID/text()"))
    return xml.select(F.col(key).alias("rec"), F.posexplode(F.transform(lists, _strip)).alias("pos", "pmid")).filter("pmid <> ''")


def word_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(word): the distinct lines of word list files without blanks at their ends."""
    return read_text(spark, paths).select(_strip(F.col("value")).alias("word")).filter("word <> ''").distinct()


def result_pages(pages: DataFrame, body: str, items: str, schema: str, start: str | None = None) -> DataFrame:
    """(pos, fields...) of saved pages of a paged answer: the items under a path
    such as 'response.docs', each with its place in the whole, which is the
    page's first place (under start, 0 if the answer has none) plus its own."""
    names = items.split(".")
    nested = f"{names[-1]} array<struct<{schema}>>"
    for n in reversed(names[:-1]):
        nested = f"{n} struct<{nested}>"
    first = F.coalesce(F.get_json_object(body, f"$.{start}").cast("bigint"), F.lit(0)) if start else F.lit(0)
    got = F.from_json(body, nested)
    for n in names:
        got = got[n]
    x = pages.select(first.alias("_first"), F.posexplode(got).alias("_at", "_item"))
    return x.select((F.col("_first") + F.col("_at")).cast("bigint").alias("pos"), "_item.*")


def sparql_bindings(answers: DataFrame, body: str, names: list[str]) -> DataFrame:
    """One row per solution of SPARQL answers in JSON: the values of the named
    variables, with their languages; a variable that is not bound is null."""
    rows = answers.select(F.explode(F.from_json(body, "results struct<bindings: array<map<string, struct<type: string, value: string, `xml:lang`: string>>>>")["results"]["bindings"]).alias("b"))
    return rows.select(*[F.col("b")[n]["value"].alias(n) for n in names], *[F.col("b")[n]["xml:lang"].alias(f"{n}_lang") for n in names])


_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"


def _described(text: str | None) -> Iterator[tuple[str, str, str, str | None, bool]]:
    """The triples of RDF/XML, one node element after the other."""
    if not text:
        return
    address = lambda tag: tag[1:].replace("}", "")
    for _, node in ElementTree.iterparse(io.StringIO(text)):
        s = node.get(f"{_RDF}about") or node.get(f"{_RDF}ID") or (f"_:{node.get(f'{_RDF}nodeID')}" if node.get(f"{_RDF}nodeID") else None)
        if s is None or node.tag == f"{_RDF}RDF":
            continue
        if node.tag != f"{_RDF}Description":
            yield s, f"{_RDF[1:-1]}type", address(node.tag), None, False
        for child in node:
            o = child.get(f"{_RDF}resource") or (f"_:{child.get(f'{_RDF}nodeID')}" if child.get(f"{_RDF}nodeID") else None)
            if o is not None:
                yield s, address(child.tag), o, None, False
            elif not len(child):
                yield s, address(child.tag), child.text or "", child.get("{http://www.w3.org/XML/1998/namespace}lang"), True
        node.clear()


def rdf_xml(documents: DataFrame, col: str = "value") -> DataFrame:
    """(s, p, o, o_lang, o_is_literal) of RDF/XML documents; a graph is a set.
    Node elements give their class, properties a resource or a literal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [t for text in b.column(0).to_pylist() for t in _described(text)]
            cols = list(zip(*got)) if got else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()))], names=["s", "p", "o", "o_lang", "o_is_literal"])

    return documents.select(col).mapInArrow(run, "s string, p string, o string, o_lang string, o_is_literal boolean").distinct()
