"""Deeply nested semi-structured records to related flat tables.

Method: each record is stream-parsed, token by token with a stack, into
(path, ordinals, value) triples; paths are grouped by their repeated ancestor,
and each group is pivoted into one table whose key is the record and the
positions. pivot() takes the ancestors wanted, and then only their paths leave
the parser, so that what is shuffled is the size of the result; derive() finds
every repeated ancestor in the paths themselves and keeps all fields.

Defined cases: null, empty and broken JSON give no triples after the point
where it breaks; a lone object where an array is declared counts as an array of
one, also where the array (or object) is held as JSON text; null elements keep
their position and give no row; null scalars give no value (ident '').
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:([{}\[\]:,])|"((?:[^"\\]|\\.)*)"|(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null))', re.S)
_ESCAPE = re.compile(r'\\(u[0-9a-fA-F]{4}|.)', re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(s: str) -> str:
    if "\\" not in s:
        return s
    out = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _PLAIN.get(m[1], m[1]), s)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", out) else out


def triples(text: str | None, arrays: frozenset[str], wrappers: frozenset[str], prefix: str = "", at: tuple[int, ...] = ()) -> Iterator[tuple[str, tuple[int, ...], str | None]]:
    """(path, ordinals, value) of one JSON text, as they are met.

    A path has a name per level and [] per array level; an object that is an
    array element gives (its path, its ordinals, None) before its fields. A key
    in arrays always holds an array; a key in wrappers is left out of the path.
    """
    if not text:
        return
    # A frame: [is_array, path, ordinals, next position, key awaited or None, virtual array]
    stack: list[list] = []
    path, ords, key, want_key = prefix, at, None, False
    pos = 0

    def begin(is_object: bool, p: str, o: tuple[int, ...], k: str | None) -> tuple[str, tuple[int, ...], bool]:
        """Where a value that begins now stands, and whether it is an element."""
        if stack and stack[-1][0]:
            f = stack[-1]
            o2, f[3] = (*f[2], f[3]), f[3] + 1
            return f[1] + "[]", o2, True
        if k is None:
            return p, o, False
        base = stack[-1][1]
        here = base if k in wrappers else (f"{base}.{k}" if base else k)
        o = stack[-1][2]
        if is_object and k in arrays:
            return here + "[]", (*o, 0), True
        return here, o, False

    while True:
        m = _TOKEN.match(text, pos)
        if not m:
            return
        pos = m.end()
        mark = m[1]
        if mark == ",":
            if stack and not stack[-1][0]:
                want_key, key = True, None
            continue
        if mark == ":":
            continue
        if mark in ("}", "]"):
            if not stack:
                return
            stack.pop()
            if not stack:
                return
            want_key, key = False, None
            continue
        if mark == "{":
            path, ords, element = begin(True, prefix, at, key)
            if element:
                yield path, ords, None
            stack.append([False, path, ords, 0])
            want_key, key = True, None
            continue
        if mark == "[":
            path, ords, _ = begin(False, prefix, at, key)
            stack.append([True, path, ords, 0])
            want_key, key = False, None
            continue
        if m[2] is not None and want_key:
            key, want_key = _unescape(m[2]), False
            continue
        path, ords, _ = begin(False, prefix, at, key)
        if m[2] is not None:
            value = _unescape(m[2])
            if key in arrays and value.lstrip()[:1] in ("[", "{"):
                inner = value.lstrip()
                if inner[0] == "{":
                    yield path + "[]", (*ords, 0), None
                    yield from triples(inner, arrays, wrappers, path + "[]", (*ords, 0))
                else:
                    yield from triples(inner, arrays, wrappers, path, ords)
            else:
                yield path, ords, value
        elif m[3] is not None:
            yield path, ords, m[3]
        elif m[4] != "null":
            yield path, ords, m[4]
        key = None
        if not stack:
            return


def shred(df: DataFrame, rec_id: str, json: str, paths: list[str] | None, arrays: list[str], wrappers: list[str]) -> DataFrame:
    """(rec_id, path, ordinals, value) of the wanted paths of every record, or
    of all that there are."""
    wanted, arr, wrap = None if paths is None else frozenset(paths), frozenset(arrays), frozenset(wrappers)
    schema = pa.schema([("rec_id", pa.int64()), ("path", pa.string()), ("ordinals", pa.list_(pa.int64())), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rec, ps, os, vs = [], [], [], []
            for r, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p, o, v in triples(text, arr, wrap):
                    if wanted is None or p in wanted:
                        rec.append(r)
                        ps.append(p)
                        os.append(list(o))
                        vs.append(v)
                if len(rec) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(ps, pa.string()), pa.array(os, pa.list_(pa.int64())), pa.array(vs, pa.string())], schema=schema)
                    rec, ps, os, vs = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(ps, pa.string()), pa.array(os, pa.list_(pa.int64())), pa.array(vs, pa.string())], schema=schema)

    return df.select(F.col(rec_id).cast("bigint"), F.col(json).cast("string")).mapInArrow(run, "rec_id bigint, path string, ordinals array<bigint>, value string")


def pivot(shredded: DataFrame, ancestors: dict[str, tuple[str, dict[str, str]]]) -> DataFrame:
    """One table per repeated ancestor, stacked: (kind, rec_id, ordinals, fields...).

    ancestors maps a kind to its ancestor path (ending in []) and to the fields
    {column: path under it}. Triples are grouped by (ancestor, record,
    ordinals), which is one object each, and pivoted by max of the wanted path.
    """
    kind = F.lit(None).cast("string")
    fields: dict[str, F.Column] = {}
    for k, (a, cols) in ancestors.items():
        own = [a, *[f"{a}.{p}" for p in cols.values()]]
        kind = F.when(F.col("path").isin(own), k).otherwise(kind)
        for c, p in cols.items():
            v = F.when(F.col("path") == f"{a}.{p}", F.col("value"))
            fields[c] = F.coalesce(fields[c], v) if c in fields else v
    tagged = shredded.select(kind.alias("kind"), "rec_id", "ordinals", *[v.alias(c) for c, v in fields.items()]).filter("kind is not null")
    return tagged.groupBy("kind", "rec_id", "ordinals").agg(*[F.max(c).alias(c) for c in fields])


def derive(shredded: DataFrame) -> DataFrame:
    """(tbl, rec_id, ordinals, parent, fields): a table for every repeated
    ancestor that the paths have, '' for the records themselves. A row is one
    object or element with its place, the place of what holds it, and its own
    scalars by their path under the ancestor; of a key met twice in one object
    the greatest value stays. An element that is a scalar is the field ''."""
    tbl = F.regexp_extract("path", r"^(?:.*\[\])?", 0)
    field = F.regexp_replace(F.substr("path", F.length("tbl") + 1), r"^\.", "")
    each = shredded.withColumn("tbl", tbl).select("tbl", "rec_id", "ordinals", field.alias("field"), "value").repartition("rec_id")
    one = each.groupBy("tbl", "rec_id", "ordinals", "field").agg(F.max("value").alias("value"))
    entry = F.when(F.col("value").isNotNull(), F.struct("field", "value"))
    rows = one.groupBy("tbl", "rec_id", "ordinals").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields"))
    above = F.when(F.size("ordinals") > 0, F.slice("ordinals", 1, F.size("ordinals") - 1))
    return rows.select("tbl", "rec_id", "ordinals", above.alias("parent"), "fields")


#: Array names, wrapper names and ancestors of the two record kinds here.
OMIM_ARRAYS = ["entryList", "referenceLists", "referenceList"]
OMIM_WRAPPERS = ["omim", "entry", "reference"]
OMIM_TABLES = {
    "entry": ("entryList[]", {"ident": "mimNumber"}),
    "entry_ref": ("entryList[].referenceList[]", {"ident": "pubmedID"}),
    "list_ref": ("referenceLists[].referenceList[]", {"ident": "pubmedID"}),
}
BIOC_TABLES = {
    "passage": ("passages[]", {"ident": "offset"}),
    "annotation": ("passages[].annotations[]", {"ident": "infons.concept"}),
}


def _paths(tables: dict[str, tuple[str, dict[str, str]]]) -> list[str]:
    return [x for a, cols in tables.values() for x in (a, *[f"{a}.{p}" for p in cols.values()])]


def _bodies(bioc: DataFrame) -> DataFrame:
    """(row_no, body): the passages as JSON, nulls kept in their places."""
    return bioc.select("row_no", F.to_json(F.struct(F.col("passages").alias("passages")), {"ignoreNullFields": "false"}).alias("body"))


def all_tables(omim: DataFrame, bioc: DataFrame) -> DataFrame:
    """(src, tbl, rec_id, ordinals, parent, fields) of both record kinds, with
    every table their paths have: authors, flags, locations, relations too."""
    a = derive(shred(omim, "response_id", "omim", None, OMIM_ARRAYS, OMIM_WRAPPERS)).select(F.lit("omim").alias("src"), "*")
    b = derive(shred(_bodies(bioc), "row_no", "body", None, ["passages", "annotations", "relations", "locations", "nodes"], [])).select(F.lit("bioc").alias("src"), "*")
    return a.unionByName(b)


def flat_records(omim: DataFrame, bioc: DataFrame) -> DataFrame:
    """(kind, rec_id, pos1, pos2, ident) of entries, references, passages and
    annotations; -1 and '' stand for none."""
    a = pivot(shred(omim, "response_id", "omim", _paths(OMIM_TABLES), OMIM_ARRAYS, OMIM_WRAPPERS), OMIM_TABLES)
    b = pivot(shred(_bodies(bioc), "row_no", "body", _paths(BIOC_TABLES), ["passages", "annotations"], []), BIOC_TABLES)
    pos = lambda i: F.coalesce(F.try_element_at("ordinals", F.lit(i)), F.lit(-1)).cast("bigint")
    return a.unionByName(b).select("kind", "rec_id", pos(1).alias("pos1"), pos(2).alias("pos2"), F.coalesce("ident", F.lit("")).alias("ident"))
