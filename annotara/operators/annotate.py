"""Annotations, tokens and spans: interval joins, dictionaries, rebasing."""

from __future__ import annotations


import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the buckets that turn an interval join into an equi-join.
BUCKET = 256


def _arrow_spans(docs: DataFrame, key: str, text: str, find: Callable[[str], list[tuple[str, int, int]]]) -> DataFrame:
    """(doc, i, str, start, end) of what find gives for a text: token places
    depend on all before them, so a text is walked once, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                rows, d, i = [], [], []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    got = find(t) if t else []
                    rows += got
                    d += [k] * len(got)
                    i += range(len(got))
                w, s, e = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(d, part.column(0).type), pa.array(i, pa.int32()), pa.array(w, pa.string()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["doc", "i", "str", "start", "end"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"doc {kind}, i int, str string, start int, end int")


def spans_of_tokens(docs: DataFrame, key: str, text: str, pattern: str = r"\S+") -> DataFrame:
    """(doc, i, str, start, end) of the tokens between white space."""
    find = re.compile(pattern).finditer
    return _arrow_spans(docs, key, text, lambda t: [(m[0], m.start(), m.end()) for m in find(t)])


def token_lists(docs: DataFrame, key: str, text: str, pattern: str = r"\S+") -> DataFrame:
    """(doc, toks) of the same tokens, a row a text: toks lists (i, start, end)."""
    find = re.compile(pattern).finditer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                ends, i, places = [0], [], []
                for t in part.column(1).to_pylist():
                    own = [m.span() for m in find(t)] if t else []
                    i += range(len(own))
                    places += own
                    ends.append(len(places))
                start, end = zip(*places) if places else ((), ())
                each = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (i, start, end)], names=["i", "start", "end"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], names=["doc", "toks"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"doc {kind}, toks array<struct<i:int,start:int,end:int>>")


def locate_tokens(docs: DataFrame, key: str, text: str, pattern: str = r"\w\w+", resume_at_end: bool = True) -> DataFrame:
    """(doc, i, str, start, end): greedy places, from left to right, of the
    lower-case tokens of a text in the lower-case text; (-1, -1) where one is
    missing. The search goes on behind the last hit, or at its beginning."""
    tok = re.compile(pattern).findall

    def find(t: str) -> list[tuple[str, int, int]]:
        low, at, out = t.lower(), 0, []
        for w in tok(low):
            p = low.find(w, at)
            out.append((w, p, p + len(w) if p >= 0 else -1))
            if p >= 0:
                at = p + len(w) if resume_at_end else p
        return out

    return _arrow_spans(docs, key, text, find)


def align(annots: DataFrame, toks: DataFrame, error: int = 0) -> DataFrame:
    """(doc, annot, i): the tokens each annotation (doc, annot, start, end)
    covers, of tokens (doc, i, start, end) whose places rise with i. Start
    token: the first whose start is within error, or that the start lies
    strictly inside of; end: the first from there whose end is within error or
    beyond; none: to the last token of the document.

    Two as-of steps over tokens and annotations in the order of their places,
    so both are moved once, by document, and no token meets an annotation it
    has nothing to do with.
    """
    own = ["annot", "as", "ae", "first"]
    kinds = dict(annots.dtypes)
    none = lambda t: F.lit(None).cast(t)
    blank = [none(kinds["annot"]).alias("annot"), none("int").alias("as"), none("int").alias("ae"), none("int").alias("first")]

    def among(rows: DataFrame, rows_at: Column, toks_at: str) -> DataFrame:
        """rows and tokens by place, rows before the tokens of the same place."""
        t = toks.select("doc", F.col(toks_at).cast("int").alias("at"), F.lit(1).alias("kind"), F.col("i").cast("int").alias("i"), F.col("start").cast("int").alias("ts"), F.col("end").cast("int").alias("te"), *blank)
        return t.unionByName(rows.select("doc", rows_at.cast("int").alias("at"), F.lit(0).alias("kind"), none("int").alias("i"), none("int").alias("ts"), none("int").alias("te"), *own))

    # Both frames run from their first row on: what is ahead is read backwards.
    upto = (Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("doc").orderBy("at", "kind").rowsBetween(*upto)
    ahead = Window.partitionBy("doc").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(*upto)
    tok = F.when(F.col("kind") == 1, F.struct("i", "ts", "te"))
    a = annots.select("doc", "annot", F.col("start").cast("int").alias("as"), F.col("end").cast("int").alias("ae"), none("int").alias("first"))
    inside = F.when(F.col("last.te") > F.col("as"), F.col("last.i"))  # the token the start lies in
    placed = among(a, F.col("as"), "start").withColumn("last", F.last(tok, True).over(back))
    if error:
        placed = placed.filter("kind = 0").select("doc", "annot", "as", "ae", inside.alias("first"))
        near = among(placed, F.col("as") - error, "start").withColumn("next", F.last(tok, True).over(ahead)).filter("kind = 0")
    else:
        near = placed.withColumn("next", F.last(tok, True).over(ahead)).filter("kind = 0").withColumn("first", inside)
    begun = near.withColumn("first", F.least("first", F.when(F.col("next.ts") <= F.col("as") + error, F.col("next.i")))).filter("first is not null").select("doc", *own)
    ended = among(begun, F.col("ae") - error, "end").withColumn("next", F.last(tok, True).over(ahead)).withColumn("most", F.max("i").over(Window.partitionBy("doc"))).filter("kind = 0")
    last = F.greatest(F.coalesce("next.i", "most"), F.col("first"))
    return ended.select("doc", "annot", F.explode(F.sequence("first", last)).alias("i")).dropDuplicates(["doc", "annot", "i"])


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, a, b): spans (doc, id, start, end) that overlap strictly."""
    cells = lambda x: F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / BUCKET)))
    left = a.withColumn("bucket", cells(a)).select("doc", "bucket", F.col("id").alias("a"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    right = b.withColumn("bucket", cells(b)).select("doc", "bucket", F.col("id").alias("b"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    hit = left.join(right, ["doc", "bucket"]).filter("e2 > s1 and s2 < e1")
    # Reported in the bucket where the overlap begins, so without a distinct.
    return hit.filter(F.col("bucket") == F.floor(F.greatest("s1", "s2") / BUCKET)).select("doc", "a", "b")


def rebase(texts: DataFrame, annots: DataFrame, gap: int = 1) -> DataFrame:
    """(text, annot, start, end): annotations placed in texts joined in order
    are put back into the text they lie in. texts is (grp, i, n) with lengths;
    annots (grp, annot, start, end). An as-of join: each start meets the last
    text that begins at or before it."""
    w = Window.partitionBy("grp").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    base = texts.select("grp", "i", F.coalesce(F.sum(F.col("n") + gap).over(w), F.lit(0)).alias("lo"))
    both = base.select("grp", F.col("lo").alias("at"), F.lit(0).alias("kind"), "i", "lo", F.lit(None).cast("bigint").alias("annot"), F.lit(None).cast("bigint").alias("end")).unionByName(
        annots.select("grp", F.col("start").cast("bigint").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("bigint").alias("lo"), F.col("annot").cast("bigint").alias("annot"), F.col("end").cast("bigint").alias("end"))
    )
    order = Window.partitionBy("grp").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("ti", F.last("i", True).over(order)).withColumn("tlo", F.last("lo", True).over(order))
    return last.filter("kind = 1").select("grp", F.col("ti").alias("i"), "annot", (F.col("at") - F.col("tlo")).alias("start"), (F.col("end") - F.col("tlo")).alias("end"))


def left_modifier(annots: DataFrame, toks: DataFrame) -> DataFrame:
    """(doc, annot, modifier): the token before the one an annotation starts in."""
    prev = F.lag("str").over(Window.partitionBy("doc").orderBy("i"))
    t = toks.withColumn("modifier", prev).select("doc", F.col("start").alias("ts"), "modifier")
    return annots.join(t, (annots.doc == t.doc) & (annots.start == t.ts)).select(annots.doc, "annot", "modifier")


_WORD = re.compile(r"[\w'-]+").finditer


def _word_places(t: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in _WORD(t)]


#: Bits of the map of first words: what it lets through is joined, so it costs no hit.
FIRST_BITS = 1 << 20


def _words_ahead(docs: DataFrame, key: str, text: str, firsts: bytes, longest: int) -> DataFrame:
    """(doc, start, ahead) of the words that may be first words of terms: the
    words (w, e) from there, as many as the longest term has, with the gap g
    before each. Words that engines may lower differently always may be."""

    def may(w: str) -> bool:
        if not w.isascii() and any(c in "İΣ" or c >= "\u0530" and c.lower() != c for c in w):
            return True
        h = zlib.crc32(w.lower().encode()) % FIRST_BITS
        return bool(firsts[h >> 3] >> (h & 7) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                d, s, a = [], [], []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    places = _word_places(t) if t else []
                    for i, (w, at, _) in enumerate(places):
                        if may(w):
                            d.append(k)
                            s.append(at)
                            a.append([{"w": x, "e": e, "g": t[places[j - 1][2] : b0] if j > i else ""} for j, (x, b0, e) in enumerate(places[i : i + longest], i)])
                yield pa.RecordBatch.from_arrays([pa.array(d, part.column(0).type), pa.array(s, pa.int32()), pa.array(a, pa.list_(pa.struct([("w", pa.string()), ("e", pa.int32()), ("g", pa.string())])))], names=["doc", "start", "ahead"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"doc {kind}, start int, ahead array<struct<w:string,e:int,g:string>>")


def match_dictionary(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(doc, id, start, end, text): whole-word places of dictionary terms
    (id, term), whatever the case, the longest at each place; every id of a
    term is given.

    Places are met by an equi-join with the first words of terms, then by
    another, on all words, with the terms of each length that such a first word
    has, so neither side is broadcast whatever its size. A bit map of the first
    words, of a fixed size, keeps most other places from being moved.
    """
    words = F.filter(F.split(F.lower(F.trim("term")), r"\s+"), lambda w: w != "")
    dict_rows = terms.select("id", words.alias("words")).filter(F.size("words") > 0).distinct()
    longest = dict_rows.agg(F.max(F.size("words"))).first()[0]
    if not longest:
        return docs.select(F.col(key).alias("doc")).filter("false").select("doc", F.lit(0).alias("id"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("text"))
    first = F.element_at("words", 1)
    firsts = bytearray(FIRST_BITS // 8)
    for (h,) in dict_rows.select(F.crc32(first) % FIRST_BITS).distinct().collect():
        firsts[h >> 3] |= 1 << (h & 7)
    lens = dict_rows.groupBy(first.alias("first")).agg(F.collect_set(F.size("words")).alias("lens"))
    each = _words_ahead(docs, key, text, bytes(firsts), longest).withColumn("first", F.lower(F.col("ahead")[0]["w"]))
    tried = each.join(lens, "first").select("doc", "start", "ahead", F.explode("lens").alias("n")).filter(F.size("ahead") >= F.col("n"))
    there = F.slice("ahead", 1, F.col("n"))
    body = F.array_join(F.transform(there, lambda x: F.concat(x["g"], x["w"])), "")
    hit = tried.select("doc", "start", "n", F.transform(there, lambda x: F.lower(x["w"])).alias("words"), F.element_at(there, -1)["e"].alias("end"), body.alias("text")).join(dict_rows.select("words").distinct(), "words")
    best = F.row_number().over(Window.partitionBy("doc", "start").orderBy(F.desc("n")))
    kept = hit.withColumn("r", best).filter("r = 1")
    return kept.join(dict_rows, "words").select("doc", "id", "start", "end", "text")


def dependency_edges(rows: DataFrame, col: str) -> DataFrame:
    """(sent, dep, head, rel) of arrays of 'relation, head-i, word-j' lines."""
    e = rows.select("sent", F.explode(col).alias("x"))
    part = lambda i: F.regexp_extract("x", r"^\s*([^,]+),\s*(.*)-(\d+),\s*(.*)-(\d+)\s*$", i)
    return e.select("sent", part(5).cast("int").alias("dep"), part(3).cast("int").alias("head"), F.when(part(3) == "0", "ROOT").otherwise(F.trim(part(1))).alias("rel"))


