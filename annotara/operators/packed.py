"""Several values packed in one field, one row per value with its position.

Method: dialects are selected by minimum description length. A dialect is a set
of delimiters, with or without quoting. Every field is parsed under each dialect
of up to two delimiters that occur in it; the code length of a parse is the cost
of its dialect plus that of its values, and a value costs -log2 of a mixture of
its share of all values of the corpus (counted by a distributed aggregation,
without the field's own share) and a character model. Counts start from all
parses alike and are taken again from the cheapest ones. Then a dialect of two
or more delimiters is widened by one more at a time, as long as that is cheaper.

A field's parses stay in one row, as indices into its values; what is shuffled
is a row per field and value, once to count and once to look the counts up.
Values, and texts of fields, that very many rows share are looked up apart.

Defined cases: null, empty and blank fields give no rows; repeated fields each
give their rows (they are parsed once); a field without delimiters is one
value; doubled quotes and backslashes before a delimiter are undone; an unclosed
quote is an ordinary character; ties take the dialect that is simpler, then
first in DELIMITERS.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotara.session import partitions, stored

#: Delimiters in the order in which ties are broken.
DELIMITERS = [";", ",", "|", "\t", "•", "、", " / ", ", ", ";;", "/", "；", "，", "·", "\n"]
#: Opening to closing quotes.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "„": "“", "「": "」"}
CLOSERS = set(QUOTES.values())
#: Bits of a character in a value never seen elsewhere, and of a dialect's
#: parts: its first delimiter, each further one, quoting.
CHAR_BITS, DIALECT_BITS, SECOND_BITS, QUOTE_BITS = 5.5, 3.0, 6.0, 1.0
#: Bits of a value that begins or ends with a quote which its parse leaves standing.
STRAY_BITS = 40.0
#: Weight of the character model in the mixture, in values.
PRIOR = 0.5


#: A delimiter left at the end separates nothing, whatever the dialect.
_TRAIL = re.compile(r"(?:(?<!\\)[;,|•、；，·/]|\s)+$")


def split_field(text: str, delims: tuple[str, ...], quoting: bool) -> list[str]:
    """The values of text under a dialect, empty ones left out."""
    order = sorted(delims, key=len, reverse=True)
    text = _TRAIL.sub("", text)
    if not quoting and "\\" not in text:  # nothing is protected
        parts = re.split("|".join(map(re.escape, order)), text) if order else [text]
        return [v for v in map(str.strip, parts) if v]
    out, buf, i, n = [], [], 0, len(text)
    starts = True
    protected = None

    def end() -> None:
        v = protected if protected is not None else "".join(buf).strip()
        if v.strip():
            out.append(v.strip())

    while i < n:
        c = text[i]
        if starts and quoting and c in QUOTES:
            close, j, piece = QUOTES[c], i + 1, []
            while j < n:
                if text[j] == "\\" and j + 1 < n and (text[j + 1] in order or text[j + 1] in (close, c, "\\")):
                    piece.append(text[j + 1])
                    j += 2
                elif text[j] == close:
                    if close == c and text[j + 1 : j + 2] == close:
                        piece.append(close)
                        j += 2
                        continue
                    k = j + 1
                    while k < n and text[k] in "  ":
                        k += 1
                    if k >= n or any(text.startswith(d, k) or text.startswith(d, j + 1) for d in order):
                        break
                    piece.append(text[j])
                    j += 1
                else:
                    piece.append(text[j])
                    j += 1
            if j < n:
                protected, i, starts = "".join(piece), j + 1, False
                continue
        if c == "\\" and i + 1 < n and (text[i + 1] in ";,|/•、\\\"'\t；，·" or text[i + 1] in order):
            buf.append(text[i + 1])
            i, starts = i + 2, False
            continue
        d = next((d for d in order if text.startswith(d, i)), None)
        if d is not None:
            end()
            buf, protected, starts = [], None, True
            i += len(d)
            continue
        if not c.isspace():
            starts = False
            if protected is not None:  # text after a closing quote: not a quoted value
                protected = None
        buf.append(c)
        i += 1
    end()
    return out


Dialect = tuple[tuple[str, ...], bool]


def present(text: str) -> list[str]:
    """The delimiters that occur in text and mean something by themselves."""
    text = _TRAIL.sub("", text)
    there = [d for d in DELIMITERS if d in text]
    return [d for d in there if not (d == ", " and text.count(",") == text.count(", ")) and not (d == ";;" and text.count(";") == 2 * text.count(";;"))]


def _apart(d: str, others: tuple[str, ...]) -> bool:
    bare = lambda x: x.strip() or x
    return all(bare(d) not in o and bare(o) not in d for o in others)


def dialects(text: str) -> list[Dialect]:
    """The dialects of up to two delimiters that can apply to text, simpler ones first."""
    there = present(text)
    sets = [()] + [(d,) for d in there] + [p for p in combinations(there, 2) if _apart(p[0], p[1:])]
    quoted = any(q in text for q in QUOTES)
    return [(s, q) for s in sets for q in ((True, False) if quoted else (False,))]


def wider(text: str, own: Dialect) -> list[Dialect]:
    """own, and what it becomes with one more delimiter."""
    return [own, *(((*own[0], d), own[1]) for d in present(text) if d not in own[0] and _apart(d, own[0]))]


_CAND = pa.struct([("delims", pa.list_(pa.string())), ("quoting", pa.bool_()), ("bits", pa.float64()), ("vals", pa.list_(pa.int32()))])
_STATE = pa.schema([("fid", pa.binary()), ("field", pa.string()), ("copies", pa.int64()), ("words", pa.list_(pa.string())), ("cands", pa.list_(_CAND)), ("owns", pa.list_(pa.float64()))])
_DDL = "fid binary, field string, copies bigint, words array<string>, cands array<struct<delims:array<string>,quoting:boolean,bits:double,vals:array<int>>>, owns array<double>"


def _parses(text: str, ways: list[Dialect], first_only: bool) -> tuple[list[str], list[dict], list[float]]:
    """(values, parses as indices into them, votes for each value): the votes
    are shared by all parses alike, or are those of the first one."""
    words: dict[str, int] = {}
    cands: dict[tuple[int, ...], dict] = {}
    for delims, quoting in ways:
        vals = split_field(text, delims, quoting)
        at = tuple(words.setdefault(v, len(words)) for v in vals)
        if vals and at not in cands:
            bits = (DIALECT_BITS if delims else 0.0) + (SECOND_BITS * (len(delims) - 1) + len(vals) if len(delims) > 1 else 0.0) + QUOTE_BITS * quoting
            bits += STRAY_BITS * sum(x[0] in QUOTES or x[-1] in CLOSERS for x in vals)
            cands[at] = {"delims": list(delims), "quoting": quoting, "bits": bits, "vals": list(at)}
    owns = [0.0] * len(words)
    voting = [next(iter(cands))] if first_only and cands else list(cands)
    for at in voting:
        for w in at:
            owns[w] += 1.0 / len(voting)
    return list(words), list(cands.values()), owns


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fid, field, copies[, delims, quoting] to states: without a dialect all
    that can apply, with one its wider ones."""
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            cols = [c.to_pylist() for c in b.slice(lo, 2000).columns]
            ways = [wider(f, (tuple(d), q)) for f, d, q in zip(cols[1], cols[3], cols[4])] if len(cols) > 3 else [dialects(f) for f in cols[1]]
            got = [_parses(f, w, len(cols) > 3) for f, w in zip(cols[1], ways)]
            keep = [i for i, g in enumerate(got) if g[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], t.type) for x, t in zip((*cols[:3], *([g[j] for g in got] for j in range(3))), _STATE)], schema=_STATE)


def _split_join(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows, all of them, with table (one row per key, n of rows in column n). Keys of
    more rows than a task has on average are fewer than there are tasks; they
    are met by a broadcast of that size, so no task holds a hot key."""
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = table.filter(F.col(n) * partitions(rows.sparkSession) > total)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key, "left")
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def _votes(state: DataFrame) -> DataFrame:
    """(val, votes, rows) from the votes of every field for its values."""
    each = state.select(F.explode(F.arrays_zip(F.col("words").alias("val"), F.col("owns").alias("own"))).alias("x")).select("x.*")
    return each.groupBy("val").agg(F.sum("own").alias("votes"), F.count(F.lit(1)).alias("rows"))


def _best(state: DataFrame, votes: DataFrame) -> DataFrame:
    """state with best, the place of the cheapest parse of every field."""
    total = F.lit(float(votes.agg(F.sum("votes")).first()[0] or 0.0))
    each = state.select("fid", F.posexplode(F.arrays_zip(F.col("words").alias("val"), F.col("owns").alias("own"))).alias("w", "x")).select("fid", "w", "x.val", "x.own")
    seen = _split_join(each, votes, "val", "rows")
    # A field's own votes for a value are left out.
    rest = F.greatest(F.coalesce("votes", F.lit(0.0)) - F.col("own"), F.lit(0.0))
    char = F.pow(F.lit(2.0), -F.lit(CHAR_BITS) * F.least(F.length("val") + 1, F.lit(150)))
    bits = -F.log2((rest + PRIOR * char) / (total + PRIOR)) + F.greatest(F.length("val") - 149, F.lit(0)) * CHAR_BITS
    costs = seen.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", bits.alias("b")))), lambda x: x["b"]).alias("costs"))
    cost = lambda c: F.round(F.aggregate(c["vals"], c["bits"], lambda t, v: t + F.get("costs", v)), 9)
    ranked = F.transform("cands", lambda c, i: F.struct(cost(c).alias("cost"), i.alias("i")))
    return state.join(costs, "fid").withColumn("best", F.array_min(ranked)["i"]).drop("costs")


def _counted(state: DataFrame) -> DataFrame:
    """state voting for its best parse alone."""
    vals = F.get("cands", F.col("best"))["vals"]
    owns = F.transform("words", lambda _, i: F.size(F.filter(vals, lambda v: v == i)).cast("double"))
    return state.withColumn("owns", owns)


def choose(fields: DataFrame, rounds: int = 3) -> DataFrame:
    """(fid, copies, vals) with the cheapest parse of every distinct text in field."""
    texts = fields.select("field").filter(F.length(F.trim("field")) > 0).groupBy("field").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.select(field_id(F.col("field")).alias("fid"), "field", "copies").repartition(partitions(fields.sparkSession), "fid")
    state = stored(texts.mapInArrow(_states, _DDL))
    # Fields with one parse only are settled; they vote, but need no scoring.
    settled, state = state.filter(F.size("cands") < 2).withColumn("best", F.lit(0)), state.filter(F.size("cands") > 1)
    fixed = stored(_votes(settled))

    def votes(of: DataFrame) -> DataFrame:
        return stored(_votes(of).unionByName(fixed).groupBy("val").agg(F.sum("votes").alias("votes"), F.sum("rows").alias("rows")))

    for _ in range(rounds):
        state = stored(_counted(_best(state, votes(state))))
    final = votes(state)
    # One more delimiter at a time, where there are two already and others stand.
    chosen = F.get("cands", F.col("best"))
    done = None
    more = state.filter(F.size(chosen["delims"]) > 1)
    out = settled.unionByName(state.filter(F.size(chosen["delims"]) < 2))
    while done is None or not more.isEmpty():
        wide = stored(more.select("fid", "field", "copies", chosen["delims"].alias("delims"), chosen["quoting"].alias("quoting")).mapInArrow(_states, _DDL))
        alone = wide.filter(F.size("cands") < 2).withColumn("best", F.lit(0))
        tried = stored(_best(wide.filter(F.size("cands") > 1), final))
        done = alone.unionByName(tried.filter("best = 0"))
        out, more = out.unionByName(done), tried.filter("best > 0")
    return out.select("fid", "copies", F.transform(chosen["vals"], lambda v: F.get("words", v)).alias("vals"))


def field_id(c: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(c))


#: What opens a keyword paragraph.
HEADING = re.compile(r"^\s*key[ \t-]?words?(?:\(s\))?[ \t]*(?:[:=：]|[-–—](?=\s))[ \t]*", re.I)


def keyword_paragraphs(text: str | None) -> list[str]:
    """The unbroken run of keyword paragraphs at the end, headings left out,
    without the full stop that ends each."""
    out: list[str] = []
    for line in reversed(re.split(r"\r\n|\r|\n", text or "")):
        if not line.strip():
            continue
        m = HEADING.match(line)
        if not m:
            break
        out.append(re.sub(r"\s*\.\s*$", "", line[m.end() :]))
    return out[::-1]


def packed_fields(series: DataFrame) -> DataFrame:
    """(row_no, src, nth, field): the array elements and the closing paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, n, f = [], [], []
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, p in enumerate(keyword_paragraphs(text)):
                    r.append(row)
                    n.append(i)
                    f.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(n, pa.int32()), pa.array(f, pa.string())], names=["row_no", "nth", "field"])

    tail = series.filter(F.col("summary").rlike(r"(?i)key[ \t-]?word")).select("row_no", "summary").mapInArrow(run, "row_no bigint, nth int, field string")
    arr = series.select("row_no", F.posexplode("keywords").alias("nth", "field"))
    return arr.select("row_no", F.lit("keywords").alias("src"), "nth", "field").unionByName(tail.select("row_no", F.lit("summary").alias("src"), "nth", "field"))


def unpack(fields: DataFrame, keys: list[str]) -> DataFrame:
    """One row per value of (keys, nth, field): keys, pos, val. pos counts from
    0 through the fields of a key in the order of nth."""
    parsed = stored(choose(fields))
    has = fields.filter(F.length(F.trim("field")) > 0).select(*keys, "nth", field_id(F.col("field")).alias("fid"))
    rows = _split_join(has, parsed, "fid", "copies").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("nth", "vals"))).alias("x"))
    flat = F.flatten(F.transform("x", lambda s: s["vals"]))
    return rows.select(*keys, F.posexplode(flat).alias("pos", "val")).withColumn("pos", F.col("pos").cast("bigint"))
