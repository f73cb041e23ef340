"""Long exact spans shared between records.

Method: repeated-phrase automata. Every window of MIN_SPAN code points has one
least-hashed phrase of PHRASE code points, the same wherever the window stands;
phrases met in more than one text are the recurring ones. They are compiled,
shard by shard, into Aho-Corasick automata, and each block of a text that can
hold a phrase of a shard is streamed through it, which locates every occurrence
to the letter. Round the places located, a text is cut into stretches whose
windows have the same phrase as their least; equal stretches, compared as
texts, are one row with the least and greatest text that holds them, so a
passage in a third of all rows is pre-aggregated and no pair of texts is ever
formed. Stretches of one text only are met window by window, by two independent
64-bit hashes of a window.

Exact copies are met once: a text with copies is shared as a whole, and its
spans are handed to its copies by a join at the end.

Defined cases: null and empty texts, and texts under MIN_SPAN, have no span;
very long texts are cut into overlapping blocks inside a task; repeats within
one text do not count, only other documents do.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annotara.session import partitions, stored

MIN_SPAN, PHRASE = 200, 120
#: Phrases of an automaton, and code points streamed by one task of a shard.
SHARD_PHRASES, TASK_CHARS = 8_000, 24_000_000
#: Code points hashed at once, and windows of a block that is routed by itself.
BLOCK, ROUTE = 1_000_000, 16_384

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, 1 << 16)
        one = np.ones(1, np.uint64)
        _POWERS[:] = [np.concatenate([one, np.cumprod(np.full(m - 1, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k code points."""
    n = len(codes)
    up, down = _powers(n)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(0x1234567)) * up, out=pre[1:])
    return _mix((pre[k:] - pre[: n - k + 1]) * down[: n - k + 1])


def slide(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over every window of w values (blockwise prefixes and suffixes)."""
    n = len(x)
    m = ceil(n / w) * w
    y = np.full(m, fill, x.dtype)
    y[:n] = x
    b = y.reshape(-1, w)
    left = op.accumulate(b, axis=1).ravel()
    right = op.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - w + 1], left[w - 1 : n])


def least(codes: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the phrases, and of each window its least one."""
    h = grams(codes, k)
    return h, slide(h, span - k + 1, np.minimum, np.iinfo(np.uint64).max)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def blocks(codes: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks that overlap so that each window lies in exactly one of them."""
    at = 0
    while at + span <= len(codes):
        yield at, codes[at : at + BLOCK + span - 1]
        at += BLOCK


def _phrases(span: int, k: int):
    """The least phrases of each routed block of a text, with a position each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs, bs, ps = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for at, codes in blocks(code_points(text), span):
                    h, m = least(codes, span, k)
                    new = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])  # windows that begin with another phrase
                    new = np.unique(np.r_[new, np.arange(-at % ROUTE, len(m), ROUTE)])
                    blk = (new + at) // ROUTE
                    _, one = np.unique(m[new] + blk.astype(np.uint64) * _BASE, return_index=True)
                    vals = m[new[one]]
                    within = np.lib.stride_tricks.sliding_window_view(h, span - k + 1)[new[one]].argmin(1)
                    ids.append(np.full(len(one), key, np.int64))
                    hs.append(vals.view(np.int64))
                    bs.append(blk[one])
                    ps.append(new[one] + within + at)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, ids, bs, ps)], names=["h", "tid", "blk", "pos"])

    return run


def located(auto: object, text: str, k: int) -> np.ndarray:
    """Where phrases of an automaton stand in a text."""
    return np.fromiter((end - k + 1 for end, _ in auto.iter(text)), np.int64)


def segments(codes: np.ndarray, at: np.ndarray, span: int, k: int, limit: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, phrase) of the stretches whose windows (the first limit ones) have
    as their least phrase one the automaton located at a place of at; a stretch
    ends where the phrase changes, so equal passages give equal stretches."""
    h, m = least(codes, span, k)
    met = np.full(len(h), np.iinfo(np.uint64).max)
    met[at] = h[at]
    kept = slide(met, span - k + 1, np.minimum, np.iinfo(np.uint64).max)[:limit] == m[:limit]
    w = np.flatnonzero(kept)
    if not len(w):
        return
    new = np.flatnonzero(np.r_[True, (w[1:] != w[:-1] + 1) | (m[w[1:]] != m[w[:-1]])])
    for x, y in zip(w[new].tolist(), [*w[new[1:] - 1].tolist(), int(w[-1])]):
        yield x, y + span, int(m[x].view(np.int64))


def _stream(span: int, k: int):
    import ahocorasick

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, auto, ready = None, None, False
        for b in batches:
            ids, starts, fs, texts = [], [], [], []
            for shard, salt, kind, num, base, text in zip(*[c.to_pylist() for c in b.columns]):
                if (shard, salt) != at:
                    at, auto, ready = (shard, salt), ahocorasick.Automaton(), False
                if kind == 0:
                    auto.add_word(text, num)
                    continue
                if not ready:
                    auto.make_automaton()
                    ready = True
                places = located(auto, text, k) if len(auto) else ()
                if len(places):
                    for x, y, f in segments(code_points(text), places, span, k, ROUTE):
                        ids.append(num)
                        starts.append(base + x)
                        fs.append(f)
                        texts.append(text[x:y])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(fs, pa.int64()), pa.array(texts, pa.string())], names=["tid", "at", "f", "seg"])

    return run


def _windows(span: int):
    """Two hashes of every window of a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, w1, w2, rel = [], [], [], []
            for i, text in enumerate(b.column(4).to_pylist()):
                codes = code_points(text)
                w1.append(grams(codes, span).view(np.int64))
                w2.append(grams(codes * np.uint32(2654435761) + np.uint32(97), span).view(np.int64))
                rows.append(np.full(len(w1[-1]), i))
                rel.append(np.arange(len(w1[-1])))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*[b.column(j).take(take) for j in range(4)], pa.array(np.concatenate(w1)), pa.array(np.concatenate(w2)), pa.array(np.concatenate(rel).astype(np.int32))], names=["k1", "k2", "lo", "hi", "w1", "w2", "rel"])

    return run


def shared_spans(docs: DataFrame, key: str, text: str, span: int = MIN_SPAN, phrase: int = PHRASE) -> DataFrame:
    """(key, span_start, span_end): the longest unbroken runs of code points of
    each document that lie in a stretch of at least span code points which
    stands in another document too."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.length("text") >= span)
    two = lambda c: (F.xxhash64(c).alias("k1"), F.xxhash64(F.lit(1), c).alias("k2"))
    # Exact copies: one representative each, by two hashes of the text and its length.
    member = stored(rows.select("id", *two("text"), F.length("text").alias("n")))
    first = stored(member.groupBy("k1", "k2", "n").agg(F.min("id").alias("tid"), F.count(F.lit(1)).alias("copies")))
    own = first.select("tid")
    met = rows.mapInArrow(_phrases(span, phrase), "h bigint, tid bigint, blk bigint, pos bigint")
    met = stored(met.join(own, "tid", "left_semi"))
    rec = met.groupBy("h").agg(F.min(F.struct("tid", "pos")).alias("at"), F.max("tid").alias("last")).filter("at.tid < last")
    rec = stored(rec.select("h", F.col("at.tid").alias("tid"), F.col("at.pos").alias("pos")))
    shards = max(1, ceil(rec.count() / SHARD_PHRASES))
    # The phrases of a passage have one representative text, so they share a shard.
    shard = F.pmod(F.xxhash64("tid"), F.lit(shards)).cast("int").alias("shard")
    homes = rec.select("h", shard)
    route = stored(met.select("h", "tid", "blk").join(homes, "h").select("tid", "blk", "shard").distinct())
    # A shard with much text is split by its own load.
    load = route.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) * F.lit(float(ROUTE)) / TASK_CHARS).cast("int").alias("salts"))
    dealt = route.join(load, "shard").select("tid", "blk", "shard", F.pmod(F.xxhash64("tid", "blk"), F.col("salts")).cast("int").alias("salt"))
    # Only blocks that hold a recurring phrase are streamed, once a shard.
    n_blocks = F.floor((F.length("text") - span) / ROUTE)
    cut_up = rows.select(F.col("id").alias("tid"), F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks)).alias("blk"), "text")
    cut_up = cut_up.select("tid", "blk", F.substr("text", (F.col("blk") * ROUTE + 1).cast("int"), F.lit(ROUTE + span - 1)).alias("text"))
    pieces = cut_up.join(dealt, ["tid", "blk"]).select("shard", "salt", F.lit(1).alias("kind"), F.col("tid").alias("num"), (F.col("blk") * ROUTE).alias("base"), "text")
    words = rows.withColumnRenamed("id", "tid").join(rec, "tid").select("h", shard, F.substr("text", (F.col("pos") + 1).cast("int"), F.lit(phrase)).alias("text"))
    words = words.join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("h").alias("num"), F.lit(0).cast("bigint").alias("base"), "text")
    tasks = max(partitions(spark), min(2 * shards, 4096))
    feed = words.unionByName(pieces).repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    occ = stored(feed.mapInArrow(_stream(span, phrase), "tid bigint, at bigint, f bigint, seg string").select("tid", "at", *two("seg"), "f", "seg"))
    # Equal stretches are one; what stands in two texts is shared as a whole.
    segs = stored(occ.groupBy("k1", "k2", "f", "seg").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")))
    whole_segs = segs.filter("lo < hi").select("k1", "k2", F.array(F.struct(F.lit(0).alias("a"), F.length("seg").alias("b"))).alias("parts"))
    # The others, which an end of a passage runs through, are met window by window.
    torn = segs.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("lo") == F.col("hi")).alias("one")).filter("n > 1 and one").select("f")
    wins = stored(segs.join(torn, "f", "left_semi").select("k1", "k2", "lo", "hi", "seg").mapInArrow(_windows(span), "k1 bigint, k2 bigint, lo bigint, hi bigint, w1 bigint, w2 bigint, rel int"))
    twice = wins.groupBy("w1", "w2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("w1", "w2")
    some = wins.filter("lo = hi").join(twice, ["w1", "w2"], "left_semi").select("k1", "k2", "rel")
    ends = F.transform("rels", lambda r: F.struct(r.alias("a"), (r + span).alias("b")))
    part_segs = some.groupBy("k1", "k2").agg(F.collect_list("rel").alias("rels")).select("k1", "k2", ends.alias("parts"))  # no more than a stretch has windows
    hit = occ.select("tid", "at", "k1", "k2").join(whole_segs.unionByName(part_segs), ["k1", "k2"]).select("tid", "at", F.explode("parts").alias("p"))
    hit = hit.select("tid", (F.col("at") + F.col("p.a")).alias("a"), (F.col("at") + F.col("p.b")).alias("b"))
    lone = first.filter("copies = 1").select("tid")
    by = Window.partitionBy("tid").orderBy("a", "b")
    upto = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = hit.join(lone, "tid", "left_semi").withColumn("gap", F.when(F.col("a") > upto, 1).otherwise(0)).withColumn("run", F.sum("gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    part = runs.groupBy("tid", "run").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).select("tid", "span_start", "span_end")
    whole = member.join(first.filter("copies > 1").select("k1", "k2", "n"), ["k1", "k2", "n"], "left_semi")
    whole = whole.select(F.col("id").alias(key), F.lit(0).cast("bigint").alias("span_start"), F.col("n").cast("bigint").alias("span_end"))
    return part.withColumnRenamed("tid", key).unionByName(whole)


def shared_share(docs: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """(key, n_chars, n_shared, share) of every document."""
    got = spans.groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    n = F.coalesce(F.length(text), F.lit(0)).cast("bigint")
    out = docs.select(key, n.alias("n_chars")).join(got, key, "left")
    shared = F.coalesce("n_shared", F.lit(0)).cast("bigint")
    return out.select(key, "n_chars", shared.alias("n_shared"), F.coalesce(F.try_divide(shared.cast("double"), F.col("n_chars").cast("double")), F.lit(0.0)).alias("share"))
