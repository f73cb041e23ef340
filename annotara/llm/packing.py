"""Filling containers of fixed capacity with documents measured in tokens.

Method: a grouping genetic algorithm. A chromosome is a list of bins; crossover
injects whole well-filled bins of one parent into the other, drops the bins
that then hold a duplicate, and best-fits the displaced documents, after
exchanging them for smaller ones of bins they fill better; mutation empties the
worst bins and a few others. Items are dealt to shards of bounded size, which
are distributed; on a shard several islands evolve populations of their own,
from seeds of growing disorder, and the elite of each migrates to the next. The
aim is not only few bins but all free room in one of them, for what the shards
leave in bins that are not well filled is pooled and evolved once more, longer.

Defined cases: a document longer than the capacity is cut into full containers
and a rest (the only case of a split); documents of no tokens (null or empty
text too) take no room and go into the first container of their shard; equal
sizes are ordered by document; an empty table gives no rows.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from itertools import accumulate
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotara.session import stored

#: Items of a shard on average.
SHARD_ITEMS = 2000
#: Kinds of containers that one call accepts.
MAX_PACKS = 1000
#: Islands of a shard, chromosomes of an island, epochs that end in a migration.
ISLANDS, POPULATION, EPOCHS = 2, 5, 2
#: Generations of an epoch: of all items, and of the few that are pooled.
GENERATIONS, POOL_GENERATIONS = 5, 40
#: A bin at least so full is well filled; what lies in others is pooled.
WELL = 0.995
#: Share of a parent's bins that crossover injects.
INJECTED = 0.1


class Chromosome:
    """Bins with their free room. Bins are never changed in place, so that
    parents and children share those they have in common."""

    __slots__ = ("cap", "bins", "free")

    def __init__(self, cap: int, bins: list[list[int]], free: list[int]) -> None:
        self.cap, self.bins, self.free = cap, bins, free

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first, then the more uneven the better."""
        return -len(self.bins), sum((self.cap - f) ** 2 for f in self.free)

    def perfect(self, least: int) -> bool:
        """No fewer bins can do, and all free room is in one of them."""
        return len(self.bins) <= least and sum(self.free) == max(self.free, default=0)


class Rooms:
    """Things by a number, found by a bit mask over the numbers in use."""

    __slots__ = ("mask", "by")

    def __init__(self) -> None:
        self.mask = 0
        self.by: dict[int, list[int]] = {}

    def add(self, n: int, thing: int) -> None:
        self.by.setdefault(n, []).append(thing)
        self.mask |= 1 << n

    def take(self, n: int) -> int:
        stack = self.by[n]
        thing = stack.pop()
        if not stack:
            self.mask &= ~(1 << n)
        return thing

    def at_most(self, n: int) -> int:
        """The greatest number in use up to n, or -1."""
        return (self.mask & ((1 << (n + 1)) - 1)).bit_length() - 1

    def at_least(self, n: int) -> int:
        """The least number in use from n, or -1."""
        m = self.mask >> n
        return n + (m & -m).bit_length() - 1 if m else -1


def place(cap: int, bins: list[list[int]], free: list[int], items: list[int], size: list[int]) -> Chromosome:
    """items in their order, each into the bin it leaves the least room in."""
    rooms = Rooms()
    for i, f in enumerate(free):
        if f:
            rooms.add(f, i)
    for x in items:
        s = size[x]
        r = rooms.at_least(s) if s else -1
        if r >= 0:
            i = rooms.take(r)
            bins[i], free[i] = [*bins[i], x], r - s
            if r > s:
                rooms.add(r - s, i)
        elif not s and bins:
            bins[0] = [*bins[0], x]
        else:
            bins.append([x])
            free.append(cap - s)
            if s < cap:
                rooms.add(cap - s, len(bins) - 1)
    return Chromosome(cap, bins, free)


def best_fit(cap: int, size: list[int]) -> Chromosome:
    """Best-fit decreasing."""
    return place(cap, [], [], sorted(range(len(size)), key=lambda x: (-size[x], x)), size)


def settle(cap: int, bins: list[list[int]], free: list[int], loose: list[int], size: list[int]) -> Chromosome:
    """Displaced items take the place of smaller ones in bins they fill better;
    what is loose then is best-fitted, the largest first."""
    pool = Rooms()
    for x in loose:
        pool.add(size[x], x)
    for i, f in enumerate(free):
        gain, out = 0, -1
        for x in bins[i] if f else ():
            y = pool.at_most(size[x] + f) - size[x]
            if y > gain:
                gain, out = y, x
                if y == f:
                    break
        if gain:
            new = pool.take(size[out] + gain)
            bins[i], free[i] = [new if x == out else x for x in bins[i]], f - gain
            pool.add(size[out], out)
    rest = [x for stack in pool.by.values() for x in stack]
    rest.sort(key=lambda x: (-size[x], x))
    return place(cap, bins, free, rest, size)


def _without(a: Chromosome, out: set[int]) -> tuple[list[list[int]], list[int]]:
    return [b for i, b in enumerate(a.bins) if i not in out], [f for i, f in enumerate(a.free) if i not in out]


def cross(a: Chromosome, b: Chromosome, size: list[int], rng: random.Random) -> Chromosome:
    """Whole well-filled bins of b go into a; bins of a that then hold a
    duplicate are dropped and what else they held is settled."""
    limit = a.cap * (1 - WELL)
    good = [i for i, f in enumerate(b.free) if f <= limit] or sorted(range(len(b.free)), key=b.free.__getitem__)[: max(1, len(b.free) // 4)]
    picked = rng.sample(good, min(len(good), max(1, int(len(b.bins) * INJECTED))))
    inside = {x for i in picked for x in b.bins[i]}
    hit = {i for i, its in enumerate(a.bins) if not inside.isdisjoint(its)}
    bins, free = _without(a, hit)
    loose = [x for i in hit for x in a.bins[i] if x not in inside]
    return settle(a.cap, bins + [b.bins[i] for i in picked], free + [b.free[i] for i in picked], loose, size)


def mutate(a: Chromosome, size: list[int], rng: random.Random) -> Chromosome:
    """A few of the worst bins and a few others are emptied and settled."""
    order = sorted(range(len(a.free)), key=lambda i: -a.free[i])
    few = max(2, len(order) // 50)
    out = {*order[: rng.randint(1, few)], *rng.sample(order, min(len(order), few))}
    return settle(a.cap, *_without(a, out), [x for i in out for x in a.bins[i]], size)


def bound(cap: int, sizes: list[int]) -> int:
    """A lower bound of the bins: total room, and, for every least size k that
    counts, items no two of which fit and what room they leave for the others."""
    s = sorted(sizes)
    sums = [0, *accumulate(s)]
    half = bisect_right(s, cap // 2)  # from there on no two fit
    best = ceil(sums[-1] / cap)
    for k in {0, *s[:half]}:
        lone = bisect_right(s, cap - k)  # from there on nothing of size k fits beside
        mid = max(0, lone - half)
        room = mid * cap - (sums[max(lone, half)] - sums[half])
        small = sums[half] - sums[min(bisect_left(s, k), half)]
        best = max(best, len(s) - half + max(0, ceil((small - room) / cap)))
    return best


def evolve(cap: int, size: list[int], seed: int, generations: int = GENERATIONS) -> list[int]:
    """The bin of every item by the best chromosome of all islands."""
    rng = random.Random(seed)
    least = bound(cap, size)
    best = best_fit(cap, size)
    islands = []
    for k in range(ISLANDS):
        pool = [best]
        while len(pool) < POPULATION and not best.perfect(least):
            noise = [s * (1 + 0.1 * (k + 1) * rng.random()) for s in size]
            pool.append(place(cap, [], [], sorted(range(len(size)), key=lambda i: -noise[i]), size))
        islands.append(pool)
    for _ in range(EPOCHS):
        for pool in islands:
            for _ in range(generations):
                best = max(best, *pool, key=Chromosome.fitness)
                if best.perfect(least):
                    break
                half = sorted(pool, key=Chromosome.fitness, reverse=True)[: max(2, POPULATION // 2)]
                while len(half) < POPULATION:
                    x, y = rng.sample(half, 2)
                    child = cross(x, y, size, rng)
                    half.append(mutate(child, size, rng) if rng.random() < 0.7 else child)
                pool[:] = half
            pool.sort(key=Chromosome.fitness, reverse=True)
        elite = [pool[0] for pool in islands]
        best = max(best, *elite, key=Chromosome.fitness)
        for k, pool in enumerate(islands):
            pool[-1] = elite[k - 1]
    out = [0] * len(size)
    for g, its in enumerate(best.bins):
        for i in its:
            out[i] = g
    return out


_SCHEMA = "pack_name string, capacity int, shard bigint, doc_id bigint, piece bigint, size bigint, bin bigint, well boolean"


def _evolved(items: DataFrame, generations: int, salt: int, shard_items: int) -> DataFrame:
    """(pack_name, capacity, shard, doc_id, piece, size, bin, well) by shards of
    items, each with all its islands in one task, written once."""
    n = items.groupBy("pack_name").count().agg(F.max("count")).first()[0] or 0
    shards = max(1, ceil(n / shard_items))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        cap, size = int(own.capacity.iat[0]), own["size"].astype(int).tolist()
        own["bin"] = evolve(cap, size, int(own["shard"].iat[0]) * 1_000_003 + salt, generations)
        own["well"] = own.groupby("bin")["size"].transform("sum") >= WELL * cap
        return own[["pack_name", "capacity", "shard", "doc_id", "piece", "size", "bin", "well"]]

    dealt = items.select("pack_name", "capacity", "doc_id", "piece", "size", F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(shards)).alias("shard"))
    return stored(dealt.groupBy("pack_name", "capacity", "shard").applyInPandas(run, _SCHEMA))


def pack(sizes: DataFrame, packs: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(pack_name, bin_id, doc_id, piece, size): every document of (doc_id, size)
    in containers of every row of packs, which is a small, fixed table."""
    caps = packs.select("pack_name", "capacity").dropna().distinct().orderBy("pack_name").limit(MAX_PACKS + 1).collect()
    if len(caps) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} kinds of containers")
    kinds = F.array(*[F.struct(F.lit(c.pack_name).alias("pack_name"), F.lit(c.capacity).cast("int").alias("capacity")) for c in caps])
    # The capacities are few and fixed; every document is packed for each of them.
    each = sizes.select("doc_id", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), F.explode(kinds).alias("k")).select("doc_id", "size", "k.*")
    full = (F.col("size") / F.col("capacity")).cast("bigint")
    each = each.select("pack_name", "capacity", "doc_id", "size", full.alias("full"), (F.col("size") - full * F.col("capacity")).alias("rest"))
    whole = each.filter("full > 0").select("pack_name", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
    whole = whole.select("pack_name", F.concat_ws(":", F.lit("full"), "doc_id", "piece").alias("bin_id"), "doc_id", "piece", F.col("capacity").cast("bigint").alias("size"))
    items = each.filter("rest > 0 or size = 0").select("pack_name", "capacity", "doc_id", F.col("full").alias("piece"), F.col("rest").alias("size"))
    named = lambda df, mark: df.select("pack_name", F.concat_ws(":", F.lit(mark), "shard", "bin").alias("bin_id"), "doc_id", "piece", "size")
    first = _evolved(items, GENERATIONS, 0, shard_items)
    last = _evolved(first.filter("not well"), POOL_GENERATIONS, 7, shard_items)
    return named(first.filter("well"), "s").unionByName(named(last, "p")).unionByName(whole)
