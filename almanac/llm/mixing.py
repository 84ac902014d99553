"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a target in words. Its documents are counted by exact length; a source takes whole passes over all its
documents while they fit, and for the budget that remains the number of documents to take of each length is fitted: in
proportion first, then by a bounded-knapsack dynamic programme over lengths, which takes more and untakes until the fit is
exact or can't be better. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import WORD, pick, scratch

WEIGHTS = (5.0, 2.0, 1.0)
#: Hash buckets of a length's documents: only the bucket in which the count ends is ranked row by row.
BUCKETS = 256
#: The dynamic programme first covers so many words at least, or four times the longest open length if that is more; while
#: it finds no exact fit, texts are untaken and it covers eight times as many, up to all of the budget or the second number.
#: Beyond, it goes on by residues.
GAP, WIDEST = 1 << 14, 1 << 25
#: So many of the shortest lengths serve as moduli, each in turn, until none leaves less.
MODULI = 8


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length, of so many at most, for the greatest sum that budget has room for. A bounded-knapsack
    programme over a bit set of sums: first[x] is the item by which the sum x is made first, so what it adds to was made by
    items before it; items are lengths in powers of two."""
    items, mask = [], (1 << (budget + 1)) - 1
    for i, length in enumerate(lengths.tolist()):
        left, power = min(int(counts[i]), budget // length), 1
        while left > 0:
            n = min(power, left)
            items.append((i, n, n * length))
            left -= n
            power *= 2
    items.sort(key=lambda x: x[2])
    reach, first = 1, np.zeros(budget + 1, np.int32)
    for k, (_, _, size) in enumerate(items):
        new = (reach << size & mask) & ~reach
        if new:
            reach |= new
            bits = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
            for at in range(0, len(bits), 1 << 17):
                first[8 * at + np.flatnonzero(np.unpackbits(bits[at : at + (1 << 17)], bitorder="little"))] = k
        if reach >> budget & 1:
            break
    take, at = np.zeros(len(lengths), np.int64), reach.bit_length() - 1
    while at:
        i, n, size = items[first[at]]
        take[i] += n
        at -= size
    return take


def by_residues(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, rest: int, pivot: int) -> np.ndarray:
    """A take that leaves no more of the budget than this one, which leaves rest; its state is two numbers for each residue
    modulo one length, the pivot's, however large the budget. cost[r] is the least sum of other lengths, taken more or
    untaken, that changes the sum by r modulo the pivot's; texts of the pivot's length then make up the difference. Of the
    residues that these suffice for, the one that leaves least is chosen."""
    a = int(lengths[pivot])
    cost = np.full(a, np.iinfo(np.int64).max // 2)
    net = np.zeros(a, np.int64)
    cost[0] = 0
    items, used = [], []  # used: of an item that made some residues cheaper, which ones
    for i in range(len(lengths)):
        for sign, left in ((1, int(counts[i] - take[i])), (-1, int(take[i]))) if i != pivot else ():
            left, power = min(left, a), 1  # a equal texts make a multiple of the pivot's length
            while left > 0:
                n = min(power, left)
                items.append((i, sign * n, n * int(lengths[i])))
                left -= n
                power *= 2
    for i, n, size in items:
        step = n * int(lengths[i])
        more = np.roll(cost, step % a) + size
        better = more < cost
        if not better.any():
            continue
        net = np.where(better, np.roll(net, step % a) + step, net)
        cost = np.where(better, more, cost)
        used.append((i, n, np.flatnonzero(better).astype(np.int32)))
    k = (rest - net) // a  # of the pivot's length, to take more
    possible = (cost < np.iinfo(np.int64).max // 2) & (-take[pivot] <= k)
    k = np.minimum(k, counts[pivot] - take[pivot])
    leaves = np.where(possible, rest - net - k * a, rest)
    r = int(leaves.argmin())
    if leaves[r] >= rest:
        return take
    out = take.copy()
    out[pivot] += k[r]
    for i, n, cheaper in used[::-1]:
        at = int(np.searchsorted(cheaper, r))
        if at < len(cheaper) and cheaper[at] == r:
            out[i] += n
            r = (r - n * int(lengths[i])) % a
    return out


def settle_by_residues(lengths: np.ndarray, counts: np.ndarray, takes: list[np.ndarray], budget: int) -> np.ndarray:
    """The best that fits by residues lead to from these takes, modulo each of the shortest lengths in turn, again and again
    until none leaves less."""

    def left(take: np.ndarray) -> int:
        return budget - int((take * lengths).sum())

    done = []
    for take in takes:
        still, turn = 0, 0
        pivots = np.argsort(lengths, kind="stable")[:MODULI]
        while still < len(pivots) and left(take):
            better = by_residues(lengths, counts, take, left(take), int(pivots[turn % len(pivots)]))
            still, turn = (0 if left(better) < left(take) else still + 1), turn + 1
            take = better
        done.append(take)
    return min(done, key=left)


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, gap: int = GAP, widest: int = WIDEST) -> np.ndarray:
    """How many documents of each length to take, so that the sum of lengths comes as near to budget from below as can be.
    lengths are distinct and positive. In proportion first, greatest first then; the programme fits what is left, and where
    that has no exact fit, what is left and what the shortest taken texts free, of them all if it must, or until it covers
    `widest`; what is left then is fitted by residues. The fit is the best of all where it is exact, or all could be
    untaken; by residues it is where the texts of one length suffice for every residue's change."""
    counts = counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts
    unit = int(np.gcd.reduce(lengths[counts > 0]))  # no sum lies between its multiples
    lengths, budget, total = lengths // unit, budget // unit, total // unit
    take = np.minimum(counts, np.floor(counts * (budget / total) * (1 - 1e-12)).astype(np.int64))
    rest = budget - int((take * lengths).sum())
    even = take
    gap = max(gap, 4 * int(lengths[counts > take].max()))
    down = np.argsort(-lengths, kind="stable")
    for i in down:
        if rest <= gap:
            break
        more = min(int(counts[i] - take[i]), max(0, rest - gap // 2) // int(lengths[i]))
        take = take + more * (np.arange(len(take)) == i)
        rest -= more * int(lengths[i])
    best, left, cover = take, rest, rest
    while True:
        back, open_ = np.zeros(len(take), np.int64), rest
        for i in down[::-1]:
            if open_ >= cover:
                break
            back[i] = min(int(take[i]), -(-(cover - open_) // int(lengths[i])))
            open_ += int(back[i] * lengths[i])
        more = knapsack(lengths, counts - take + back, open_)
        missed = open_ - int((more * lengths).sum())
        if missed < left:
            best, left = take - back + more, missed
        if left == 0 or (back == take).all():
            return best
        if cover >= max(gap, widest):
            return settle_by_residues(lengths, counts, [best, even], budget)
        cover = max(gap, 8 * cover)


#: Sources among which the last step of the search for the level is made in one place.
FEW = 10_000


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sizes(source, ...) with rank, from 0: sources in code point order, null last. They are dealt out by ranges, which are
    numbered by themselves and start where the ones before end, so no task sorts them all."""
    order = F.col("source").asc_nulls_last()
    parted = scratch(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    starts, before = [], 0
    for part, n in sorted(map(tuple, parted.groupBy("part").count().collect())):  # a row for each partition
        starts.append((part, before))
        before += n
    start = parted.sparkSession.createDataFrame(starts, "part int, start long")
    number = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parted.join(F.broadcast(start), "part").withColumn("rank", F.col("start") + number).drop("part", "start")


def settled_level(sources: DataFrame, total: float, bins: int = 512) -> float:
    """The level L at which the sum of least(cap, L * w) over sources(level, cap, w), level being cap / w, is total. Sums by
    range of levels narrow it down; what lies in the last range is solved exactly."""
    w_all, cap_all, high = sources.agg(F.sum("w"), F.sum("cap"), F.max("level")).first()
    if w_all is None or total >= cap_all:
        return math.inf
    low, capped, w_left, n = -1.0, 0.0, w_all, None  # capped: of all levels up to low; w_left: the weights above
    while (n is None or n > FEW) and low < high:
        step = (high - max(low, 0.0)) / bins
        part = F.least(F.floor((F.col("level") - F.lit(max(low, 0.0))) / F.lit(step)), F.lit(bins - 1)) if step > 0 else F.lit(0)
        inside = sources.where((F.col("level") > F.lit(low)) & (F.col("level") <= F.lit(high)))
        rows = inside.groupBy(part.alias("b")).agg(F.count("*").alias("n"), F.sum("cap").alias("cap"), F.sum("w").alias("w"), F.max("level").alias("most")).orderBy("b").collect()
        before = n
        for r in rows:
            if capped + r["cap"] + r["most"] * (w_left - r["w"]) >= total:
                high, n = r["most"], r["n"]
                break
            low, capped, w_left = r["most"], capped + r["cap"], w_left - r["w"]
        if n == before and len(rows) == 1:
            break  # one level, or levels that doubles can't tell apart
    for r in sources.where((F.col("level") > F.lit(low)) & (F.col("level") <= F.lit(high))).groupBy("level").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w")).orderBy("level").collect():
        if total - capped <= r["level"] * w_left:
            break
        capped, w_left = capped + r["cap"], w_left - r["w"]
    return (total - capped) / w_left


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target): sources in code point order, null last, take the weights in turn and share `share`
    of all words; a target ends at `most` times its source's words, the excess goes to the others by weight. sizes has a
    row for each source."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = ranked_sources(sizes).withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("w"))
    s = scratch(s, "levels")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = settled_level(s, share * total)
    return s.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 7, also: dict[str, str] | None = None) -> DataFrame:
    """doc_id, the columns named in `also`, size, source_size, target and copies (0, 1 or 2) for each row of docs.

    A null or empty text has the size 0 and as many copies as its source has passes. Null sources are one source, the
    last. Texts of one length tie, and a seeded hash decides; a very long one is a length of its own. Rows that are equal
    are taken or left one by one. An empty table gives an empty table; columns other than doc_id, text, source and those in
    `also` take no part."""
    also = also or {}
    docs = pick(docs, doc_id="long", text="string", source="string", **{c: t for c, t in also.items() if c not in ("text", "source")})
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    sized = sized.withColumn("tie", F.xxhash64("text")).withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    light = scratch(sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "lengths")
    targets = scratch(source_targets(light.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, most, weights), "targets")

    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # a null source meets itself in joins
    lengths = light.withColumn("key", key).groupBy("key", "size").agg(F.sum("n").alias("n"))
    goals = targets.withColumn("key", key).drop("source")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable")
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = 0 if total == 0 else min(int(target // total), int(most))
        some = pdf["size"].to_numpy() > 0
        take = np.zeros(len(pdf), np.int64)
        if passes < most:
            take[some] = fit_counts(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], int(round(target)) - passes * total)
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "passes": passes, "take": take})

    fitted = lengths.join(goals, "key").groupBy("key").applyInPandas(fit, "key string, size long, passes long, take long")
    # of a length's documents, whole hash buckets are taken while they fit; `left` are wanted of the bucket where the count ends
    buckets = light.withColumn("key", key).join(fitted, ["key", "size"])
    upto = F.sum("n").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    buckets = buckets.withColumn("left", F.greatest(F.lit(0), F.least(F.col("n"), F.col("take") - upto + F.col("n"))))
    plan = scratch(buckets.join(goals, "key").select("key", "size", "bucket", "n", "left", "passes", "source_size", "target"), "plan")

    rows = sized.withColumn("key", key)
    placed = rows.join(plan, ["key", "size", "bucket"])
    whole = (F.col("left") == 0) | (F.col("left") == F.col("n"))
    sure = placed.where(whole).withColumn("copies", F.col("passes") + (F.col("left") > 0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h", "doc_id", "tie"))
    split = placed.where(~whole).withColumn("copies", F.col("passes") + (rank <= F.col("left")).cast("long"))
    columns = ["doc_id", *also, "size", "source_size", "target", "copies"]
    return sure.select(*columns).unionByName(split.select(*columns))


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, also: dict[str, str]) -> DataFrame:
    """The mix itself: a row for each copy taken, with the columns named in `also`."""
    out = mix(docs, also=also)
    return out.select("doc_id", *also, F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("_")).drop("_")
