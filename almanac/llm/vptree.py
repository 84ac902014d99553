"""SimHash near-dedup with vantage-point trees.

Distinct fingerprints are dealt to the leaves of a vantage-point tree: at each node a vantage fingerprint and a radius
split the metric space of Hamming distances into a ball and its outside. A fingerprint has one home leaf; as a query it
visits every leaf that its own ball of radius 3 reaches, for by the triangle inequality a neighbour p of q has
|d(q, v) - d(p, v)| <= 3. Inside a leaf the same rule goes on locally down to small blocks, which are compared in full. The
pairs found are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import Words, components, forest, pick, scratch

RADIUS = 3
#: The router is built from so many fingerprints at least, and from eight for each leaf that it is to have; it is all that
#: goes to every executor. It has so many levels at most, which is 16,384 leaves from 131,072 fingerprints.
ROUTER_SAMPLE, MOST_LEVELS = 8192, 14


def fingerprints_of(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text over its word shingles, repeats included."""
    words = Words(texts)
    counts = words.counts()
    out = np.zeros(words.n_docs, np.uint64)
    if not len(words.doc):
        return out
    # the words of each text once more, one space between two: a shingle is then one slice
    lengths = words.end - words.start
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    buf = np.full(int(ends[-1]) + 1, 32, np.uint8)
    base = int(words.start[0])
    buf[np.arange(int(lengths.sum())) + np.repeat(starts - (words.start - base), lengths)] = words.data[base : int(words.end[-1])]
    raw = buf.tobytes()
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    n_shingles = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    at = np.arange(int(n_shingles.sum())) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + np.repeat(first, n_shingles)
    last = np.minimum(at + shingle - 1, np.repeat(first + counts - 1, n_shingles))
    digest, total = xxhash.xxh64_intdigest, int(n_shingles.sum())
    h = np.fromiter((digest(raw[s:e], 42) for s, e in zip(starts[at].tolist(), ends[last].tolist(), strict=True)), np.uint64, total)
    done, cut = 0, 1 << 18
    has = np.flatnonzero(n_shingles)
    sums = np.zeros((len(has), 64), np.int64)
    owner = np.repeat(np.arange(len(has)), n_shingles[has])
    while done < total:  # in pieces: 64 bytes for each shingle
        part = h[done : done + cut]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = owner[done : done + cut]
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        done += len(part)
    over = 2 * sums > n_shingles[has][:, None]
    out[has] = np.packbits(over, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            fp = fingerprints_of(batch.column(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- the tree


def build_router(sample: np.ndarray, depth: int) -> list[tuple[int, int, int, int, int]]:
    """Nodes (vantage, radius, inner, outer, leaf); children are positions in the list, leaf is -1 for inner nodes."""
    nodes: list = []
    leaves = 0

    def grow(part: np.ndarray, level: int) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(None)
        if level == 0 or len(part) < 4:
            nodes[at] = (0, 0, -1, -1, leaves)
            leaves += 1
            return at
        best = None
        for v in part[:: max(1, len(part) // 8)][:8]:  # of a few candidates, the one with the most even split
            d = np.bitwise_count(part ^ v)
            mu = int(np.median(d))
            inner = int((d <= mu).sum())
            score = abs(2 * inner - len(part))
            if 0 < inner < len(part) and (best is None or score < best[0]):
                best = (score, v, mu, d)
        if best is None:
            nodes[at] = (0, 0, -1, -1, leaves)
            leaves += 1
            return at
        _, v, mu, d = best
        inner, outer = grow(part[d <= mu], level - 1), grow(part[d > mu], level - 1)
        nodes[at] = (int(v), mu, inner, outer, -1)
        return at

    grow(np.unique(sample.astype(np.uint64)), depth)
    return nodes


def route(nodes: list, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, position in fps, home): each fingerprint's home leaf, and the others that its ball reaches."""
    leaf, pos, home = [], [], []
    stack = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        at, who, own = stack.pop()
        if not len(who):
            continue
        v, mu, inner, outer, number = nodes[at]
        if number >= 0:
            leaf.append(np.full(len(who), number))
            pos.append(who)
            home.append(own)
            continue
        d = np.bitwise_count(fps[who] ^ np.uint64(v)).astype(np.int16)
        near, far = d <= mu + radius, d >= mu + 1 - radius
        stack.append((inner, who[near], own[near] & (d[near] <= mu)))
        stack.append((outer, who[far], own[far] & (d[far] > mu)))
    return np.concatenate(leaf or [[]]).astype(np.int64), np.concatenate(pos or [[]]).astype(np.int64), np.concatenate(home or [[]]).astype(bool)


def search(home: np.ndarray, others: np.ndarray, radius: int = RADIUS, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that span what home-others pairs at most radius apart connect. others includes home."""
    us, vs, held = [], [], 0

    def keep(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal us, vs, held
        us.append(u)
        vs.append(v)
        held += len(u)
        if held > 500_000:
            a, b = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [a], [b], len(a)

    def down(h: np.ndarray, o: np.ndarray) -> None:
        if len(h) == 0 or len(o) < 2:
            return
        if len(h) > block:
            v = h[len(h) // 2]
            dh = np.bitwise_count(h ^ v)
            mu = int(np.median(dh))
            inner = dh <= mu
            if 0.05 * len(h) < inner.sum() < 0.95 * len(h):
                do = np.bitwise_count(o ^ v)
                down(h[inner], o[do <= mu + radius])
                down(h[~inner], o[do >= max(0, mu + 1 - radius)])
                return
        for i in range(0, len(h), 64):
            part = h[i : i + 64]
            for j in range(0, len(o), 2048):
                other = o[j : j + 2048]
                a, b = np.nonzero(np.bitwise_count(part[:, None] ^ other[None, :]) <= radius)
                u, w = part[a], other[b]
                apart = u != w
                if apart.any():
                    keep(u[apart], w[apart])

    down(home, others)
    return forest(np.concatenate(us), np.concatenate(vs)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def depth_for(n: int) -> int:
    """Levels of the router: each doubles the leaves and makes about 1.4 to 1.5 times as many visits, so leaves and visits
    both grow with a root of n."""
    return max(0, min(MOST_LEVELS, round(0.5 * math.log2(max(n, 1) / 2048)) + 2)) if n > 4096 else 0


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that span the near-duplicate graph of distinct(fp)."""
    depth = depth_for(distinct.count())
    sample = distinct.orderBy(F.xxhash64("fp")).limit(max(ROUTER_SAMPLE, 8 << depth)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = build_router(sample, depth)

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            leaf, pos, home = route(nodes, fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(fps[pos]), pa.array(home)], ["leaf", "fp", "home"])

    def find(table):
        fps = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        home = table.column("home").to_numpy().astype(bool)
        u, v = search(fps[home], fps)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = distinct.mapInArrow(deal, "leaf int, fp long, home boolean")
    return dealt.groupBy("leaf").applyInArrow(find, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text).

    Null and empty texts and texts without words have the fingerprint zero, like any other; a very long text goes in whole;
    a bit set in exactly half the shingles, a tie, is 0. Equal fingerprints are one class, so copies meet the tree once. A
    null doc_id takes part and gets its class's smallest doc_id, null if there is
    none. Repeated rows stay. An empty table gives an empty table; further columns take no part."""
    fps = scratch(fingerprints(docs), "fingerprints")
    classes = scratch(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(placed, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
