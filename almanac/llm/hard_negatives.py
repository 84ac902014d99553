"""Hard-negative mining by blocked dense products.

Vectors are packed into blocks once. Anchors go to the workers in waves of a bounded size; each wave meets the blocks of all
candidates twice, as products of float64 matrices, which are exact while no sum reaches 2^53. The first pass keeps each
anchor's best rows of its label, the second its best rows of other labels inside the window that each positive's score sets.
A task keeps at most k rows for an anchor (and positive), and tasks' rows are merged by a ranked window over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import pick, scratch

#: Candidates of one product, and bytes of anchors that are broadcast at a time.
ROWS, WAVE = 2048, 1 << 24
#: The id that stands for a null one inside: it comes last among equal scores.
NO_ID = (1 << 63) - 1

PACKED = "dims int, n int, bytes long, ids binary, labels binary, kind string, rows binary"
_PACKED = pa.schema([("dims", pa.int32()), ("n", pa.int32()), ("bytes", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("kind", pa.string()), ("rows", pa.binary())])


# ---------------------------------------------------------------- blocks


def packed(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One block, ordered by id; its components in the narrowest type that holds them."""
    order = np.argsort(ids, kind="stable")
    ids, labels, rows = ids[order], labels[order], rows[order]
    top = np.abs(rows).max(initial=0)
    kind = next((k for k, most in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1)) if top <= most and (rows == np.trunc(rows)).all()), "<f8")
    n, dims = rows.shape
    columns = [[dims], [n], [8 * n * max(1, dims)], [ids.astype("<i8").tobytes()], [labels.astype("<i8").tobytes()], [kind], [rows.astype(kind).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED)], schema=_PACKED)


def unpacked(dims: int, n: int, ids: bytes, labels: bytes, kind: str, rows: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(rows, kind).astype(np.float64).reshape(n, dims)


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks of packed rows."""
    for k in range(batch.num_rows):
        r = {f.name: batch.column(f.name)[k].as_py() for f in _PACKED if f.name != "bytes"}
        yield unpacked(**r)


def pack(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that take part, those of one length together: ids, labels and floor(scale * x)."""
        for batch in batches:
            vectors = batch.column("vector")
            if isinstance(vectors, pa.ChunkedArray):
                vectors = vectors.combine_chunks()
            values = vectors.flatten()
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = (bad[ends] == bad[starts]) & pc.is_valid(vectors).to_numpy(zero_copy_only=False) & pc.is_valid(batch.column("label")).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch.column("id"), NO_ID).to_numpy(zero_copy_only=False)
            labels = pc.fill_null(batch.column("label"), 0).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths[good]):
                at = np.flatnonzero(good & (lengths == dims))
                for some in np.array_split(at, -(-len(at) // ROWS)):
                    with np.errstate(over="ignore"):
                        rows = np.nan_to_num(np.floor(scale * x[starts[some][:, None] + np.arange(dims)]))
                    yield packed(ids[some], labels[some], rows)

    return run


def pick_anchors(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors of the blocks, packed anew."""
        held: dict[int, list] = {}
        for batch in batches:
            for ids, labels, rows in blocks(batch):
                of = (ids % every == 0) & (ids != NO_ID)
                if of.any():
                    held.setdefault(rows.shape[1], []).append((ids[of], labels[of], rows[of]))
                for dims in [d for d, some in held.items() if sum(len(i) for i, _, _ in some) >= ROWS // 2]:
                    yield packed(*map(np.concatenate, zip(*held.pop(dims))))
        for some in held.values():
            yield packed(*map(np.concatenate, zip(*some)))

    return run


# ---------------------------------------------------------------- products and their best


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of a and of b. Matrices of float64 are exact below 2^53; larger sums are made from
    integers, and what a long can't hold ends at its greatest and least."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object)
    return np.clip(whole(a) @ whole(b).T, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best rows of each of n queries: greatest scores first, smallest ids among equal ones. Two of them, merged, are
    the best of both, so tiles and tasks may come in any order."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, -(2**63), np.int64)  # the k-th score, once there are k

    def add(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """A tile: scores[q, c] of query q and row c, where allowed."""
        allowed = allowed & (scores >= self.least[:, None])
        if allowed.sum() > 8 * self.k * len(scores) and scores.shape[1] > self.k:
            tile = np.where(allowed, scores, -(2**63))
            allowed &= scores >= np.partition(tile, -self.k, axis=1)[:, -self.k, None]
        q, c = np.nonzero(allowed)
        if not len(q):
            return
        query, score, row = np.concatenate([self.query, q]), np.concatenate([self.score, scores[q, c]]), np.concatenate([self.id, ids[c]])
        order = np.lexsort((row, ~score, query))  # ~x falls as x grows, at every x
        query, score, row = query[order], score[order], row[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[keep], row[keep]
        last = place[keep] == self.k - 1
        self.least[self.query[last]] = self.score[last]


def best_positives(wave, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's best rows of each anchor's label: (anchor, score, id)."""
        found = {}
        for batch in batches:
            for ids, labels, rows in blocks(batch):
                for b, (anchor_ids, anchor_labels, anchors) in enumerate(wave.value):
                    if anchors.shape[1] == rows.shape[1]:
                        best = found.setdefault(b, Best(len(anchors), k))
                        best.add(products(anchors, rows), ids, (anchor_labels[:, None] == labels) & (anchor_ids[:, None] != ids))
        first = np.cumsum([0] + [len(i) for i, _, _ in wave.value])
        for b, best in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(best.query + first[b]), pa.array(best.score), pa.array(best.id)], names=["anchor", "score", "id"])

    return run


def best_negatives(wave, windows, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's best rows of other labels inside each positive's window: (anchor, place, score, id)."""
        found = {}
        first = np.cumsum([0] + [len(i) for i, _, _ in wave.value])
        low, high = windows.value
        for batch in batches:
            for ids, labels, rows in blocks(batch):
                for b, (_, anchor_labels, anchors) in enumerate(wave.value):
                    if anchors.shape[1] != rows.shape[1]:
                        continue
                    scores, other = products(anchors, rows), anchor_labels[:, None] != labels
                    of = slice(first[b], first[b + 1])
                    for place in range(low.shape[1]):
                        best = found.setdefault((b, place), Best(len(anchors), k))
                        best.add(scores, ids, other & (scores >= low[of, place, None]) & (scores <= high[of, place, None]))
        for (b, place), best in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(best.query + first[b]), pa.array(np.full(len(best.query), place, np.int32)), pa.array(best.score), pa.array(best.id)], names=["anchor", "place", "score", "id"])

    return run


def merged(partial: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k best of all tasks' rows, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k)


def bounds(positive: int, window: tuple[int, int]) -> tuple[int, int]:
    """The scores s with window[0] * positive <= 100 * s <= window[1] * positive."""
    return -(-window[0] * positive // 100), window[1] * positive // 100


def waves_of(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Blocks, by name and bytes, in waves of at most so many bytes, or of one block."""
    out, room = [], 0
    for name, size in sizes:
        if not out or size > room:
            out.append([])
            room = most
        out[-1].append(name)
        room -= size
    return out


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: float = 256.0, wave_bytes: int = WAVE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor and each of its first
    `positives` rows of the same label the first `negatives` rows of other labels whose scores lie within `window` percent of
    the positive's. vectors has id, label and vector; anchors are the rows whose id is divisible by `every`.

    Rows with a null label, a null vector or any null or non-finite component take no part; vectors of other lengths than an
    anchor's don't meet it, empty ones score 0. A null id is no anchor and comes last among equal scores. Rows that repeat
    an id are rows of their own, and anchors too, but none is a positive of its own id. Ties go to the smaller id; of rows
    equal in score and id, which give equal output, as many as there is room for. A vector's length is bounded by one row's
    memory. Tables without rows or anchors give an empty table; other columns take no part.

    Each wave of anchors, of at most wave_bytes, costs two products with all rows."""
    spark = vectors.sparkSession
    source = pick(vectors, id="long", label="long", vector="array<double>")
    # dealt out evenly: the products cost far more than reading, and a small file would be one task
    source = source.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = scratch(source.mapInArrow(pack(scale), PACKED), "vectors")
    chosen = scratch(table.mapInArrow(pick_anchors(every), PACKED).withColumn("block", F.expr("uuid()")), "anchors")
    sizes = [(r["block"], r["bytes"]) for r in chosen.select("block", "bytes").orderBy("block").toLocalIterator()]  # a row for each block
    out = None
    for names in waves_of(sizes, wave_bytes):
        rows = chosen.where(F.col("block").isin(names)).orderBy("block").collect()  # at most wave_bytes
        anchors = [unpacked(*(r[f.name] for f in _PACKED if f.name != "bytes")) for r in rows]
        wave = spark.sparkContext.broadcast(anchors)
        first = merged(table.mapInArrow(best_positives(wave, positives), "anchor long, score long, id long"), ["anchor"], positives)
        first = scratch(first.withColumnRenamed("rank", "place"), "positives")
        count = sum(len(i) for i, _, _ in anchors)
        low, high = np.full((count, positives), 2**63 - 1, np.int64), np.full((count, positives), -(2**63), np.int64)
        for r in first.toLocalIterator():  # `positives` rows of each anchor of the wave
            low[r["anchor"], r["place"] - 1], high[r["anchor"], r["place"] - 1] = (min(max(x, -(2**63)), 2**63 - 1) for x in bounds(r["score"], window))
        windows = spark.sparkContext.broadcast((low, high))
        second = merged(table.mapInArrow(best_negatives(wave, windows, negatives), "anchor long, place int, score long, id long"), ["anchor", "place"], negatives)
        second = second.select("anchor", (F.col("place") + 1).alias("place"), "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
        pairs = first.select("anchor", "place", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")).join(second, ["anchor", "place"])
        ids = np.concatenate([i for i, _, _ in anchors])
        named = spark.createDataFrame(pa.table({"anchor": np.arange(count), "anchor_id": ids}))
        done = scratch(pairs.join(named, "anchor").select("anchor_id", _id("positive_id"), "rank", _id("negative_id"), "positive_score", "negative_score"), "negatives")
        wave.unpersist()
        windows.unpersist()
        out = done if out is None else out.unionByName(done)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def _id(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)


def digest(vectors: DataFrame) -> DataFrame:
    """Every seventh row's label is the next one; components are floor(256 x)."""
    rows = pick(vectors, vec_id="long", label="long", embedding="array<double>")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
