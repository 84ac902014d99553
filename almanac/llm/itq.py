"""Near-duplicate embeddings by iterative quantisation.

A rotation is learnt on a bounded sample so that the signs of the rotated, centred vectors make balanced binary codes
(iterative quantisation; several rotations from different starts give as many codes as are needed). Codes are cut into
substrings, and each substring is a key of one of the Hamming tables: vectors that agree in one substring meet and are
compared by the Hamming distance of whole codes. Only those with a near partner there send their vectors, by which the pairs
are reranked: what links is decided by the cosine of the original vectors. Equal vectors are one, with a count.

The number of tables follows from the threshold: partners at that very cosine are made for sampled vectors, and enough
tables are taken for them to meet with probability `recall` by the substrings of the learnt codes that they share, whatever
centring and projection leave of their angle; nearer pairs meet more surely. Buckets of any size are cut into chunks that
meet in pairs, so no task gets a bucket whole, and tasks send sums and spanning edges, never pairs. Vectors of each length
have a quantiser of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import components, forest, pick, scratch

#: Vectors that rotations are learnt on, at most about, over all lengths; and of a length, if it has so many.
SAMPLE, SAMPLE_LENGTH = 20_000, 500
ROUNDS = 30
#: Vectors of a chunk: a task compares two chunks.
CHUNK = 2048
#: Codes whose distance tells whether two vectors are to be reranked.
COMPARED = 4
#: Of fewer vectors of a length, all meet.
FEW = 256


class Codes:
    """The learnt quantiser: a centre and, for each code, a projection to its bits."""

    def __init__(self, sample: np.ndarray, n_codes: int, seed: int = 5):
        self.centre = sample.mean(axis=0)
        x = sample - self.centre
        _, _, directions = np.linalg.svd(x.T @ x)
        bits = min(64, x.shape[1])
        principal = directions[:bits].T
        rng = np.random.default_rng(seed)
        self.maps = []
        for _ in range(n_codes):
            v = x @ principal
            rotation, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
            for _ in range(ROUNDS):  # codes for the rotation, then the rotation that brings vectors nearest to their codes
                b = np.where(v @ rotation >= 0, 1.0, -1.0)
                u, _, w = np.linalg.svd(b.T @ v)
                rotation = (u @ w).T
            self.maps.append(principal @ rotation)
        self.bits = bits

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The codes' bits, one row of booleans for each vector and code after code."""
        return np.concatenate([(x - self.centre) @ m >= 0 for m in self.maps], axis=1)


class Plan:
    """What vectors of one length are dealt out and compared with: the substrings' width, their number, the codes, how many
    of these are compared, and by how many bits partners differ there at most."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, recall: float):
        bits = min(64, sample.shape[1])
        # a bucket of vectors that are apart from each other stays near a chunk's size
        self.width = 0 if n < FEW else min(bits, max(4, min(24, round(math.log2(max(2, n / 128))))))
        self.codes = Codes(sample, COMPARED)
        meet, self.most = agreement(self.codes, sample, threshold, self.width)
        self.tables = tables_for(meet, recall) if self.width else 1
        self.a_code = bits // self.width if self.width else 1
        if (needed := math.ceil(self.tables / self.a_code)) > COMPARED:
            self.codes = Codes(sample, needed)
        self.bits = bits
        self.places = [t // self.a_code * bits + t % self.a_code * self.width for t in range(self.tables)]
        self.powers = 1 << np.arange(self.width, dtype=np.int64)

    def keys(self, code: np.ndarray, tables: int | None = None) -> np.ndarray:
        """The first so many tables' keys of rows of code bits."""
        places = self.places[:tables]
        return np.stack([code[:, p : p + self.width] @ self.powers for p in places], axis=1) if places else np.zeros((len(code), 0), np.int64)

    def compared(self, code: np.ndarray) -> np.ndarray:
        return code[:, : COMPARED * self.bits]

    @property
    def seen(self) -> int:
        """Tables whose keys the compared codes hold."""
        return min(self.tables, COMPARED * self.a_code)


def agreement(codes: Codes, sample: np.ndarray, threshold: float, width: int, pairs: int = 4000, seed: int = 9) -> tuple[np.ndarray, int]:
    """For pairs at the threshold, a sampled unit vector and a partner in a random direction from it, the share of
    substrings in which each agrees, half a substring at least; and how many bits of the codes differ, for all but a
    thousandth of the pairs."""
    rng = np.random.default_rng(seed)
    x = sample[rng.integers(len(sample), size=pairs)]
    w = rng.standard_normal(x.shape)
    w -= (w * x).sum(axis=1, keepdims=True) * x
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * w
    same = codes.encode(x) == codes.encode(y)
    # a pair's bits agree with its own probability; substrings of so many bits then do with its power
    agree = np.clip((same[:, : codes.bits].sum(axis=1) + 0.5) / (codes.bits + 1), 0.5, 1.0)
    return agree**width, int(np.ceil(np.quantile((~same).sum(axis=1), 0.999)))


def tables_for(meet: np.ndarray, recall: float, most: int = 4096) -> int:
    """The least number of tables in which pairs that meet in one with these probabilities meet with `recall`."""
    low, high = 1, most
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if 1 - ((1 - meet) ** mid).mean() >= recall else (mid + 1, high)
    return low


def matrix(column, d: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(-1, d)


def unit_vector(e):
    """embedding / its norm, null for what is null, empty, zero, or holds a null or a non-finite number."""
    sound = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scale = F.array_max(F.transform(e, F.abs))
    units = F.transform(F.array(F.transform(e, lambda x: x / scale)), lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y))))[0]
    return F.when(F.coalesce(sound, F.lit(False)) & F.coalesce(scale > 0, F.lit(False)), units)


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors(vec_id, embedding).

    Rows link at a cosine of at least threshold, computed in double precision, with rows of the same length. Vectors that
    are null, empty, zero, or hold a null or a non-finite number link with nothing and are their own component, as is a row
    with a null vec_id that links with none with one; its component is null. Rows of one vec_id are vectors like others;
    equal vectors are told by 128 bits of hash. An empty table gives an empty table; further columns take no part."""
    vectors = pick(vectors, vec_id="long", embedding="array<double>")
    united = vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", unit_vector(F.col("embedding")).alias("unit"))
    is_one = F.col("unit").isNotNull()
    hashes = [F.when(is_one, F.xxhash64(F.lit(k), "unit")).alias(f"h{k}") for k in (1, 2)]
    rows = scratch(united.select("rid", "vec_id", *hashes, "unit"), "vectors")
    grouped = rows.where(is_one).groupBy("h1", "h2").agg(F.min("rid").alias("cid"), F.count("*").alias("m"), F.min("vec_id").alias("low"), F.first("unit").alias("unit"))
    classes = scratch(grouped.withColumn("d", F.size("unit")), "classes")
    plans = learn(classes, threshold, recall)
    sent = vectors.sparkSession.sparkContext.broadcast(plans)

    def deal(batches, coded: bool):
        for batch in batches:
            lengths = batch.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                if (plan := sent.value.get(int(d))) is None:
                    continue  # the only one of its length
                some = batch.filter(pa.array(lengths == d))
                code = plan.codes.encode(matrix(some.column(2), int(d)))
                keys, n = plan.keys(code), len(some)
                packed = np.packbits(plan.compared(code), axis=1)
                blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * packed.shape[1]).tobytes()), pa.py_buffer(packed.tobytes())])
                for t in range(plan.tables):
                    columns = [some.column(1), pa.array(np.full(n, t, np.int32)), pa.array(keys[:, t])]
                    yield pa.RecordBatch.from_arrays([*columns, some.column(0), blobs] if coded else columns, ["d", "t", "key", "cid", "code"][: 5 if coded else 3])

    vectors_of = classes.select("cid", "d", "unit")
    dealt = vectors_of.mapInArrow(lambda batches: deal(batches, True), "d int, t int, key long, cid long, code binary")
    sizes = vectors_of.mapInArrow(lambda batches: deal(batches, False), "d int, t int, key long").groupBy("d", "t", "key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = scratch(sizes.withColumn("chunks", F.ceil(F.col("n") / CHUNK)), "buckets")
    # a vector goes to every pair of chunks that has its own; one that is alone in its bucket to none
    chunked = dealt.join(buckets.drop("n"), ["d", "t", "key"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("chunks")))
    spread = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tile = ["d", "t", "key", "i", "j"]
    tiles = spread.select("d", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "code")

    def halves(table):
        i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
        own = table.column("own").to_numpy()
        return np.flatnonzero(own == i), np.flatnonzero(own == j), i == j

    def near(table):
        """The members that have a partner within the Hamming bound that they haven't met in a table before."""
        d, t = (table.column(c)[0].as_py() for c in ("d", "t"))
        plan = sent.value[d]
        raw = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(table), -1)
        keys = plan.keys(np.unpackbits(raw, axis=1)[:, : COMPARED * plan.bits], min(t, plan.seen))
        words = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), np.uint8)
        words[:, : raw.shape[1]] = raw
        words = words.view(np.uint64)
        left, right, same = halves(table)
        active = np.zeros(len(table), bool)
        for k in range(0, len(left), 128):
            part = left[k : k + 128]
            apart = np.zeros((len(part), len(right)), np.uint16)
            for w in range(words.shape[1]):
                apart += np.bitwise_count(words[part, w][:, None] ^ words[right, w][None, :])
            ok = apart <= plan.most
            if same:
                ok &= part[:, None] < right[None, :]
            for s in range(keys.shape[1]):
                if not ok.any():
                    break
                ok &= keys[part, s][:, None] != keys[right, s][None, :]
            active[part] |= ok.any(axis=1)
            active[right] |= ok.any(axis=0)
        return table.select([*tile, "own", "cid"]).filter(pa.array(active))

    kept = "d int, t int, key long, i long, j long, own long, cid long"
    active = scratch(tiles.groupBy(*tile).applyInArrow(near, kept), "active")

    def link(table):
        """Two kinds of rows: a vector's links here (v is null), and the edges that span what is linked here."""
        d, t = (table.column(c)[0].as_py() for c in ("d", "t"))
        plan = sent.value[d]
        x = matrix(table.column("unit").combine_chunks(), d)
        cid, m = table.column("cid").to_numpy(), table.column("m").to_numpy()
        keys = plan.keys(plan.codes.encode(x), t)
        left, right, same = halves(table)
        us, vs, links = [], [], np.zeros(len(cid))
        for k in range(0, len(left), 128):
            part = left[k : k + 128]
            ok = x[part] @ x[right].T >= threshold
            if same:
                ok &= part[:, None] < right[None, :]
            p, q = np.nonzero(ok)
            p, q = part[p], right[q]
            first = np.ones(len(p), bool)
            for s in range(t):  # a pair counts in the first table in which it meets
                first &= keys[p, s] != keys[q, s]
            p, q = p[first], q[first]
            if len(p):
                links += np.bincount(p, m[q], len(cid)) + np.bincount(q, m[p], len(cid))
                u, v = forest(p, q)
                us.append(u)
                vs.append(v)
        u, v = forest(np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2
        some = np.flatnonzero(links)
        return pa.table({"u": np.concatenate([cid[some], cid[u]]), "v": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(cid[v], pa.int64())]), "n": np.concatenate([links[some].astype(np.int64), np.zeros(len(u), np.int64)])})

    found = scratch(active.join(classes.select("cid", "m", "unit"), "cid").groupBy(*tile).applyInArrow(link, "u long, v long, n long"), "links")
    links = found.where("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("n"))
    roots = components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "cid")
    placed = classes.select("h1", "h2", "cid", "m", "low").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component"))
    placed = placed.join(lowest, "root").join(links, "cid", "left").select("h1", "h2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component")
    out = rows.select("vec_id", "h1", "h2").join(placed, ["h1", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component")))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def learn(classes: DataFrame, threshold: float, recall: float) -> dict[int, Plan]:
    """A plan for each length of which classes(cid, d, unit) has two vectors at least."""
    lengths = classes.groupBy("d").agg(F.count("*").alias("n")).where("n > 1")
    counts = {r["d"]: r["n"] for r in lengths.collect()}  # as many rows as there are lengths
    share = F.greatest(F.lit(SAMPLE / max(1, sum(counts.values()))), SAMPLE_LENGTH / F.col("n"))
    toss = F.pmod(F.xxhash64("cid", F.lit("itq")), F.lit(1_000_000)) < share * 1_000_000 + 1
    sample = classes.join(F.broadcast(lengths), "d").where(toss).select("d", "unit").toArrow()
    d = sample.column("d").to_numpy()
    return {k: Plan(matrix(sample.filter(pa.array(d == k)).column("unit").combine_chunks(), k), n, threshold, recall) for k, n in counts.items() if (d == k).any()}
