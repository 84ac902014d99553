"""What the operators of this subpackage share: scratch tables in the shared folder, word
splitting and hashing over Arrow columns, and connected components as DataFrame rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are of so many bytes; operators make temporaries of some ten times that.
BATCH_BYTES = "4m"

WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and all run on one machine,
    a folder of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        root = "file://" + tempfile.mkdtemp(prefix="almanac-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there, so a lost executor costs a
    re-read, and what is decided once (a row id, a batch) stays decided. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/almanac/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", compression).parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete a table that scratch() wrote and nothing reads any more."""
    spark, path = df.sparkSession, df.scratch_path
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


# ---------------------------------------------------------------- words of Arrow text columns


class Words:
    """The words of a batch of texts, flat: word i is data[start[i]:end[i]], and doc[i] is its text's position."""

    def __init__(self, texts: pa.Array, lower: bool = True, lines: bool = False):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        parts = pc.split_pattern(texts, "\n") if lines else pc.ascii_split_whitespace(texts)
        flat, parent = pc.list_flatten(parts), pc.list_parent_indices(parts)
        if lines:
            flat = pc.ascii_trim_whitespace(flat)
        else:
            keep = pc.greater(pc.binary_length(flat), 0)
            flat, parent = flat.filter(keep), parent.filter(keep)
        self.flat, self.n_docs = flat, len(texts)
        self.doc = parent.to_numpy(zero_copy_only=False).astype(np.int64)
        wide = pa.types.is_large_string(flat.type)
        offsets = np.frombuffer(flat.buffers()[1], dtype=np.int64 if wide else np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        self.offsets = offsets.astype(np.int64)
        self.data = np.frombuffer(flat.buffers()[2], dtype=np.uint8) if len(flat) and flat.buffers()[2] is not None else np.zeros(0, np.uint8)

    @property
    def start(self) -> np.ndarray:
        return self.offsets[:-1]

    @property
    def end(self) -> np.ndarray:
        return self.offsets[1:]

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_slices(self.data, self.offsets, seed)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of the SplitMix generator, on each element."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_slices(data: np.ndarray, offsets: np.ndarray, seed: int = 0, chunk: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each of the adjoining slices of data that offsets bound: random weights by position, summed
    modulo 2**64 and mixed. Two different strings meet with a chance of about 2**-56."""
    n = len(offsets) - 1
    out = np.zeros(n, dtype=np.uint64)
    if n == 0:
        return out
    longest = int((offsets[1:] - offsets[:-1]).max(initial=0))
    weights = splitmix(np.arange(longest, dtype=np.uint64) + np.uint64((seed * 0x632BE5AB1F4D + 0x51ED27) & 0xFFFFFFFFFFFFFFFF)) | np.uint64(1)
    lo = 0
    while lo < n:  # in pieces, so that the temporaries stay small
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, side="right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        lengths = offsets[lo + 1 : hi + 1] - offsets[lo:hi]
        if b > a:
            starts = offsets[lo:hi] - a
            terms = (data[a:b].astype(np.uint64) + np.uint64(1)) * weights[np.arange(b - a) - np.repeat(starts, lengths)]
            full = lengths > 0
            sums = np.add.reduceat(terms, starts[full])
            out[lo:hi][full] = sums
        lo = hi
    lengths = (offsets[1:] - offsets[:-1]).astype(np.uint64)
    return splitmix(out + lengths * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def pick(df: DataFrame, **columns) -> DataFrame:
    """Only the named columns, as given types; a column that is missing is null. Other columns of df, whatever they are
    called, take no part. Python workers get the rows in Arrow batches of a few MB, so that their memory is bounded by
    that or by one row."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[n]}`") if n in have else F.lit(None)).cast(t).alias(n) for n, t in columns.items()])


# ---------------------------------------------------------------- small graphs in numpy, large ones in Spark


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph with edges u[i]-v[i], as stars: (node, smallest node of its component), without
    the smallest itself. At most one edge for each node, however many edges come in."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        low, high = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
        order = np.argsort(-low, kind="stable")
        root[high[order]] = low[order]  # the smallest is written last
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(u, v): (node, root), root being the smallest node reachable, for each node with an
    edge to another. Alternates large-star and small-star rounds, in which each node's neighbours meet its smallest
    neighbour by joins and partial minima, so no node's neighbours gather in one task. Each round is written to the
    shared folder, so a lost executor costs one round."""
    pairs = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = scratch(pairs, "edges")
    mark = F.struct(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)))
    before = pairs.agg(mark).first()[0]
    if before[0] == 0:
        return pairs.select(F.col("v").alias("node"), F.col("u").alias("root"))
    for _ in range(max_rounds):
        # large-star: greater neighbours of a node hang from its smallest neighbour
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small-star: a node's smaller neighbours, and itself, hang from the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        tied = large.join(low, "v")
        small = tied.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(low.select(F.col("m").alias("u"), "v")).distinct()
        after_pairs = scratch(small, "edges")
        drop_scratch(pairs)
        pairs, after = after_pairs, after_pairs.agg(mark).first()[0]
        if after == before:
            return pairs.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = after
    raise RuntimeError("the components didn't settle")
