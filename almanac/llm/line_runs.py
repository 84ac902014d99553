"""Line dedup by levelled sorted runs of line hashes.

The seen lines are kept as sorted runs, each a Parquet table of (key, owner) in as many buckets as shuffles have
partitions, one file each, sorted by key. A new batch of documents is counted by key, which deals it out like the runs,
and meets them run by run in merge joins to which the runs come as they lie, without an exchange or a sort: lines that no
run has are new, and go out as a run of level 0; the others are repeats. When a level holds `fanout` runs, they are merged into
one of the next level, so after n batches there are about fanout * log(n) runs to join, and each key
is rewritten log(n) times.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import Words, arrow_rows, drop_scratch, pick, scratch, shared_dir

LINES = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])
KEYS = ["k1", "k2"]


def _lines_of(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text position and 128-bit key of every line that has at least min_chars code points in its key."""
    words = Words(texts, lines=True)
    long = pc.utf8_length(words.flat).to_numpy(zero_copy_only=False) >= min_chars
    return words.doc[long], words.hashes(1)[long].view(np.int64), words.hashes(2)[long].view(np.int64)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, k1, k2): the keys of each text's lines, repeats included."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            doc, k1, k2 = _lines_of(batch.column(1), min_chars)
            yield arrow_rows(LINES, doc_id=ids[doc], k1=k1, k2=k2)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long")


#: A bucket's one file is sorted, and plans may rely on it while this is set.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """The runs, by level. add() takes a batch's lines and returns the seen ones with their owners."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def found(self, lines: DataFrame) -> DataFrame:
        """(k1, k2, first, last, owner) of the distinct keys in lines(doc_id, k1, k2); owner is the runs', if they have it."""
        out = lines.groupBy(*KEYS).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        owners = [F.lit(None).cast("long")]
        for n, run in enumerate(self.runs()):
            out = out.join(run.withColumnRenamed("owner", f"owner_{n}").hint("merge"), KEYS, "left")
            owners.append(F.col(f"owner_{n}"))
        return out.select(*KEYS, "first", "last", F.coalesce(*owners).alias("owner"))

    def add(self, lines: DataFrame) -> DataFrame:
        """Owners of the keys in lines(doc_id, k1, k2) that more than one document holds by now: (k1, k2, owner)."""
        before = self.spark.conf.get(SORTED_BUCKETS)
        self.spark.conf.set(SORTED_BUCKETS, "true")
        try:
            found = scratch(self.found(lines), "found")
            new = found.where("owner is null").select(*KEYS, F.col("first").alias("owner")).repartition(self.buckets, *KEYS)
            self.levels[0].append(self._write(new))
            self._compact()
        finally:
            self.spark.conf.set(SORTED_BUCKETS, before)
        return found.where("owner is not null or first <> last").select(*KEYS, F.coalesce("owner", "first").alias("owner"))

    def drop(self) -> None:
        for run in self.runs():
            self._drop(run)
        self.levels = [[]]

    def _write(self, run: DataFrame) -> DataFrame:
        name = f"almanac_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/almanac/{name}"
        run.write.format("parquet").option("path", path).bucketBy(self.buckets, *KEYS).sortBy(*KEYS).saveAsTable(name)
        out = self.spark.table(name)
        out.scratch_path, out.table_name = path, name
        return out

    def _drop(self, run: DataFrame) -> None:
        self.spark.sql(f"DROP TABLE {run.table_name}")
        drop_scratch(run)

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs = self.levels[level]
            # read as plain files: the union of bucketed tables would pass for dealt out by key, which it isn't
            merged = self.spark.read.schema(runs[0].schema).parquet(*[r.scratch_path for r in runs])
            merged = self._write(merged.repartition(self.buckets, *KEYS))
            for r in runs:
                self._drop(r)
            self.levels[level] = []
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1


def repeated_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(doc_id, drop: array of (k1, k2)): the lines that each document loses. The documents are taken in batches by
    ascending doc_id, so the first holder that the runs know is always the smallest doc_id."""
    docs = pick(docs, doc_id="long", text="string")
    spark = docs.sparkSession
    edges = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    batch = sum([(F.col("doc_id") > F.lit(int(e))).cast("int") for e in edges], F.lit(0))
    lines = scratch(line_keys(docs, min_chars).withColumn("batch", batch), "lines", ["batch"])
    runs, owners = LineRuns(spark, fanout), None
    for b in range(len(edges) + 1):
        part = runs.add(lines.where(F.col("batch") == b).drop("batch")).withColumn("batch", F.lit(b))
        owners = part if owners is None else owners.unionByName(part)
    runs.drop()
    # a key that repeats only in a later batch is owned there by the run that has it: every row of a batch meets its batch's owners
    gone = lines.join(owners, ["batch", *KEYS]).where("doc_id <> owner")
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*KEYS))).alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3, also: dict[str, str] | None = None) -> DataFrame:
    """doc_id, the columns named in `also` (with their types), n_lines (lines before), n_dropped and kept_text.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least min_chars code
    points that two documents hold stay in the smallest doc_id alone, there with all their copies. Null and empty texts
    have one empty line; very long texts and lines are taken whole; a null doc_id owns and loses nothing; rows of one
    doc_id count as one document, so they tie; an empty table gives an empty table; further columns take no part."""
    also = also or {}
    docs = pick(docs, doc_id="long", text="string", **also)
    gone = repeated_lines(docs, min_chars, batches, fanout)

    def run(parts):
        for batch in parts:
            texts = pc.fill_null(batch.column("text"), "")
            pairs = batch.column("drop")
            lost = set()
            pair_doc = pc.list_parent_indices(pairs).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(pairs)
            if len(flat):
                k1, k2 = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                lost = set(zip(pair_doc.tolist(), k1.tolist(), k2.tolist(), strict=True))
            touched = np.zeros(len(batch), bool)
            touched[pair_doc] = True
            n_lines, n_dropped, kept = [], [], []
            words = Words(texts.filter(pa.array(touched)), lines=True) if lost else None
            keys = {}
            if words:
                back = np.flatnonzero(touched)
                h1, h2 = words.hashes(1).view(np.int64).tolist(), words.hashes(2).view(np.int64).tolist()
                long = (pc.utf8_length(words.flat).to_numpy(zero_copy_only=False) >= min_chars).tolist()
                for d, a, b, ok in zip(back[words.doc].tolist(), h1, h2, long, strict=True):
                    keys.setdefault(d, []).append(ok and (d, a, b) in lost)
            for i, text in enumerate(texts.to_pylist()):
                flags = keys.get(i)
                n = text.count("\n") + 1
                n_lines.append(n)
                if flags is None:
                    n_dropped.append(0)
                    kept.append(text)
                else:
                    left = [x for x, f in zip(text.split("\n"), flags, strict=True) if not f]
                    n_dropped.append(n - len(left))
                    kept.append("\n".join(left))
            rest = [batch.column(c) for c in ("doc_id", *also)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", *also, "n_lines", "n_dropped", "kept_text"])

    schema = ", ".join(f"`{c}` {t}" for c, t in {"doc_id": "long", **also, "n_lines": "long", "n_dropped": "long", "kept_text": "string"}.items())
    return docs.join(gone, "doc_id", "left").mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The operator's result by document as counts and a hash of the kept text."""
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: The same result in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(o.owner) FILTER (WHERE o.owner <> l.doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.owner IS NULL OR o.owner = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN o USING (k) GROUP BY l.doc_id
"""
