"""Document fingerprints by I-Match over randomised lexicons.

The lexicon is what lies in a band of document frequencies: words of more than a share of all documents say nothing, words of
fewer than another share are noise. As both edges are shares, the lexicon holds at most (mean distinct words of a text) /
(lower share) words however many documents there are. Subsets of it are drawn by hashes of the words, some dense and some
sparse; a text's distinct terms in each subset, sorted, are hashed to a signature, and the signatures are the fingerprint.
Two fingerprints are as alike as the share of equal signatures at the sparsest level that still says something about them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import Words, pick, scratch, splitmix

#: Terms in more than the first and in fewer than the second share of documents make no part of the lexicon.
COMMON, RARE = 1 / 8, 1 / 2048
#: Sizes of random subsets, as the bits that a term's hash must have zero: a quarter, a sixteenth, ... of the lexicon; so many
#: of each.
LEVELS, EACH = (2, 4, 6, 8), 16
#: Texts with fewer terms of the lexicon take all their words instead.
FEWEST = 4
#: Terms that are broadcast: 32 MiB. A band with more begins at the next share, doubled, where it fits.
MOST = 1 << 22
#: Terms that a counting task holds before it passes them on.
HELD = 1 << 20
#: Bytes of text whose words are taken at once, or one text, whatever a batch holds: temporaries take many times that. A run's
#: rows count with the bytes of their results as well.
PIECE, RESULT = 1 << 19, 1 << 10

SIGNATURES = len(LEVELS) * EACH


def subsets(h: np.ndarray) -> np.ndarray:
    """For each term's hash, a bit for each of the 64 subsets that it is in."""
    out = np.zeros(len(h), np.uint64)
    for level, bits in enumerate(LEVELS):
        per = min(EACH, 64 // bits)
        for k in range(EACH):
            if k % per == 0:
                drawn = splitmix(h ^ np.uint64(1000 * level + k + 1))
            field = (drawn >> np.uint64(bits * (k % per))) & np.uint64((1 << bits) - 1)
            out |= (field == 0).astype(np.uint64) << np.uint64(EACH * level + k)
    return out


def distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of all texts' words, sorted; then the texts' distinct terms, sorted by text and hash: their text's
    position and their place among the hashes."""
    words = Words(texts)
    terms, at = np.unique(words.hashes(), return_inverse=True)
    pairs = np.unique(words.doc * max(1, len(terms)) + at)
    return terms, *np.divmod(pairs, max(1, len(terms)))


def fingerprints(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """A row of signatures of 32 bits for each text; 0 is that of no term. lexicon: sorted hashes."""
    terms, doc, at = distinct_terms(texts)
    out = np.zeros((len(texts), SIGNATURES), np.uint32)
    if not len(terms):
        return out
    place = np.minimum(np.searchsorted(lexicon, terms), max(0, len(lexicon) - 1))
    known = lexicon[place] == terms if len(lexicon) else np.zeros(len(terms), bool)
    few = np.bincount(doc[known[at]], minlength=len(texts)) < FEWEST
    taken = known[at] | few[doc]
    doc, at = doc[taken], at[taken]
    member = subsets(terms)[at]
    rank = splitmix(np.arange(np.bincount(doc, minlength=1).max(initial=0), dtype=np.uint64))
    for k in range(SIGNATURES):
        of = np.flatnonzero(member & np.uint64(1 << k))
        if len(of):
            docs, first, count = np.unique(doc[of], return_index=True, return_counts=True)
            position = np.arange(len(of)) - np.repeat(first, count)
            total = np.add.reduceat(splitmix(terms[at[of]] ^ rank[position]), first)
            out[docs, k] = np.maximum(splitmix(total + count.astype(np.uint64)) >> np.uint64(32), np.uint64(1))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How alike fingerprints are, row by row, from 0 to 1. Equal ones are 1. Of the subsets that hold a term of either, the
    share with equal signatures, at the sparsest level with half of its subsets among them, or at the densest."""
    shape = (len(a), len(LEVELS), EACH)
    some = ((a | b) != 0).reshape(shape)
    n = some.sum(axis=2)
    equal = ((a == b).reshape(shape) & some).sum(axis=2)
    enough = n >= EACH // 2
    level = np.where(enough.any(axis=1), len(LEVELS) - 1 - np.argmax(enough[:, ::-1], axis=1), 0)
    rows = np.arange(len(a))
    share = equal[rows, level] / np.maximum(1, n[rows, level])
    return np.where((a == b).all(axis=1), 1.0, share)


def written(prints: np.ndarray) -> list[str]:
    """Eight hexadecimal digits for each signature."""
    return [row.tobytes().hex() for row in prints.astype(">u4")]


# ---------------------------------------------------------------- the lexicon


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of about PIECE bytes, at least one text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, side="right")))
        yield texts[lo:hi]
        lo = hi


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task that hold each term, passed on when so many terms are held."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def together() -> tuple[np.ndarray, np.ndarray]:
        terms, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        return terms, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def batch_of(terms: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

    loose = 0  # terms that came since parts were put together
    for batch in batches:
        for texts in pieces(batch.column("text")):
            terms, _, at = distinct_terms(texts)
            parts.append((terms, np.bincount(at, minlength=len(terms)).astype(np.int64)))
            loose += len(terms)
            if loose > HELD // 2:
                parts[:] = [together()]
                loose = 0
                if len(parts[0][0]) > HELD:
                    yield batch_of(*parts.pop())
    if parts:
        yield batch_of(*together())


def lexicon_of(texts: DataFrame, common: float = COMMON, rare: float = RARE, most: int = MOST) -> np.ndarray:
    """The sorted hashes of the terms in the band, at most `most`. All texts are counted; a term counts once a text."""
    rows = texts.count()
    band = scratch(texts.select("text").mapInArrow(count_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n").between(F.lit(rare * rows), F.lit(common * rows))), "terms")
    low = rare * rows
    while band.where(F.col("n") >= F.lit(low)).count() > most:
        low *= 2
    found = band.where(F.col("n") >= F.lit(low)).select("term").toArrow().column("term").to_numpy()
    return np.sort(found.view(np.uint64))


# ---------------------------------------------------------------- texts beside the next ones


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the other."""
    tail = len(text) // 4
    return text[: len(text) - tail] + after[:tail]


def results(ids: list, texts: list[str], nexts: list[str], lexicon: np.ndarray) -> list[pa.Array]:
    """SCHEMA's columns for texts and the texts that come after them."""
    made = [edited(t, u) for t, u in zip(texts, nexts)]
    chain = nexts[:-1] == texts[1:]  # as in a sorted run: then only the last one's next is fingerprinted anew
    prints = fingerprints(pa.array(texts + made + (nexts[-1:] if chain else nexts), pa.large_string()), lexicon)
    n = len(texts)
    own, of_made, after = prints[:n], prints[n : 2 * n], prints[2 * n :]
    if chain:
        after = np.concatenate([own[1:], after])
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in made]
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), pa.array(written(own)), pa.array(written(of_made)), pa.array(likeness(own, of_made)), pa.array(likeness(own, after))]


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: What is dealt out and sorted: texts are compressed for that.
DEALT = "doc_id long, tie long, body binary"
#: The first and the last text of a run, whose neighbours are in other runs, go along.
RUN = f"{SCHEMA}, part int, head string, tail string"


def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        bodies = pa.array([squeeze(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), bodies], names=["doc_id", "tie", "body"])


def sorted_runs(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's rows in order, each beside the next; the last one stays open, and is given with its text."""
        ids, texts, part, first, size = [], [], None, True, 0
        expand = zstandard.ZstdDecompressor().decompress

        def rows(columns: list, n: int, head: list, tail: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int32()), pa.array(head, pa.string()), pa.array(tail, pa.string())], names=[*NAMES, "part", "head", "tail"])

        def closed() -> pa.RecordBatch:
            n = len(ids) - 1
            return rows(results(ids[:-1], texts[:-1], texts[1:], lexicon.value), n, [texts[0] if first else None] + [None] * (n - 1), [None] * n)

        for batch in batches:
            if part is None and batch.num_rows:
                part = batch.column("part")[0].as_py()
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("body")):
                text = expand(body.as_buffer())  # a batch of bodies may hold any number of times as much text
                ids.append(doc_id)
                texts.append(text.decode())
                size += len(text) + RESULT
                if size > PIECE and len(ids) > 1:
                    yield closed()
                    ids, texts, first, size = ids[-1:], texts[-1:], False, len(text) + RESULT
        if len(ids) > 1:
            yield closed()
            ids, texts, first = ids[-1:], texts[-1:], False
        if ids:
            none = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.string())] * 3, *[pa.nulls(1, pa.float64())] * 2]
            none[0] = pa.array(ids, pa.int64())
            yield rows(none, 1, [texts[0] if first else None], [texts[0]])

    return run


def beside(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a row for each run, with two whole texts
                doc_id, tail, head = (batch.column(c)[k].as_py() for c in ("doc_id", "tail", "head"))
                yield pa.RecordBatch.from_arrays(results([doc_id], [tail], [head], lexicon.value), names=NAMES)

    return run


def fingerprint_edits(docs: DataFrame, common: float = COMMON, rare: float = RARE, most: int = MOST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each row of docs: its
    fingerprint, that of its text with the last quarter replaced by the beginning of the next document's, and how alike its
    own is to that and to the next document's.

    Documents come in the order of doc_id, a null one last, rows that share one in that of their texts' xxhash64; after the last comes
    the first, so a single row is its own next. A null or empty text has no terms and signatures of zeros, which are alike to
    each other. Equal texts have equal fingerprints. Texts with fewer than FEWEST terms in the band take all their words. A
    text of any length is taken whole, and a task holds a batch, a piece and two texts. An empty table gives an empty table; columns
    other than doc_id and text take no part.

    The texts are dealt out, compressed, by ranges of doc_id and sorted there, once; what a run's last text needs of the next run's first
    is joined afterwards, a row for each run. Rows that share a doc_id lie in one run."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    lexicon = spark.sparkContext.broadcast(lexicon_of(docs, common, rare, most))
    order = F.col("doc_id").asc_nulls_last()
    bodies = docs.withColumn("tie", F.xxhash64("text")).mapInArrow(compressed, DEALT)
    dealt = bodies.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order, "tie")
    runs = scratch(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(sorted_runs(lexicon), RUN), "runs")
    parts = [r["part"] for r in runs.where("head is not null").select("part").orderBy("part").collect()]  # a row for each run
    if not parts:
        return runs.select(*NAMES)
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    heads = runs.where("head is not null").select(F.col("part").alias("after"), "head")
    tails = runs.where("tail is not null").select("doc_id", "part", "tail").join(F.broadcast(follows), "part").join(heads, "after")
    return runs.where("tail is null").select(*NAMES).unionByName(tails.select("doc_id", "tail", "head").mapInArrow(beside(lexicon), SCHEMA))


def digest(docs: DataFrame) -> DataFrame:
    return fingerprint_edits(docs)
