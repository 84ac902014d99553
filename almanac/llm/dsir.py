"""Quality by importance resampling.

Two generative models over hashed word n-grams are compared: the target's, from labelled good documents, and the raw
corpus', from all of it. A document's log weight is the ratio of its probabilities under both, less the rate per n-gram
that good documents have, so that length alone says nothing. The documents kept are drawn without replacement by weight,
which is the Gumbel top-k: the k documents with the greatest log weight plus Gumbel noise. k is the number of documents
whose log weight reaches the cut that tells labelled good and bad documents apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import hash_slices, pick, scratch, splitmix

#: Hash buckets of the n-gram models: what is collected and broadcast are two arrays of this size.
BUCKETS = 1 << 18
#: The target model is fitted on at most about so many labelled documents; the raw model on all documents.
LABELLED = 40_000
SMOOTH, MARGIN = 3.0, 0.7


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text position, bucket) of every word and word pair; a word that follows itself is one and the same pair."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, parent = pc.list_flatten(parts), pc.list_parent_indices(parts)
    keep = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(keep).dictionary_encode()
    doc = parent.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    uniques = coded.dictionary
    offsets = np.frombuffer(uniques.buffers()[1], np.int32, len(uniques) + 1, uniques.offset * 4).astype(np.int64)
    data = np.frombuffer(uniques.buffers()[2], np.uint8)
    h = hash_slices(data, offsets)[coded.indices.to_numpy(zero_copy_only=False)]
    pair = splitmix(h[:-1] * np.uint64(0x9FB21C651E98DF25) ^ h[1:])
    pair[h[:-1] == h[1:]] = 1
    both = doc[:-1] == doc[1:]
    half = np.uint64(BUCKETS // 2)
    return np.concatenate([doc, doc[1:][both]]), np.concatenate([h % half, pair[both] % half + half]).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Count of each bucket over docs(text), as an array of BUCKETS."""

    def run(batches):
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            sums += np.bincount(features(batch.column(0))[1], minlength=BUCKETS)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["b", "n"])

    out = np.zeros(BUCKETS, np.int64)
    rows = docs.select("text").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out[rows["b"].to_numpy(int)] = rows["n"].to_numpy(int)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Each bucket's log of its probability under the target's model over that under the raw model, words and pairs by
    themselves. The target's model is smoothed towards the raw one by SMOOTH counts a bucket, so what the labelled sample
    is too small to have seen says nothing; ratios within MARGIN, such as those between languages of which unequal shares
    are good, are none, and others count by what they exceed it."""
    t, r = target.reshape(2, -1).astype(float), raw.reshape(2, -1).astype(float)
    expected = r / np.maximum(1.0, r.sum(axis=1, keepdims=True)) * t.sum(axis=1, keepdims=True)
    ratio = np.log((t + SMOOTH) / (expected + SMOOTH)).ravel()
    return np.sign(ratio) * np.maximum(np.abs(ratio) - MARGIN, 0.0)


def weigh(docs: DataFrame, ratio: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with log_weight, the sum of the n-grams' log ratios, and n_features."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))

    def run(batches):
        for batch in batches:
            doc, b = features(batch.column("text"))
            w = np.bincount(doc, sent.value[b], minlength=len(batch)).astype(float)  # whole numbers if no text has a word
            n = np.bincount(doc, minlength=len(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(w), pa.array(n.astype(np.int64))], [*keep, "log_weight", "n_features"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{schema}, log_weight double, n_features long")


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The log weight from which on documents are good. A share of the good ones lost counts four times a share of the
    bad ones caught."""
    if not len(weights) or good.all() or not good.any():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    caught = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    at = int(np.argmax(caught - 4 * lost))
    if at == 0:
        return -np.inf
    return float((w[at - 1] + w[at]) / 2) if at < len(w) else np.inf


def kth_greatest(keys: DataFrame, k: int, few: int = 50_000) -> float:
    """The k-th greatest of keys(key), exactly: histograms narrow the range in which it lies, round by round, until few
    enough keys are left there to be sorted at one place."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k <= 0 or n == 0:
        return np.inf
    if k >= n:
        return low
    inside, above = n, 0
    while inside > few and low < high:
        step = (high - low) / 1024
        if low + step == low:
            break
        bin_of = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(step)), F.lit(1023))
        rows = keys.where(F.col("key").between(low, high)).groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high, inside = r["low"], r["high"], r["n"]
                break
            above += r["n"]
    if low == high:
        return low
    rest = np.sort(keys.where(F.col("key").between(low, high)).toPandas()["key"].to_numpy())[::-1]
    return float(rest[k - above - 1])


def gumbel(seed: int):
    """Gumbel noise that depends on doc_id and seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, seed: int = 11, also: dict[str, str] | None = None) -> DataFrame:
    """doc_id, the columns named in `also` (text among them, if wanted), log_weight, n_features and kept for each row of
    docs.

    labels(doc_id, quality, toxic) has good documents (quality 1, toxic 0) and bad ones; a label with a null counts as
    bad. A document without words has the weight 0; a very long one weighs by all its n-grams. Rows that tie with the
    k-th, such as repeated ones, are kept with it. Without good or without bad labels, all documents are kept. An empty
    table gives an empty table; a null doc_id has no label and its own noise; further columns take no part."""
    also = also or {}
    docs = pick(docs, doc_id="long", text="string", **{c: t for c, t in also.items() if c != "text"})
    labels = pick(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null")
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    labels = labels.groupBy("doc_id").agg(F.min(good).alias("good"))
    share = min(1.0, LABELLED / max(1, labels.count()))
    toss = F.pmod(F.xxhash64("doc_id", F.lit("label")), F.lit(2_000_000))
    labels = labels.withColumn("toss", toss).where(F.col("toss") < int(share * 2_000_000))
    # the sampled labels are a fixed number of ids, so texts stay where they are
    sample = scratch(docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id"), "labelled")
    fit, hold = sample.where("toss % 4 <> 0"), sample.where("toss % 4 = 0")

    ratio = log_ratio(bucket_counts(fit.where("good")), bucket_counts(docs))
    held = weigh(hold, ratio, ["good"]).toPandas()
    is_good = held["good"].to_numpy(bool)
    n = held["n_features"].to_numpy(float)
    usual = float(held["log_weight"].to_numpy()[is_good].sum() / max(1.0, n[is_good].sum()))
    cut = best_cut(held["log_weight"].to_numpy() - usual * n, is_good)

    keyed = weigh(docs, ratio - usual, ["doc_id", *also]).withColumn("key", F.col("log_weight") + gumbel(seed))
    scored = scratch(keyed, "scored")  # each text is weighed once
    k = scored.where(F.col("log_weight") >= F.lit(cut)).count()
    least = kth_greatest(scored.select("key"), k)
    return scored.withColumn("kept", F.col("key") >= F.lit(least)).drop("key")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return resample(docs, labels).select("doc_id", "n_features", F.round("log_weight", 6).alias("log_weight"), "kept")
