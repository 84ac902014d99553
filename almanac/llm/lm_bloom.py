"""Language-model scoring with a log-frequency Bloom filter.

Counts of all words and word pairs of the training part are quantised to 1 + floor(log_b c) and held in one Bloom filter:
an n-gram of level q has the q keys (n-gram, 1) ... (n-gram, q) in it. The filter grows with the keys and is a table of
segments of bounded size, told by an n-gram's first bits. While it is small enough it is broadcast; a larger one stays
where it is, and the distinct n-grams of each batch of documents go to their segments and their levels come back: both
give the same levels. Level after level is probed until one fails; each stands for the mean count that the corpus has
there. P(w | h) interpolates the pair's share of its history with the add-half word model, by weights that depend on the
history's level and are fitted on all training documents, leaving each token's own occurrence out. A token's probability
follows from three levels, so what is summed for the fit is counts of level triples.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import drop_scratch, hash_slices, pick, scratch, splitmix

#: Quantisation base, hash functions a key (all in one 64-bit word), bits a key.
BASE, PROBES, KEY_BITS = 1.5, 4, 12
#: A segment of the filter has so many bits at most (8 MiB), and there are so many segments at least, a power of two.
SEGMENT_BITS = 1 << 26
SEGMENTS = 64
#: A filter of so many bits at most (128 MiB) is broadcast; a larger one stays dealt out by segments, and is asked by them.
BROADCAST_BITS = 1 << 30
#: Exact counts are broadcast for at most so many of the most frequent words; the others' are joined.
EXACT_WORDS = 1 << 20
#: A task counts so many distinct n-grams of its batches before it sends them.
HELD = 3_000_000
GRID = np.array([0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99, 0.999, 1.0])
HISTORY_LEVELS = 80
WIDTH = HISTORY_LEVELS + 2

END, START = (int(x) for x in splitmix(np.array([1, 2], np.uint64) * np.uint64(0xA0761D6478BD642F)) & ~np.uint64(1))


class Tokens:
    """A batch's tokens, each text's words and then its end: word `kind[i]` of the distinct ones, whose hashes are
    `word`; `pair[i]` is the hash of the token with its history, which is the token before it or, of the `starts`, none."""

    def __init__(self, texts: pa.Array):
        texts = pc.ascii_lower(pc.fill_null(texts, ""))
        parts = pc.ascii_split_whitespace(texts)
        flat, parent = pc.list_flatten(parts), pc.list_parent_indices(parts)
        keep = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(keep).dictionary_encode()
        doc = parent.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(texts)
        counts = np.bincount(doc, minlength=n)
        uniques = coded.dictionary
        offsets = np.frombuffer(uniques.buffers()[1], np.int32, len(uniques) + 1, uniques.offset * 4).astype(np.int64) if len(uniques) else np.zeros(1, np.int64)
        data = np.frombuffer(uniques.buffers()[2], np.uint8) if len(uniques) and uniques.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.word = np.concatenate([hash_slices(data, offsets) & ~np.uint64(1), np.array([END], np.uint64)])
        ends = np.cumsum(counts + 1) - 1
        self.kind = np.full(len(doc) + n, len(uniques), np.int64)
        inner = np.ones(len(self.kind), bool)
        inner[ends] = False
        self.kind[inner] = coded.indices.to_numpy(zero_copy_only=False)
        self.doc = np.repeat(np.arange(n), counts + 1)
        self.n_docs, self.n_tokens = n, counts + 1
        self.starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[:n]
        here = self.word[self.kind]
        before = np.empty_like(here)
        before[1:] = here[:-1]
        before[self.starts] = START
        self.pair = splitmix(before * np.uint64(0x9FB21C651E98DF25) ^ here) | np.uint64(1)

    def histories(self, of_words: np.ndarray) -> np.ndarray:
        """What of_words has for each token's history; a text's start counts like its end, of which there is one too."""
        out = np.empty(len(self.kind), of_words.dtype)
        out[1:] = of_words[self.kind[:-1]]
        out[self.starts] = of_words[-1]
        return out


def crc_of(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def ngram_counts(train: DataFrame) -> DataFrame:
    """(h, c, q): counts and levels of words (even h) and pairs (odd h) of train(text), in partitions that are ranges of h
    and sorted by it. Counted over some batches first; rows of one h are added as they come, sorted, so a task holds a
    batch. Which task gets an n-gram follows from its hash, so frequent ones don't gather."""
    n = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(held):
        h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        c = np.bincount(at, np.concatenate([x for _, x in held])).astype(np.int64)
        part = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(part)], ["h", "c", "part"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            t = Tokens(batch.column(0))
            pairs, often = np.unique(t.pair, return_counts=True)
            words = np.bincount(t.kind, minlength=len(t.word))
            held += [(t.word[words > 0], words[words > 0]), (pairs, often)]
            size += len(t.word) + len(pairs)
            if size > HELD:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    def added(batches):
        rest = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last h may go on in the next batch
        for batch in batches:
            h, c = (np.concatenate([r, batch.column(k).to_numpy(zero_copy_only=False)]) for k, r in enumerate(rest))
            heads = np.flatnonzero(np.diff(h, prepend=~h[:1])) if len(h) else np.zeros(0, np.int64)
            h, c = h[heads], np.add.reduceat(c, heads) if len(heads) else c
            rest = h[-1:], c[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(h[:-1]), pa.array(c[:-1]), pa.array(level_of(c[:-1]))], ["h", "c", "q"])
        yield pa.RecordBatch.from_arrays([pa.array(rest[0]), pa.array(rest[1]), pa.array(level_of(rest[1]))], ["h", "c", "q"])

    rows = train.select("text").mapInArrow(run, "h long, c long, part int")
    return rows.repartitionById(n, F.col("part")).select("h", "c").sortWithinPartitions("h").mapInArrow(added, "h long, c long, q int")


#: 1 + the number of bounds that a count reaches is its level: whole numbers are compared, no logarithm rounds.
BOUNDS = np.array([math.ceil(BASE**q - 1e-9) for q in range(1, HISTORY_LEVELS) if BASE**q < 2**62])


def level_of(c: np.ndarray) -> np.ndarray:
    return 1 + np.searchsorted(BOUNDS, c, side="right").astype(np.int32)


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each n-gram, of a power of two of them."""
    return (h >> np.uint64(32)) >> np.uint64(32 - (segments.bit_length() - 1))


def _probes(h: np.ndarray, level: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word, of so many in the n-gram's own segment, that has its key of this level, and the key's bits there:
    all of them in one word, so a probe reads memory once."""
    x = splitmix(h + np.uint64(level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    bits = np.uint64(1) << (x & np.uint64(63))
    for i in range(1, PROBES):
        bits |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
    return ((x >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32), bits


class LogFrequencyFilter:
    """Reads levels back from the bytes of so many segments; 1 is for n-grams that are all of one segment."""

    def __init__(self, data: bytes | np.ndarray, segments: int):
        self.table, self.segments = np.frombuffer(data, np.uint64), segments
        self.words = len(self.table) // segments

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 if it isn't in: level after level is probed until one fails."""
        out = np.zeros(len(h), np.uint8)
        for lo in range(0, len(h), 1 << 15):  # in pieces that stay in a processor's cache
            some = h[lo : lo + (1 << 15)]
            base = segment_of(some, self.segments) * np.uint64(self.words)
            at, level = np.arange(lo, lo + len(some)), 1
            while len(at) and level <= HISTORY_LEVELS:
                word, bits = _probes(some, level, self.words)
                in_it = self.table[base + word] & bits == bits
                at, some, base = at[in_it], some[in_it], base[in_it]
                out[at] = level
                level += 1
        return out


def filter_segments(counts: DataFrame, words: int, segments: int) -> DataFrame:
    """(segment, bits): the filter's segments, of so many 64-bit words each, that hold n-grams of counts(h, q). Tasks set
    what they have of a segment, a few segments each since counts lie in ranges of h; those parts meet by segment."""

    def run(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            q = batch.column(1).to_numpy(zero_copy_only=False)
            own = segment_of(h, segments).astype(np.int64)
            for s in np.unique(own):
                some = parts.setdefault(int(s), np.zeros(words, np.uint64))
                hs, qs = h[own == s], q[own == s]
                for level in range(1, int(qs.max()) + 1):
                    hs, qs = hs[qs >= level], qs[qs >= level]
                    word, bits = _probes(hs, level, words)
                    np.bitwise_or.at(some, word.astype(np.int64), bits)
            while len(parts) > 8:  # no more than some segments are held
                s = next(iter(parts))
                yield part(s, parts.pop(s))
        for s, x in parts.items():
            yield part(s, x)

    def part(s: int, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["segment", "bits"])

    def joined(batches):
        at, held = None, None
        for batch in batches:
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != at:
                    if at is not None:
                        yield part(at, held)
                    at, held = s, np.zeros(words, np.uint64)
                held |= np.frombuffer(x, np.uint64)
        if at is not None:
            yield part(at, held)

    rows = counts.select("h", "q").mapInArrow(run, "segment int, bits binary")
    return rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(joined, "segment int, bits binary")


class Model:
    """What tokens are weighed with: plain arrays."""

    def __init__(self, n: int, v: int, means: np.ndarray, exact_h: np.ndarray, exact_c: np.ndarray):
        self.n, self.v, self.means, self.exact_h, self.exact_c = n, v, means, exact_h, exact_c

    def parts(self, leave_out: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """By the levels of history, word and pair: the pair's share of its history, and the word model's probability."""
        own = np.maximum(self.means[0] - leave_out, 0)
        p1 = (own + 0.5) / (max(0, self.n - leave_out) + 0.5 * (self.v + 1))
        c2 = np.maximum(self.means[1] - leave_out, 0)
        ch = np.maximum(self.means[0] - leave_out, 1)
        return np.minimum(c2[None, None, :] / ch[:, None, None], 1.0), p1[None, :, None]

    def logs(self, triples: np.ndarray) -> np.ndarray:
        """The logarithm of P(w | h) by triple of levels, with weights fitted on the training tokens' counts by triple."""
        often, (p2, p1) = triples.reshape(WIDTH, WIDTH, WIDTH), self.parts(leave_out=1)
        gains = np.stack([(often * np.log10((1 - rest) * p2 + rest * p1)).sum(axis=(1, 2)) for rest in GRID], axis=1)
        weights = np.where(gains.any(axis=1), GRID[gains.argmax(axis=1)], 1.0)
        weights[0] = 1.0  # no history
        (p2, p1), rest = self.parts(), weights[:, None, None]
        return np.log10((1 - rest) * p2 + rest * p1).ravel()


def fit_model(train: DataFrame, segment_bits: int = SEGMENT_BITS) -> tuple[Model, DataFrame, DataFrame, int]:
    """The model of train(text), the exact counts (h, c) of the words that it doesn't hold itself, and the filter's
    segments and their number."""
    counts = scratch(ngram_counts(train), "ngrams")
    pair = (F.col("h") % 2 != 0).cast("int")
    tally = counts.groupBy(pair.alias("pair"), "q").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    words = {r["q"]: r for r in tally if r["pair"] == 0}
    pairs = {r["q"]: r for r in tally if r["pair"] == 1}
    n, v = sum(r["c"] for r in words.values()), sum(r["n"] for r in words.values())

    keys, segments = sum(r["q"] * r["n"] for r in tally), SEGMENTS
    while keys * KEY_BITS > segments * segment_bits:
        segments *= 2
    held = scratch(filter_segments(counts.select("h", "q"), max(1, math.ceil(keys * KEY_BITS / (64 * segments))), segments), "filter")
    means = np.zeros((2, WIDTH))
    for k, rows in enumerate((words, pairs)):
        for q in range(1, WIDTH):
            means[k, q] = rows[q]["c"] / rows[q]["n"] if q in rows else 0
        for q in range(1, WIDTH):  # a level that no n-gram has is met by a false probe alone
            if q not in rows:
                means[k, q] = means[k, q - 1]

    # exact counts of frequent words: the least level whose words and those above fit the bound
    cut = HISTORY_LEVELS + 1
    while cut > 1 and sum(r["n"] for q, r in words.items() if q >= cut - 1) <= EXACT_WORDS:
        cut -= 1
    exact = counts.where((pair == 0) & (F.col("q") >= cut)).select("h", "c").toArrow()
    exact_h, exact_c = exact["h"].to_numpy().astype(np.int64).view(np.uint64), exact["c"].to_numpy().astype(np.int64)
    order = np.argsort(exact_h)
    rare = scratch(counts.where((pair == 0) & (F.col("q") < cut)).select("h", "c"), "rare")
    drop_scratch(counts)
    return Model(n, v, means, exact_h[order], exact_c[order]), rare, held, segments


PLACED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, word binary, pair binary, rare array<struct<h:long,tf:long>>"
RARE = pa.struct([("h", pa.int64()), ("tf", pa.int64())])


def _by_text(levels: np.ndarray, n_tokens: np.ndarray) -> pa.Array:
    """A byte for each token, a binary value for each text."""
    bounds = np.concatenate([[0], np.cumsum(n_tokens)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n_tokens), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(levels.astype(np.uint8).tobytes())])


def _place(batch, t: Tokens, m: Model, word: np.ndarray, pair: np.ndarray) -> pa.RecordBatch:
    """The batch's texts with their base scores as far as exact counts are at hand, and each token's levels."""
    z = m.n + 0.5 * (m.v + 1)
    at = np.minimum(np.searchsorted(m.exact_h, t.word), max(0, len(m.exact_h) - 1))
    known = m.exact_h[at] == t.word if len(m.exact_h) else np.zeros(len(t.word), bool)
    logs = np.where(known, np.log10(((m.exact_c[at] if len(m.exact_h) else 0) + 0.5) / z), 0.0)
    base = np.bincount(t.doc, logs[t.kind], minlength=t.n_docs).astype(float)
    n_known = np.bincount(t.doc, known[t.kind], minlength=t.n_docs).astype(np.int64)
    other = ~known[t.kind]
    key, tf = np.unique(t.doc[other] * len(t.word) + t.kind[other], return_counts=True)
    offsets = np.searchsorted(key, np.arange(t.n_docs + 1) * len(t.word)).astype(np.int32)
    rare = pa.StructArray.from_arrays([pa.array(t.word[key % len(t.word)].view(np.int64)), pa.array(tf.astype(np.int64))], fields=list(RARE))
    columns = [batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), pa.array(t.n_tokens.astype(np.int64)), pa.array(n_known), pa.array(base)]
    return pa.RecordBatch.from_arrays([*columns, _by_text(word[t.kind], t.n_tokens), _by_text(pair, t.n_tokens), pa.ListArray.from_arrays(pa.array(offsets), rare)], [x.split()[0] for x in PLACED.split(", ")])


def _bounded(t: Tokens, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """A pair is no more frequent than its parts, so it has no higher level."""
    return np.minimum(pair, np.minimum(word[t.kind], t.histories(word)))


# ---------------------------------------------------------------- a filter of bounded size is broadcast


def place_by_broadcast(docs: DataFrame, model, held: DataFrame, segments: int) -> DataFrame:
    """docs(rid, doc_id, held_out, text) with their tokens' levels, all segments of the filter being in each worker."""
    size = held.agg(F.coalesce(F.max(F.length("bits")), F.lit(8))).first()[0]
    table = np.zeros((segments, size), np.uint8)
    for r in held.toLocalIterator():
        table[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(table.reshape(-1))
    del table

    def run(batches):
        reader = LogFrequencyFilter(sent.value, segments)
        for batch in batches:
            t = Tokens(batch.column("text"))
            word = reader.levels(t.word)
            open_ = np.flatnonzero(np.minimum(word[t.kind], t.histories(word)))
            pair = np.zeros(len(t.pair), np.uint8)
            pair[open_] = reader.levels(t.pair[open_])
            yield _place(batch, t, model.value, word, _bounded(t, word, pair))

    return docs.mapInArrow(run, PLACED)


# ---------------------------------------------------------------- a larger one stays where it is, and is asked


ASKED = "bid long, at long, kind int, data binary, rid long, doc_id long, held_out boolean, text string"
NAMES = [x.split()[0] for x in ASKED.split(", ")]


def ask(docs: DataFrame, segments: int) -> DataFrame:
    """docs(rid, doc_id, held_out, text) in batches `bid`: a row for each document (kind 1, at its place) and for each
    segment that has some of the batch's distinct n-grams (kind 0, at the segment), with their hashes."""

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        for k, batch in enumerate(batches):
            n = len(batch)
            if not n:
                continue
            t = Tokens(batch.column("text"))
            h = np.concatenate([t.word, np.unique(t.pair)])
            own = segment_of(h, segments).astype(np.int64)
            order = np.argsort(own, kind="stable")
            some, start = np.unique(own[order], return_index=True)
            data = [x.tobytes() for x in np.split(h[order], start[1:])]
            m = len(some)
            blank = lambda kind, size: pa.nulls(size, kind)
            bid = lambda size: pa.array(np.full(size, first + k, np.int64))
            yield pa.RecordBatch.from_arrays([bid(m), pa.array(some), pa.array(np.zeros(m, np.int32)), pa.array(data, pa.binary()), blank(pa.int64(), m), blank(pa.int64(), m), blank(pa.bool_(), m), blank(pa.string(), m)], NAMES)
            yield pa.RecordBatch.from_arrays([bid(n), pa.array(np.arange(n)), pa.array(np.ones(n, np.int32)), blank(pa.binary(), n), *(batch.column(c) for c in NAMES[4:])], NAMES)

    return docs.select(*NAMES[4:]).mapInArrow(run, ASKED)


def answer(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(bid, at, data): the levels of what asked(bid, at, data) has of each segment, a byte for each n-gram. A segment
    comes before what is asked of it, so a task holds one at a time."""

    def run(batches):
        at, reader = None, None
        for batch in batches:
            out = []
            for bid, s, data in zip(*(batch.column(c).to_pylist() for c in ("bid", "at", "data")), strict=True):
                if s != at:
                    at, reader = s, None
                if bid is None:
                    reader = LogFrequencyFilter(data, 1)
                    continue
                h = np.frombuffer(data, np.uint64)
                out.append((bid, s, (reader.levels(h) if reader else np.zeros(len(h), np.uint8)).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bid", "at", "data"])

    both = asked.unionByName(held.select(F.lit(None).cast("long").alias("bid"), F.col("segment").cast("long").alias("at"), F.col("bits").alias("data")))
    return both.repartition("at").sortWithinPartitions("at", F.asc_nulls_first("bid")).mapInArrow(run, "bid long, at long, data binary")


def place_by_segment(docs: DataFrame, model, held: DataFrame, segments: int) -> DataFrame:
    """The same, each batch's distinct n-grams going to their segments and their levels coming back to the batch."""
    asked = scratch(ask(docs, segments), "asked")
    told = answer(asked.where("kind = 0").select("bid", "at", "data"), held).withColumn("kind", F.lit(0))
    batched = asked.where("kind = 1").unionByName(told, allowMissingColumns=True).repartition("bid").sortWithinPartitions("bid", "kind", "at")

    def whole(batches):
        """The rows of one bid after another."""
        held = []
        for batch in batches:
            bid = batch.column("bid").to_numpy()
            cuts = [0, *(np.flatnonzero(bid[1:] != bid[:-1]) + 1).tolist(), len(bid)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if held and held[0].column("bid")[0].as_py() != bid[start]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        for table in whole(batches):
            own = pc.equal(table.column("kind"), 1)
            levels = np.frombuffer(b"".join(table.filter(pc.invert(own)).column("data").to_pylist()), np.uint8)
            batch = table.filter(own).combine_chunks().to_batches()[0]
            t = Tokens(batch.column("text"))
            pairs, pair = np.unique(t.pair, return_inverse=True)
            order = np.argsort(segment_of(np.concatenate([t.word, pairs]), segments), kind="stable")  # as they were asked for
            found = np.empty_like(levels)
            found[order] = levels
            word = found[: len(t.word)]
            yield _place(batch, t, model.value, word, _bounded(t, word, found[len(t.word) :][pair]))

    return batched.mapInArrow(run, PLACED)


# ---------------------------------------------------------------- scores


def score(docs: DataFrame, learn=None, segment_bits: int = SEGMENT_BITS, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs(doc_id, text).

    Documents learn's condition holds for are learnt from: those whose crc32(doc_id as text) mod 5 is not 1, unless it is
    given. A null or empty text has one token, its end; a very long one is one row of tokens, of some 40 bytes each while
    it is worked on. A null doc_id counts as the empty text there. Equal rows are scored and counted one by one, so they
    tie. With nothing to learn from, all tokens are unknown. An empty table gives an empty table; further columns take no
    part. Words are told apart by 64-bit hashes."""
    docs = pick(docs, doc_id="long", text="string")
    docs = docs.withColumn("held_out", ~learn if learn is not None else crc_of() % 5 == 1)
    model, rare, held, segments = fit_model(docs.where(~F.col("held_out")), segment_bits)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    bits = held.agg(F.coalesce(F.sum(8 * F.length("bits")), F.lit(0))).first()[0]
    place = place_by_broadcast if bits <= broadcast_bits else place_by_segment
    placed = scratch(place(docs.withColumn("rid", F.monotonically_increasing_id()), sent, held, segments), "placed", compression="zstd")

    def triples_of(batch) -> tuple[np.ndarray, np.ndarray]:
        """Each token's triple of levels (history, word, pair) as one number, and how many tokens each text has."""
        word, pair = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).astype(np.int64) for c in ("word", "pair"))
        n = pc.binary_length(batch.column("word")).to_numpy()
        ends = np.cumsum(n) - 1
        history = np.concatenate([[0], word[:-1]])
        history[np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)] = word[ends]  # a text ends and starts with the same
        return (history * WIDTH + word) * WIDTH + pair, n

    def tally(batches):
        often = np.zeros(WIDTH**3, np.int64)
        for batch in batches:
            if len(batch):
                often += np.bincount(triples_of(batch)[0], minlength=WIDTH**3)
        some = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(often[some])], ["code", "n"])

    triples = np.zeros(WIDTH**3)
    for r in placed.where(~F.col("held_out")).select("word", "pair").mapInArrow(tally, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow().to_batches():
        triples[r.column("code").to_numpy()] = r.column("n").to_numpy()
    logs = spark.sparkContext.broadcast(model.logs(triples))
    kept = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score"]

    def add(batches):
        for batch in batches:
            sums = np.zeros(0)
            if len(batch):
                codes, n = triples_of(batch)
                sums = np.bincount(np.repeat(np.arange(len(n)), n), logs.value[codes], minlength=len(n)).astype(float)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sums)], [*kept, "score"])

    scored = placed.select(*kept, "word", "pair").mapInArrow(add, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    z = model.n + 0.5 * (model.v + 1)
    seldom = placed.select("rid", F.explode("rare").alias("w")).select("rid", "w.h", "w.tf")
    found = seldom.join(rare, "h", "left").withColumn("k", F.coalesce("c", F.lit(0)))
    more = found.groupBy("rid").agg(F.sum(F.when(F.col("k") > 0, F.col("tf")).otherwise(0)).alias("k_more"), F.sum(F.col("tf") * F.log10((F.col("k") + 0.5) / F.lit(z))).alias("b_more"))
    out = scored.join(more, "rid", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k_more", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("b_more", F.lit(0.0))).alias("base_score"), "score")
