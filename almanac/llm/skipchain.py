"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail and IP addresses, card and phone numbers. A conditional random field then labels the words that could
be part of one by their form and the words beside them: neighbours in the text share a chain potential, and words of a
document that are the same or similar (the same digits, the same last digits, or those of a whole pattern span) share a
skip potential, however far apart they are. Loopy message passing spreads the labels, so a number that is written as a
phone number in one place is found where it stands bare in another. Weights are fitted by pseudo-likelihood on a bounded
sample of documents that the patterns label. What the patterns leave open beside one of their own words has no known label
and teaches nothing; each span teaches twice more by its bare forms, such as digits alone: beside a word of its label, as
the repeat that it might be, and alone, as a number like others.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import pick

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # the first is "other"
#: Weights are fitted on about so many documents, and on so many distinct rows of them, at most.
SAMPLE, ROWS = 3000, 50_000
#: Messages pass until none changes by more than the second number, so often at most.
PASSES, SETTLED = 30, 1e-3
#: Hash buckets of the words before and after.
CONTEXT = 32
#: Numbers whose last digits, so many, are the same are similar: a country's or an area's code is left out of some.
SUFFIX = 7
#: A word is added if it has so much belief.
SURE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield 0, start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _short(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that pass their checks, in order."""
    out = [(s, k, e) for k, s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_short, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# ---------------------------------------------------------------- the graph of a document


class Graph:
    """The words that hold a digit or an @ sign: their features, the patterns' labels, and the two kinds of edges."""

    FORM = 24
    FEATURES = FORM + 2 * CONTEXT

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
        nodes = [(k, s, e, w) for k, (s, e, w) in enumerate(words) if "@" in w or _DIGIT.search(w)]
        self.spans = [(s, e) for _, s, e, _ in nodes]
        self.words = [w for *_, w in nodes]
        n = len(nodes)
        self.label = np.zeros(n, np.int64)
        at = 0
        for i, (s, e) in enumerate(self.spans):
            while at and spans[at - 1][2] > s:
                at -= 1
            while at < len(spans) and spans[at][2] <= s:
                at += 1
            k = at
            while k < len(spans) and spans[k][0] < e and not self.label[i]:
                if spans[k][2] > s:
                    self.label[i] = spans[k][1] + 1
                k += 1
        index = [k for k, *_ in nodes]
        self.features = np.zeros((n, self.FEATURES))
        if n:
            self.features[:, : self.FORM] = [self._form(w) for w in self.words]
            before = [words[k - 1][2] if k else "" for k in index]
            after = [words[k + 1][2] if k + 1 < len(words) else "" for k in index]
            for side, near in enumerate((before, after)):
                self.features[np.arange(n), self.FORM + side * CONTEXT + np.array([self._bucket(w) for w in near])] = 1.0
        self.chain = [(i, i + 1) for i in range(n - 1) if index[i + 1] == index[i] + 1]
        keys: list[set] = [self._keys(w) for w in self.words]
        whole = {}  # the spans' last digits, at the spans' last words
        first = 0
        for start, kind, end in spans:
            while first < n and self.spans[first][1] <= start:
                first += 1
            at = first
            while at + 1 < n and self.spans[at + 1][0] < end:
                at += 1
            if at < n and self.spans[at][0] < end:
                part = text[start:end]
                keys[at] |= self._keys(part)
                if kind and len(d := _NOT_DIGIT.sub("", part)) >= SUFFIX:
                    whole[d[-SUFFIX:]] = at
        edges: set[tuple[int, int]] = set()
        last: dict = {}
        for i in range(n):  # occurrences are linked one to the next, so edges are as many as words
            for key in keys[i]:
                if key in last:
                    edges.add((last[key], i))
                last[key] = i
        follows = {b for _, b in self.chain}
        i = 0
        while whole and i < n:  # a number that is written in some words, as a span is elsewhere
            digits, k = _NOT_DIGIT.sub("", self.words[i]), i + 1
            found = None
            while not self.label[i] and k < min(n, i + 6) and k in follows and not self.label[k] and len(digits) < 15:
                digits += _NOT_DIGIT.sub("", self.words[k])
                k += 1
                if len(digits) >= SUFFIX and digits[-SUFFIX:] in whole:
                    found = k
            if found:
                digits = _NOT_DIGIT.sub("", "".join(self.words[i:found]))
                edges |= {tuple(sorted((whole[digits[-SUFFIX:]], j))) for j in range(i, found)}
            i = found or i + 1
        self.skip = sorted(edges)

    @staticmethod
    def _keys(w: str) -> set:
        """What a word, or a span, is linked by to others that have it."""
        if "@" in w:
            key = w.lower().strip(".,;:!?\"'()<>[]{}#*$%&|")
            return {key} if len(key) >= 4 else set()
        d = _NOT_DIGIT.sub("", w)
        return ({d} if len(d) >= 4 else set()) | ({("last", d[-SUFFIX:])} if len(d) >= SUFFIX else set())

    @staticmethod
    def _bucket(w: str) -> int:
        """Of a word beside one: none and what isn't letters have a bucket each."""
        w = w.strip(".,;:!?\"'()").lower()
        return 0 if not w else 1 if not w.isalpha() else 2 + zlib.crc32(w.encode()) % (CONTEXT - 2)

    @classmethod
    def _form(cls, w: str) -> list[float]:
        d = _NOT_DIGIT.sub("", w)
        size = len(d)
        sizes = [size == 0, 1 <= size <= 2, size == 3, size == 4, 5 <= size <= 6, size == 7, 8 <= size <= 9, 10 <= size <= 11, 12 <= size <= 15, size == 16, 17 <= size <= 19, size > 19]
        marks = ["@" in w, w.count(".") == 3, "." in w.strip("."), "+" in w, "(" in w or ")" in w, "-" in w.strip("-"), any(c.isalpha() for c in w), "/" in w or ":" in w, '"' in w or "=" in w, 12 <= size <= 19 and luhn(d), w.isdigit()]
        return [1.0, *map(float, sizes), *map(float, marks)]


class Weights:
    """Unary weights by feature and label, and the tables of both kinds of edges."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip


def fit(features: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, often: np.ndarray | None = None, rounds: int = 300, ridge: float = 1e-4) -> Weights:
    """Pseudo-likelihood: each word's label given its neighbours'. chain and skip count a word's neighbours by label; a row
    counts as often as it occurs."""
    if not len(labels):
        return Weights(np.zeros((Graph.FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.eye(LABELS))
    x = np.concatenate([features, chain, skip], axis=1)
    share = np.ones(len(x)) if often is None else often.astype(float)
    share = (share / share.sum())[:, None]
    want = np.eye(LABELS)[labels]
    w, moment, scale = np.zeros((x.shape[1], LABELS)), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ ((p - want) * share) + ridge * w
        moment, scale = 0.9 * moment + 0.1 * g, 0.99 * scale + 0.01 * g * g
        w -= 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
    n = Graph.FEATURES
    both = lambda m: (m + m.T) / 2  # noqa: E731  an edge has no direction
    return Weights(w[:n], both(w[n : n + LABELS]), both(w[n + LABELS :]))


def beliefs(g: Graph, w: Weights) -> np.ndarray:
    """Each word's label probabilities after loopy sum-product passes; words with a pattern's label keep it."""
    unary = g.features @ w.unary
    unary -= unary.max(axis=1, keepdims=True)
    fixed = g.label > 0
    unary[fixed] = -50.0
    unary[np.flatnonzero(fixed), g.label[fixed]] = 0.0
    edges = g.chain + g.skip
    if not edges:
        p = np.exp(unary)
        return p / p.sum(axis=1, keepdims=True)
    a, b = np.array(edges).T
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    tables = np.exp(np.stack([w.chain, w.skip]))
    kind = np.tile((np.arange(len(a)) >= len(g.chain)).astype(int), 2)
    messages = np.zeros((len(source), LABELS))
    into = lambda: np.stack([np.bincount(target, messages[:, k], len(unary)) for k in range(LABELS)], axis=1)
    for step in range(PASSES):
        out = (unary + into())[source] - messages[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.where(kind[:, None] == 0, out @ tables[0], out @ tables[1]) + 1e-300)
        new -= new.max(axis=1, keepdims=True)
        new = new if step < PASSES // 2 else 0.5 * (messages + new)  # loops may swing
        change, messages = np.abs(new - messages).max(), new
        if change < SETTLED:
            break
    total = unary + into()
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, spans: list[tuple[int, int, int]], w: Weights) -> list[tuple[int, int, int]]:
    """What the random field adds: runs of neighbouring words of one label that the patterns don't have, by belief alone."""
    g = Graph(text, spans)
    if g.label.all():
        return []  # no words, or none that is open
    p = beliefs(g, w)
    best = p.argmax(axis=1)
    free = [i for i in range(len(best)) if g.label[i] == 0 and best[i] and p[i, best[i]] >= SURE]
    follows = {b for _, b in g.chain}
    runs: list[list[int]] = []
    for i in free:
        if runs and runs[-1][-1] == i - 1 and i in follows and best[i] == best[i - 1]:
            runs[-1].append(i)
        else:
            runs.append([i])
    out = []
    for run in runs:
        start, end = g.spans[run[0]][0], g.spans[run[-1]][1]
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        if start < end and not any(s < end and e > start for s, _, e in spans):
            out.append((start, int(best[run[0]]) - 1, end))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def bare_forms(span: str, kind: int) -> list[str]:
    """How a span's repeats may be written: its digits alone, or its last ones; an address's first part."""
    if not kind:
        return [span.split("@")[0]]
    digits = _NOT_DIGIT.sub("", span)
    return list(dict.fromkeys([digits, *(digits[-n:] for n in (10, 9, SUFFIX) if KINDS[kind] == "phone")]))


def lessons(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows (features, neighbours' labels by chain and skip) and labels of what a text teaches."""
    g = Graph(text, base_spans(text))
    near = np.zeros((len(g.words), 2 * LABELS))
    unknown = np.zeros(len(g.words), bool)
    for k, edges in enumerate((g.chain, g.skip)):
        for a, b in edges:
            near[a, k * LABELS + g.label[b]] += 1
            near[b, k * LABELS + g.label[a]] += 1
            if k:  # open, though the patterns label a word like it
                unknown[a] |= g.label[a] == 0 and g.label[b] > 0
                unknown[b] |= g.label[b] == 0 and g.label[a] > 0
    rows, labels = [np.concatenate([g.features, near], axis=1)[~unknown]], [g.label[~unknown]]
    forms = [(f, kind + 1) for start, kind, end in base_spans(text) for f in bare_forms(text[start:end], kind)]
    if forms:
        bare = np.zeros((len(forms), Graph.FEATURES + 2 * LABELS))
        bare[:, : Graph.FORM] = [Graph._form(f) for f, _ in forms]
        kinds = np.array([k for _, k in forms])
        linked = bare.copy()
        linked[np.arange(len(forms)), Graph.FEATURES + LABELS + kinds] = 1.0
        rows += [linked, bare]
        labels += [kinds, np.zeros(len(forms), np.int64)]
    return np.concatenate(rows), np.concatenate(labels)


def learn(docs: DataFrame, sample: int = SAMPLE, most_rows: int = ROWS) -> Weights:
    """Weights from a bounded sample of docs(doc_id, text) with candidates in them."""
    some = docs.where(F.col("text").rlike("[0-9@]"))
    n = some.count()
    toss = F.pmod(F.xxhash64("doc_id", F.lit("crf")), F.lit(1_000_000))
    picked = some.where(toss < int(min(1.0, sample / max(1, n)) * 1_000_000) + 1).select("text")

    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                x, labels = lessons(text)
                packed = [r.tobytes() for r in x.astype(np.uint16)]  # all features are counts
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array(packed, pa.binary())], ["label", "x"])

    # equal rows weigh by their number, so what is collected is the distinct ones, of which a bounded number by their hash
    counted = picked.mapInArrow(run, "label long, x binary").groupBy("label", "x").count()
    got = counted.orderBy(F.xxhash64("label", "x"), "x").limit(most_rows).toPandas()
    width = Graph.FEATURES + 2 * LABELS
    x = np.frombuffer(b"".join(got["x"]), np.uint16).reshape(-1, width).astype(float)
    n = Graph.FEATURES
    return fit(x[:, :n], got["label"].to_numpy(int), x[:, n : n + LABELS], x[:, n + LABELS :], got["count"].to_numpy(float))


def find(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card and n_phone (of the patterns), base_sha256, spans (all), n_added and n_spans (all) for
    each row of docs(doc_id, text).

    Places are in code points, ends exclusive. A null or empty text has no spans; a very long one is one graph, with as many
    edges as candidate words. Of labels that tie in belief none is sure enough to be added. Repeated rows stay. An empty
    table gives an empty table; further columns take no part."""
    docs = pick(docs, doc_id="long", text="string")
    w = weights or learn(docs)

    def run(batches):
        for batch in batches:
            counts, shas, alls, added, totals = [[] for _ in KINDS], [], [], [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text) if text else []
                more = added_spans(text, spans, w) if text else []
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[1] == k for s in spans))
                shas.append(hashlib.sha256(written(spans).encode()).hexdigest())
                alls.append(written(spans + more))
                added.append(len(more))
                totals.append(len(spans) + len(more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(alls, pa.string()), pa.array(added, pa.int64()), pa.array(totals, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
