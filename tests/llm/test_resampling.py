"""The quality classifier's weights and kept documents, recomputed from dictionaries."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import dsir, queries
from almanac.llm.common import hash_slices, splitmix

SF = "/root/testdata/sf0.001"
HALF = dsir.BUCKETS // 2


def grams(text, known):
    """Buckets of a text's words and pairs, one by one."""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    for w in ws:
        if w not in known:
            known[w] = hash_slices(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
    out = [int(known[w][0] % np.uint64(HALF)) for w in ws]
    for a, b in zip(ws, ws[1:]):
        pair = np.array([1], np.uint64) if a == b else splitmix(known[a] * np.uint64(0x9FB21C651E98DF25) ^ known[b])
        out.append(int(pair[0] % np.uint64(HALF)) + HALF)
    return out


def test_weights_and_kept_documents_are_those_of_dictionaries(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    number = F.pmod(F.xxhash64("doc_id", F.lit("label")), F.lit(2_000_000))
    rows = docs.select("doc_id", "text", number.alias("toss"), dsir.gumbel(11).alias("noise")).collect()
    good = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in labels.collect()}
    known: dict = {}
    found = {r["doc_id"]: grams(r["text"], known) for r in rows}
    raw = Counter(b for bs in found.values() for b in bs)
    target = Counter(b for r in rows if good.get(r["doc_id"]) and r["toss"] % 4 for b in found[r["doc_id"]])
    sums = {(side, part): sum(n for b, n in c.items() if (b >= HALF) == part) for side, c in (("raw", raw), ("target", target)) for part in (False, True)}

    def ratio(b):
        expected = raw[b] / max(1, sums["raw", b >= HALF]) * sums["target", b >= HALF]
        x = math.log((target[b] + dsir.SMOOTH) / (expected + dsir.SMOOTH))
        return math.copysign(max(abs(x) - dsir.MARGIN, 0.0), x)

    ratios = {b: ratio(b) for b in raw}
    held = [r["doc_id"] for r in rows if r["doc_id"] in good and r["toss"] % 4 == 0]
    plain = {i: sum(ratios[b] for b in bs) for i, bs in found.items()}
    usual = sum(plain[i] for i in held if good[i]) / max(1, sum(len(found[i]) for i in held if good[i]))
    weight = {i: sum(ratios[b] - usual for b in bs) for i, bs in found.items()}

    ordered = sorted((weight[i], good[i]) for i in held)
    lost = lambda k: sum(g for _, g in ordered[:k]) / sum(g for _, g in ordered)
    caught = lambda k: sum(not g for _, g in ordered[:k]) / sum(not g for _, g in ordered)
    at = max(range(len(ordered) + 1), key=lambda k: (round(caught(k) - 4 * lost(k), 12), -k))
    assert 0 < at < len(ordered)
    cut = (ordered[at - 1][0] + ordered[at][0]) / 2
    k = sum(w >= cut for w in weight.values())
    keys = {r["doc_id"]: weight[r["doc_id"]] + r["noise"] for r in rows}
    least = sorted(keys.values(), reverse=True)[k - 1]

    got = {r["doc_id"]: r for r in dsir.digest(docs, labels).collect()}
    assert got.keys() == weight.keys() and 0 < k < len(rows)
    for i, r in got.items():
        assert r["n_features"] == len(found[i]) and r["log_weight"] == pytest.approx(weight[i], rel=1e-4, abs=1e-3)
    near = {i for i, x in keys.items() if abs(x - least) < 1e-3}  # ratios are sent as 32-bit floats
    assert {i for i, r in got.items() if r["kept"]} ^ {i for i, x in keys.items() if x >= least} <= near
    assert len(near) <= 2
