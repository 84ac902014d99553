"""Fill-in-middle, hard negatives and fingerprints: brute force, SQL, exact restoration, and at the edges."""

import hashlib
import math
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from almanac.llm import fim, hard_negatives, imatch, queries
from almanac.llm.common import Words, hash_slices

SF = "/root/testdata/sf0.001"
#: Nulls, empties, repeats, a shared id, markers and halves of them, line ends, letters beside other scripts and pairs of surrogates.
TEXTS = [(1, "The quick brown fox, jumps over 2 dogs."), (2, None), (3, ""), (4, "a"), (5, "a<P>b"), (6, "x <S> y"), (7, "<<S<M><P"), (8, "<P<S<M"), (8, "the same id"), (8, "the same id"), (None, "no id at all"),
         (9, "😀ab😀😀é漢c\r\n\n\tz"), (10, "\n"), (11, " \n x"), (12, "ab1" * 40_000), (13, "S>M>P><"), (-5, "negative id"), *((k, f"word{k} " * (k % 7) + "tail é") for k in range(20, 90))]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, k, "x", 1.0, ["u"], "p") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, form string, `_units` double, head array<string>, `part` string")


def same(rows, want):
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


# ---------------------------------------------------------------- 11


def brute_fim(i, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(sha(f"1:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(tokens), "plain", None, None, sha(text), sha(text)
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return i, len(tokens), form, len(p), len(m), sha(out), sha(text)


def test_texts_are_cut_written_and_restored(docs):
    got = [tuple(r) for r in fim.digest(docs).collect()]
    same(got, [brute_fim(i, t) for i, t in TEXTS])
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_all_forms_restore_whatever_the_rates_and_the_grammar(docs):
    for grammar in fim.UNITS:
        for plain, spm in ((0, 0), (0, 100), (100, 0))[: 1 if grammar != "code" else 3]:
            out = fim.transform(docs, grammar=grammar, plain=plain, spm=spm, seed=3)
            got = out.select("form", "text", fim.restore(F.col("output"), F.col("form")).alias("restored")).collect()
            assert all(r["restored"] == r["text"] for r in got) and len(got) == len(TEXTS)
            assert {r["form"] for r in got} == ({"plain"} if plain else {"plain", "spm" if spm else "psm"})


@pytest.mark.parametrize(("grammar", "unit"), [("code", r"[A-Za-z]+|[^A-Za-z]"), ("char", r"[\s\S]"), ("word", r"[ \t-\r]+|[^ \t-\r]+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_boundaries_cut_where_units_end(docs, grammar, unit):
    for r in docs.where("text is not null").select("text", fim.units(F.col("text"), grammar).alias("u")).collect():
        assert r["u"] == re.findall(unit, r["text"])


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert fim.digest(none).count() == imatch.digest(none).count() == 0
    assert hard_negatives.digest(none.selectExpr("doc_id as vec_id", "n as label", "array(1.0f) as embedding")).count() == 0


# ---------------------------------------------------------------- 12


def brute_negatives(rows, every=100, k=5, low=80, high=100):
    rows = [(i, label, [int(math.floor(256 * x)) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, last = [], (1 << 63) - 1
    for i, label, v in rows:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), last if j is None else j, other) for j, other, w in rows if len(w) == len(v))
        for positive in [s for s in scored if s[2] == label and s[1] != i][:k]:
            p = -positive[0]
            some = [s for s in scored if s[2] != label and low * p <= 100 * -s[0] <= high * p][:k]
            out += [(i, positive[1], rank, None if n[1] == last else n[1], p, -n[0]) for rank, n in enumerate(some, 1)]
    return [(a, None if b == last else b, *rest) for a, b, *rest in out]


def test_hard_negatives_with_ties_repeats_gaps_and_huge_values(spark):
    rng = np.random.default_rng(0)
    rows = [(k, int(rng.integers(3)), [float(x) for x in rng.integers(-2, 3, 8) / 4]) for k in range(400)]
    rows += [(100, 1, rows[100][2]), (100, 1, rows[7][2]), (None, 1, rows[100][2]), (None, 2, rows[100][2]), (401, None, rows[3][2]), (402, 1, None), (403, 1, [math.nan] * 8), (404, 1, [None, *rows[3][2][:7]]), (405, 1, [math.inf] * 8)]
    rows += [(500, 1, [1.0, 2.0]), (501, 1, [1.0, 2.5]), (502, 2, [1.0, 1.9]), (600, 1, []), (601, 1, []), (602, 2, []), (1000, 5, [0.5] * 8)]
    rows += [(k, 7 + k % 2, [2.0**21 + k % 5, 1.0, 3.0 + k % 3]) for k in range(700, 760)]  # sums beyond 2^53
    df = spark.createDataFrame([(i, label, v, "x", 1) for i, label, v in rows], "id long, label int, vector array<double>, `rows` string, anchor int")
    want = brute_negatives(rows)
    assert len(want) > 100 and any(r[4] > 2**53 for r in want)
    for wave in (hard_negatives.WAVE, 1):
        same([tuple(r) for r in hard_negatives.mine(df, wave_bytes=wave).collect()], want)
    narrow = brute_negatives(rows, every=7, k=2, low=-50, high=90)
    same([tuple(r) for r in hard_negatives.mine(df, every=7, positives=2, negatives=2, window=(-50, 90)).collect()], narrow)


def test_waves_are_bounded_and_hold_all_blocks():
    sizes = [(str(k), 1 + k % 5) for k in range(50)] + [("wide", 30)]
    waves = hard_negatives.waves_of(sizes, 10)
    assert [n for w in waves for n in w] == [n for n, _ in sizes]
    assert all(len(w) == 1 or sum(dict(sizes)[n] for n in w) <= 10 for w in waves)


# ---------------------------------------------------------------- 13


def brute_imatch(rows, common=imatch.COMMON, rare=imatch.RARE):
    """Fingerprints as tuples of sorted terms, subset by subset."""
    def terms(text):
        return {w for w in re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))}

    def subset(word):
        h = hash_slices(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))
        return int(imatch.subsets(h)[0])

    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).astype(np.int64)))
    count = Counter(w for _, t in rows for w in terms(t))
    lexicon = {w for w, n in count.items() if rare * len(rows) <= n <= common * len(rows)}
    masks = {}

    def prints(text):
        known = terms(text) & lexicon
        known = known if len(known) >= imatch.FEWEST else terms(text)
        for w in known - masks.keys():
            masks[w] = subset(w)
        return [tuple(sorted(w for w in known if masks[w] >> k & 1)) for k in range(imatch.SIGNATURES)]

    def alike(a, b):
        if a == b:
            return 1.0
        levels = [(sum(bool(x or y) for x, y in zip(a[s : s + imatch.EACH], b[s : s + imatch.EACH])), s) for s in range(0, imatch.SIGNATURES, imatch.EACH)]
        n, s = next((x for x in reversed(levels) if x[0] >= imatch.EACH // 2), levels[0])
        return sum(bool(x) and x == y for x, y in zip(a[s : s + imatch.EACH], b[s : s + imatch.EACH])) / max(1, n)

    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        made = t[: len(t) - q] + after[:q]
        a = prints(t)
        out.append((i, len(t), sha(made), round(alike(a, prints(made)), 9), round(alike(a, prints(after)), 9)))
    return out


def digest_of(df, **how):
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in imatch.fingerprint_edits(df, **how).collect()]


def test_fingerprints_are_alike_as_sets_of_terms_are(spark, docs):
    same(digest_of(docs), brute_imatch(TEXTS))
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").collect()]
    want = brute_imatch(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            same(digest_of(queries.table(spark, SF, "documents")), want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    edited, after = (np.array([r[k] for r in want]) for k in (3, 4))
    assert edited.mean() > 0.3 and after.mean() < 0.02
    same(digest_of(queries.table(spark, SF, "documents").where("doc_id = 3")), brute_imatch([r for r in rows if r[0] == 3]))


def test_workers_take_texts_by_pieces_however_well_they_compress(monkeypatch):
    texts = ["", "a b", *(f"Word{k % 50} again and é " * 4000 for k in range(100)), "", "long " * 150_000, "c"]
    n, longest = len(texts), max(len(t.encode()) for t in texts)
    rows = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array(texts)], names=["doc_id", "tie", "text"])
    (bodies,) = imatch.compressed([rows])
    assert bodies.nbytes < 100_000 < 8 << 20 < rows.nbytes
    batch = pa.RecordBatch.from_arrays([*bodies.columns, pa.array([3] * n, pa.int32())], names=["doc_id", "tie", "body", "part"])
    sizes = []
    monkeypatch.setattr(imatch, "Words", lambda t: (sizes.append(t.nbytes), Words(t))[1])

    def run():
        return pa.Table.from_batches(imatch.sorted_runs(SimpleNamespace(value=np.zeros(0, np.uint64)))(iter([batch]))).to_pylist()

    def counts():
        return sorted(tuple(r.values()) for b in imatch.count_terms(iter([rows])) for r in b.to_pylist())

    got = run(), counts()
    assert max(sizes) <= 4 * longest < rows.nbytes / 2
    assert [r["doc_id"] for r in got[0]] == list(range(n)) and [r["head"] for r in got[0]] == [""] + [None] * (n - 1) and [r["tail"] for r in got[0]] == [None] * (n - 1) + ["c"]
    for piece in (1, 1 << 40):
        monkeypatch.setattr(imatch, "PIECE", piece)
        assert (run(), counts()) == got


def test_equal_texts_have_equal_fingerprints_and_others_have_not(spark):
    out = queries.op13_imatch(spark, SF).select("doc_id", "fingerprint").collect()
    text = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    terms = {i: frozenset(t.lower().split()) for i, t in text.items()}
    by = {}
    for r in out:
        assert by.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    apart = {(r["fingerprint"], terms[r["doc_id"]]) for r in out}
    assert len({f for f, _ in apart}) > 0.95 * len({t for _, t in apart})


def test_a_band_with_too_many_terms_begins_at_a_greater_share(spark):
    df = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(200) if k % (j % 40 + 1) == 0)) for k in range(400)], "doc_id long, text string")
    whole = imatch.lexicon_of(df, common=1.0, rare=0.01)
    some = imatch.lexicon_of(df, common=1.0, rare=0.01, most=100)
    assert len(whole) == 200 and 0 < len(some) <= 100 and set(some) <= set(whole)
    words = Words(pa.array(["w0"])).hashes()
    assert words[0] in some
