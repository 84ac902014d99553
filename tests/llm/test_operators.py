"""The training-data operators against brute force, the tokenizers library, SQL and held-out labels, and at the edges."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from almanac.llm import bpe, dsir, host_rules, html_blocks, itq, line_runs, lm_bloom, mixing, queries, skipchain, vptree
from almanac.llm.common import components, forest
from tests.compare import connection, difference

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALPHABET = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Nulls, empties, repeated rows, ties, a long text, and columns whose names the operators use inside.
EDGES = [(1, "a b c d e f g h " * 30), (2, None), (3, ""), (4, " \t\n "), (5, "One line of text here\nanother line of text\nOne line of text here"), (5, "One line of text here\nanother line of text\nOne line of text here"),
         (6, "one LINE of text here \nwrite to jane@example.org or 10.1.2.3"), (None, "no id, yet one line of text here"), (7, "word " * 200_000), (8, "é ß 漢字 \x00 x" * 3), (9, "x" * 300_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return queries.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, f"s{k % 3}" if k % 4 else None, k, "x", 0.5, [1]) for k, (i, t) in enumerate(EDGES)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, h int, `key` string, size double, `drop` array<int>")


def words(text):
    return WORD.findall(text.translate(ALPHABET))


def one(rows, key="doc_id"):
    return {r[key]: r for r in rows}


def lowest(n, pairs):
    """Each node's smallest reachable node."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# ---------------------------------------------------------------- every operator at the edges


def apply_all(spark, df):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    pages = df.selectExpr("doc_id as page_id", "source as url", "text as html", "h")
    vectors = df.selectExpr("doc_id as vec_id", "array(1.0f, float(h)) as embedding", "h", "size")
    return {
        1: lm_bloom.score(df), 2: mixing.digest(df), 3: dsir.digest(df, labels), 4: host_rules.digest(df), 5: html_blocks.extract(pages), 6: itq.near_vectors(vectors),
        7: skipchain.find(df), 8: bpe.digest(df, queries.tokenizer_path()), 9: vptree.digest(df), 10: line_runs.digest(df),
    }


def brute_fingerprint(t):
    ws = words(t)
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ([" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else [])]
    bits = np.unpackbits(np.array(hs, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) if hs else np.zeros(64)
    return int.from_bytes(np.packbits(2 * bits > len(hs)).tobytes(), "big")


def test_edges_give_the_stated_values(spark, edges):
    out = {n: df.collect() for n, df in apply_all(spark, edges).items()}
    assert all(len(rows) == len(EDGES) for rows in out.values())
    texts = [(i, t or "") for i, t in EDGES]
    same = lambda rows, want: sorted(map(str, rows)) == sorted(map(str, want))
    train = [words(t) for i, t in texts if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    count = Counter(w for ws in train for w in [*ws, None])
    n, v = sum(count.values()), len(count)
    assert same([(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in out[1]], [(i, len(ts), sum(w in count for w in ts), round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), 4)) for i, ts in ((i, [*words(t), None]) for i, t in texts)])
    assert same([(r["doc_id"], r["size"]) for r in out[2]], [(i, len(WORD.findall(t))) for i, t in texts]) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in out[2])
    assert same([(r["doc_id"], r["n_features"]) for r in out[3]], [(i, max(0, 2 * len(WORD.findall(t)) - 1)) for i, t in texts])
    assert same([(r["page_id"], r["text"]) for r in out[5]], [(i, html_blocks.main_text(t)) for i, t in texts])
    heights = [(i, k) for k, (i, _) in enumerate(EDGES)]
    near = [[(1 + a * b) / math.sqrt((1 + a * a) * (1 + b * b)) >= 0.9 for _, b in heights] for _, a in heights]
    assert same([(r["vec_id"], r["n_links"]) for r in out[6]], [(i, sum(near[k]) - 1) for k, (i, _) in enumerate(heights)])
    assert same([(r["doc_id"], r["base_sha256"]) for r in out[7]], [(i, hashlib.sha256(skipchain.written(brute_spans(t)).encode()).hexdigest()) for i, t in texts])
    fps = [brute_fingerprint(t) for _, t in texts]
    best = lowest(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    least = lambda k: min((i for j, (i, _) in enumerate(texts) if best[j] == best[k] and i is not None), default=None)
    assert same([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in out[9]], [(i, f"{fps[k]:016x}", least(k)) for k, (i, _) in enumerate(texts)])


def test_empty_tables_give_empty_tables(spark, edges):
    for n, out in apply_all(spark, edges.where("false")).items():
        assert out.count() == 0, n


# ---------------------------------------------------------------- 1


def test_lm_counts_and_base_scores(docs, texts):
    got = one(lm_bloom.score(docs).collect())
    train = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1}
    count = Counter(w for t in train.values() for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        tokens = [*words(t), None]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens), sum(w in count for w in tokens), n, i not in train)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)
    assert all(r["score"] < 0 for r in held)


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    h = np.sort(np.random.default_rng(0).integers(-(2**63), 2**63, 20_000))
    level = np.arange(20_000) % 6 + 1
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(h, level)], "h long, q int")
    n = math.ceil(int(level.sum()) * lm_bloom.KEY_BITS / 64 / 8)
    parts = {r["segment"]: bytes(r["bits"]) for r in lm_bloom.filter_segments(df, n, 8).collect()}
    f = lm_bloom.LogFrequencyFilter(b"".join(parts[k] for k in range(8)), 8)
    read = f.levels(h.astype(np.int64).view(np.uint64))
    assert (read >= level).all() and (read == level).mean() > 0.98
    other = np.random.default_rng(1).integers(-(2**63), 2**63, 20_000).astype(np.int64).view(np.uint64)
    assert (f.levels(other) > 0).mean() < 0.02


def brute_scores(texts):
    """The model with exact levels, from dictionaries."""
    train = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1}
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    ones, twos = Counter(), Counter()
    for i in train:
        ones.update(tokens[i])
        twos.update(zip(["<s>", *tokens[i]], tokens[i]))
    level = lambda c: 0 if c == 0 else 1 + sum(c >= math.ceil(lm_bloom.BASE**q - 1e-9) for q in range(1, 60))
    q1, q2 = {w: level(c) for w, c in ones.items()}, {w: level(c) for w, c in twos.items()}
    q1["<s>"] = q1[None]
    means = np.zeros((2, lm_bloom.WIDTH))
    for k, (counts, q) in enumerate(((ones, q1), (twos, q2))):
        by = defaultdict(list)
        for w, c in counts.items():
            by[q[w]].append(c)
        for j in range(1, lm_bloom.WIDTH):
            means[k, j] = np.mean(by[j]) if j in by else means[k, j - 1]
    n, v = sum(ones.values()), len(ones)

    def p(h, w, out):
        a, b, c = q1.get(h, 0), q1.get(w, 0), q2.get((h, w), 0)
        p1 = (max(means[0, b] - out, 0) + 0.5) / (n - out + 0.5 * (v + 1))
        return a, min(1.0, max(means[1, c] - out, 0) / max(means[0, a] - out, 1)), p1

    gains = defaultdict(lambda: np.zeros(len(lm_bloom.GRID)))
    for i in train:
        for h, w in zip(["<s>", *tokens[i]], tokens[i]):
            a, p2, p1 = p(h, w, 1)
            gains[a] += np.log10((1 - lm_bloom.GRID) * p2 + lm_bloom.GRID * p1)
    weight = {a: lm_bloom.GRID[g.argmax()] for a, g in gains.items()} | {0: 1.0}
    out = {}
    for i, ts in tokens.items():
        parts = [p(h, w, 0) for h, w in zip(["<s>", *ts], ts)]
        out[i] = sum(math.log10((1 - weight.get(a, 1.0)) * p2 + weight.get(a, 1.0) * p1) for a, p2, p1 in parts)
    return out


def test_scores_are_the_model_s(docs, texts, monkeypatch):
    want = brute_scores(texts)
    off = lambda: np.array([abs(r["score"] - want[r["doc_id"]]) / r["n_tokens"] for r in lm_bloom.score(docs).collect()])
    assert off().mean() < 0.02  # log10 a token, from the false probes of 12 bits a key
    monkeypatch.setattr(lm_bloom, "KEY_BITS", 512)  # so wide a filter has next to none
    exact = off()
    assert (exact < 1e-9).mean() > 0.9 and exact.max() < 0.01


def test_a_filter_in_segments_gives_the_broadcast_one_s_scores(docs, edges):
    for df in (docs, edges):
        whole = sorted(map(str, lm_bloom.score(df, segment_bits=1 << 13).collect()))
        assert whole == sorted(map(str, lm_bloom.score(df, segment_bits=1 << 13, broadcast_bits=0).collect()))


# ---------------------------------------------------------------- 2


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, total, out = set(names), share * sum(sizes.values()), {}
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in left}
        out |= {s: most * sizes[s] for s in over}
        left -= over
    return out


def test_mix_meets_its_targets(docs, texts):
    rows = mixing.digest(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = defaultdict(int)
    for i, t in texts.items():
        sizes[source[i]] += len(WORD.findall(t))
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]])) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert {s: (taken[s], want[s]) for s in want if abs(taken[s] - want[s]) > 0.02 * want[s]} == {}
    assert sorted(rows) == sorted(mixing.digest(docs.repartition(5)).collect())


def test_targets_of_many_sources_are_those_of_water_filling(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 5)
    rng = np.random.default_rng(2)
    sizes = {f"s{k}": int(x) for k, x in enumerate(rng.integers(0, 50, 400) ** 3)} | {None: 1000, "": 5, "é": 70_000}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    for share in (0.3, 1.5, 1.99, 2.0):
        got = {r["source"]: r["target"] for r in mixing.source_targets(df, share).collect()}
        want = brute_targets(sizes, share)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-9) for s in want), share


@pytest.mark.parametrize("seed", range(20))
def test_fitted_counts_come_as_near_as_any_subset(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 40, 6)) * (1 if seed % 3 else 7_001)
    counts = rng.integers(1, 5, len(lengths))
    sums = {0}
    for n, k in zip(lengths, counts):
        sums = {s + j * int(n) for s in sums for j in range(k + 1)}
    budget = int(rng.integers(1, (lengths * counts).sum()))
    take = mixing.fit_counts(lengths, counts, budget, gap=8)
    assert (take <= counts).all() and (take >= 0).all()
    assert (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_long_texts_and_large_tables_are_fitted_exactly():
    assert mixing.fit_counts(np.array([17_000, 17_001, 17_002, 17_003]), np.ones(4, int), 34_003) @ np.array([17_000, 17_001, 17_002, 17_003]) == 34_003
    assert mixing.fit_counts(np.array([30_000, 50_000, 70_000]), np.ones(3, int), 80_000).tolist() == [1, 1, 0]
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(1, 20_000, 3000))
    counts = rng.integers(1, 100, len(lengths))
    take = mixing.fit_counts(lengths, counts, budget := int((lengths * counts).sum() * 0.37) + 1)
    assert (take * lengths).sum() == budget and (take <= counts).all() and (take >= 0).all()


# ---------------------------------------------------------------- 3


def test_resampling_keeps_good_documents_and_repeats(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    out = dsir.digest(docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    marks = labels.collect()
    good = [kept[r["doc_id"]] for r in marks if r["quality"] == 1 and r["toxic"] == 0]
    bad = [kept[r["doc_id"]] for r in marks if r["quality"] == 0 or r["toxic"] == 1]
    assert np.mean(good) > 0.9 and np.mean(bad) < np.mean(good) - 0.2
    assert kept == {r["doc_id"]: r["kept"] for r in dsir.digest(docs.repartition(7), labels).collect()}


def test_kth_greatest(spark):
    x = np.round(np.random.default_rng(2).normal(size=3000), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "key double")
    for k in (1, 2, 700, 2999, 3000):
        assert dsir.kth_greatest(df, k, few=50) == np.sort(x)[::-1][k - 1]


# ---------------------------------------------------------------- 4, 10: their SQL, and brute force


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_forms(spark, name):
    assert difference(queries.queries()[name](spark, SF), queries.oracle_sql()[name], connection(SF)) == ""


def test_rules_by_hand(docs, texts, edges):
    for source, got in ((texts, one(host_rules.digest(docs).collect())), (dict(EDGES[:4]), one(host_rules.digest(edges).collect()))):
        for i, t in source.items():
            t, r = t or "", got[i]
            ws = WORD.findall(t)
            lines = [x for x in t.split("\n") if WORD.search(x)]
            windows = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
            often = Counter(windows)
            covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(8)}
            want = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
            assert r["base_failed"] == (len(ws) < 20 or 100 * len(covered) > 30 * len(ws))
            assert not (r["base_failed"] and r["kept"])


def test_a_failing_host_takes_its_documents_along(spark):
    fine = " ".join(f"w{k}" for k in range(40))
    rows = [(k, "short", "bad") for k in range(60)] + [(100, fine, "bad")] + [(200 + k, fine, "fine") for k in range(60)]
    got = one(host_rules.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert not got[100]["base_failed"] and not got[100]["kept"] and got[200]["kept"]


def test_lines_by_hand_in_any_number_of_batches(docs, texts, edges):
    tables = ((docs, list(texts.items())), (edges.where("doc_id is not null").dropDuplicates(["doc_id"]), [(i, t) for i, t in dict(EDGES).items() if i is not None]))
    for df, rows in tables:
        key = lambda x: x.strip(" \t\n\v\f\r").translate(ALPHABET)
        owner, holders = {}, defaultdict(set)
        for i, t in rows:
            for line in (t or "").split("\n"):
                holders[key(line)].add(i)
        owner = {k: min(s) for k, s in holders.items() if len(k) >= 10 and len(s) > 1}
        for batches in (1, 4):
            got = one(line_runs.dedup_lines(df, batches=batches, fanout=2).collect())
            for i, t in rows:
                lines = (t or "").split("\n")
                kept = [x for x in lines if owner.get(key(x), i) == i]
                assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))


def test_verdicts_meet_salted_hosts_as_they_do_broadcast(spark, docs):
    measured = host_rules.measures(docs.withColumnRenamed("source", "host")).withColumn("host_key", F.col("host")).withColumn("fails", host_rules.base_failed())
    verdicts = host_rules.host_verdicts(measured)
    a, b = (host_rules.with_verdicts(measured, verdicts, size) for size in (1 << 20, 0))
    assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))


def test_runs_are_joined_where_they_lie(spark, docs):
    runs = line_runs.LineRuns(spark, 2)
    lines = line_runs.line_keys(docs, 10)
    for k in range(3):  # the second compacts
        runs.add(lines.where(f"doc_id % 4 = {k}"))
    spark.conf.set(line_runs.SORTED_BUCKETS, "true")
    plan = runs.found(lines.where("doc_id % 4 = 3"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset(line_runs.SORTED_BUCKETS)
    assert [len(x) for x in runs.levels] == [1, 1] and plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 2
    assert plan.count("Exchange") == 1 and plan.count(" Sort ") == 1  # the batch's own
    runs.drop()


# ---------------------------------------------------------------- 5


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("<p>" + "The cat is on the mat and it was there for all of the day. " * 3 + "</p>", ("The cat is on the mat and it was there for all of the day. " * 3).strip()),
    ("<html><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>Short &amp; sweet.</p><p>A  b\n c</p></article><footer>Copyright</footer></html>", "Title\nShort & sweet.\nA b c"),
    ("<script>var a = '<p>no</p>';</script><main><p>Yes it is.</p><div class='comments'><p>First!</p></div></main>", "Yes it is."),
    ("<article><p>One<p>Two<div class=ad>Buy</div><p>Three", "One\nTwo\nThree"),
])
def test_pages_by_hand(page, text):
    assert html_blocks.main_text(page) == text


def test_ambiguous_blocks_follow_their_neighbours():
    prose = "<p>" + "This is the text that we have and it is about all of the things. " * 3 + "</p>"
    assert "In between" in html_blocks.main_text(f"{prose}<p>In between</p>{prose}")
    links = "<ul>" + "<li><a href=x>Some link</a></li>" * 3 + "</ul>"
    assert "Lonely" not in html_blocks.main_text(f"{prose}{links}<p>Lonely</p>{links}")


# ---------------------------------------------------------------- 6, 9


def test_vectors_by_brute_force(spark):
    df = queries.table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = df.select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = one(itq.near_vectors(df).collect(), "vec_id")
    links = np.array([got[r["vec_id"]]["n_links"] for r in rows])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.95 * near.sum()
    order = np.argsort([r["vec_id"] for r in rows])
    best = lowest(len(rows), [tuple(sorted((int(np.flatnonzero(order == a)[0]), int(np.flatnonzero(order == b)[0])))) for a, b in zip(*np.nonzero(np.triu(near)))])
    ids = sorted(r["vec_id"] for r in rows)
    assert np.mean([got[ids[k]]["component_id"] == ids[best[k]] for k in range(len(ids))]) > 0.95


def test_unsound_vectors_link_with_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1e-300, 0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in itq.near_vectors(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 7: (2, 1, False)} | {i: (0, i, True) for i in (3, 4, 5, 6)}


def test_fingerprints_and_components_by_brute_force(docs, texts):
    fps = {}
    for i, t in texts.items():
        ws = words(t)
        shingles = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    ids = sorted(fps)
    f = np.array([fps[i] for i in ids], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    best = lowest(len(ids), zip(*np.nonzero(np.triu(near, 1))))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in vptree.digest(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", ids[best[k]]) for k, i in enumerate(ids)}


def test_router_loses_no_near_pair():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64))
    fps = np.unique(np.concatenate([a, b]))
    nodes = vptree.build_router(fps[::5], 6)
    leaf, pos, home = vptree.route(nodes, fps)
    assert home.sum() == len(fps)
    edges = [vptree.search(fps[pos[(leaf == k) & home]], fps[pos[leaf == k]]) for k in np.unique(leaf)]
    at = {int(x): k for k, x in enumerate(fps)}
    found = lowest(len(fps), [(at[int(u)], at[int(v)]) for us, vs in edges for u, v in zip(us, vs)])
    assert all(found[at[int(x)]] == found[at[int(y)]] for x, y in zip(a, b))


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {501: 500}
    nodes, roots = forest(np.array([3, 1, 7]), np.array([1, 2, 8]))
    assert dict(zip(nodes.tolist(), roots.tolist())) == {2: 1, 3: 1, 8: 7}


# ---------------------------------------------------------------- 7


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and skipchain.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_are_the_patterns(docs, texts):
    tricky = ["a@b@c.com d..e@x-y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4 1.2.3", "4111 1111 1111 1111 2 4111-1111-1111-1111", "+1 (555) 010-9999, +49 30 1234567.", "é x@y.z漢", "@@ a@.b a@b. a@b..c"]
    for t in tricky:
        assert skipchain.base_spans(t) == brute_spans(t), t
    got = one(skipchain.find(docs).collect())
    for i, t in texts.items():
        want = brute_spans(t)
        line = skipchain.written(want)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in skipchain.KINDS] == [sum(s[1] == k for s in want) for k in range(4)]
        assert set(filter(None, line.split(","))) <= set(got[i]["spans"].split(","))


def test_a_repeated_number_takes_its_label(spark):
    w = skipchain.Weights(np.zeros((skipchain.Graph.FEATURES, skipchain.LABELS)), np.zeros((skipchain.LABELS,) * 2), 6 * np.eye(skipchain.LABELS))
    text = "call +1 555 0109999 now or 0109999 later, not 7777777"
    base = skipchain.base_spans(text)
    added = skipchain.added_spans(text, base, w)
    assert [(text[s:e], k) for s, k, e in added] == [("0109999", 3)]


# ---------------------------------------------------------------- 8


def test_encoding_is_the_library_s(docs, texts, edges):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    for df, rows in ((docs, texts), (edges.where("doc_id is not null"), {i: t or "" for i, t in EDGES if i is not None})):
        got = one(bpe.encode(df, path, most=500).collect())
        for i, t in rows.items():
            ids = library.encode(t, add_special_tokens=False).ids
            assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
            assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df, path), path).collect()}
        assert back == rows


def test_lexicon_is_a_minimal_map():
    entries = sorted({b"walked": [1, 2], b"walks": [1, 3], b"talked": [4, 2], b"talks": [4, 3], b"a": [9], b"": [7]}.items())
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    assert all(lexicon.get(w) == ids for w, ids in entries)
    assert lexicon.get(b"walk") is None and lexicon.get(b"walkss") is None
    assert len(lexicon.first) - 1 <= 9  # walk and talk share their endings


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p

    docs = queries.table(spark, SF, "documents")
    for (_, stage), n in zip(p.STAGES, range(len(p.STAGES))):
        before = docs
        docs = stage(spark, docs, SF)
        if n < len(p.STAGES) - 1:
            assert docs.columns == list(p.COLUMNS)
        if n in (0, 2):
            assert 0 < docs.count() < before.count()
    assert docs.count() > 0 and p.run(spark, SF).columns == docs.columns


def test_pipeline_stages_at_the_edges(spark, edges):
    import corpus_pipeline as p

    rows = edges.selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as long) as n_chars", "h", "size").unionByName(spark.createDataFrame([(20, "one\ntwo words of a line that stays here", "en", None, 1), (20, "another text under the same id, quite unlike it", "en", "s9", 2)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    for name, stage in p.STAGES:
        full, none = stage(spark, rows, SF), stage(spark, rows.where("false"), SF)
        assert none.count() == 0 and none.columns == full.columns, name
        if full.columns == list(p.COLUMNS):
            ids = [r["doc_id"] for r in full.select("doc_id").collect()]
            assert set(ids) <= {r["doc_id"] for r in rows.collect()}, name
    one = p.near_duplicates(spark, rows, SF).where("doc_id = 20").collect()
    assert [r["text"] for r in one] == ["another text under the same id, quite unlike it"]
    assert p.lines(spark, rows, SF).where("n_chars <> length(text)").count() == 0
