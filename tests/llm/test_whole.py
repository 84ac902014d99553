"""Training-data operators where they once did less than the whole job."""

import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from almanac.llm import html_blocks, itq, lm_bloom, mixing, skipchain


def test_pairs_seen_once_count_and_scores_do_not_depend_on_the_filters_segments(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(80):
        walk = [int(rng.integers(400))]
        for _ in range(60):
            walk.append((7 * walk[-1] + 31 * int(rng.integers(6))) % 400)
        texts.append([f"w{k}" for k in walk])
    seen = Counter(p for t in texts for p in zip(t, t[1:]))
    once = sorted(p for p, c in seen.items() if c == 1)[:60]
    swapped = [(a, next(y for y in (once[(k + j) % 60][1] for j in range(1, 60)) if (a, y) not in seen)) for k, (a, _) in enumerate(once)]
    rows = [*enumerate(" ".join(t) for t in texts), (1000, " ".join(f"{a} {b}" for a, b in once)), (1001, " ".join(f"{a} {b}" for a, b in swapped))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_bloom.score(df, learn=F.col("doc_id") < 1000).collect()}
    assert got[1000] > got[1001] + 20  # of 60 pairs each
    many = {r["doc_id"]: r["score"] for r in lm_bloom.score(df, learn=F.col("doc_id") < 1000, segment_bits=512).collect()}
    assert np.mean([abs(many[i] - got[i]) < 0.03 * abs(got[i]) for i in got]) > 0.9


def test_similar_numbers_take_a_label_however_many_and_however_written():
    n = skipchain.LABELS
    w = skipchain.Weights(np.zeros((skipchain.Graph.FEATURES, n)), np.zeros((n, n)), 6 * np.eye(n))
    for text, want in (
        ("+49301234567 x 49301234567 y 49301234567 z 49301234567", ["49301234567"] * 3),
        ("+1 555 010 9999 or 15550109999 or 555-010-9999, not 7777777", ["15550109999", "555-010-9999"]),
        ("+1 555 010 9999 is what is written 555 010 9999 there", ["555 010 9999"]),
    ):
        assert [text[s:e] for s, _, e in skipchain.added_spans(text, skipchain.base_spans(text), w)] == want


def test_belief_alone_adds_a_span_where_no_pattern_has_one():
    n = skipchain.LABELS
    unary = np.zeros((skipchain.Graph.FEATURES, n))
    unary[8, 4] = 9  # ten or eleven digits
    w = skipchain.Weights(unary, np.zeros((n, n)), np.zeros((n, n)))
    assert skipchain.added_spans("call 5550109999 or 12", [], w) == [(5, 3, 15)]


def test_long_texts_fill_a_budget_that_a_subset_makes():
    lengths = np.array([17_000, 17_001, 17_002, 17_003])
    for budget in (34_001, 34_003, 34_005, 51_003):
        take = mixing.fit_counts(lengths, np.ones(4, np.int64), budget)
        assert (take <= 1).all() and (take * lengths).sum() == budget
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(rng.integers(17_000, 90_000, 40)), None
    counts = rng.integers(1, 4, len(lengths))
    for budget in rng.integers(1_000_000, (lengths * counts).sum(), 5):
        take = mixing.fit_counts(lengths, counts, int(budget))
        assert (take <= counts).all() and 0 <= budget - (take * lengths).sum() < 100


def test_fits_beyond_the_programme_by_residues():
    def least_left(lengths, counts, budget):
        sums, mask = 1, (1 << (budget + 1)) - 1
        for length, n in zip(lengths.tolist(), counts.tolist()):
            for _ in range(n):
                sums |= sums << length & mask
        return budget - (sums.bit_length() - 1)

    lengths, counts = np.array([200_000, 300_002, 700_001, 1_100_000, 2_000_003]), np.array([40, 30, 20, 10, 5])
    for widest in (1 << 22, mixing.WIDEST):
        take = mixing.fit_counts(lengths, counts, 31_234_567, widest=widest)
        assert (take >= 0).all() and (take <= counts).all() and 31_234_567 - (take * lengths).sum() == 34_475
    rng = np.random.default_rng(0)
    for _ in range(200):
        lengths = np.unique(rng.integers(50, 3000, rng.integers(2, 6)))
        counts = rng.integers(1, 60, len(lengths))
        budget = int(rng.integers(1, (lengths * counts).sum()))
        take = mixing.fit_counts(lengths, counts, budget, gap=16, widest=16)
        assert (take >= 0).all() and (take <= counts).all() and budget - (take * lengths).sum() == least_left(lengths, counts, budget)


def test_pages_in_other_languages_and_names_of_the_whole_page():
    russian = "Сегодня утром в городе открылась новая библиотека, и сотни жителей пришли посмотреть на неё. " * 2
    polish = "Dzisiaj rano otwarto w mieście nową bibliotekę, setki mieszkańców przyszły ją obejrzeć. " * 2
    chinese = "今天早上，这座城市的新图书馆正式开放，数百名居民前来参观，孩子们尤其喜欢二楼的阅览室和花园。"
    for prose in (russian, polish, chinese):
        page = f"<body><ul><li><a href=x>{prose[:30]}</a></li></ul><div><p>{prose}</p></div><div class=footer><p>{prose}</p></div></body>"
        assert html_blocks.main_text(page) == prose.strip()
    english = "This is the text that we have and it is about all of the things. " * 3
    for body in ('<body class="single has-sidebar">', '<body id="page-with-comments">', '<html class="has-header"><body>', '<main class="related">', '<article class="post share">'):
        assert html_blocks.main_text(f"{body}<p>{english}</p>") == english.strip()
    assert html_blocks.main_text(f"<div class=sidebar><p>{english}</p></div>") == ""


def test_vectors_with_a_common_mean_are_found_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 64)) / 8 + 1.5 * np.eye(64)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.standard_normal(x.shape)
    w -= (w * x).sum(axis=1, keepdims=True) * x
    y = 0.901 * x + np.sqrt(1 - 0.901**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    both = np.concatenate([x, y])
    near = (both @ both.T >= 0.9).sum() - len(both)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(both)], "vec_id long, embedding array<double>")
    found = itq.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert 0.97 * near <= found <= near


def brute_first_pass(blocks):
    """The rules as sentences: each block alone, then the page's marks against the prose found."""
    words = [[w.strip(html_blocks.MARKS).lower() for w in b.text.split()] for b in blocks]

    def hits(k, stop):
        return len([w for w in words[k] if w in stop])

    def letters(t):
        return [c for c in t if c.isalpha()]

    size = [len(b.text) + len([c for c in b.text if c >= "\u2e80"]) for b in blocks]
    linked = [b.links / len(b.text) for b in blocks]
    script = [2 * len([c for c in letters(b.text) if c >= "\u0370"]) > len(letters(b.text)) for b in blocks]
    ends = [any(c in b.text for c in ".!?…") for b in blocks]
    share = [hits(k, html_blocks.STOP_WORDS) / len(w) for k, w in enumerate(words)]
    long = [k for k, b in enumerate(blocks) if size[k] >= 70 and not b.heading and linked[k] <= 0.2 and not script[k]]
    native = [k for k in long if not blocks[k].boiler] or long
    own = max(html_blocks.LANGUAGES, key=lambda stop: sum(hits(k, stop) for k in native))
    unknown = sum(hits(k, html_blocks.STOP_WORDS) for k in native) < 0.1 * sum(len(words[k]) for k in native)
    labels = []
    for k, b in enumerate(blocks):
        foreign = any(hits(k, stop) - hits(k, own) >= 2 for stop in html_blocks.LANGUAGES)
        bad = linked[k] > 0.5 or bool(html_blocks.RIGHTS.match(b.text))
        if size[k] < 70 or b.heading:
            good, bad = False, bad or linked[k] > 0.3 or (foreign and not b.heading)
        elif size[k] < 140 and foreign:
            good = False
        else:
            good = share[k] >= 0.3 or (linked[k] <= 0.2 and (script[k] or (ends[k] and (share[k] >= 0.15 or unknown))))
            bad = bad or (not good and share[k] < 0.15 and not (ends[k] and linked[k] <= 0.2))
        labels.append("bad" if bad else "good" if good else "?")
    article = {k for k, b in enumerate(blocks) if b.main and not b.boiler}
    boiler = {k for k, b in enumerate(blocks) if b.boiler == html_blocks.MARKED}
    sure = {k for k, b in enumerate(blocks) if b.boiler == html_blocks.SURE}
    rest = set(range(len(blocks))) - article - boiler - sure

    def prose(some):
        return sum(size[k] for k in some if labels[k] == "good")

    against = set(sure)
    misled = prose(boiler) >= 1000 and prose(boiler) >= 10 * prose(article | rest)
    boxes = [blocks[k].box for k in boiler if labels[k] == "good"] if misled else []
    against |= {k for k in boiler if blocks[k].box not in boxes}
    for_ = set() if misled or (prose(rest) >= 1000 and prose(rest) >= 10 * prose(article)) else article
    if for_:
        against |= rest
    out = list(labels)
    for k in range(len(blocks)):
        if k in against:
            out[k] = "bad"
        elif k in for_:
            told = not blocks[k].heading and (ends[k] or (size[k] >= 70 and share[k] >= 0.15))
            out[k] = "bad" if linked[k] > 0.5 else "good" if told else "?"
    return out, [-1 if k in against else 1 if k in for_ else 0 for k in range(len(blocks))]


def brute_second_pass(blocks, labels, weights):
    """Each undecided block holds all decided ones of either side against each other."""
    out = []
    for k, b in enumerate(blocks):
        if labels[k] != "?":
            out.append(labels[k] == "good")
            continue
        sides = []
        for way in (range(k - 1, -1, -1), range(k + 1, len(blocks))):
            near = [(abs(j - k) + (3 if blocks[j].box != b.box else 0), blocks[j].box == b.box, labels[j]) for j in way if labels[j] != "?"]
            near += [(3, -1, "good")] if weights[k] > 0 and not any(n[0] <= 3 for n in near) else []
            sides.append(min(near, key=lambda n: n[:2]) if near else (10**6, 0, "?"))
        (near_up, _, up), (near_down, _, down) = sides
        if b.heading and down != "?":
            out.append(down == "good")
        elif up == down:
            out.append(up == "good")
        elif near_up == near_down:
            out.append(any(c in b.text for c in ".!?…"))
        else:
            out.append((up if near_up < near_down else down) == "good")
    return out


def unmarked(page):
    page = re.sub(r"</?(article|nav|footer)>", lambda m: "</div>" if m[0][1] == "/" else "<div>", page)
    return page.replace(' class="ad"', "")


def swapped(page):
    """Articles marked as boilerplate, and navigation, adverts and footers as articles."""
    page = re.sub(r"<(/?)(article|nav|footer)>", lambda m: f"<{m[1]}aside>" if m[2] == "article" else f"<{m[1]}article>", page)
    return page.replace(' class="ad"', ' class="content"')


def related(page):
    """Articles in a section whose class is one of boilerplate."""
    return page.replace("<article>", '<section class="related">').replace("</article>", "</section>")


def test_passes_equal_brute_force_whatever_the_marks():
    prose = "This is the text that we have and it is about all of the things. " * 3
    foreign, links = "Nicht auch für sie, aber mit uns.", "<a href=x>Some link</a>"
    parts = [prose, prose * 6, foreign, foreign * 3, links, f"{links} and more", "Short", "Short one.", "All rights reserved.", "今天早上，这座城市的新图书馆正式开放。" * 3, "word " * 30, "word " * 30 + "end."]
    tags = ["p", "h2", "div", "article", "aside", "section", 'div class="comments"', 'div class="promo"', "div hidden", "main"]
    rng = np.random.default_rng(11)
    for _ in range(600):
        page, open_ = "", []
        for _ in range(rng.integers(1, 14)):
            tag = tags[rng.integers(len(tags))]
            page += f"<{tag}>{parts[rng.integers(len(parts))]}"
            open_.append(tag.split()[0])
            while open_ and rng.random() < 0.6:
                page += f"</{open_.pop()}>"
        blocks = html_blocks.blocks_of(page)
        labels, weights = html_blocks.first_pass(blocks)
        assert (labels, weights) == brute_first_pass(blocks)
        assert html_blocks.second_pass(blocks, labels, weights) == brute_second_pass(blocks, labels, weights)


def test_marks_are_outweighed_by_an_articles_prose():
    prose = "This is the text that we have and it is about all of the things. " * 3
    article = f"<p>{prose}</p>" * 6
    whole = "\n".join([prose.strip()] * 6)
    assert html_blocks.main_text(f'<div class="related">{article}</div><div class="promo"><p>Buy now.</p></div>') == whole
    assert html_blocks.main_text(f"<article><p>Read on.</p></article><div>{article}</div>").endswith(whole)
    assert html_blocks.main_text(f"<article><p>{prose}</p></article><aside>{article}</aside>") == prose.strip()
    for tag in ('div class="comments"', "div hidden", 'div style="display:none"'):
        assert html_blocks.main_text(f"<article><p>Look at this.</p></article><{tag}>{article}</div>") == "Look at this."
    assert html_blocks.main_text(f"<div>{article}<p>Mehr von uns und für sie.</p>{article}</div>") == f"{whole}\n{whole}"


def test_both_passes_decide_pages_without_marks(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    found, lost, extra, marked, bad = 0, Counter(), Counter(), 0, 0
    for page in pages:
        want = Counter(html_blocks.main_text(page).split("\n"))
        found += want.total()
        for change in (unmarked, swapped, related):
            blocks = html_blocks.blocks_of(change(page))
            labels, weights = html_blocks.first_pass(blocks)
            assert (labels, weights) == brute_first_pass(blocks)
            content = html_blocks.second_pass(blocks, labels, weights)
            assert content == brute_second_pass(blocks, labels, weights)
            got = Counter(b.text for b, c in zip(blocks, content) if c)
            lost[change], extra[change] = lost[change] + (want - got).total(), extra[change] + (got - want).total()
        blocks = html_blocks.blocks_of(page)
        assert html_blocks.first_pass(blocks) == brute_first_pass(blocks)
        bare = [html_blocks.Block(b.text, b.links, 0, False, b.heading, b.box) for b in blocks]
        marked += sum(b.boiler > 0 for b in blocks)
        bad += sum(b.boiler > 0 and label == "bad" for b, label in zip(blocks, html_blocks.first_pass(bare)[0]))
    assert bad > 0.9 * marked
    assert lost[unmarked] < 0.04 * found and extra[unmarked] < 0.01 * found
    assert lost[related] < 0.3 * found and lost[swapped] < 0.4 * found
    prose = "<p>" + "This is the text that we have and it is about all of the things. " * 3 + "</p>"
    words = "<p>" + "keyword seo traffic ranking boost backlinks domain authority crawl budget sitemap index " * 2 + "</p>"
    whole = html_blocks.main_text(prose + words + prose)
    assert "seo" not in whole and whole.count("\n") == 1
    monkeypatch.setattr(html_blocks, "STOP_WORDS", frozenset({"seo", "traffic", "keyword", "ranking", "index", "boost", "domain"}))
    assert "seo" in html_blocks.main_text(prose + words + prose)


def test_vectors_of_any_length_link_with_their_own_and_equal_ones_count(spark):
    rng = np.random.default_rng(5)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((300, 16)))]
    rows += [(1000 + k, rows[k % 3][1]) for k in range(40)]  # copies
    rows += [(2000, [1.0, 2.0, 3.0]), (2001, [1.0, 2.0, 3.1]), (2002, [3.0, -1.0, 0.0]), (3000, [5.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for i, v in rows:
        same = [j for j, w in rows if len(w) == len(v) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9]
        assert got[i] == (len(same) - 1, min(same)), i


def test_pairs_at_the_threshold_meet_at_any_planned_width():
    rows = np.random.default_rng(6).standard_normal((6000, 64)) + 1.0
    x = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for n in (5_000, 2_000_000):
        plan = itq.Plan(x[:3000], n, 0.9, 0.99)
        y = x[3000:]
        w = np.random.default_rng(7).standard_normal(y.shape)
        w -= (w * y).sum(axis=1, keepdims=True) * y
        z = 0.901 * y + np.sqrt(1 - 0.901**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
        a, b = plan.codes.encode(y), plan.codes.encode(z)
        met = (plan.keys(a) == plan.keys(b)).any(axis=1) & ((plan.compared(a) != plan.compared(b)).sum(axis=1) <= plan.most)
        assert met.mean() > 0.98, n


def test_messages_give_exact_marginals_on_trees():
    rng = np.random.default_rng(8)
    n = skipchain.LABELS
    both = lambda: (lambda m: m + m.T)(rng.standard_normal((n, n)) / 2)
    w = skipchain.Weights(rng.standard_normal((skipchain.Graph.FEATURES, n)), both(), both())
    g = skipchain.Graph("12 345 6 word 345 9", [])
    assert g.chain == [(0, 1), (1, 2), (3, 4)] and g.skip == []
    g.skip = [(1, 3)]
    unary, total = g.features @ w.unary, np.zeros((5, n))
    for labels in itertools.product(range(n), repeat=5):
        p = np.exp(sum(unary[i, k] for i, k in enumerate(labels)) + sum(w.chain[labels[a], labels[b]] for a, b in g.chain) + sum(w.skip[labels[a], labels[b]] for a, b in g.skip))
        for i, k in enumerate(labels):
            total[i, k] += p
    assert np.abs(skipchain.beliefs(g, w) - total / total.sum(axis=1, keepdims=True)).max() < 1e-2


def test_learnt_weights_find_planted_repeats_and_leave_other_numbers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    w = skipchain.learn(docs)
    rng = np.random.default_rng(9)
    caught = planted = wrong = 0
    for r in docs.limit(200).collect():
        number = "".join(map(str, rng.integers(1, 10, 9)))
        other = "".join(map(str, rng.integers(1, 10, 9)))
        text = f"+49 {number[:2]} {number[2:]} {r['text'][:2000]} then 49{number} and more words {number} too, order {other} and {other} of 2024"
        spans = skipchain.base_spans(text)
        added = [text[s:e] for s, _, e in skipchain.added_spans(text, spans, w)]
        caught += (f"49{number}" in added) + (number in added)
        planted += 2
        wrong += sum(a not in (number, f"49{number}") for a in added)
    assert caught > 0.9 * planted and wrong < 0.05 * planted, (caught, planted, wrong)
