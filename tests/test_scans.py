"""Running values, as-of rows, nearest rows, capped weights, grams and dictionaries against brute force, on keys that hold much."""

import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from almanac.operators import calendar as cal
from almanac.operators import mentions, portfolio, select, substring
from almanac.operators.scan import Running, asof, numbered, scan


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def hot(spark):
    """A key with half of the rows, one that is null, and keys of a row."""
    rng = np.random.default_rng(0)
    rows = [(("hot", None, f"k{k % 50}")[0 if k % 2 else 1 if k % 10 == 0 else 2], int(rng.integers(500)), k, float(rng.integers(-50, 50)) if k % 7 else None) for k in range(800)]
    return spark.createDataFrame(rows, "key string, at int, id int, x double").repartition(5)


def brute_running(pdf, keys, ascending, kind, after, inclusive):
    out = {}
    for _, g in pdf.groupby(keys, dropna=False) if keys else [(0, pdf)]:
        g = g.sort_values(["at", "id"], ascending=ascending, kind="stable")
        x = g["x"].tolist()
        for k, i in enumerate(g["id"]):
            some = x[k if inclusive else k + 1 :] if after else x[: k + 1 if inclusive else k]
            some = [v for v in some if not np.isnan(v)]
            out[i] = {"sum": sum, "max": max, "min": min}[kind](some) if some else None
    return out


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_running_values_are_those_of_one_sorted_list(hot, keys):
    pdf = hot.toPandas()
    for ascending in (True, False):
        order = [F.asc("at"), F.asc("id")] if ascending else [F.desc("at"), F.desc("id")]
        how = {f"{kind}{after}{inclusive}": (kind, after, inclusive) for kind in ("sum", "max", "min") for after in (False, True) for inclusive in (False, True)}
        got = scan(hot, order, {n: Running(k, F.col("x"), after=a, inclusive=i) for n, (k, a, i) in how.items()}, keys).toPandas().set_index("id")
        for n, h in how.items():
            want = brute_running(pdf, keys, ascending, *h)
            assert {i: None if pd.isna(v) else v for i, v in got[n].items()} == want, n


def test_no_task_orders_a_hot_keys_rows(spark, hot):
    out = numbered(hot, [F.asc("at"), F.asc("id")], "n", ["key"])
    assert sorted(out.where("key = 'hot'").select("n").toPandas()["n"]) == list(range(1, 401))
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan)
    assert windows and all("_part" in w or "key" in w for w in windows)
    held = scan(hot, [F.asc("at"), F.asc("id")], {"s": Running("sum", F.col("x"))}, ["key"])
    assert held.count() == 800
    from almanac.operators.scan import dealt

    parts = dealt(hot, ["key"], [F.asc("at"), F.asc("id")])
    most = parts.groupBy("key", "_part").count().agg(F.max("count")).first()[0]
    assert most < 240 and parts.where("key = 'hot'").select("_part").distinct().count() > 2


def test_asof_rows_on_a_hot_key(spark):
    rng = np.random.default_rng(1)
    series = [("hot" if k % 3 else f"k{k % 20}", datetime(2024, 1, 1) + timedelta(minutes=int(t)), k) for k, t in enumerate(rng.choice(20_000, 3000, replace=False))]
    probes = [("hot" if k % 3 else f"k{k % 25}", datetime(2024, 1, 1) + timedelta(minutes=int(rng.integers(-100, 20_100))), k) for k in range(1500)]
    s, p = spark.createDataFrame(series, "key string, ts timestamp, v long"), spark.createDataFrame([*probes, ("hot", None, 9000), (None, datetime(2024, 1, 2), 9001)], "key string, ts timestamp, id long")
    left, right = pd.DataFrame(probes, columns=["key", "ts", "id"]).sort_values("ts"), pd.DataFrame(series, columns=["key", "ts", "v"]).sort_values("ts")
    got = asof(p, s, "key", "ts", ["v"], before="b", after="a").select("id", "b.v", F.col("a.v").alias("w")).toPandas().set_index("id")
    for column, way in (("v", "backward"), ("w", "forward")):
        want = pd.merge_asof(left, right, on="ts", by="key", direction=way).set_index("id")["v"]
        assert got[column].loc[want.index].fillna(-1).tolist() == want.fillna(-1).tolist()
        assert got[column].loc[[9000, 9001]].isna().all()
        again = cal.asof_time(p, s, "key", "ts", ["v"], forward=way == "forward").toPandas().set_index("id")["v_asof"]
        assert again.loc[want.index].fillna(-1).tolist() == want.fillna(-1).tolist()


def test_budget_runs_out_across_ranges(spark):
    rng = np.random.default_rng(2)
    need = rng.integers(0, 9, 3000).astype(float)
    got = {r["k"]: r["granted"] for r in select.budget(spark.createDataFrame(list(enumerate(need.tolist())), "k int, need double"), "need", [F.asc("k")], 5000.0, 6.0).collect()}
    left = 5000.0
    for k, n in enumerate(need):
        give = min(min(n, 6.0), left)
        left -= give
        assert got[k] == give
    assert left == 0


def test_equity_and_drawdown_follow_the_path(spark):
    r = np.random.default_rng(3).normal(0, 0.05, 400)
    r[350] = -1.5
    got = portfolio.equity(spark.createDataFrame(list(enumerate(r.tolist())), "day int, r double"), "day", "r").orderBy("day").toPandas()
    equity = np.concatenate([np.cumprod(1 + r[:350]), np.zeros(50)])
    assert np.allclose(got["equity"], equity)
    assert np.allclose(got["drawdown"], equity / np.maximum(1, np.maximum.accumulate(equity)) - 1)


def poured(weights, most):
    """Weights filled up round by round."""
    w = np.array(weights, float) / np.sum(weights)
    if most * len(w) <= 1:
        return np.full(len(w), 1 / len(w))
    while (w > most + 1e-12).any():
        over = w > most
        free = w < most
        spare = (w[over] - most).sum()
        w[over] = most
        w[free] += spare * w[free] / w[free].sum()
    return w


def test_capped_weights_are_those_poured_round_by_round(spark):
    rng = np.random.default_rng(4)
    groups = [rng.integers(1, 50, n).astype(float) for n in (1, 2, 5, 12, 13, 14, 40, 300)] + [np.full(20, 3.0), np.array([1000.0] + [1.0] * 30)]
    rows = [(g, k, w) for g, ws in enumerate(groups) for k, w in enumerate(ws.tolist())] + [(3, 900, None), (3, 901, 0.0)]
    got = {(r["g"], r["k"]): r["w"] for r in portfolio.capped(spark.createDataFrame(rows, "g int, k int, x double"), ["g"], "x", 0.08, "w").collect()}
    for g, ws in enumerate(groups):
        assert np.allclose([got[g, k] for k in range(len(ws))], poured(ws, 0.08))
    assert got[3, 900] == got[3, 901] == 0


def test_nearest_and_rows_away_from_marks(spark):
    rng = np.random.default_rng(5)
    t = [(f"g{k % 3}" if k % 11 else None, float(rng.integers(0, 200)) / 10 if k % 13 else None, k) for k in range(300)]
    c = [(f"g{k % 4}", float(rng.integers(0, 200)) / 10, k) for k in range(400)]
    got = {r["id"]: (r["control"], r["distance"]) for r in select.nearest(spark.createDataFrame(t, "g string, x double, id int"), spark.createDataFrame(c, "g string, x double, control int"), ["g"], "x", "control").collect()}
    for g, x, i in t:
        some = [(abs(y - x), k) for h, y, k in c if h == g] if g and x is not None else []
        assert got[i] == ((min(some)[1], pytest.approx(min(some)[0])) if some else (None, None))
    marks = [("g0", 10), ("g0", 50), ("g1", 0)]
    rows = [(f"g{g}", p) for g in range(3) for p in range(80)]
    kept = select.away_from(spark.createDataFrame(rows, "g string, p long"), spark.createDataFrame(marks, "g string, p long"), "g", "p", 10)
    assert rows_of(kept) == sorted(map(repr, ((g, p) for g, p in rows if all(h != g or abs(p - q) > 10 for h, q in marks))))


def test_texts_contain_what_their_grams_led_to(spark):
    rng = np.random.default_rng(6)
    letters = list("abé😀")
    texts = [(k, "".join(rng.choice(letters, int(rng.integers(0, 40))))) for k in range(200)] + [(900, None), (901, "")]
    words = [(k, "".join(rng.choice(letters, int(rng.integers(0, 7))))) for k in range(300)] + [(900, None), (901, "zzzz")]
    got = substring.containing(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(words, "needle_id int, word string"))
    assert rows_of(got) == sorted(map(repr, ((i, j) for i, t in texts for j, w in words if t and w and w in t)))
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


NAMES = [("Nvidia", "alias", "NVDA"), ("Tesla", "alias", "TSLA"), ("Palantir", "alias", "PLTR"), ("SoFi", "alias", "SOFI"), ("Apple", "alias", "AAPL"), ("Amazon", "alias", "AMZN"), ("Disney", "alias", "DIS"), ("Meta", "alias", "META"), ("Super Micro", "alias", "SMCI"), ("Clear Secure", "alias", "YOU"), *((s, "symbol", s) for s in ("NVDA", "TSLA", "AAPL", "HOOD", "META", "SMCI", "YOU", "ON"))]


@pytest.mark.parametrize(("text", "want"), [
    ("I am watching $NVDA and $TSLA calls this week.", [(15, "NVDA", "cashtag", 0.95), (25, "TSLA", "cashtag", 0.95)]),
    ("The CEO discussed GDP, EPS, USD, AI, and SEC rules.", []),
    ("NVDA stock still has upside after earnings.", [(1, "NVDA", "plain_context", 0.7)]),
    ("I am buying Nvidia stock", [(13, "NVDA", "alias_context", 0.75)]),
    ("Tesla is on my watchlist", [(1, "TSLA", "alias_context", 0.75)]),
    ("Palantir has upside", [(1, "PLTR", "alias_context", 0.75)]),
    ("SoFi stock looks undervalued", [(1, "SOFI", "alias_context", 0.75)]),
    ("apple pie", []), ("amazon package", []), ("disney movie", []), ("meta analysis", []), ("hood neighborhood", []),
    ("$XYZ and $AI", [(1, "XYZ", "cashtag", 0.85)]),
    ("$AI stock", [(1, "AI", "cashtag", 0.85)]),
    ("we like NASDAQ: SMCI here", [(17, "SMCI", "exchange_prefix", 0.9)]),
    ("Super  Micro shares, Supermicro shares", []),
    ("I buy if you like stocks, YOU know", []),
    ("time to buy YOU now", [(13, "YOU", "plain_context", 0.7)]),
    ("Clear Secure stock: YOU grows", [(1, "YOU", "alias_context", 0.75), (21, "YOU", "plain_context", 0.7)]),
    (None, []),
])
def test_tickers_in_texts(spark, text, want):
    names = spark.createDataFrame(NAMES, "phrase string, kind string, code string")
    got = mentions.ticker_mentions(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", names)
    assert sorted((r["at"], r["code"], r["method"], r["confidence"]) for r in got.collect()) == want


def test_the_automaton_finds_every_place_of_every_phrase(spark):
    rng = np.random.default_rng(7)
    words = ["ab", "b", "ba", "É", "#", "12", "ab12"]
    phrases = list({" ".join(rng.choice(words, int(rng.integers(1, 5)))) for _ in range(60)})
    texts = [(k, "".join(w + rng.choice([" ", "\t", "\n", "  "]) for w in rng.choice(words + ["B", "x"], 80))) for k in range(40)] + [(99, None), (100, "")]
    tokens = lambda t: [(m.start(), m.end(), m.group()) for m in re.finditer(mentions.TOKEN, t.translate(str.maketrans("AB", "ab")))]
    want = Counter()
    for i, t in texts:
        ts = tokens(t or "")
        for p in phrases:
            ps = [x[2] for x in tokens(p)]
            want.update((i, ts[k][0] + 1, t[ts[k][0] : ts[k + len(ps) - 1][1]], p) for k in range(len(ts) - len(ps) + 1) if [x[2] for x in ts[k : k + len(ps)]] == ps)
    df, names = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p, "k", str(len(p))) for p in [*phrases, "", "never there"]], "phrase string, kind string, code string")
    for most in (mentions.MOST, 10):
        got = mentions.dictionary_mentions(df, "id", "text", names, most=most)
        assert Counter((r["id"], r["at"], r["surface"], r["phrase"]) for r in got.collect()) == want
