"""What keeps queries whole on larger tables: no pairs of events, no frame made anew for each row, no sum beyond its type."""

import datetime
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from almanac import plans
from almanac.functions import rules
from almanac.operators import confound, resample, returns, select, stats
from almanac.plans import inference, joins, mechanisms, samples
from almanac.plans.registry import aligned, index
from almanac.plans.rules import _GRADE_TEXTS, _GRADE_WANT
from almanac.streaming import jobs
from tests.compare import connection, difference

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_days_meet_articles_not_events(spark, monkeypatch):
    day = datetime.date(2024, 1, 10)
    events = spark.createDataFrame([(k, "a", day) for k in range(50)] + [(7, "b", day)], "event_id long, ticker string, event_date date")
    rows = [("a", day + datetime.timedelta(d), f"k{k}") for d in (-8, -7, -1, 3) for k in range(4)] + [("b", day - datetime.timedelta(2), "k1"), ("b", day + datetime.timedelta(7), "k9")]
    articles = spark.createDataFrame(rows, "ticker string, article_date date, name string")
    met, within = [], confound.within
    monkeypatch.setattr(confound, "within", lambda e, a, d: met.append(e.count()) or within(e, a, d))
    got = confound.capped_articles(events, articles, 7, 3, F.col("name")).collect()
    assert met == [2]
    by = {i: sorted((r["article_date"], r["key"], r["gap"]) for r in got if r["event_id"] == i) for i in range(50)}
    first = [(day - datetime.timedelta(7), f"k{k}", -7) for k in range(3)]
    assert all(by[i] == first for i in range(50))  # 7 is there twice: b's articles come later
    assert len(got) == 150


@pytest.mark.parametrize("name", ["median_and_fixed_buckets", "quantiles", "quartile_buckets"])
def test_no_frame_is_made_anew_for_each_row(spark, name):
    plan = plan_of(plans.queries()[name](spark, SF)).lower()
    assert "window" in plan and "unboundedfollowing" not in plan


def test_no_two_events_are_paired(spark, tmp_path):
    rng = np.random.default_rng(0)
    days = pd.Timestamp("1995-01-01") + pd.to_timedelta(rng.integers(0, 200, 400), "D")
    orders = pd.DataFrame({"o_orderkey": np.arange(400) * 25, "o_custkey": 35 * (np.arange(400) % 9), "o_orderstatus": "O", "o_totalprice": 1.0, "o_orderdate": days, "o_orderpriority": "1-URGENT"})
    spark.createDataFrame(orders).coalesce(1).write.parquet(str(tmp_path / "o"))
    next((tmp_path / "o").glob("*.parquet")).rename(tmp_path / "orders.parquet")
    out = joins.prior_event_match(spark, str(tmp_path))
    assert difference(out, plans.oracle_sql()["prior_event_match"], connection(str(tmp_path))) == ""
    plan = plan_of(out)
    assert "Generate" not in plan and "Window" in plan


def test_signed_ranks_of_millions(spark):
    n, c = 2_500_000, 2_500
    got = stats.signed_rank(spark.range(n).select((F.col("id") % 1000 + 1).cast("double").alias("x")), "x").first()
    sd = (n * (n + 1) * (2 * n + 1) / 24 - 1000 * c * (c * c - 1) / 48) ** 0.5
    assert got["n"] == n and got["w_plus"] == n * (n + 1) / 2 and got["z"] == pytest.approx(n * (n + 1) / 4 / sd)


def test_thirds_and_their_edges_are_of_one_making(spark, monkeypatch):
    @F.pandas_udf("double")
    def noise(x: pd.Series) -> pd.Series:
        return pd.Series(np.random.default_rng().random(len(x)))

    made = spark.range(301).select(F.lit("up").alias("direction"), noise.asNondeterministic()("id").alias("ar"))
    monkeypatch.setattr(samples, "returns5", lambda spark, sf: made)
    r = samples.order_statistic_winsor(spark, SF).first()
    assert (r["n"], r["low_third"], r["middle_third"], r["high_third"]) == (301, 101, 100, 100)


def test_a_range_join_counts_parts_of_seconds(spark):
    at = datetime.datetime(2024, 1, 1, 12, 0, 0, 900_000)
    later = {1: 86_400_000_000, 2: 86_400_000_001, 3: -86_400_000_000, 4: -86_400_000_001, 5: 86_399_999_999}
    events = spark.createDataFrame([(i, 1, at + datetime.timedelta(microseconds=m)) for i, m in later.items()], "event_id long, user_id long, ts timestamp")
    static = spark.createDataFrame([(1, at, 9)], "user_id long, event_ts timestamp, signup long")
    assert sorted(r["event_id"] for r in jobs.with_static(events, static, 1).collect()) == [1, 3, 5]


def test_each_row_takes_a_drawn_row_of_its_group(spark):
    n, draws, seed = 210_000, 7, 5  # groups of more places than a block has
    x = np.round(np.random.default_rng(1).normal(size=n), 3)
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(n) % 3, "k": 2 * np.arange(n), "x": x}))
    got = resample.within_group(df.repartition(5), "g", "k", "x", draws, seed).first()
    means = []
    for d in range(draws):
        u = (2 * np.arange(n) * 48271 + d * 69621 + seed) % resample.PRIME
        u = ((u * u + 12345) % resample.PRIME * 16807) % resample.PRIME
        u = ((u * u + 54321) % resample.PRIME + 0.5) / resample.PRIME
        means.append(np.mean([x[g::3][np.floor(u[g::3] * (n // 3)).astype(int)].mean() for g in range(3)]))
    assert got["n"] == n and got["drawn_mean"] == pytest.approx(np.mean(means), abs=1e-12)
    assert got["p"] == pytest.approx(np.mean(np.abs(means) >= abs(x.mean())))


def test_long_horizons_take_drawn_rows(spark):
    i = index(spark, SF)
    r = returns.horizon_returns(returns.align(aligned(spark, SF).drop("adj_date", "idx", "trade_date"), i), i, [63]).where("ar is not null").toPandas()
    means = []
    for d in range(20):
        taken = []
        for _, g in r.sort_values("event_id").groupby("ticker"):
            u = (g["event_id"].to_numpy() * 48271 + d * 69621 + 11) % resample.PRIME
            u = ((u * u + 12345) % resample.PRIME * 16807) % resample.PRIME
            u = ((u * u + 54321) % resample.PRIME + 0.5) / resample.PRIME
            taken += g["ar"].to_numpy()[np.floor(u * len(g)).astype(int)].tolist()
        means.append(np.mean(taken))
    got = plans.queries()["long_horizon_permutation"](spark, SF).first()
    assert got["n"] == len(r) and got["drawn_mean"] == pytest.approx(np.mean(means), abs=2e-6)


def test_strata_are_cut_before_they_meet(spark):
    out = plans.queries()["stratified_round_robin"](spark, SF)
    assert "WindowGroupLimit" in plan_of(out)


def test_each_different_grade_is_judged_once(spark):
    texts = [*_GRADE_TEXTS, None, "Hold", "weak hold", "perform / outperform", "hold on a weak hold", "to buy", "coverage"]
    want = [*_GRADE_WANT, ("unknown", "unknown", "missing"), ("neutral", "high", "exact"), ("bearish", "high", "exact"), ("bullish", "medium", "phrase"), ("bearish", "medium", "phrase"), ("bullish", "medium", "to_grade"), ("unknown", "unknown", "unmapped")]
    out = rules.graded(spark.createDataFrame([(k, texts[k % len(texts)]) for k in range(3 * len(texts))], "k int, g string"), "g")
    got = {r["k"]: (r["stance"], r["sure"], r["rule"]) for r in out.collect()}
    assert got == {k: want[k % len(texts)] for k in range(3 * len(texts))}
    plan = plan_of(out)
    assert "Aggregate" in plan and plan.count("RLIKE") < 200


def test_a_seeded_part_of_each_group_needs_no_order_of_all(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), None if k % 7 == 0 else f"g{rng.integers(0, 3)}", None if k % 11 == 0 else float(rng.integers(0, 99))) for k in range(20_000)] + [(k, f"few{k // 4}", 1.0) for k in range(50_000, 50_014)]
    df = spark.createDataFrame(rows, "k long, g string, x double")
    out = select.first_seeded(df, ["g"], ["k"], "s", "k", 3, "x")
    h = lambda k: hashlib.sha256(f"{k}|s".encode()).hexdigest()
    want = {}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (h(r[0]), r[0]))
        values = [r[2] for r in own[: len(own) // 3]]
        if values:
            want[g] = (len(values), sum(v is not None for v in values), sum(v or 0.0 for v in values))
    assert {r["g"]: (r["n"], r["c"], r["s"]) for r in out.collect()} == want


def test_prices_and_features_are_made_once(spark):
    for made in (index(spark, SF), mechanisms.row_features(spark, SF), inference._features(spark, SF)):
        assert "Window" not in plan_of(made) and "Join" not in plan_of(made)


def test_creators_returns_are_found_on_price_rows(spark):
    assert "pivotfirst" not in plan_of(plans.queries()["creator_report"](spark, SF)).lower()


def test_a_forest_passes_over_written_rows(spark, monkeypatch):
    made, own = [], inference.written
    monkeypatch.setattr(inference, "written", lambda df, name: made.append(name) or own(df, name))
    rows = inference.forest_importances(spark, SF).collect()
    assert made == ["features"] and sum(r["importance"] for r in rows) == pytest.approx(1)


def test_equal_labelled_rows_are_one_that_weighs_as_many(spark, monkeypatch):
    f = mechanisms.features(spark, SF)
    monkeypatch.setattr(mechanisms, "features", lambda spark, sf: f.unionByName(f).unionByName(f))
    d = mechanisms._labelled(spark, SF)
    known = f.where(" and ".join(f"{c} is not null" for c in [*mechanisms._SETS["all"], "post21"])).count()
    assert d.agg(F.sum("weight")).first()[0] == 3 * known and d.count() <= known


def _drawn(rows, draws, seed):
    """Means of draws of rows (g, k, v), by group in the order of k."""
    d, sums = np.arange(draws)[:, None], np.zeros(draws)
    for _, of in rows.sort_values("k").groupby("g"):
        u = (of["k"].to_numpy() * 48271 + d * 69621 + seed) % resample.PRIME
        u = ((u * u + 12345) % resample.PRIME * 16807) % resample.PRIME
        u = ((u * u + 54321) % resample.PRIME + 0.5) / resample.PRIME
        sums += of["v"].to_numpy()[np.floor(u * len(of)).astype(int)].sum(1)
    return sums / rows["g"].notna().sum()


def test_long_horizons_are_all_drawn_fifty_times(spark):
    i = index(spark, SF)
    r = returns.horizon_returns(returns.align(aligned(spark, SF).drop("adj_date", "idx", "trade_date"), i), i, [21, 63, 126, 252]).where("ar is not null").toPandas()
    got = {(o["horizon"], o["draws"]): o for o in plans.queries()["long_horizon_permutation"](spark, SF).collect()}
    assert {h for h, draws in got if draws == 50} == {21, 63, 126, 252}
    for (h, draws), o in got.items():
        rows = r[r["h"] == h].rename(columns={"ticker": "g", "event_id": "k", "ar": "v"})
        means = _drawn(rows, draws, 11)
        assert o["n"] == len(rows) > 0 and o["drawn_mean"] == pytest.approx(means.mean(), abs=2e-6)
        assert o["p"] == pytest.approx(np.mean(np.abs(means) >= abs(rows["v"].mean())), abs=2e-6)


def test_columns_are_drawn_from_the_rows_that_have_them(spark):
    n, draws = 150_000, 6  # one group of three blocks, small ones, one whose rows lack x, rows without a group
    rng, k = np.random.default_rng(4), np.arange(n)
    g = np.where(k % 50 == 0, None, np.where(k % 40 == 1, "few", np.where(k % 1000 == 3, "none", "hot")))
    x = [None if a == "none" or b % 3 == 0 else float(c) for a, b, c in zip(g, k, rng.normal(1, 1, n).round(3))]
    y = rng.normal(0, 1, n).round(3).tolist()
    df = spark.createDataFrame(pd.DataFrame({"g": g, "k": k, "x": pd.Series(x, dtype=object), "y": y}), "g string, k long, x double, y double").withColumn("z", F.lit(None).cast("double"))
    got = {(o["x"], o["draws"]): o for o in resample.within_groups(df.repartition(7), "g", "k", ["x", "y", "z"], draws, 9, [2, draws]).collect()}
    assert len(got) == 6
    for name, v in (("x", x), ("y", y)):
        rows = pd.DataFrame({"g": g, "k": k, "v": v}).dropna(subset="v")
        means = _drawn(rows, draws, 9)
        for look in (2, draws):
            o = got[name, look]
            assert o["n"] == len(rows) and o["mean"] == pytest.approx(rows["v"].mean()) and o["drawn_mean"] == pytest.approx(means[:look].mean(), abs=1e-12)
            assert o["p"] == pytest.approx(np.mean(np.abs(means[:look]) >= abs(rows["v"].mean())))
    for look in (2, draws):
        o = got["z", look]
        assert (o["n"], o["mean"], o["drawn_mean"], o["p"]) == (0, None, None, None)
