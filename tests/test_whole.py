"""Queries whose SQL form names a part of the events: the whole job against brute force in pandas."""

import numpy as np
import pytest

from almanac import plans
from almanac.operators import returns
from almanac.plans.registry import aligned, index

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def days(spark):
    d = returns.with_daily(index(spark, SF)).select("ticker", "idx", "date", "px", "ret", "bret").toPandas()
    return {t: g.sort_values("idx").reset_index(drop=True) for t, g in d.groupby("ticker")}


@pytest.fixture(scope="module")
def events(spark):
    return [r for r in aligned(spark, SF).select("event_id", "ticker", "idx").collect() if r["idx"] is not None]


def test_every_event_has_its_beta(spark, days, events):
    got = {r["event_id"]: (r["n"], r["beta"], r["alpha"]) for r in plans.queries()["rolling_beta"](spark, SF).collect()}
    want = {}
    for r in events:
        g = days[r["ticker"]]
        g = g[(g["idx"] >= r["idx"] - 130) & (g["idx"] < r["idx"])].dropna(subset=["ret", "bret"])
        if len(g) >= 40:
            beta = np.cov(g["ret"], g["bret"])[0, 1] / g["bret"].var()
            want[r["event_id"]] = (len(g), beta, g["ret"].mean() - beta * g["bret"].mean())
    assert any(i % 10 for i in want) and got.keys() == want.keys()
    for i, w in want.items():
        assert got[i] == pytest.approx(w, abs=6e-5)


def test_every_event_has_its_control(spark, days, events):
    got = {r["event_id"]: r["control"] for r in plans.queries()["matched_control_month"](spark, SF).collect()}
    want = {}
    for t, g in days.items():
        g["pre"] = (g["px"] / g["px"].shift(5) - 1).round(6)
        g["month"] = [(d.year, d.month) for d in g["date"]]
    for r in events:
        g = days[r["ticker"]]
        own = g[g["idx"] == r["idx"]].iloc[0]
        c = g[(g["month"] == own["month"]) & g["pre"].notna() & ((g["idx"] - r["idx"]).abs() > 5)]
        if not np.isnan(own["pre"]) and len(c):
            want[r["event_id"]] = min(zip((c["pre"] - own["pre"]).abs().round(9), c["idx"]))[1]
    assert any(i % 5 for i in want) and got.keys() == want.keys()
    assert sum(got[i] != want[i] for i in want) <= len(want) // 1000  # a tie in the last digit of a momentum
