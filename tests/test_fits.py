"""Quantiles by group, effects of many levels and draws within groups against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import resample, select, stats


def test_quantiles_of_groups_of_any_size(spark):
    rng = np.random.default_rng(0)
    rows = [(("hot", None, "b", "one")[0 if k % 2 else 1 if k % 5 == 0 else 2], float(np.round(rng.normal(), 1)) if k % 9 else None) for k in range(1500)] + [("one", 4.0), ("b", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    shares = {"low": 0.05, "mid": 0.5, "high": 0.977, "least": 0.0, "most": 1.0}
    out = stats.quantiles(df, ["g"], "x", shares)
    got = {r["g"]: r for r in out.collect()}
    assert got.keys() == {"hot", None, "b", "one"}
    values = lambda g: [x for h, x in rows if (g == "all" or h == g) and x is not None and not np.isnan(x)]
    for g, r in got.items():
        assert [r[n] for n in shares] == pytest.approx([np.quantile(values(g), q) for q in shares.values()])
    assert "percentile" not in out._jdf.queryExecution().toString()
    whole = stats.quantiles(df, [], "x", shares).collect()
    assert len(whole) == 1 and [whole[0][n] for n in shares] == pytest.approx([np.quantile(values("all"), q) for q in shares.values()])
    assert stats.quantiles(df.where("false"), [], "x", shares).collect()[0]["mid"] is None
    cuts = np.quantile(values("all"), [0.25, 0.5, 0.75])
    for r in select.quantile_bucket(df.where("not isnan(x) or x is null"), "x", 4, "q").collect():
        assert r["q"] == (None if r["x"] is None else 1 + int((r["x"] > cuts).sum()))


def dummies(rows, groups):
    """Coefficients, classical and HC1 errors of the slopes beside dummies of all levels."""
    y, x = np.array([r["y"] for r in rows]), np.array([[r["x1"], r["x2"]] for r in rows])
    parts = [x] + [np.array([[r[g] == v for v in {q[g] for q in rows}] for r in rows], float) for g in groups]
    m = np.concatenate(parts, axis=1)
    rank = np.linalg.matrix_rank(m)
    inverse = np.linalg.pinv(m.T @ m)
    beta = inverse @ m.T @ y
    e = y - m @ beta
    plain = np.sqrt(np.diag(inverse) * (e @ e) / (len(y) - rank))
    robust = np.sqrt(np.diag(inverse @ (m.T * e**2) @ m @ inverse) * len(y) / (len(y) - rank))
    return beta[:2], plain[:2], robust[:2]


@pytest.mark.parametrize("groups", [["a"], ["a", "b"]])
def test_effects_taken_out_leave_what_dummies_leave(spark, groups):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(400):
        a, b = int(12 * rng.random() ** 3), int(9 * rng.random() ** 2)
        if k % 40 == 0:
            a, b = 90 + k % 3, 80  # tied to no other level
        x1, x2 = rng.normal() + a / 3, rng.normal() - b / 2
        rows.append({"a": None if a == 5 else a, "b": f"b{b}", "x1": x1, "x2": x2, "y": 0.7 * x1 - 0.3 * x2 + a - 2 * b + rng.normal() * (1 + abs(x1))})
    df = spark.createDataFrame([(r["a"], r["b"], r["x1"], r["x2"], r["y"]) for r in rows] + [(1, "b1", None, 1.0, 2.0), (1, "b1", 1.0, float("nan"), 2.0)], "a int, b string, x1 double, x2 double, y double")
    beta, plain, robust = dummies(rows, groups)
    got = stats.fixed_effects(df, "y", ["x1", "x2"], groups)
    assert [r["coef"] for r in got] == pytest.approx(beta, rel=1e-6) and [r["se"] for r in got] == pytest.approx(plain, rel=1e-6)
    assert [r["se"] for r in stats.fixed_effects(df, "y", ["x1", "x2"], groups, robust=True)] == pytest.approx(robust, rel=1e-6)


def test_draws_within_groups_keep_the_groups_weights(spark):
    rng = np.random.default_rng(2)
    rows = [(k % 3, k, float(rng.normal()) + 10 * (k % 3)) for k in range(600)]
    r = resample.within_group(spark.createDataFrame(rows, "g int, k long, x double"), "g", "k", "x", 200, 5).first()
    x = np.array([v for _, _, v in rows])
    assert r["n"] == 600 and r["mean"] == pytest.approx(x.mean())
    assert abs(r["drawn_mean"] - x.mean()) < 4 * np.sqrt(np.mean([x[g::3].var() for g in range(3)]) / 600 / 200) + 1e-3
    assert 0.3 < r["p"] < 0.7  # as often above as below
    plan = resample.within_group(spark.createDataFrame(rows, "g int, k long, x double"), "g", "k", "x", 20, 5)._jdf.queryExecution().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_areas_by_ranks_are_those_by_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(("hot", None, "b", "ones")[0 if k % 2 else 1 if k % 5 == 0 else 2], float(rng.integers(0, 12)), bool(rng.random() < 0.4)) for k in range(500)] + [("ones", 1.0, True), ("b", None, True), ("b", 2.0, None)]
    got = {r["g"]: (r["n"], r["positives"], r["area"]) for r in stats.rank_area(spark.createDataFrame(rows, "g string, x double, y boolean"), ["g"], "x", F.col("y")).collect()}
    for g in ("hot", None, "b", "ones"):
        p, n = ([x for h, x, y in rows if h == g and x is not None and y is label] for label in (True, False))
        pairs = [(a > b) + (a == b) / 2 for a in p for b in n]
        assert got[g] == (len(p) + len(n), len(p), pytest.approx(np.mean(pairs)) if pairs else None)


def test_deciles_of_groups_and_of_all(spark):
    rows = [(k % 3 if k % 3 else None, k * 7 % 101) for k in range(101)]
    df = spark.createDataFrame(rows, "g int, x int")
    for keys in (["g"], []):
        for r in select.decile(df, keys, [F.asc("x")], "d").collect():
            group = sorted(x for g, x in rows if not keys or g == r["g"])
            assert r["d"] == min(10, 1 + 10 * group.index(r["x"]) // len(group))
