"""Closed-form cases and edges of the event-study operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from almanac.operators import calendar as cal
from almanac.operators import portfolio, returns, select, stats
from almanac.sources import tables


def days(n, start=dt.date(2023, 9, 1)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(1)
    return out


@pytest.fixture(scope="module")
def index(spark):
    """The linear price: 100 + i against 200 + i on business days."""
    rows = [("T", d, 100.0 + i, 200.0 + i) for i, d in enumerate(days(120))]
    return cal.price_index(spark.createDataFrame(rows, "ticker string, date date, px double, bench double"))


def events(spark, *rows):
    return spark.createDataFrame(list(rows), "event_id long, ticker string, event_date date")


def test_linear_price_returns(spark, index):
    d = days(120)
    out = returns.horizon_returns(returns.align(events(spark, (1, "T", d[3])), index), index, [1, 5]).collect()
    for r in out:
        raw = r["h"] / 103
        assert r["raw"] == pytest.approx(raw)
        assert r["ar"] == pytest.approx(raw - r["h"] / 203)


def test_weekend_rolls_to_monday(spark, index):
    got = returns.align(events(spark, (1, "T", dt.date(2024, 1, 6))), index).first()
    assert got["adj_date"] == got["trade_date"] == dt.date(2024, 1, 8)


def test_events_without_prices_keep_their_row(spark, index):
    got = returns.align(events(spark, (1, "NONE", dt.date(2024, 1, 8)), (2, "T", dt.date(2030, 1, 1)), (3, "T", None)), index).collect()
    assert len(got) == 3 and all(r["idx"] is None for r in got)


def test_horizon_past_the_end_is_null(spark, index):
    r = returns.horizon_returns(returns.align(events(spark, (1, "T", days(120)[118])), index), index, [5]).first()
    assert r["raw"] is None and r["ar"] is None


def test_panel_flags_what_it_cuts(spark, index):
    daily = returns.with_daily(index)
    rows = {r["name"]: r for r in returns.panel(returns.align(events(spark, (1, "T", days(120)[2])), index), daily, [("f5", 0, 5), ("pre10", -10, 0), ("f500", 0, 500)]).collect()}
    assert rows["f5"]["status"] == "computed" and not rows["f5"]["right_censored"]
    assert rows["pre10"]["left_censored"] and rows["f500"]["right_censored"]
    assert rows["f500"]["end_date"] == days(120)[-1]


def test_asof_takes_the_last_row_before_and_respects_tolerance(spark, index):
    e = events(spark, (1, "T", dt.date(2023, 9, 2)), (2, "T", dt.date(2023, 8, 1)))
    got = {r["event_id"]: r["trade_date"] for r in cal.asof_backward(e, index, "event_date").collect()}
    assert got == {1: dt.date(2023, 9, 1), 2: None}
    near = {r["event_id"]: r["trade_date"] for r in cal.asof_backward(e, index, "event_date", 0).collect()}
    assert near == {1: None, 2: None}


def test_asof_on_an_empty_table(spark, index):
    empty = spark.createDataFrame([], "event_id long, ticker string, event_date date")
    assert cal.asof_forward(empty, index, "event_date").count() == 0


def test_business_days(spark):
    r = spark.sql("select date'2024-01-05' a, date'2024-01-08' b").select(cal.business_days("a", "b").alias("n")).first()
    assert r["n"] == 1


def test_anchor_clusters_compare_with_the_first(spark):
    df = spark.createDataFrame([("v", p) for p in (0, 20, 40, 61)], "k string, p long")
    got = {r["p"]: r["anchor"] for r in select.anchor_clusters(df, ["k"], "p", 30).collect()}
    assert got == {0: 0, 20: 0, 40: 40, 61: 40}


def test_non_overlapping(spark):
    base = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("c", base + dt.timedelta(d)) for d in (0, 3, 5, 9, 10, 10)], "k string, d date")
    got = sorted((r["d"] - base).days for r in select.non_overlapping(df, ["k"], "d", 5).collect())
    assert got == [0, 5, 10]


def test_multiple_testing(spark):
    ps = [0.01, 0.02, 0.03, 0.5]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
    got = {r["i"]: r for r in stats.adjust(df, "p", "i").collect()}
    assert [got[i]["bonferroni"] for i in range(4)] == pytest.approx([0.04, 0.08, 0.12, 1.0])
    assert [got[i]["holm"] for i in range(4)] == pytest.approx([0.04, 0.06, 0.06, 0.5])
    assert [got[i]["bh"] for i in range(4)] == pytest.approx([0.04, 0.04, 0.04, 0.5])


@pytest.mark.parametrize("t, df, p", [(2.0, 10, 0.07338803), (0.5, 3, 0.65144796), (12.706205, 1, 0.05)])
def test_student_p(spark, t, df, p):
    got = spark.range(1).select(stats.student_p(F.lit(t), F.lit(float(df))).alias("p")).first()["p"]
    assert got == pytest.approx(p, abs=1e-6)


def test_ols_recovers_a_line(spark):
    df = spark.range(100).select((F.col("id") * 1.0).alias("x"), (3 + 2.0 * F.col("id")).alias("y"))
    got = {r["name"]: r["coef"] for r in stats.ols(df, "y", ["x"])}
    assert got["const"] == pytest.approx(3) and got["x"] == pytest.approx(2)


def test_clustered_error_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 6.0), ("b", None)], "g string, x double")
    r = stats.clustered_se(df, [], "x", ["g"]).first()
    assert r["mean"] == 3.0 and r["se"] == pytest.approx(math.sqrt(2 * (9 + 9)) / 3)


def test_wilson_and_normal_p(spark):
    low, high = stats.wilson(F.lit(5), F.lit(10))
    r = spark.range(1).select(low.alias("l"), high.alias("h"), stats.normal_p(F.lit(1.959964)).alias("p")).first()
    assert (r["l"], r["h"], r["p"]) == pytest.approx((0.23659, 0.76341, 0.05), abs=1e-4)


def test_sign_of_a_direction(spark):
    df = spark.createDataFrame([("positive",), ("negative",), ("neutral",)], "direction string")
    assert [r[0] for r in df.select(portfolio.sign()).collect()] == [1, -1, 0]


def test_csv_is_typed_and_bad_fields_are_null(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c,d\n1,2024-01-02T00:00:00,nan,more\n x ,,3.5,\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DateType()), T.StructField("c", T.DoubleType()), T.StructField("gone", T.StringType())])
    got = sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "x.csv"), schema).collect()), key=repr)
    assert got == sorted([(1, dt.date(2024, 1, 2), None, None), (None, None, 3.5, None)], key=repr)
    assert tables.read_csv(spark, str(tmp_path / "none.csv"), schema).count() == 0


def test_upsert_never_writes_null_over_a_value(spark):
    old = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string")
    new = spark.createDataFrame([(1, None, "c"), (2, "d", None)], "k int, x string, y string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a", "c"), (2, "d", None)]
    assert tables.validate(new, ["x"], ["k"]).collect()[0]["n"] == 1
