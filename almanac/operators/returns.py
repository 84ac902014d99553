"""Holding-period, benchmark-adjusted and cumulative abnormal returns over a grid of horizons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators import calendar as cal


def with_daily(index: DataFrame) -> DataFrame:
    """The series with daily returns, daily abnormal returns, and running sums of them, of their squares and of gaps, so
    that a window's sum is a difference of two rows."""
    w = Window.partitionBy("ticker").orderBy("idx")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ret, bret = F.col("px") / F.lag("px").over(w) - 1, F.col("bench") / F.lag("bench").over(w) - 1
    daily = index.withColumn("ret", ret).withColumn("bret", bret).withColumn("ar", F.col("ret") - F.col("bret"))
    return daily.withColumns({
        "sum_ar": F.sum(F.coalesce("ar", F.lit(0.0))).over(run),
        "gaps": F.count_if(F.col("ar").isNull()).over(run),
        "sum_ret": F.sum(F.coalesce("ret", F.lit(0.0))).over(run),
        "sum_ret2": F.sum(F.coalesce(F.col("ret") * F.col("ret"), F.lit(0.0))).over(run),
    })


def align(events: DataFrame, index: DataFrame) -> DataFrame:
    """events with adj_date, and idx and trade_date of the trading day that it leads to."""
    return cal.asof_forward(events.withColumn("adj_date", cal.roll_weekend("event_date")), index, "adj_date")


def horizon_returns(aligned: DataFrame, index: DataFrame, horizons: list[int]) -> DataFrame:
    """A row for each event and horizon: raw, benchmark and abnormal return from idx to idx + h; null past the end."""
    grid = aligned.withColumn("h", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons])))
    at = cal.offset(grid, index, F.lit(0), {"px0": "px", "b0": "bench"})
    to = cal.offset(at, index, F.col("h"), {"px1": "px", "b1": "bench", "end_date": "date"})
    raw, bench = F.col("px1") / F.col("px0") - 1, F.col("b1") / F.col("b0") - 1
    return to.withColumns({"raw": raw, "benchmark": bench, "ar": raw - bench})


def panel(aligned: DataFrame, daily: DataFrame, windows: list[tuple[str, int, int]]) -> DataFrame:
    """A row for each event and window (name, s, e), rows s to e from the event's. Windows that leave the series are cut at
    its ends and flagged; events without a trading day are missing, with the reason."""
    grid = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).cast("long").alias("s"), F.lit(e).cast("long").alias("e")) for n, s, e in windows])
    ends = daily.groupBy("ticker").agg(F.max("idx").alias("last"))
    g = aligned.drop("n").join(ends, "ticker", "left").withColumn("w", F.explode(grid)).select("*", "w.*").drop("w")
    g = g.withColumns({
        "left_censored": F.coalesce(F.col("idx") + F.col("s") < 1, F.lit(False)),
        "right_censored": F.coalesce(F.col("idx") + F.col("e") > F.col("last"), F.lit(False)),
        "i0": F.greatest(F.lit(1), F.least("last", F.col("idx") + F.col("s"))),
        "i1": F.greatest(F.lit(1), F.least("last", F.col("idx") + F.col("e"))),
    })
    a = daily.select("ticker", F.col("idx").alias("i0"), F.col("px").alias("px0"), F.col("bench").alias("b0"), F.col("sum_ar").alias("ca0"), F.col("gaps").alias("g0"), F.col("sum_ret").alias("s0"), F.col("sum_ret2").alias("q0"), F.col("date").alias("start_date"))
    b = daily.select("ticker", F.col("idx").alias("i1"), F.col("px").alias("px1"), F.col("bench").alias("b1"), F.col("sum_ar").alias("ca1"), F.col("gaps").alias("g1"), F.col("sum_ret").alias("s1"), F.col("sum_ret2").alias("q1"), F.col("date").alias("end_date"))
    j = g.join(a, ["ticker", "i0"], "left").join(b, ["ticker", "i1"], "left")
    k = F.col("i1") - F.col("i0")
    s, q = F.col("s1") - F.col("s0"), F.col("q1") - F.col("q0")
    raw, bench = F.col("px1") / F.col("px0") - 1, F.col("b1") / F.col("b0") - 1
    return j.withColumns({
        "days": k,
        "raw": raw,
        "bhar": raw - bench,
        "car": F.when(F.col("g1") == F.col("g0"), F.col("ca1") - F.col("ca0")),
        "vol": F.when(k >= 2, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / k) / (k - 1)))),
        "hit": raw > 0,
        "status": F.when(F.col("idx").isNull(), "missing").when(F.col("right_censored") | F.col("left_censored"), "censored").otherwise("computed"),
        "missing_reason": missing_reason(),
    })


def missing_reason() -> Column:
    return F.when(F.col("event_date").isNull(), "no_event_date").when(F.col("last").isNull(), "no_price_series").when(F.col("idx").isNull(), "after_last_price")


def path_extremes(aligned: DataFrame, index: DataFrame, h: int) -> DataFrame:
    """(event_id, max_drawdown, max_runup) over rows idx to idx + h. A path is followed once for each ticker and row that
    events start from, however many do."""
    events = aligned.where("idx is not null").select("event_id", "ticker", "idx")
    path = events.select("ticker", "idx").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(h))))
    path = cal.offset(path, index, F.col("k"), {"p": "px"}, "inner")
    w = Window.partitionBy("ticker", "idx").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumns({"peak": F.max("p").over(w), "low": F.min("p").over(w)})
    far = path.groupBy("ticker", "idx").agg(F.min(F.col("p") / F.col("peak") - 1).alias("max_drawdown"), F.max(F.col("p") / F.col("low") - 1).alias("max_runup"))
    return events.join(far, ["ticker", "idx"]).select("event_id", "max_drawdown", "max_runup")


def event_path(aligned: DataFrame, daily: DataFrame, before: int, after: int) -> DataFrame:
    """Mean daily abnormal return by offset from the event."""
    path = aligned.where("idx is not null").select("event_id", "ticker", "idx").withColumn("k", F.explode(F.sequence(F.lit(-before), F.lit(after))))
    return cal.offset(path, daily, F.col("k"), {"a": "ar"}, "inner").groupBy("k").agg(F.count("a").alias("n"), F.avg("a").alias("mean_ar"))
