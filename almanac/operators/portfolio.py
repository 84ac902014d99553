"""Portfolios of event positions: daily overlapping series, cost and delay grids, metrics, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.scan import Running, scan


def sign(direction: str = "direction") -> Column:
    return F.when(F.col(direction) == "positive", 1.0).when(F.col(direction) == "negative", -1.0).otherwise(0.0)


def net(gross: Column, bps: Column, delayed: Column | None = None) -> Column:
    """A round trip costs bps on each side, and 5 bps more if entry is delayed."""
    return gross - 2 * bps / 10000 - (F.when(delayed, 5 / 10000).otherwise(0.0) if delayed is not None else 0.0)


def daily_series(positions: DataFrame, daily: DataFrame, h: int, bps: float = 10.0) -> DataFrame:
    """(date, n, gross, net, bench): the equal-weighted mean over positions(ticker, idx, sign) active in (idx, idx + h]. Cost
    falls on a position's first and last day. Positions are counted by the row that they start from, and a row's active
    ones are the running sum over the h rows before it, so their number doesn't grow with h."""
    n, gross = F.sum("n"), F.sum(F.col("s") * F.col("ret"))
    return active(positions, daily, [], h).groupBy("date").agg(n.alias("n"), (gross / n).alias("gross"), ((gross - bps / 10000 * F.sum("turns")) / n).alias("net"), (F.sum(F.col("n") * F.col("bret")) / n).alias("bench"))


def equity(series: DataFrame, day: str, r: str) -> DataFrame:
    """Compounded equity and its drawdown; a loss of everything ends it at zero."""
    order = [F.col(day).asc()]
    grown = scan(series, order, {"_least": Running("min", 1 + F.col(r)), "_log": Running("sum", F.log1p(F.greatest(F.col(r), F.lit(-0.999999))))})
    out = grown.withColumn("equity", F.when(F.col("_least") <= 0, F.lit(0.0)).otherwise(F.exp("_log"))).drop("_least", "_log")
    return scan(out, order, {"_top": Running("max", F.col("equity"))}).withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.col("_top")) - 1).drop("_top")


def metrics(series: DataFrame, keys: list[str], r: str, periods: float = 252.0) -> DataFrame:
    """Annualised mean, volatility, Sharpe, Sortino, skew and hit rate by keys."""
    x = F.col(r)
    agg = series.groupBy(*keys).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.sqrt(F.avg(F.least(x, F.lit(0.0)) ** 2)).alias("down"), F.skewness(r).alias("skew"), F.avg(F.when(x > 0, 1.0).otherwise(0.0)).alias("hit_rate"))
    root = periods**0.5
    return agg.withColumns({"annual": F.col("mean") * periods, "sharpe": F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * root), "sortino": F.when(F.col("down") > 0, F.col("mean") / F.col("down") * root)})


def beta(series: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    return series.groupBy(*keys).agg(F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def capped(df: DataFrame, keys: list[str], weight: str, most: float, name: str) -> DataFrame:
    """df with each row's share of its group's weight, `most` at most: the excess goes to the others in proportion, until none
    is above, or all are 1 / n where n rows can't fill up. With the k greatest at the cap the others are scaled by
    (1 - k * most) / (their sum), and the greatest such level over all k is the one that fills. Weights that are null or not
    positive take nothing."""
    w = Window.partitionBy(*keys)
    down = w.orderBy(F.desc("_w"))
    rest = F.sum("_w").over(down.rowsBetween(0, Window.unboundedFollowing))
    out = df.withColumn("_w", F.when(F.col(weight) > 0, F.col(weight).cast("double")))
    out = out.withColumns({"_n": F.count("_w").over(w), "_level": (1 - most * (F.count("_w").over(down.rowsBetween(Window.unboundedPreceding, 0)) - 1)) / rest})
    out = out.withColumn("_level", F.max("_level").over(w))
    share = F.when(F.col("_n") * most <= 1, 1 / F.col("_n")).otherwise(F.least(F.lit(most), F.col("_level") * F.col("_w")))
    return out.withColumn(name, F.when(F.col("_w").isNotNull(), share).otherwise(0.0)).drop("_w", "_n", "_level")


def active(positions: DataFrame, daily: DataFrame, keys: list[str], h: int) -> DataFrame:
    """(keys, ticker, date, ret, bret, n, s, turns): for each day how many of positions(keys, ticker, idx, sign) are active in
    (idx, idx + h], the sum of their signs, and how many begin or end that day."""
    opened = positions.where("idx is not null and sign <> 0").groupBy(*keys, "ticker", "idx").agg(F.count("*").alias("_n"), F.sum("sign").alias("_s"))
    w = Window.partitionBy(*keys, "ticker").orderBy("idx")
    zero = lambda c: F.coalesce(c, F.lit(0))
    held = lambda c: zero(F.sum(c).over(w.rowsBetween(-h, -1)))
    days = opened.select(*keys, "ticker").distinct().join(daily.select("ticker", "idx", "date", "ret", "bret"), "ticker")
    days = days.join(opened, [*keys, "ticker", "idx"], "left")
    turns = zero(F.lag("_n", 1).over(w)) + (zero(F.lag("_n", h).over(w)) if h > 1 else 0)
    return days.select(*keys, "ticker", "date", "ret", "bret", held("_n").alias("n"), held("_s").alias("s"), turns.alias("turns")).where("n > 0")


def capped_series(positions: DataFrame, daily: DataFrame, keys: list[str], h: int, most: float) -> DataFrame:
    """(keys, date, n, top, gross, turnover): each day's portfolio of the active positions, in which a ticker weighs as many as
    it has, `most` of all at most; top is the greatest weight, turnover what begins or ends."""
    held = capped(active(positions, daily, keys, h), [*keys, "date"], "n", most, "w")
    part = F.col("w") / F.col("n")
    return held.groupBy(*keys, "date").agg(F.sum("n").alias("n"), F.max("w").alias("top"), F.sum(part * F.col("s") * F.col("ret")).alias("gross"), F.sum(part * F.col("turns")).alias("turnover"))
