"""Portfolio queries: daily overlapping series, monthly means, strategy and cost grids, metrics, equity."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import portfolio, returns, stats
from almanac.plans.registry import EVENTS, RETURNS, index, query, r6, returns5
from almanac.sources.tables import recommendations

_DAILY = f"""{EVENTS}, held AS (SELECT d.date, CASE direction WHEN 'positive' THEN 1.0 ELSE -1.0 END AS sg, d.ret, d.bret, CASE WHEN k IN (1, 5) THEN 10 / 10000.0 ELSE 0 END AS cost FROM al CROSS JOIN range(1, 6) t(k) JOIN daily d ON al.ticker = d.ticker AND al.idx + k = d.idx WHERE direction <> 'neutral'),
series AS (SELECT date, count(*) AS n, avg(sg * ret) AS gross, avg(sg * ret - cost) AS net, avg(bret) AS bench FROM held GROUP BY 1)"""


def _series(spark, sf):
    daily = returns.with_daily(index(spark, sf))
    positions = returns.align(recommendations(spark, sf), daily).withColumn("sign", portfolio.sign())
    return portfolio.daily_series(positions.select("event_id", "ticker", "idx", "sign"), daily, 5)


@query(f"{_DAILY} SELECT date, n, round(gross, 6) AS gross, round(net, 6) AS net, round(bench, 6) AS bench FROM series")
def daily_portfolio(spark, sf):
    return _series(spark, sf).select("date", "n", *r6("gross", "net", "bench"))


@query(f"""{_DAILY} SELECT year(date) AS year, count(*) AS n, round(avg(net), 6) AS mean, round(stddev_samp(net), 6) AS sd, round(avg(net) / stddev_samp(net) * sqrt(252), 4) AS sharpe, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM series GROUP BY 1""")
def portfolio_metrics(spark, sf):
    m = portfolio.metrics(_series(spark, sf).withColumn("year", F.year("date").cast("long")), ["year"], "net")
    return m.select("year", "n", *r6("mean", "sd"), F.round("sharpe", 4).alias("sharpe"), *r6("hit_rate"))


@query(f"""{_DAILY} SELECT count(*) AS n, round(regr_slope(net, bench), 5) AS beta, round(regr_intercept(net, bench), 5) AS alpha, round(regr_r2(net, bench), 5) AS r2 FROM series""")
def portfolio_beta(spark, sf):
    return portfolio.beta(_series(spark, sf), [], "net", "bench").select("n", *[F.round(c, 5).alias(c) for c in ("beta", "alpha", "r2")])


@query(f"""{RETURNS}, m AS (SELECT date_trunc('month', event_date) AS month, avg(ar) AS m, count(ar) AS n FROM r5 WHERE ar IS NOT NULL GROUP BY 1) SELECT CAST(month AS DATE) AS month, n, round(m, 6) AS mean FROM m""")
def monthly_portfolio(spark, sf):
    return returns5(spark, sf).where("ar is not null").groupBy(F.trunc("event_date", "month").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("ar"), 6).alias("mean"))


@query(f"""{RETURNS}, s AS (SELECT unnest(CASE WHEN direction = 'positive' THEN ['all', 'long_only'] WHEN direction = 'negative' THEN ['all', 'short_only'] ELSE ['all'] END) AS strategy, CASE direction WHEN 'positive' THEN raw WHEN 'negative' THEN -raw ELSE 0 END AS x FROM r5 WHERE raw IS NOT NULL), c AS (SELECT CAST(unnest([0, 5, 10, 25, 50]) AS INTEGER) AS bps)
SELECT strategy, bps, count(*) AS n, round(avg(x - 2 * bps / 10000), 6) AS mean_net, round(avg(CASE WHEN x - 2 * bps / 10000 > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM s CROSS JOIN c GROUP BY 1, 2""")
def strategy_cost_grid(spark, sf):
    r = returns5(spark, sf).where("raw is not null").withColumn("x", portfolio.sign() * F.col("raw"))
    named = F.array_compact(F.array(F.lit("all"), F.when(F.col("direction") == "positive", "long_only"), F.when(F.col("direction") == "negative", "short_only")))
    g = r.select(F.explode(named).alias("strategy"), "x").withColumn("bps", F.explode(F.array(*[F.lit(b) for b in (0, 5, 10, 25, 50)])))
    net = portfolio.net(F.col("x"), F.col("bps"))
    return g.groupBy("strategy", "bps").agg(F.count("*").alias("n"), F.round(F.avg(net), 6).alias("mean_net"), F.round(F.avg(F.when(net > 0, 1.0).otherwise(0.0)), 6).alias("win_rate"))


@query(f"""{EVENTS}, d AS (SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS dl), f AS (SELECT ticker, idx - dl AS idx, dl, lead(px, 5) OVER (PARTITION BY ticker, dl ORDER BY pi.idx) / px - 1 AS r FROM pi CROSS JOIN d),
x AS (SELECT dl AS delay, CASE direction WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END * r - CASE WHEN dl > 0 THEN 5 / 10000.0 ELSE 0 END - 20 / 10000.0 AS net FROM al JOIN f USING (ticker, idx) WHERE r IS NOT NULL)
SELECT delay, count(*) AS n, round(avg(net), 6) AS mean_net FROM x GROUP BY 1""")
def execution_delay(spark, sf):
    from almanac.operators import calendar as cal

    i = index(spark, sf)
    e = returns.align(recommendations(spark, sf), i).withColumn("delay", F.explode(F.array(*[F.lit(d).cast("long") for d in (0, 1, 2)])))
    e = cal.offset(cal.offset(e, i, F.col("delay"), {"p0": "px"}, "inner"), i, F.col("delay") + 5, {"p1": "px"}, "inner")
    x = portfolio.net(portfolio.sign() * (F.col("p1") / F.col("p0") - 1), F.lit(10.0), F.col("delay") > 0)
    return e.groupBy("delay").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean_net"))


@query(f"""{RETURNS}, c AS (SELECT creator, avg(ar) AS m FROM r5 WHERE ar IS NOT NULL GROUP BY 1), q AS (SELECT quantile_cont(m, 0.75) AS cut FROM c) SELECT creator, round(m, 6) AS mean FROM c, q WHERE m >= cut""")
def top_quartile_creators(spark, sf):
    c = returns5(spark, sf).where("ar is not null").groupBy("creator").agg(F.avg("ar").alias("m"))
    q = stats.quantiles(c, [], "m", {"cut": 0.75})
    return c.crossJoin(F.broadcast(q)).where("m >= cut").select("creator", F.round("m", 6).alias("mean"))


@query(f"""{_DAILY}, m AS (SELECT date_trunc('month', date) AS month, avg(net) / 100 AS r FROM series GROUP BY 1), e AS (SELECT month, r, exp(sum(ln(1 + r)) OVER (ORDER BY month)) AS equity FROM m) SELECT CAST(month AS DATE) AS month, round(equity, 5) AS equity, round(equity / greatest(1.0, max(equity) OVER (ORDER BY month)) - 1, 5) AS drawdown FROM e""")
def equity_curve(spark, sf):
    m = _series(spark, sf).groupBy(F.trunc("date", "month").alias("month")).agg((F.avg("net") / 100).alias("r"))
    return portfolio.equity(m, "month", "r").select("month", F.round("equity", 5).alias("equity"), F.round("drawdown", 5).alias("drawdown"))


_CAP = 0.08


@query(f"""{EVENTS}, p AS (SELECT unnest(CASE direction WHEN 'positive' THEN ['long_only', 'long_short'] WHEN 'negative' THEN ['short_only', 'long_short'] ELSE [] END) AS strategy, ticker, idx, CASE direction WHEN 'positive' THEN 1.0 ELSE -1.0 END AS sg FROM al),
held AS (SELECT strategy, h, d.ticker, d.date, any_value(d.ret) AS ret, count(*) AS n, sum(sg) AS s, count(*) FILTER (k IN (1, h)) AS turns FROM p CROSS JOIN (SELECT unnest([1, 5, 20]) AS h) CROSS JOIN range(1, 21) t(k) JOIN daily d ON p.ticker = d.ticker AND p.idx + k = d.idx WHERE k <= h GROUP BY 1, 2, 3, 4),
lv AS (SELECT *, count(*) OVER g AS names, (1 - {_CAP} * (row_number() OVER o - 1)) / sum(n) OVER (PARTITION BY strategy, h, date ORDER BY n DESC, ticker ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM held WINDOW g AS (PARTITION BY strategy, h, date), o AS (PARTITION BY strategy, h, date ORDER BY n DESC, ticker)),
w AS (SELECT *, CASE WHEN names * {_CAP} <= 1 THEN 1.0 / names ELSE least({_CAP}, max(level) OVER (PARTITION BY strategy, h, date) * n) END AS w FROM lv),
s AS (SELECT strategy, h, date, max(w) AS top, sum(w / n * s * ret) AS gross, sum(w / n * turns) AS turnover FROM w GROUP BY 1, 2, 3),
x AS (SELECT *, gross - bps / 10000.0 * turnover AS net FROM s CROSS JOIN (SELECT CAST(unnest([0, 10, 25]) AS INTEGER) AS bps))
SELECT strategy, CAST(h AS INTEGER) AS h, bps, count(*) AS n, round(avg(net), 6) AS mean, round(stddev_samp(net), 6) AS sd, round(avg(net) / stddev_samp(net) * sqrt(252), 4) AS sharpe, round(CAST(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE), 6) AS hit_rate, round(avg(turnover), 6) AS turnover, round(avg(top), 6) AS top FROM x GROUP BY 1, 2, 3""")
def capped_portfolios(spark, sf):
    """Daily portfolios of three strategies, held over three horizons at three costs, in which no ticker weighs more than the
    cap while others can take the rest."""
    daily = returns.with_daily(index(spark, sf))
    e = returns.align(recommendations(spark, sf), daily).withColumn("sign", portfolio.sign())
    named = F.array_compact(F.array(F.when(F.col("sign") > 0, "long_only"), F.when(F.col("sign") < 0, "short_only"), F.when(F.col("sign") != 0, "long_short")))
    positions = e.select(F.explode(named).alias("strategy"), "ticker", "idx", "sign")
    series = [portfolio.capped_series(positions, daily, ["strategy"], h, _CAP).withColumn("h", F.lit(h)) for h in (1, 5, 20)]
    x = series[0].unionByName(series[1]).unionByName(series[2]).withColumn("bps", F.explode(F.array(*[F.lit(b) for b in (0, 10, 25)])))
    x = x.withColumn("net", F.col("gross") - F.col("bps") / 10000 * F.col("turnover"))
    m = portfolio.metrics(x, ["strategy", "h", "bps"], "net").join(x.groupBy("strategy", "h", "bps").agg(F.avg("turnover").alias("turnover"), F.avg("top").alias("top")), ["strategy", "h", "bps"])
    return m.select("strategy", "h", "bps", "n", *r6("mean", "sd"), F.round("sharpe", 4).alias("sharpe"), *r6("hit_rate", "turnover", "top"))
