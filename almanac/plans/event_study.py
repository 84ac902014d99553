"""Event-study queries: alignment, returns by horizon, censoring, cumulative returns, extremes, series features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.operators import calendar as cal
from almanac.operators import returns, stats
from almanac.plans.registry import AL, EV, EVENTS, PX, RETURNS, aligned, index, query, r6, returns5
from almanac.sources.tables import prices, recommendations, table


@query(f"""{RETURNS} SELECT ticker, count(ar) AS n, round(avg(ar), 6) AS mean, round(stddev_samp(ar), 6) AS sd, round(CASE WHEN stddev_samp(ar) > 0 THEN avg(ar) / (stddev_samp(ar) / sqrt(count(ar))) END, 6) AS t
FROM r5 GROUP BY ticker HAVING count(ar) >= 1""")
def abnormal_return_by_ticker(spark, sf):
    return stats.bundle(returns5(spark, sf), ["ticker"], "ar").select("ticker", "n", *r6("mean", "sd", "t"))


@query(f"{EVENTS} SELECT event_id, ticker, event_date, adj_date, idx, trade_date FROM al")
def align_events(spark, sf):
    return aligned(spark, sf).select("event_id", "ticker", "event_date", "adj_date", "idx", "trade_date")


@query(f"{EVENTS} SELECT event_id, CASE WHEN date_diff('day', event_date, pi.date) <= 9 THEN pi.idx END AS idx FROM ev ASOF LEFT JOIN pi ON ev.ticker = pi.ticker AND ev.event_date <= pi.date")
def asof_forward_tolerance(spark, sf):
    return cal.asof_forward(recommendations(spark, sf), index(spark, sf), "event_date", tolerance=9).select("event_id", "idx")


@query(f"{EVENTS} SELECT event_id, pi.idx, pi.date AS trade_date FROM ev ASOF LEFT JOIN pi ON ev.ticker = pi.ticker AND ev.event_date >= pi.date")
def asof_backward(spark, sf):
    return cal.asof_backward(recommendations(spark, sf), index(spark, sf), "event_date").select("event_id", "idx", "trade_date")


@query(f"""{EVENTS}, s AS (SELECT event_id, event_date, pi.date AS d FROM ev ASOF LEFT JOIN pi ON ev.ticker = pi.ticker AND ev.event_date >= pi.date),
b AS (SELECT *, (SELECT count(*) FROM range(CAST(d AS TIMESTAMP), CAST(event_date AS TIMESTAMP), INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6) AS lag_days FROM s)
SELECT event_id, CASE WHEN d IS NOT NULL AND lag_days <= 3 THEN d END AS fresh_date, CAST(CASE WHEN d IS NOT NULL THEN lag_days END AS INTEGER) AS lag_days FROM b""")
def asof_backward_staleness(spark, sf):
    """The last row on or before an event, null if it is more than three business days old, and its age."""
    out = cal.asof_backward(recommendations(spark, sf), index(spark, sf), "event_date").withColumn("lag_days", cal.business_days("trade_date", "event_date"))
    return out.select("event_id", F.when(F.col("lag_days") <= 3, F.col("trade_date")).alias("fresh_date"), "lag_days")


@query("""WITH c AS (SELECT * FROM events WHERE event_type = 'click'), v AS (SELECT * FROM events WHERE event_type = 'view')
SELECT c.event_id, v.ts AS ts_asof, v.value AS value_asof FROM c ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM v GROUP BY 1, 2) v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def asof_minutes_backward(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    clicks, views = e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return cal.asof_time(clicks, views, "user_id", "ts", ["value"]).select("event_id", "ts_asof", "value_asof")


@query("""WITH c AS (SELECT * FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT c.event_id, v.ts AS ts_asof, v.value AS value_asof FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts <= v.ts""")
def asof_minutes_forward(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    clicks, views = e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return cal.asof_time(clicks, views, "user_id", "ts", ["value"], forward=True).select("event_id", "ts_asof", "value_asof")


@query(f"""{EVENTS}, h AS (SELECT unnest([1, 5, 10, 21, 63]) AS h), r AS (SELECT event_id, CAST(h AS BIGINT) AS h, b.px / a.px - 1 AS raw, b.bench / a.bench - 1 AS bm, b.date AS end_date
FROM al CROSS JOIN h LEFT JOIN pi a ON al.ticker = a.ticker AND al.idx = a.idx LEFT JOIN pi b ON al.ticker = b.ticker AND al.idx + h = b.idx)
SELECT event_id, h, end_date, round(raw, 6) AS raw, round(bm, 6) AS benchmark, round(raw - bm, 6) AS ar FROM r""")
def horizon_grid(spark, sf):
    out = returns.horizon_returns(aligned(spark, sf), index(spark, sf), [1, 5, 10, 21, 63])
    return out.select("event_id", "h", "end_date", *r6("raw", "benchmark", "ar"))


@query(f"""{EVENTS} SELECT event_id, round(round(b.px / a.px - 1, 6) - round(b.bench / a.bench - 1, 6), 6) AS ar_1d, round(round(c.px / a.px - 1, 6) - round(c.bench / a.bench - 1, 6), 6) AS ar_5d
FROM al JOIN pi a ON al.ticker = a.ticker AND al.idx = a.idx LEFT JOIN pi b ON al.ticker = b.ticker AND al.idx + 1 = b.idx LEFT JOIN pi c ON al.ticker = c.ticker AND al.idx + 5 = c.idx""")
def event_study_rounded(spark, sf):
    """One- and five-step abnormal returns; returns are rounded before they are subtracted."""
    out = returns.horizon_returns(aligned(spark, sf).where("idx is not null"), index(spark, sf), [1, 5])
    ar = F.round(F.round("raw", 6) - F.round("benchmark", 6), 6)
    return out.groupBy("event_id").pivot("h", [1, 5]).agg(F.first(ar)).select("event_id", F.col("1").alias("ar_1d"), F.col("5").alias("ar_5d"))


WINDOWS = [("post_5", 0, 5), ("post_21", 0, 21), ("post_252", 0, 252), ("pre_5_1", -5, -1), ("pre_21_1", -21, -1)]
_PANEL = f"""{EVENTS}, g AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {s}, {e})" for n, s, e in WINDOWS)}) t(name, s, e)), ends AS (SELECT ticker, max(idx) AS last FROM pi GROUP BY 1),
w AS (SELECT al.*, name, s, e, last, coalesce(idx + s < 1, false) AS left_censored, coalesce(idx + e > last, false) AS right_censored, CASE WHEN idx IS NOT NULL THEN greatest(1, least(last, idx + s)) END AS i0, CASE WHEN idx IS NOT NULL THEN greatest(1, least(last, idx + e)) END AS i1
FROM al LEFT JOIN ends USING (ticker) CROSS JOIN g),
cs AS (SELECT ticker, idx, px, bench, sum(coalesce(ar, 0)) OVER w AS ca, sum(coalesce(ret, 0)) OVER w AS sr, sum(coalesce(ret * ret, 0)) OVER w AS sq, sum(CASE WHEN ar IS NULL THEN 1 ELSE 0 END) OVER w AS gaps FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY idx)),
p AS (SELECT w.*, i1 - i0 AS days, b.px / a.px - 1 AS raw, (b.px / a.px - 1) - (b.bench / a.bench - 1) AS bhar, CASE WHEN a.gaps = b.gaps THEN b.ca - a.ca END AS car,
CASE WHEN i1 - i0 >= 2 THEN sqrt(greatest(0, ((b.sq - a.sq) - (b.sr - a.sr) * (b.sr - a.sr) / (i1 - i0)) / (i1 - i0 - 1))) END AS vol,
CASE WHEN w.idx IS NULL THEN 'missing' WHEN right_censored OR left_censored THEN 'censored' ELSE 'computed' END AS status
FROM w LEFT JOIN cs a ON w.ticker = a.ticker AND w.i0 = a.idx LEFT JOIN cs b ON w.ticker = b.ticker AND w.i1 = b.idx)"""


def panel(spark, sf):
    daily = returns.with_daily(index(spark, sf))
    return returns.panel(returns.align(recommendations(spark, sf), daily), daily, WINDOWS)


@query(f"{_PANEL} SELECT event_id, name, CAST(days AS BIGINT) AS days, left_censored, right_censored, status, round(raw, 6) AS raw, round(bhar, 6) AS bhar, round(car, 5) AS car, round(vol, 4) AS vol FROM p")
def window_panel(spark, sf):
    return panel(spark, sf).select("event_id", "name", "days", "left_censored", "right_censored", "status", *r6("raw", "bhar"), F.round("car", 5).alias("car"), F.round("vol", 4).alias("vol"))


@query(f"""{_PANEL} SELECT name, count(*) AS n, count(*) FILTER (status = 'computed') AS computed, count(*) FILTER (right_censored) AS right_censored, count(*) FILTER (left_censored) AS left_censored, count(*) FILTER (status = 'missing') AS missing,
round(avg(bhar) FILTER (status = 'computed'), 6) AS mean_bhar FROM p GROUP BY name""")
def window_coverage(spark, sf):
    p = panel(spark, sf)
    return p.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "computed").alias("computed"), F.count_if("right_censored").alias("right_censored"), F.count_if("left_censored").alias("left_censored"), F.count_if(F.col("status") == "missing").alias("missing"), F.round(F.avg(F.when(F.col("status") == "computed", F.col("bhar"))), 6).alias("mean_bhar"))


@query(f"""WITH {PX}, {EV.replace("FROM orders)", "FROM orders_)")}, {AL}, ends AS (SELECT ticker, max(idx) AS last FROM pi GROUP BY 1) SELECT CASE WHEN event_date IS NULL THEN 'no_event_date' WHEN last IS NULL THEN 'no_price_series' WHEN idx IS NULL THEN 'after_last_price' ELSE 'matched' END AS reason, count(*) AS n
FROM al LEFT JOIN ends USING (ticker) GROUP BY 1""".replace("FROM orders_)", "FROM orders)").replace("ev AS (SELECT o_orderkey AS event_id, 'Brand#' || CAST(1 + o_orderkey % 25 AS VARCHAR) AS ticker", "ev AS (SELECT o_orderkey AS event_id, CASE WHEN o_custkey % 35 = 3 THEN 'Delisted' ELSE 'Brand#' || CAST(1 + o_orderkey % 25 AS VARCHAR) END AS ticker").replace("CAST(o_orderdate AS DATE) AS event_date", "CASE WHEN o_custkey % 35 <> 4 THEN CAST(o_orderdate + CASE WHEN o_custkey % 35 = 5 THEN INTERVAL 20 YEAR ELSE INTERVAL 0 YEAR END AS DATE) END AS event_date"))
def unmatched_reasons(spark, sf):
    """Why events have no trading day; some are given a ticker without prices, no date, or one after the last price."""
    i = index(spark, sf)
    ends = i.groupBy("ticker").agg(F.max("idx").alias("last"))
    c = F.col("creator")
    ev = recommendations(spark, sf).withColumns({"ticker": F.when(c == 3, "Delisted").otherwise(F.col("ticker")), "event_date": F.when(c == 5, F.add_months("event_date", 240)).when(c != 4, F.col("event_date"))})
    return returns.align(ev, i).join(ends, "ticker", "left").groupBy(F.coalesce(returns.missing_reason(), F.lit("matched")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""{EVENTS}, path AS (SELECT event_id, k, p.px, max(p.px) OVER w AS peak, min(p.px) OVER w AS low FROM al CROSS JOIN range(0, 22) t(k) JOIN pi p ON al.ticker = p.ticker AND al.idx + k = p.idx WINDOW w AS (PARTITION BY event_id ORDER BY k))
SELECT event_id, round(min(px / peak - 1), 6) AS max_drawdown, round(max(px / low - 1), 6) AS max_runup FROM path GROUP BY event_id""")
def drawdown_runup(spark, sf):
    i = index(spark, sf)
    return returns.path_extremes(returns.align(recommendations(spark, sf), i), i, 21).select("event_id", *r6("max_drawdown", "max_runup"))


@query(f"{EVENTS} SELECT CAST(k AS INTEGER) AS k, count(d.ar) AS n, round(avg(d.ar), 6) AS mean_ar FROM al CROSS JOIN range(-10, 22) t(k) JOIN daily d ON al.ticker = d.ticker AND al.idx + k = d.idx GROUP BY k")
def event_time_path(spark, sf):
    daily = returns.with_daily(index(spark, sf))
    return returns.event_path(returns.align(recommendations(spark, sf), daily), daily, 10, 21).select("k", "n", *r6("mean_ar"))


@query(f"""WITH {PX} SELECT ticker, date, round(ret, 6) AS ret_1, round(px / lag(px, 5) OVER w - 1, 6) AS ret_5, round(px - lag(px, 4) OVER w, 6) AS diff_4,
CASE WHEN count(px) OVER r20 >= 5 THEN round(avg(px) OVER r20, 6) END AS mean_21, CASE WHEN count(px) OVER r60 >= 20 AND stddev_samp(px) OVER r60 > 0 THEN round((px - avg(px) OVER r60) / stddev_samp(px) OVER r60, 6) END AS z_60,
CASE WHEN count(px) OVER r200 >= 80 THEN px > avg(px) OVER r200 END AS above_trend
FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY idx), r20 AS (PARTITION BY ticker ORDER BY idx ROWS 20 PRECEDING), r60 AS (PARTITION BY ticker ORDER BY idx ROWS 59 PRECEDING), r200 AS (PARTITION BY ticker ORDER BY idx ROWS 199 PRECEDING)""")
def rolling_features(spark, sf):
    w = Window.partitionBy("ticker").orderBy("idx")
    r20, r60, r200 = (w.rowsBetween(-k, 0) for k in (20, 59, 199))
    sd = F.stddev_samp("px").over(r60)
    return returns.with_daily(index(spark, sf)).select(
        "ticker", "date", F.round("ret", 6).alias("ret_1"), F.round(F.col("px") / F.lag("px", 5).over(w) - 1, 6).alias("ret_5"), F.round(F.col("px") - F.lag("px", 4).over(w), 6).alias("diff_4"),
        F.when(F.count("px").over(r20) >= 5, F.round(F.avg("px").over(r20), 6)).alias("mean_21"),
        F.when((F.count("px").over(r60) >= 20) & (sd > 0), F.round((F.col("px") - F.avg("px").over(r60)) / sd, 6)).alias("z_60"),
        F.when(F.count("px").over(r200) >= 80, F.col("px") > F.avg("px").over(r200)).alias("above_trend"))


@query(f"""WITH {PX} SELECT ticker, date, round(px / max(px) OVER r63 - 1, 6) AS drawdown_63, round(100 * sqrt(252) * stddev_samp(ret) OVER r21, 4) AS vol_21,
CAST(sum(CASE WHEN ar > 0 THEN 1 ELSE 0 END) OVER r252 AS BIGINT) AS up_days_252 FROM daily
WINDOW r63 AS (PARTITION BY ticker ORDER BY idx ROWS 62 PRECEDING), r21 AS (PARTITION BY ticker ORDER BY idx ROWS 20 PRECEDING), r252 AS (PARTITION BY ticker ORDER BY idx ROWS 251 PRECEDING)""")
def feature_vector(spark, sf):
    w = Window.partitionBy("ticker").orderBy("idx")
    return returns.with_daily(index(spark, sf)).select(
        "ticker", "date", F.round(F.col("px") / F.max("px").over(w.rowsBetween(-62, 0)) - 1, 6).alias("drawdown_63"),
        F.round(100 * F.sqrt(F.lit(252.0)) * F.stddev_samp("ret").over(w.rowsBetween(-20, 0)), 4).alias("vol_21"), F.count_if(F.col("ar") > 0).over(w.rowsBetween(-251, 0)).alias("up_days_252"))


REGIMES = [("1995-01-01", "1996-06-30", "early"), ("1996-07-01", "1997-12-31", "build"), ("1998-01-01", "1999-06-30", "boom"), ("1999-07-01", "2000-12-31", "peak")]


@query(f"""WITH {EV}, reg AS (SELECT * FROM (VALUES {', '.join(f"(DATE '{a}', DATE '{b}', '{n}')" for a, b, n in REGIMES)}) t(a, b, regime)) SELECT regime, count(*) AS n FROM ev LEFT JOIN reg ON event_date BETWEEN a AND b GROUP BY regime""")
def market_regime(spark, sf):
    c = F.lit(None).cast("string")
    for a, b, name in REGIMES:
        c = F.when(F.col("event_date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), name).otherwise(c)
    return recommendations(spark, sf).groupBy(c.alias("regime")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN isodow(ts) >= 6 THEN 'weekend_or_holiday' WHEN ((hour(ts) * 60 + minute(ts) - 300) % 1440 + 1440) % 1440 < 570 THEN 'before_open' WHEN ((hour(ts) * 60 + minute(ts) - 300) % 1440 + 1440) % 1440 < 960 THEN 'during_market' ELSE 'after_close' END AS bucket, count(*) AS n FROM events GROUP BY 1""")
def timing_buckets(spark, sf):
    return table(spark, sf, "events").groupBy(cal.timing_bucket("ts").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""{EVENTS}, near AS (SELECT ticker, idx, px, lag(px, 5) OVER w AS earlier, lead(px, 5) OVER w AS later FROM pi WINDOW w AS (PARTITION BY ticker ORDER BY idx)),
s AS (SELECT px / earlier - 1 AS pre, later / px - 1 AS post FROM al JOIN near USING (ticker, idx) WHERE earlier IS NOT NULL AND later IS NOT NULL)
SELECT CASE WHEN abs(pre) > 1e-6 AND abs(post) > 1e-6 THEN CASE WHEN sign(pre) = sign(post) THEN 'momentum' ELSE 'reversal' END ELSE 'flat' END AS pattern, count(*) AS n, round(avg(post), 6) AS mean_post FROM s GROUP BY 1""")
def momentum_reversal(spark, sf):
    i = index(spark, sf)
    a = cal.offset(aligned(spark, sf), i, F.lit(0), {"p0": "px"}, "inner")
    a = cal.offset(cal.offset(a, i, F.lit(-5), {"pm": "px"}, "inner"), i, F.lit(5), {"pp": "px"}, "inner")
    pre, post = F.col("p0") / F.col("pm") - 1, F.col("pp") / F.col("p0") - 1
    pattern = F.when((F.abs(pre) > 1e-6) & (F.abs(post) > 1e-6), F.when(F.signum(pre) == F.signum(post), "momentum").otherwise("reversal")).otherwise("flat")
    return a.select(pattern.alias("pattern"), post.alias("post")).groupBy("pattern").agg(F.count("*").alias("n"), F.round(F.avg("post"), 6).alias("mean_post"))


@query(f"""WITH {PX}, m AS (SELECT ticker, date_trunc('month', date) AS month, last(px ORDER BY date) AS px FROM pi GROUP BY 1, 2) SELECT ticker, CAST(month AS DATE) AS month, round(px / lag(px) OVER (PARTITION BY ticker ORDER BY month) - 1, 6) AS ret FROM m""")
def monthly_returns(spark, sf):
    m = prices(spark, sf).groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.max_by("px", "date").alias("px"))
    return m.select("ticker", "month", F.round(F.col("px") / F.lag("px").over(Window.partitionBy("ticker").orderBy("month")) - 1, 6).alias("ret"))
