"""Robustness queries: bootstraps, permutations, factor-adjusted returns, intraday windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.operators import calendar as cal
from almanac.operators import factors, resample, returns, scan
from almanac.operators.resample import poisson_sql, uniform_sql
from almanac.plans.registry import EVENTS, RETURNS, index, query, r6, returns5
from almanac.sources.tables import recommendations, table


def _draws(n: int) -> str:
    return f"(SELECT unnest(range(0, {n})) AS d)"


@query(f"""{RETURNS}, x AS (SELECT event_id, ar FROM r5 WHERE ar IS NOT NULL), m AS (SELECT d, sum(w * ar) / sum(w) AS m FROM (SELECT d, ar, {poisson_sql(uniform_sql('event_id', 'd', 42))} AS w FROM x CROSS JOIN {_draws(100)}) GROUP BY 1)
SELECT (SELECT count(*) FROM x) AS n, round((SELECT avg(ar) FROM x), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_interval(spark, sf):
    """Mean five-step abnormal return with the interval of draws of events."""
    return resample.bootstrap(returns5(spark, sf), "event_id", "ar", 100, 42).select("n", *r6("mean", "low", "high"))


@query(f"""{RETURNS}, s AS (SELECT creator, sum(CASE WHEN direction = 'positive' THEN ar ELSE 0 END) AS sa, count(*) FILTER (direction = 'positive') AS na, sum(CASE WHEN direction = 'positive' THEN 0 ELSE ar END) AS sb, count(*) FILTER (direction <> 'positive') AS nb FROM r5 WHERE ar IS NOT NULL GROUP BY 1),
m AS (SELECT d, sum(w * sa) / sum(w * na) - sum(w * sb) / sum(w * nb) AS m FROM (SELECT s.*, d, {poisson_sql(uniform_sql('creator', 'd', 496))} AS w FROM s CROSS JOIN {_draws(400)}) GROUP BY 1)
SELECT (SELECT count(*) FROM s) AS clusters, round((SELECT sum(sa) / sum(na) - sum(sb) / sum(nb) FROM s), 6) AS diff, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_difference(spark, sf):
    """Positive events' mean less the others', with the interval of draws of creators."""
    r = returns5(spark, sf).withColumn("number", F.col("creator"))
    return resample.bootstrap_difference(r, "creator", "number", "ar", F.col("direction") == "positive", 400, 496).select("clusters", *r6("diff", "low", "high"))


@query(f"""{RETURNS}, x AS (SELECT event_id, ar FROM r5 WHERE ar IS NOT NULL), o AS (SELECT count(*) AS n, avg(ar) AS mean FROM x), m AS (SELECT d, avg(CASE WHEN {uniform_sql('event_id', 'd', 42)} < 0.5 THEN -ar ELSE ar END) AS m FROM x CROSS JOIN {_draws(100)} GROUP BY 1)
SELECT any_value(n) AS n, round(any_value(mean), 6) AS mean, CAST(greatest(count(*) FILTER (abs(m) >= abs(mean)) / 100.0, 0.01) AS DOUBLE) AS p FROM m, o""")
def sign_flip_test(spark, sf):
    return resample.sign_flips(returns5(spark, sf), "event_id", "ar", 100, 42).select("n", *r6("mean"), "p")


def _permuted(h: str, draws: int, seed: int) -> str:
    return f"""x AS (SELECT ticker, event_id, {h} AS v, row_number() OVER (PARTITION BY ticker ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY ticker) AS size FROM r5 WHERE {h} IS NOT NULL),
k AS (SELECT d, ticker, CAST(floor({uniform_sql('event_id', 'd', seed)} * size) AS BIGINT) AS place FROM x CROSS JOIN {_draws(draws)}), m AS (SELECT d, avg(v) AS m FROM k JOIN x USING (ticker, place) GROUP BY 1), o AS (SELECT count(*) AS n, avg(v) AS mean FROM x)
SELECT any_value(n) AS n, round(any_value(mean), 6) AS mean, round(avg(m), 6) AS drawn_mean, round(CAST(avg(CASE WHEN abs(m) >= abs(mean) THEN 1.0 ELSE 0.0 END) AS DOUBLE), 6) AS p FROM m, o"""


@query(f"{RETURNS}, {_permuted('ar', 50, 7)}")
def within_ticker_permutation(spark, sf):
    """Events take the return of a drawn event of their ticker: how often the mean is as far from zero."""
    return resample.within_group(returns5(spark, sf), "ticker", "event_id", "ar", 50, 7).select("n", *r6("mean", "drawn_mean", "p"))


#: Steps, and numbers of draws after which the means are looked at; the last of them is how many there are.
_STEPS, _LOOKS = [21, 63, 126, 252], [20, 50]


@query(f"""{EVENTS}, hs AS (SELECT unnest({_STEPS}) AS h), rh AS (SELECT h, al.ticker, event_id, (b.px / a.px - 1) - (b.bench / a.bench - 1) AS v FROM al CROSS JOIN hs LEFT JOIN pi a ON al.ticker = a.ticker AND al.idx = a.idx LEFT JOIN pi b ON al.ticker = b.ticker AND al.idx + h = b.idx),
x AS (SELECT h, ticker, event_id, v, row_number() OVER (PARTITION BY h, ticker ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY h, ticker) AS size FROM rh WHERE v IS NOT NULL),
k AS (SELECT h, d, ticker, CAST(floor({uniform_sql('event_id', 'd', 11)} * size) AS BIGINT) AS place FROM x CROSS JOIN range({_LOOKS[-1]}) AS r(d)), m AS (SELECT h, d, avg(v) AS m FROM k JOIN x USING (h, ticker, place) GROUP BY 1, 2), o AS (SELECT h, count(v) AS n, avg(v) AS mean FROM hs LEFT JOIN x USING (h) GROUP BY 1)
SELECT CAST(o.h AS BIGINT) AS horizon, CAST(l AS BIGINT) AS draws, any_value(n) AS n, round(any_value(mean), 6) AS mean, round(avg(m), 6) AS drawn_mean, round(CAST(avg(CASE WHEN abs(m) >= abs(mean) THEN 1.0 ELSE 0.0 END) FILTER (m IS NOT NULL) AS DOUBLE), 6) AS p FROM o CROSS JOIN (SELECT unnest({_LOOKS}) AS l) LEFT JOIN m ON m.h = o.h AND d < l GROUP BY 1, 2""")
def long_horizon_permutation(spark, sf):
    """The same over 21, 63, 126 and 252 steps, after 20 draws and after all 50; the row of 63 steps after 20 comes first."""
    i, w = index(spark, sf), Window.partitionBy("ticker").orderBy("idx")
    ahead = lambda k: (F.lead("px", k).over(w) / F.col("px") - 1) - (F.lead("bench", k).over(w) / F.col("bench") - 1)
    rows = i.select("ticker", "idx", *[ahead(k).alias(str(k)) for k in _STEPS])
    r = returns.align(recommendations(spark, sf), i).select("event_id", "ticker", "idx").join(rows, ["ticker", "idx"])
    out = resample.within_groups(r, "ticker", "event_id", [str(k) for k in _STEPS], _LOOKS[-1], 11, _LOOKS)
    out = out.select(F.col("x").cast("long").alias("horizon"), "draws", "n", *r6("mean", "drawn_mean", "p"))
    return out.orderBy("draws", F.col("horizon") != 63, "horizon")


# ---------------------------------------------------------------- factors


_FACTORS = """fd AS (SELECT date, avg(bret) - 0.0001 AS mkt, avg(ret) FILTER (k <= 12) - avg(ret) FILTER (k > 12) AS smb, avg(ret) FILTER (k % 3 = 0) - avg(ret) FILTER (k % 3 = 1) AS hml, 0.0001 AS rf FROM (SELECT *, CAST(substr(ticker, 7) AS INTEGER) AS k FROM daily) GROUP BY 1),
fz AS (SELECT * FROM fd WHERE mkt IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL),
fy AS (SELECT d.ticker, d.idx, d.ret - rf AS y, mkt, smb, hml, rf, ret FROM daily d LEFT JOIN fz USING (date))"""


def daily_factors(daily):
    """(date, mkt, smb, hml, rf) from the tickers' own returns: the market, small less large numbers, and thirds."""
    k, ret = F.substring("ticker", 7, 9).cast("int"), F.col("ret")
    mean = lambda c: F.avg(F.when(c, ret))
    f = daily.groupBy("date").agg((F.avg("bret") - 0.0001).alias("mkt"), (mean(k <= 12) - mean(k > 12)).alias("smb"), (mean(k % 3 == 0) - mean(k % 3 == 1)).alias("hml"), F.lit(0.0001).alias("rf"))
    return f.where("mkt is not null and smb is not null and hml is not null")


def _loading_sql(name: str, start: int, end: int, least: int) -> str:
    f = ["mkt", "smb", "hml"]
    cov = lambda a, b: f"(sum({a} * {b}) - sum({a}) * sum({b}) / count(*))"
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    m = [[f"c_{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    covs = ", ".join(f"{cov(f[i], f[j])} AS c_{i}{j}" for i in range(3) for j in range(i, 3))
    slopes = ", ".join(f"{det([[f'v_{r}' if c == k else m[r][c] for c in range(3)] for r in range(3)])} / {det(m)} AS b_{f[k]}" for k in range(3))
    return f"""{name}_0 AS (SELECT al.event_id, al.ticker, al.idx, count(*) AS n, avg(y) AS my, {', '.join(f'avg({x}) AS m_{x}' for x in f)}, {covs}, {', '.join(f"{cov('y', x)} AS v_{i}" for i, x in enumerate(f))} FROM al JOIN fy ON al.ticker = fy.ticker AND fy.idx BETWEEN al.idx + {start} AND al.idx + {end} WHERE y IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= {least}),
{name}_1 AS (SELECT *, {slopes} FROM {name}_0), {name} AS (SELECT *, my - b_mkt * m_mkt - b_smb * m_smb - b_hml * m_hml AS a FROM {name}_1)"""


@query(f"""{RETURNS}, {_FACTORS}, {_loading_sql('near', -130, -1, 40)}, {_loading_sql('far', -252, -21, 60)},
w AS (SELECT al.event_id, CASE WHEN count(mkt) = 5 THEN 1 END AS ok, CASE WHEN count(mkt) = 5 THEN sum(rf) END AS rf, sum(mkt) AS mkt, sum(smb) AS smb, sum(hml) AS hml FROM al JOIN fy ON al.ticker = fy.ticker AND fy.idx BETWEEN al.idx + 1 AND al.idx + 5 GROUP BY 1)
SELECT r5.event_id, coalesce(near.n, 0) AS n, round(raw - w.rf - near.a * 5 - near.b_mkt * w.mkt - near.b_smb * w.smb - near.b_hml * w.hml, 4) AS alpha, round(raw - w.rf - far.a * 5 - far.b_mkt * w.mkt - far.b_smb * w.smb - far.b_hml * w.hml, 4) AS alpha_far, round(raw - w.rf - w.mkt - w.smb - w.hml, 5) AS unit_alpha
FROM r5 JOIN w USING (event_id) LEFT JOIN near USING (event_id) LEFT JOIN far USING (event_id) WHERE raw IS NOT NULL""")
def factor_alpha(spark, sf):
    """Five-step returns less what three factors explain: loadings from the 130 rows before, from rows 252 to 21 before, and
    all of them one."""
    daily = returns.with_daily(index(spark, sf))
    sums = factors.running(daily, daily_factors(daily))
    r = returns5(spark, sf).where("raw is not null").select("event_id", "ticker", "idx", "raw")
    e, raw = r.select("event_id", "ticker", "idx"), r.select("event_id", "raw")
    near = factors.abnormal(factors.loadings(e, sums, -130, -1, 40), sums, raw, 5).withColumn("n", F.when(F.col("n") >= 40, F.col("n")).otherwise(0))
    far = factors.abnormal(factors.loadings(e, sums, -252, -21, 60), sums, raw, 5).select("event_id", F.col("alpha").alias("alpha_far"))
    return near.join(far, "event_id").select("event_id", "n", F.round("alpha", 4).alias("alpha"), F.round("alpha_far", 4).alias("alpha_far"), F.round("unit_alpha", 5).alias("unit_alpha"))


# ---------------------------------------------------------------- within the day


_BARS = """hours AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS bench FROM events GROUP BY 1),
bars AS MATERIALIZED (SELECT *, date_trunc('hour', ts) AS hour FROM (SELECT user_id, ts, max(value) AS price, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS volume FROM events GROUP BY 1, 2) JOIN hours ON date_trunc('hour', ts) = hour)"""
_OPEN = "CAST(CAST(CAST({d} AS DATE) + CAST(CASE isodow(CAST({d} AS DATE)) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER) AS DATE) AS TIMESTAMP) + INTERVAL 570 MINUTE"
_MINUTES = [5, 15, 30, 60, 240, 1440]
_INTRADAY = f"""WITH {_BARS}, e AS (SELECT event_id, user_id, ts, ts - INTERVAL 5 HOUR AS et FROM events WHERE event_type = 'click'),
t AS (SELECT *, CASE WHEN isodow(et) >= 6 OR hour(et) * 60 + minute(et) + (CASE WHEN second(et) > 0 OR microsecond(et) % 1000000 > 0 THEN 1 ELSE 0 END) > 960 THEN {_OPEN.format(d="et + INTERVAL 1 DAY")} ELSE et END + INTERVAL 5 HOUR AS target FROM e),
a AS (SELECT t.event_id, t.user_id, t.target, bars.ts AS aligned, bars.price AS p0, bars.volume AS v0, bars.bench AS b0 FROM t ASOF LEFT JOIN bars ON t.user_id = bars.user_id AND t.target <= bars.ts)"""
_DAY = "CAST(CAST(aligned - INTERVAL 5 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 5 HOUR"
_AFTER = {f"w{m}": f"aligned + INTERVAL {m} MINUTE" for m in _MINUTES} | {"pre": "aligned - INTERVAL 60 MINUTE"}
_BEFORE = {"regular": f"{_DAY} + INTERVAL 16 HOUR", "last": f"{_DAY} + INTERVAL 24 HOUR - INTERVAL 1 MICROSECOND"}


def _met_sql() -> str:
    """A table for each place around an event: the bar that is there."""
    some = "(SELECT *, {at} AS at FROM a WHERE aligned IS NOT NULL)"
    return "".join(f", {n} AS (SELECT x.event_id, x.aligned, bars.ts, bars.price AS p, bars.volume AS v, bars.bench AS b FROM {some.format(at=at)} x ASOF JOIN bars ON x.user_id = bars.user_id AND x.at {'<=' if n in _AFTER else '>='} bars.ts)" for n, at in (_AFTER | _BEFORE).items())


@query(_INTRADAY + _met_sql() + f""", close AS (SELECT l.event_id, coalesce(r.p, l.p) AS p, coalesce(r.b, l.b) AS b FROM last l LEFT JOIN regular r ON l.event_id = r.event_id AND r.ts >= {_DAY.replace('aligned', 'r.aligned')})
SELECT a.event_id, a.target, a.aligned, {', '.join(f'round(w{m}.p / nullif(p0, 0) - 1, 6) AS return_{m}m, round(w{m}.p / nullif(p0, 0) - w{m}.b / nullif(b0, 0), 6) AS abnormal_{m}m' for m in _MINUTES)}, round(close.p / nullif(p0, 0) - 1, 6) AS return_to_close, round(close.p / nullif(p0, 0) - close.b / nullif(b0, 0), 6) AS abnormal_to_close,
round(CASE WHEN pre.ts < a.aligned THEN p0 / nullif(pre.p, 0) - 1 END, 6) AS pre_60m, {', '.join(f'round(w{m}.v / nullif(v0, 0) - 1, 6) AS volume_change_{m}m' for m in (30, 60))} FROM a """ + " ".join(f"LEFT JOIN {n} ON a.event_id = {n}.event_id" for n in [*_AFTER, "close"]))
def intraday_study(spark, sf):
    """Events go to the session's time: at night and on weekends to the next weekday's open at 9:30 in New York; then to the
    first bar from there. From it: returns, and returns less the market's, to the first bars some minutes later and to the
    day's last bar in the session (to its last one where none is in it), the return of the hour before, and how volume
    changes. All places around all events are met in one pass over the bars."""
    a = _intraday(spark, sf)
    some = a.where("aligned is not null")
    minutes = lambda m: F.col("aligned") + F.expr(f"interval {m} minute")
    day = lambda h: F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp("aligned", "America/New_York")) + F.expr(h), "America/New_York")
    places = {f"w{m}": minutes(m) for m in _MINUTES} | {"pre": minutes(-60), "regular": day("interval 16 hour"), "last": day("interval 24 hour") - F.expr("interval 1 microsecond")}
    asked = some.select("event_id", "user_id", F.explode(F.array(*[F.struct(F.lit(n).alias("place"), c.alias("ts")) for n, c in places.items()])).alias("x")).select("event_id", "user_id", "x.*")
    met = scan.asof(asked, _bars(spark, sf), "user_id", "ts", ["price", "volume", "bench"], before="before", after="after")
    there = lambda n: F.max(F.when(F.col("place") == n, F.col("before" if n in ("regular", "last") else "after"))).alias(n)
    out = a.join(met.groupBy("event_id").agg(*[there(n) for n in places]), "event_id", "left")
    out = out.withColumn("close", F.when(F.col("regular.ts") >= day("interval 0 hour"), F.col("regular")).otherwise(F.col("last")))
    over = lambda x, y: F.try_divide(F.col(x), F.col(y))
    gains = [c for n, end in [*[(f"{m}m", f"w{m}") for m in _MINUTES], ("to_close", "close")] for c in (F.round(over(f"{end}.price", "p0") - 1, 6).alias(f"return_{n}"), F.round(over(f"{end}.price", "p0") - over(f"{end}.bench", "b0"), 6).alias(f"abnormal_{n}"))]
    pre = F.round(F.when(F.col("pre.ts") < F.col("aligned"), over("p0", "pre.price") - 1), 6).alias("pre_60m")
    return out.select("event_id", "target", "aligned", *gains, pre, *[F.round(over(f"w{m}.volume", "v0") - 1, 6).alias(f"volume_change_{m}m") for m in (30, 60)])


def _bars(spark, sf):
    """A user's bars (price, volume) and the mean price of all in the hour."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bars = e.groupBy("user_id", "ts").agg(F.max("value").alias("price"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("volume")).withColumn("hour", F.date_trunc("hour", "ts"))
    return bars.join(e.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("bench")), "hour").drop("hour")


def _intraday(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'click'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("target", cal.session_target("ts"))
    a = cal.asof_time(e.select("event_id", "user_id", F.col("target").alias("ts")), _bars(spark, sf), "user_id", "ts", ["price", "volume", "bench"], forward=True)
    return a.select("event_id", "user_id", F.col("ts").alias("target"), F.col("ts_asof").alias("aligned"), F.col("price_asof").alias("p0"), F.col("volume_asof").alias("v0"), F.col("bench_asof").alias("b0"))


@query(_INTRADAY + f""", o AS (SELECT event_id, user_id, p0, aligned, {_OPEN.format(d="aligned - INTERVAL 5 HOUR + INTERVAL 1 DAY")} + INTERVAL 5 HOUR AS next_open, CAST(CAST(aligned - INTERVAL 5 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 24 HOUR + INTERVAL 5 HOUR - INTERVAL 1 MICROSECOND AS day_end FROM a WHERE aligned IS NOT NULL),
c AS (SELECT o.event_id, bars.price AS close FROM o ASOF JOIN bars ON o.user_id = bars.user_id AND o.day_end >= bars.ts), n AS (SELECT o.event_id, bars.price AS opened FROM o ASOF JOIN bars ON o.user_id = bars.user_id AND o.next_open <= bars.ts)
SELECT o.event_id, round(close / nullif(p0, 0) - 1, 6) AS to_close, round(opened / nullif(close, 0) - 1, 6) AS gap, round(opened / nullif(p0, 0) - 1, 6) AS to_open, date_diff('day', CAST(aligned AS DATE), (SELECT CAST(max(ts) AS DATE) FROM events)) <= 20 AS feasible FROM o LEFT JOIN c USING (event_id) LEFT JOIN n USING (event_id)""")
def intraday_windows(spark, sf):
    """From an aligned event to the day's last bar, from there to the next open, both together; and whether minute data
    still reach back to it."""
    a, bars = _intraday(spark, sf).where("aligned is not null"), _bars(spark, sf)
    et = lambda c: F.from_utc_timestamp(c, "America/New_York")
    day_end = F.to_utc_timestamp(F.date_trunc("day", et("aligned")) + F.expr("interval 1 day"), "America/New_York") - F.expr("interval 1 microsecond")
    places = F.array(F.struct(F.lit("close").alias("place"), day_end.alias("ts")), F.struct(F.lit("opened").alias("place"), cal.next_open("aligned").alias("ts")))
    asked = a.select("event_id", "user_id", F.explode(places).alias("x")).select("event_id", "user_id", "x.*")
    met = scan.asof(asked, bars, "user_id", "ts", ["price"], before="before", after="after")
    there = met.groupBy("event_id").agg(F.max(F.when(F.col("place") == "close", F.col("before.price"))).alias("close"), F.max(F.when(F.col("place") == "opened", F.col("after.price"))).alias("opened"))
    last = table(spark, sf, "events").agg(F.to_date(F.max("ts")).alias("last"))
    j = a.join(there, "event_id", "left").crossJoin(F.broadcast(last))
    gain = lambda x, y: F.round(F.try_divide(x, y) - 1, 6)
    return j.select("event_id", gain("close", "p0").alias("to_close"), gain("opened", "close").alias("gap"), gain("opened", "p0").alias("to_open"), (F.datediff("last", F.to_date("aligned")) <= 20).alias("feasible"))
