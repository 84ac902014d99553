"""Control queries: placebo shifts and draws, matched controls, label shuffles, pre-trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.operators import calendar as cal
from almanac.operators import returns, select
from almanac.plans.registry import EVENTS, RETURNS, aligned, index, query, returns5
from almanac.sources.shared import written

_AT = "SELECT al.event_id, al.ticker, al.idx, al.direction, al.event_date, al.creator, al.size FROM al WHERE idx IS NOT NULL"


@query(f"""{EVENTS}, f AS (SELECT ticker, idx, (lead(px, 5) OVER w / px - 1) - (lead(bench, 5) OVER w / bench - 1) AS ar FROM pi WINDOW w AS (PARTITION BY ticker ORDER BY idx)), g AS (SELECT event_id, ticker, idx + shift AS idx, shift FROM al CROSS JOIN (SELECT CAST(unnest([-60, -30, 0, 30, 60]) AS BIGINT) AS shift))
SELECT shift, count(*) AS n, round(avg(ar), 6) AS mean_ar FROM g JOIN f USING (ticker, idx) WHERE ar IS NOT NULL GROUP BY 1""")
def placebo_shifts(spark, sf):
    i = index(spark, sf)
    e = returns.align(aligned(spark, sf).drop("adj_date", "idx", "trade_date"), i).where("idx is not null").withColumn("shift", F.explode(F.array(*[F.lit(s).cast("long") for s in (-60, -30, 0, 30, 60)])))
    e = cal.offset(cal.offset(e, i, F.col("shift"), {"p0": "px", "b0": "bench"}, "inner"), i, F.col("shift") + 5, {"p1": "px", "b1": "bench"}, "inner")
    ar = F.col("p1") / F.col("p0") - F.col("b1") / F.col("b0")
    return e.groupBy("shift").agg(F.count("*").alias("n"), F.round(F.avg(ar), 6).alias("mean_ar"))


@query(f"""{EVENTS}, e AS (SELECT DISTINCT ticker, idx FROM al WHERE idx IS NOT NULL), free AS (SELECT ticker, idx FROM pi ANTI JOIN e USING (ticker, idx)), r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY sha256(ticker || '|' || CAST(idx AS VARCHAR) || '|pl'), idx) AS k FROM free) SELECT ticker, idx FROM r WHERE k <= 3""")
def placebo_rows(spark, sf):
    """Three seeded rows of each ticker on which nothing happened."""
    e = aligned(spark, sf).where("idx is not null").select("ticker", "idx").distinct()
    free = index(spark, sf).select("ticker", "idx").join(e, ["ticker", "idx"], "left_anti").withColumn("h", select.seeded("ticker", "idx", seed="pl"))
    return select.cap(free, ["ticker"], [F.asc("h"), F.asc("idx")], 3).select("ticker", "idx")


@query(f"""{RETURNS}, x AS (SELECT event_id, ar, year(event_date) AS y FROM r5 WHERE ar IS NOT NULL), k AS (SELECT unnest(range(0, 20)) AS rep), p AS (SELECT rep, y, ar, row_number() OVER (PARTITION BY rep, y ORDER BY sha256(CAST(event_id AS VARCHAR) || '|' || CAST(rep AS VARCHAR) || '|sh'), event_id) AS r, count(*) OVER (PARTITION BY rep, y) AS n FROM x CROSS JOIN k) SELECT CAST(rep AS INTEGER) AS rep, count(*) AS n, round(avg(ar), 6) AS mean_ar FROM p WHERE r <= n // 3 GROUP BY 1""")
def year_stratified_shuffle(spark, sf):
    """In each replicate a seeded third of each year's events: how means spread if labels are shuffled within years."""
    x = written(returns5(spark, sf).where("ar is not null").select("event_id", "ar", F.year("event_date").alias("y")), "shuffled")
    drawn = select.first_seeded(x.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(19)))), ["rep", "y"], ["event_id", "rep"], "sh", "event_id", 3, "ar")
    return drawn.groupBy("rep").agg(F.sum("n").alias("n"), F.round(F.try_divide(F.sum("s"), F.sum("c")), 6).alias("mean_ar"))


@query(f"""{EVENTS}, t AS (SELECT al.event_id, al.ticker, al.idx, date_trunc('month', al.trade_date) AS month, round(a.px / p.px - 1, 6) AS pre FROM al JOIN pi a ON al.ticker = a.ticker AND al.idx = a.idx JOIN pi p ON al.ticker = p.ticker AND al.idx - 5 = p.idx),
c AS (SELECT a.ticker, a.idx, date_trunc('month', a.date) AS month, round(a.px / p.px - 1, 6) AS pre FROM pi a JOIN pi p ON a.ticker = p.ticker AND a.idx - 5 = p.idx),
x AS (SELECT event_id, c.idx AS control, row_number() OVER (PARTITION BY event_id ORDER BY abs(c.pre - t.pre), c.idx) AS r FROM t JOIN c ON t.ticker = c.ticker AND t.month = c.month AND abs(c.idx - t.idx) > 5) SELECT event_id, control FROM x WHERE r = 1""")
def matched_control_month(spark, sf):
    """Each event's control: the row of the same ticker and month, more than five rows away, whose five-step momentum is
    nearest. Events of one ticker and trade day have one control, which is found once."""
    i = index(spark, sf)
    w = Window.partitionBy("ticker").orderBy("idx")
    pre = F.round(F.col("px") / F.lag("px", 5).over(w) - 1, 6)
    c = i.withColumn("pre", pre).where("pre is not null").select("ticker", F.trunc("date", "month").alias("month"), F.col("idx").alias("control"), F.col("pre").alias("c_pre"))
    e = returns.align(aligned(spark, sf).drop("adj_date", "idx", "trade_date"), i).where("idx is not null").select("event_id", "ticker", "idx", "trade_date")
    days = e.select("ticker", "idx", "trade_date").distinct()
    t = cal.offset(days, i.withColumn("pre", pre), F.lit(0), {"pre": "pre"}, "inner").where("pre is not null").withColumn("month", F.trunc("trade_date", "month"))
    near = t.join(c, ["ticker", "month"]).where("abs(control - idx) > 5")
    best = near.groupBy("ticker", "idx").agg(F.min_by("control", F.struct(F.abs(F.col("c_pre") - F.col("pre")), "control")).alias("control"))
    return e.join(best, ["ticker", "idx"]).select("event_id", "control")


@query(f"""{EVENTS}, f AS (SELECT event_id, ticker, idx FROM al QUALIFY row_number() OVER (PARTITION BY creator, ticker ORDER BY event_date, event_id) = 1), m AS (SELECT ticker, idx, round((px / lag(px, 21) OVER w) - (bench / lag(bench, 21) OVER w), 6) AS pre FROM pi WINDOW w AS (PARTITION BY ticker ORDER BY idx)),
c AS (SELECT * FROM m WHERE pre IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.ticker = m.ticker AND abs(f.idx - m.idx) <= 10)), t AS (SELECT event_id, f.ticker, m.pre FROM f JOIN m ON f.ticker = m.ticker AND f.idx = m.idx WHERE pre IS NOT NULL)
SELECT event_id, c.idx AS control, round(abs(c.pre - t.pre), 6) AS distance FROM t JOIN c ON t.ticker = c.ticker QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(c.pre - t.pre), c.idx) = 1""")
def nearest_control(spark, sf):
    """A creator's first event of a ticker beside the ticker's day whose 21-step momentum over the benchmark is nearest, among
    days more than ten steps from every such event."""
    i = index(spark, sf)
    first = select.keep_first(returns.align(aligned(spark, sf).drop("adj_date", "idx", "trade_date"), i), ["creator", "ticker"], [F.asc("event_date"), F.asc("event_id")]).where("idx is not null").select("event_id", "ticker", "idx")
    w = Window.partitionBy("ticker").orderBy("idx")
    m = i.select("ticker", "idx", F.round(F.col("px") / F.lag("px", 21).over(w) - F.col("bench") / F.lag("bench", 21).over(w), 6).alias("pre")).where("pre is not null")
    free = select.away_from(m, first, "ticker", "idx", 10).withColumnRenamed("idx", "control")
    return select.nearest(first.join(m, ["ticker", "idx"]).drop("idx"), free, ["ticker"], "pre", "control").where("control is not null").select("event_id", "control", F.round("distance", 6).alias("distance"))


@query(f"""{EVENTS}, e AS ({_AT}), c AS (SELECT ticker, row_number() OVER (ORDER BY count(*) DESC, ticker) <= 5 AS top FROM e GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY ticker) - 1 AS pos, count(*) OVER (PARTITION BY top) AS size FROM c),
d AS (SELECT e.event_id, k.top, k.pos, ((e.event_id * 7919 + 104729) % 1000003) % (k.size - 1) AS j FROM e JOIN k ON e.ticker = k.ticker WHERE k.size > 1) SELECT d.event_id, o.ticker AS placebo FROM d JOIN k o ON d.top = o.top AND o.pos = d.j + CASE WHEN d.j >= d.pos THEN 1 ELSE 0 END""")
def cross_ticker_placebo(spark, sf):
    """A drawn other ticker of the same class (the five busiest, or the rest): a place in the class, drawn from the event's
    id and skipping its own, is joined to the ticker there."""
    e = aligned(spark, sf).where("idx is not null").select("event_id", "ticker")
    counts = e.groupBy("ticker").count()
    busy = counts.withColumn("top", F.row_number().over(Window.orderBy(F.desc("count"), "ticker")) <= 5)  # a row for each ticker
    k = busy.select("ticker", "top", (F.row_number().over(Window.partitionBy("top").orderBy("ticker")) - 1).alias("pos"), F.count("*").over(Window.partitionBy("top")).alias("size"))
    j = ((F.col("event_id") * 7919 + 104729) % 1000003) % (F.col("size") - 1)
    d = e.join(k.where("size > 1"), "ticker").withColumn("j", j).withColumn("to", F.col("j") + (F.col("j") >= F.col("pos")).cast("int"))
    return d.select("event_id", "top", F.col("to").alias("pos")).join(k.select("top", F.col("pos").cast("long").alias("pos"), F.col("ticker").alias("placebo")), ["top", "pos"]).select("event_id", "placebo")


def _windows_sql() -> str:
    grid = [("pre_20_11", -20, -11), ("pre_10_6", -10, -6), ("pre_5_1", -5, -1), ("post_1_5", 1, 5), ("post_6_20", 6, 20)]
    part = "SELECT '{n}' AS name, direction, ar FROM al JOIN (SELECT ticker, idx - ({s}) AS idx, (lead(px, {k}) OVER w / px - 1) - (lead(bench, {k}) OVER w / bench - 1) AS ar FROM pi WINDOW w AS (PARTITION BY ticker ORDER BY idx)) f USING (ticker, idx)"
    return " UNION ALL ".join(part.format(n=n, s=s, k=e - s) for n, s, e in grid)


@query(f"""{EVENTS}, x AS ({_windows_sql()}) SELECT name, direction, count(*) AS n, round(avg(ar), 6) AS mean_ar FROM x WHERE ar IS NOT NULL GROUP BY 1, 2""")
def pretrend_and_decay(spark, sf):
    i = index(spark, sf)
    grid = [("pre_20_11", -20, -11), ("pre_10_6", -10, -6), ("pre_5_1", -5, -1), ("post_1_5", 1, 5), ("post_6_20", 6, 20)]
    e = aligned(spark, sf).where("idx is not null").withColumn("g", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("s"), F.lit(t).alias("e")) for n, s, t in grid]))).select("*", "g.*")
    e = cal.offset(cal.offset(e, i, F.col("s"), {"p0": "px", "b0": "bench"}, "inner"), i, F.col("e"), {"p1": "px", "b1": "bench"}, "inner")
    return e.groupBy("name", "direction").agg(F.count("*").alias("n"), F.round(F.avg(F.col("p1") / F.col("p0") - F.col("b1") / F.col("b0")), 6).alias("mean_ar"))


@query(f"""{RETURNS}, p AS (SELECT ticker, event_date, ar FROM r5 WHERE ar IS NOT NULL) SELECT ticker, count(*) AS n, count(*) FILTER (ar > 0) AS popped, round(avg(CASE WHEN ar > 0 THEN 1.0 ELSE 0.0 END), 6) AS pop_rate FROM p GROUP BY 1""")
def pop_rates(spark, sf):
    return returns5(spark, sf).where("ar is not null").groupBy("ticker").agg(F.count("*").alias("n"), F.count_if(F.col("ar") > 0).alias("popped"), F.round(F.avg(F.when(F.col("ar") > 0, 1.0).otherwise(0.0)), 6).alias("pop_rate"))
