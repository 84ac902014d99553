"""What goes before events and what follows: a feature table, selection and attention regressions, windows against several
benchmarks, records before events, and how well features predict."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.operators import confound, returns, scan, select, stats
from almanac.plans.inference import _coefficients, _ols_sql
from almanac.plans.registry import EV, EVENTS, aligned, index, query, r6
from almanac.sources.shared import written
from almanac.sources.tables import recommendations, table

_TOP = "substr(ticker, 7) IN ('1', '2', '3', '4', '5')"
_over = lambda k: f"(px / lag(px, {k}) OVER w - 1) - (bench / lag(bench, {k}) OVER w - 1)"
_ahead = lambda k: f"(lead(px, {k}) OVER w / px - 1) - (lead(bench, {k}) OVER w / bench - 1)"
#: Features of a ticker's rows: returns over the benchmark before and after, volatilities, volume against its usual.
_FX = f"""vq AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
fx AS MATERIALIZED (SELECT ticker, idx, {', '.join(f'{_over(k)} AS pre{k}' for k in (5, 21, 63))}, {', '.join(f'{_ahead(k)} AS post{k}' for k in (5, 21))}, stddev_samp(ret) OVER (w ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS vol21, stddev_samp(ret) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS post_vol5,
CASE WHEN count(*) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN volume / avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS volume_ratio FROM daily JOIN vq USING (ticker, date) WINDOW w AS (PARTITION BY ticker ORDER BY idx)),
fe AS (SELECT al.event_id, al.creator, al.event_date, al.direction, al.score, CAST({_TOP.replace('ticker', 'al.ticker')} AS DOUBLE) AS top, CAST(al.score <= 2 AS DOUBLE) AS sure, fx.* FROM al JOIN fx ON al.ticker = fx.ticker AND al.idx = fx.idx)"""
FEATURES = ["pre5", "pre21", "pre63", "vol21", "volume_ratio", "post5", "post21", "post_vol5"]


def row_features(spark, sf):
    """Every row of the price table with its features, from rows before and after it: no join for a horizon. Written once."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    volume = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("volume"))
    d = returns.with_daily(index(spark, sf)).join(volume, ["ticker", "date"])
    w = Window.partitionBy("ticker").orderBy("idx")
    gain = lambda x, k: F.col(x) / F.lag(x, k).over(w) - 1 if k > 0 else F.lead(x, -k).over(w) / F.col(x) - 1
    over = lambda k: gain("px", k) - gain("bench", k)
    before = w.rowsBetween(-20, -1)
    ratio = F.when(F.count("*").over(before) == 20, F.col("volume") / F.avg("volume").over(before))
    rows = d.select("ticker", "idx", *[over(k).alias(f"pre{k}") for k in (5, 21, 63)], *[over(-k).alias(f"post{k}") for k in (5, 21)], F.stddev_samp("ret").over(w.rowsBetween(-20, 0)).alias("vol21"), F.stddev_samp("ret").over(w.rowsBetween(1, 5)).alias("post_vol5"), ratio.alias("volume_ratio"))
    return written(rows, "rows")


def features(spark, sf):
    e = aligned(spark, sf).select("event_id", "creator", "ticker", "event_date", "direction", "score", "idx")
    return e.join(row_features(spark, sf), ["ticker", "idx"]).withColumns({"top": F.expr(_TOP).cast("double"), "sure": (F.col("score") <= 2).cast("double")})


@query(f"{EVENTS}, {_FX} SELECT event_id, top, sure, {', '.join(f'round({c}, 5) AS {c}' for c in FEATURES)} FROM fe")
def event_features(spark, sf):
    """A row for each matched event with what went before it and what followed."""
    return features(spark, sf).select("event_id", "top", "sure", *[F.round(c, 5).alias(c) for c in FEATURES])


_SELECTION = f"""{EVENTS}, {_FX}, pl AS (SELECT fx.* FROM fx ANTI JOIN (SELECT DISTINCT ticker, idx FROM al WHERE idx IS NOT NULL) t USING (ticker, idx) WHERE fx.pre63 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fx.ticker ORDER BY sha256(fx.ticker || '|' || CAST(fx.idx AS VARCHAR) || '|sel'), fx.idx) <= 80),
sel AS (SELECT 1.0 AS event, ticker, pre21, pre63, vol21, volume_ratio, direction, score FROM fe UNION ALL SELECT 0.0, ticker, pre21, pre63, vol21, volume_ratio, NULL, NULL FROM pl)"""


def _selection(spark, sf):
    """Events, and 80 seeded rows of each ticker on which there was none and whose past is as long."""
    f = row_features(spark, sf)
    e = aligned(spark, sf).where("idx is not null").select("ticker", "idx", "direction", "score")
    free = f.where("pre63 is not null").join(e.select("ticker", "idx").distinct(), ["ticker", "idx"], "left_anti").withColumn("h", select.seeded("ticker", "idx", seed="sel"))
    placebo = select.cap(free, ["ticker"], [F.asc("h"), F.asc("idx")], 80).drop("h").withColumns({"event": F.lit(0.0), "direction": F.lit(None).cast("string"), "score": F.lit(None).cast("int")})
    return e.join(f, ["ticker", "idx"]).withColumn("event", F.lit(1.0)).unionByName(placebo).withColumn("top", F.expr(_TOP).cast("double"))


@query(f"{_SELECTION}, {_ols_sql(f'SELECT pre21 AS y, event, CAST({_TOP} AS DOUBLE) AS top, event * CAST({_TOP} AS DOUBLE) AS event_top, ticker AS g FROM sel', ['event', 'top', 'event_top'], 'cluster')}")
def selection_regression(spark, sf):
    """Whether events are where returns had gone up: the 21 steps before on being an event, on the top class, and on both, with
    errors clustered by ticker."""
    d = written(_selection(spark, sf).select("ticker", "pre21", "event", "top", (F.col("event") * F.col("top")).alias("event_top")), "selection")  # which is passed over three times
    return _coefficients(spark, stats.ols(d, "pre21", ["event", "top", "event_top"], cluster="ticker"))


@query(f"""{_SELECTION}, l AS (SELECT *, unnest([pre21, pre63, vol21, volume_ratio]) AS x, unnest(['pre21', 'pre63', 'vol21', 'volume_ratio']) AS feature FROM sel),
s AS (SELECT feature, x, unnest(list_filter([CASE WHEN event = 0 THEN 'placebo' END, CASE WHEN event = 1 THEN 'events' END, CASE WHEN event = 1 AND {_TOP} THEN 'top_events' END, CASE WHEN event = 1 AND NOT {_TOP} THEN 'non_top_events' END, CASE WHEN direction = 'positive' THEN 'buy_events' END, CASE WHEN score <= 2 THEN 'sure_events' END], lambda v: v IS NOT NULL)) AS sample FROM l)
SELECT sample, feature, count(x) AS n, round(avg(x), 6) AS mean, round(avg(x) / (stddev_samp(x) / sqrt(count(x))), 3) AS t FROM s WHERE x IS NOT NULL GROUP BY 1, 2""")
def selection_means(spark, sf):
    """What went before events, and before rows without one, by sample."""
    d = _selection(spark, sf)
    is_event = F.col("event") == 1
    samples = {"placebo": ~is_event, "events": is_event, "top_events": is_event & (F.col("top") == 1), "non_top_events": is_event & (F.col("top") == 0), "buy_events": F.col("direction") == "positive", "sure_events": F.col("score") <= 2}
    named = F.array_compact(F.array(*[F.when(c, n) for n, c in samples.items()]))
    s = d.withColumn("sample", F.explode(named)).select("sample", F.expr("stack(4, 'pre21', pre21, 'pre63', pre63, 'vol21', vol21, 'volume_ratio', volume_ratio) as (feature, x)"))
    g = s.where("x is not null").groupBy("sample", "feature").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    return g.select("sample", "feature", "n", F.round("m", 6).alias("mean"), F.round(F.try_divide("m", F.col("sd") / F.sqrt("n")), 3).alias("t"))


@query(f"{EVENTS}, {_FX}, {_ols_sql('SELECT post_vol5 AS y, top, pre21, sure, ticker AS g FROM fe', ['top', 'pre21', 'sure'], 'robust')}")
def attention_regression(spark, sf):
    """Volatility of the five steps after an event on its class, what went before and how sure it was."""
    return _coefficients(spark, stats.ols(features(spark, sf), "post_vol5", ["top", "pre21", "sure"], robust=True))


# ---------------------------------------------------------------- windows against several benchmarks


_HORIZONS = {"1d": 1, "5d": 5, "21d": 21, "252d": 252}


@query(f"""{EVENTS}, cl AS (SELECT {_TOP} AS top, date, avg(px) AS cpx FROM pi GROUP BY 1, 2), b AS (SELECT pi.*, cpx FROM pi LEFT JOIN cl ON {_TOP.replace('ticker', 'pi.ticker')} = cl.top AND pi.date = cl.date),
x AS (SELECT al.event_id, h.name AS "window", al.idx, e.idx AS last_idx, s.px AS p0, e.px AS p1, s.bench AS b0, e.bench AS b1, s.cpx AS c0, e.cpx AS c1 FROM al CROSS JOIN (SELECT unnest({list(_HORIZONS)}) AS name, unnest({list(_HORIZONS.values())}) AS h) h LEFT JOIN b s ON al.ticker = s.ticker AND al.idx = s.idx LEFT JOIN b e ON al.ticker = e.ticker AND al.idx + h.h = e.idx),
r AS (SELECT *, CASE WHEN idx IS NULL THEN 'no_trading_day' WHEN p0 IS NULL OR p0 <= 0 THEN 'no_start_price' WHEN last_idx IS NULL THEN 'window_beyond_data' WHEN b0 IS NULL OR b1 IS NULL THEN 'no_benchmark' ELSE '' END AS invalid_reason FROM x)
SELECT event_id, "window", invalid_reason = '' AS valid, invalid_reason, CASE WHEN invalid_reason = '' THEN round(p1 / p0 - 1, 6) END AS raw, CASE WHEN invalid_reason = '' THEN round(p1 / p0 - b1 / b0, 6) END AS over_market, CASE WHEN invalid_reason = '' THEN round(p1 / p0 - c1 / c0, 6) END AS over_class FROM r""")
def benchmark_windows(spark, sf):
    """Each event's return over four windows against the market and against its class, or why there is none. A row's later
    prices are carried to it, so one join serves all windows and benchmarks."""
    i = index(spark, sf).withColumn("top", F.expr(_TOP))
    b = i.join(i.groupBy("top", "date").agg(F.avg("px").alias("cpx")), ["top", "date"])
    w = Window.partitionBy("ticker").orderBy("idx")
    later = F.array(*[F.struct(F.lit(n).alias("window"), *[F.lead(c, h).over(w).alias(f"{c}1") for c in ("idx", "px", "bench", "cpx")]) for n, h in _HORIZONS.items()])
    rows = b.select("ticker", "idx", "px", "bench", "cpx", later.alias("later"))
    blank = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(None).cast("long").alias("idx1"), *[F.lit(None).cast("double").alias(f"{c}1") for c in ("px", "bench", "cpx")]) for n in _HORIZONS])
    x = aligned(spark, sf).select("event_id", "ticker", "idx").join(rows, ["ticker", "idx"], "left").withColumn("l", F.explode(F.coalesce("later", blank))).select("event_id", "idx", "px", "bench", "cpx", "l.*")
    reason = confound.first_label((F.col("idx").isNull(), "no_trading_day"), (F.col("px").isNull() | (F.col("px") <= 0), "no_start_price"), (F.col("idx1").isNull(), "window_beyond_data"), (F.col("bench").isNull() | F.col("bench1").isNull(), "no_benchmark"), otherwise="")
    x = x.withColumn("invalid_reason", reason)
    ok = F.col("invalid_reason") == ""
    over = lambda c: F.when(ok, F.round(F.col("px1") / F.col("px") - F.col(f"{c}1") / F.col(c), 6))
    return x.select("event_id", "window", ok.alias("valid"), "invalid_reason", F.when(ok, F.round(F.col("px1") / F.col("px") - 1, 6)).alias("raw"), over("bench").alias("over_market"), over("cpx").alias("over_class"))


# ---------------------------------------------------------------- records before events


@query(f"""WITH {EV}, hd AS (SELECT ticker, event_date AS d, count(*) FILTER (direction = 'positive') AS up, count(*) FILTER (direction = 'negative') AS down, arg_max(direction, event_id) AS latest FROM ev GROUP BY 1, 2),
a AS (SELECT ev.event_id, ev.ticker, ev.event_date, hd.d, hd.latest FROM (SELECT *, event_date - 1 AS upto FROM ev) ev ASOF LEFT JOIN hd ON ev.ticker = hd.ticker AND ev.upto >= hd.d),
r AS (SELECT a.event_id, coalesce(sum(up), 0) AS ups, coalesce(sum(down), 0) AS downs FROM a LEFT JOIN hd ON a.ticker = hd.ticker AND hd.d BETWEEN a.event_date - 30 AND a.event_date - 1 GROUP BY 1)
SELECT a.event_id, CASE WHEN date_diff('day', a.d, event_date) <= 365 THEN a.d END AS record_date, CASE WHEN date_diff('day', a.d, event_date) <= 365 THEN latest END AS latest, CASE WHEN date_diff('day', a.d, event_date) <= 365 THEN CAST(date_diff('day', a.d, event_date) AS INTEGER) END AS age, CAST(ups AS BIGINT) AS ups, CAST(downs AS BIGINT) AS downs,
CASE WHEN a.d IS NULL THEN 'no_record' WHEN date_diff('day', a.d, event_date) > 365 THEN 'stale' WHEN ups > 0 AND downs > 0 THEN 'mixed_revisions' WHEN ups > 0 THEN 'upgraded' WHEN downs > 0 THEN 'downgraded' ELSE 'unrevised' END AS diagnosis FROM a JOIN r USING (event_id)""")
def record_diagnostics(spark, sf):
    """The ticker's last record of the year before an event's day, its age, and what was revised in the month before."""
    ev = recommendations(spark, sf).select("event_id", "ticker", "event_date", "direction")
    daily = ev.groupBy("ticker", F.col("event_date").alias("d")).agg(F.count_if(F.col("direction") == "positive").alias("up"), F.count_if(F.col("direction") == "negative").alias("down"), F.max_by("direction", "event_id").alias("latest"))
    asked = ev.select("event_id", "ticker", "event_date", F.date_sub("event_date", 1).alias("d"))
    a = scan.asof(asked, daily.select("ticker", "d", "latest"), "ticker", "d", ["latest"]).drop("d")
    counts = daily.select("ticker", F.col("d").alias("article_date"), "up", "down")
    r = confound.around(a, counts, {"ups": ("up", -30, -1), "downs": ("down", -30, -1)})
    age = F.datediff("event_date", "before.d")
    fresh = age <= 365
    some = lambda c: F.col(c) > 0
    said = confound.first_label((F.col("before").isNull(), "no_record"), (~fresh, "stale"), (some("ups") & some("downs"), "mixed_revisions"), (some("ups"), "upgraded"), (some("downs"), "downgraded"), otherwise="unrevised")
    return r.select("event_id", F.when(fresh, F.col("before.d")).alias("record_date"), F.when(fresh, F.col("before.latest")).alias("latest"), F.when(fresh, age).alias("age"), "ups", "downs", said.alias("diagnosis"))


@query("""WITH wk AS (SELECT p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT ticker, week, volume, volume - lag(volume, 4) OVER (PARTITION BY ticker ORDER BY week) AS change_4w FROM wk""")
def weekly_changes(spark, sf):
    """Each week's volume and its difference from four weeks with volume before."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    wk = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("ticker"), F.trunc("l_shipdate", "week").alias("week")).agg(F.sum("l_quantity").alias("volume"))
    return wk.withColumn("change_4w", F.col("volume") - F.lag("volume", 4).over(Window.partitionBy("ticker").orderBy("week")))


# ---------------------------------------------------------------- prediction


_AREAS = ["pre5", "pre21", "pre63", "vol21", "volume_ratio", "sure", "top"]


@query(f"""{EVENTS}, {_FX}, l AS (SELECT year(event_date) AS year, post21 > 0 AS y, unnest({_AREAS}) AS feature, unnest([{', '.join(f'round({c}, 9)' for c in _AREAS)}]) AS x FROM fe WHERE post21 IS NOT NULL), v AS (SELECT * FROM l WHERE x IS NOT NULL), r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY feature, year, x) - 1) / 2.0 AS rk FROM v WINDOW w AS (PARTITION BY feature, year ORDER BY x))
SELECT feature, year, count(*) AS n, count(*) FILTER (y) AS positives, round(CAST((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / nullif(count(*) FILTER (y) * (count(*) - count(*) FILTER (y)), 0) AS DOUBLE), 6) AS area FROM r GROUP BY 1, 2""")
def rank_areas(spark, sf):
    """How well each feature alone tells events that the ticker's lead follows from others, by year."""
    f = features(spark, sf).where("post21 is not null")
    x = f.select(F.year("event_date").cast("long").alias("year"), (F.col("post21") > 0).alias("y"), F.expr("stack(" + str(len(_AREAS)) + ", " + ", ".join(f"'{c}', round({c}, 9)" for c in _AREAS) + ") as (feature, x)"))
    return stats.rank_area(x, ["feature", "year"], "x", F.col("y")).select("feature", "year", "n", "positives", F.round("area", 6).alias("area"))


_SETS = {"market": ["pre5", "pre21", "pre63"], "all": ["pre5", "pre21", "pre63", "vol21", "volume_ratio", "top", "sure"]}


def _labelled(spark, sf):
    """Events with all features and whether the 21 steps after were above the benchmark, with three families of folds: a row for each
    different one, weighing as many as there are. Features are a ticker's and day's, so these grow with days, not events."""
    known = " and ".join(f"{c} is not null" for c in [*_SETS["all"], "post21"])
    f = features(spark, sf).where(known).withColumn("label", (F.col("post21") > 0).cast("double"))
    folds = {"creator": F.col("creator") % 3, "ticker": F.substring("ticker", 7, 9).cast("int") % 3, "year": F.year("event_date") % 3}
    f = f.select("label", *_SETS["all"], *[c.cast("int").alias(f"fold_{n}") for n, c in folds.items()])
    return written(f.groupBy(*f.columns).agg(F.count("*").cast("double").alias("weight")), "labelled")


@query()
def incremental_areas(spark, sf):
    """Areas of nested feature sets on folds of creators, tickers and years that the model hasn't seen: the mean over folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    d, rows = _labelled(spark, sf), []
    for name, columns in _SETS.items():
        assembled = VectorAssembler(inputCols=columns, outputCol="features").transform(d)
        for family in ("creator", "ticker", "year"):
            model = LogisticRegression(maxIter=8, regParam=0.01, weightCol="weight")  # which brings features to one scale itself
            fitted = CrossValidator(estimator=model, estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(weightCol="weight"), numFolds=3, foldCol=f"fold_{family}", parallelism=3).fit(assembled)
            rows.append((name, family, len(columns), float(fitted.avgMetrics[0])))
    return spark.createDataFrame(rows, "features string, unseen string, n_features int, area double")


@query()
def predictive_validity(spark, sf):
    """A model of the first 70 % of events by date on the others: accuracy beside the majority's, and area, for three targets."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = " and ".join(f"{c} is not null" for c in [*_SETS["all"], "post5", "post21"])
    f = features(spark, sf).where(known).select("event_id", "event_date", "top", "post5", "post21", *[c for c in _SETS["all"] if c != "top"])
    f = select.decile(f, [], [F.asc("event_date"), F.asc("event_id")], "tenth")
    f = written(f, "dated")
    low = stats.quantiles(f, [], "post21", {"q": 0.25}).first()["q"]
    targets = {"positive_5": F.col("post5") > 0, "positive_21": F.col("post21") > 0, "bottom_quarter_21": F.col("post21") <= F.lit(low)}
    steps = [VectorAssembler(inputCols=_SETS["all"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(maxIter=15, regParam=0.01)]
    out = None
    for name, target in targets.items():
        d = f.withColumn("label", target.cast("double"))
        train, test = d.where("tenth <= 7"), d.where("tenth > 7")
        likely = train.agg(F.avg("label")).first()[0]
        if likely in (None, 0.0, 1.0):
            continue
        scored = Pipeline(stages=steps).fit(train).transform(test).select("label", "prediction", F.round(vector_to_array("probability")[1], 9).alias("p"))
        scored = written(scored, "scored")
        area = stats.rank_area(scored, [], "p", F.col("label") == 1)
        hits = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.avg((F.col("label") == float(likely >= 0.5)).cast("double")).alias("majority"))
        one = area.crossJoin(F.broadcast(hits)).select(F.lit(name).alias("target"), "n", "positives", *r6("majority", "accuracy", "area"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "target string, n long, positives long, majority double, accuracy double, area double")
