"""Aggregate queries: conditional, distinct, pivots, grouping sets, shares, leave-one-out, confusion counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.operators import stats
from almanac.plans.registry import EV, RETURNS, query, r6, returns5
from almanac.sources.tables import recommendations, table


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY 1, 2""")
def named_aggregates(spark, sf):
    x = table(spark, sf, "lineitem")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"))


@query(f"""WITH {EV} SELECT creator, count(*) FILTER (direction = 'positive') AS pos, count(*) FILTER (direction = 'negative') AS neg, count(DISTINCT ticker) AS tickers, count(DISTINCT event_date) AS days, round(max(size), 2) AS biggest FROM ev GROUP BY creator HAVING count(*) >= 3""")
def conditional_distinct(spark, sf):
    return recommendations(spark, sf).groupBy("creator").agg(F.count("*").alias("n"), F.count_if(F.col("direction") == "positive").alias("pos"), F.count_if(F.col("direction") == "negative").alias("neg"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("event_date").alias("days"), F.round(F.max("size"), 2).alias("biggest")).where("n >= 3").drop("n")


@query(f"""WITH {EV} SELECT creator, count(*) FILTER (direction = 'positive') AS positive, count(*) FILTER (direction = 'negative') AS negative, count(*) FILTER (direction = 'neutral') AS neutral FROM ev GROUP BY 1""")
def pivot_counts(spark, sf):
    kinds = ["positive", "negative", "neutral"]
    return recommendations(spark, sf).groupBy("creator").pivot("direction", kinds).count().na.fill(0, kinds)


@query(f"""WITH {EV} SELECT ticker, 'n' AS measure, CAST(count(*) AS DOUBLE) AS value FROM ev GROUP BY 1 UNION ALL SELECT ticker, 'size', round(avg(size), 4) FROM ev GROUP BY 1 UNION ALL SELECT ticker, 'score', round(avg(score), 6) FROM ev GROUP BY 1""")
def unpivot_measures(spark, sf):
    g = recommendations(spark, sf).groupBy("ticker").agg(F.count("*").cast("double").alias("n"), F.round(F.avg("size"), 4).alias("size"), F.round(F.avg("score"), 6).alias("score"))
    return g.unpivot("ticker", ["n", "size", "score"], "measure", "value")


@query(f"""WITH {EV} SELECT creator, year(event_date) AS year, count(*) AS n, CAST(grouping(creator) * 2 + grouping(year(event_date)) AS BIGINT) AS level FROM ev GROUP BY CUBE (creator, year(event_date))""")
def cube_counts(spark, sf):
    return recommendations(spark, sf).withColumn("year", F.year("event_date").cast("long")).cube("creator", "year").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query(f"""WITH {EV} SELECT creator, ticker, direction, count(*) AS n FROM ev GROUP BY GROUPING SETS ((creator), (ticker), (direction), ())""")
def grouping_sets(spark, sf):
    keys = ["creator", "ticker", "direction"]
    return recommendations(spark, sf).groupingSets([["creator"], ["ticker"], ["direction"], []], *keys).agg(F.count("*").alias("n")).select(*keys, "n")


@query("""SELECT c_mktsegment, n_regionkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)""")
def rollup_balances(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).rollup("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@query(f"""WITH {EV} SELECT ticker, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, row_number() OVER (ORDER BY count(*) DESC, ticker) AS rank FROM ev GROUP BY ticker""")
def concentration(spark, sf):
    g = recommendations(spark, sf).groupBy("ticker").agg(F.count("*").alias("n"))
    return g.select("ticker", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"), F.row_number().over(Window.orderBy(F.desc("n"), "ticker")).cast("long").alias("rank"))


@query(f"""WITH {EV} SELECT creator, count(*) AS n FROM ev GROUP BY creator ORDER BY n DESC, creator LIMIT 8""")
def most_common(spark, sf):
    return recommendations(spark, sf).groupBy("creator").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "creator").limit(8)


@query(f"""WITH {EV}, d AS (SELECT event_date, creator, avg(size) AS m FROM ev GROUP BY 1, 2) SELECT event_date, count(*) AS creators, round(avg(m), 6) AS mean FROM d GROUP BY 1""")
def two_stage_mean(spark, sf):
    d = recommendations(spark, sf).groupBy("event_date", "creator").agg(F.avg("size").alias("m"))
    return d.groupBy("event_date").agg(F.count("*").alias("creators"), F.round(F.avg("m"), 6).alias("mean"))


@query(f"""WITH {EV} SELECT creator, string_agg(DISTINCT direction, ';' ORDER BY direction) AS directions, count(DISTINCT direction) AS kinds, round(max(abs(size - 200000)), 2) AS furthest FROM ev GROUP BY 1""")
def label_sets(spark, sf):
    return recommendations(spark, sf).groupBy("creator").agg(F.array_join(F.sort_array(F.collect_set("direction")), ";").alias("directions"), F.countDistinct("direction").alias("kinds"), F.round(F.max(F.abs(F.col("size") - 200000)), 2).alias("furthest"))


@query(f"""WITH {EV} SELECT direction, round(quantile_cont(size, 0.05), 4) AS p05, round(quantile_cont(size, 0.25), 4) AS p25, round(median(size), 4) AS p50, round(quantile_cont(size, 0.95), 4) AS p95 FROM ev GROUP BY 1""")
def quantiles(spark, sf):
    q = stats.quantiles(recommendations(spark, sf), ["direction"], "size", {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p95": 0.95})
    return q.select("direction", *[F.round(c, 4).alias(c) for c in ("p05", "p25", "p50", "p95")])


@query(f"""{RETURNS}, g AS (SELECT ticker, count(ar) AS c, sum(ar) AS s, sum(ar * ar) AS q FROM r5 WHERE ar IS NOT NULL GROUP BY 1), t AS (SELECT ticker, sum(c) OVER () - c AS n, sum(s) OVER () - s AS s, sum(q) OVER () - q AS q FROM g)
SELECT ticker, CAST(n AS BIGINT) AS n_left, round(s / n, 6) AS mean_left, round(CASE WHEN (q - s * s / n) / (n - 1) > 0 THEN (s / n) / sqrt((q - s * s / n) / (n - 1) / n) END, 4) AS t_left FROM t""")
def leave_one_ticker_out(spark, sf):
    return stats.leave_one_out(returns5(spark, sf), "ticker", "ar").select("ticker", "n_left", *r6("mean_left"), F.round("t_left", 4).alias("t_left"))


@query(f"""WITH {EV}, c AS (SELECT creator, ticker, event_date, count(*) AS k FROM ev GROUP BY 1, 2, 3) SELECT count(*) AS clusters, count(*) FILTER (k > 1) AS repeated, max(k) AS biggest, CAST(sum(k) AS BIGINT) AS events FROM c""")
def duplicate_overview(spark, sf):
    c = recommendations(spark, sf).groupBy("creator", "ticker", "event_date").agg(F.count("*").alias("k"))
    return c.agg(F.count("*").alias("clusters"), F.count_if(F.col("k") > 1).alias("repeated"), F.max("k").alias("biggest"), F.sum("k").alias("events"))


@query("""WITH x AS (SELECT quality = 1 AS truth, length(text) > 600 AS guess FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn, count(*) FILTER (NOT truth AND NOT guess) AS tn FROM x)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS agreement FROM c""")
def classifier_metrics(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.length("text") > 600).alias("guess"))
    x = table(spark, sf, "labels").join(d, "doc_id").select((F.col("quality") == 1).alias("truth"), "guess")
    t, g = F.col("truth"), F.col("guess")
    c = x.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    return c.select("*", F.round(F.expr("tp / (tp + fp)"), 6).alias("precision"), F.round(F.expr("tp / (tp + fn)"), 6).alias("recall"), F.round(F.expr("2 * tp / (2 * tp + fp + fn)"), 6).alias("f1"), F.round(F.expr("(tp + tn) / (tp + fp + fn + tn)"), 6).alias("agreement"))


@query("""SELECT d.lang, count(*) AS n, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.quality = 0) AS bad, count(*) FILTER (l.doc_id IS NULL) AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def crosstab(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


@query(f"""WITH {EV}, g AS (SELECT creator, count(*) AS n, count(*) FILTER (score <= 2) AS k FROM ev GROUP BY 1) SELECT creator, n, k, round(k / n, 6) AS rate, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low,
round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM g""")
def conditional_probability(spark, sf):
    g = recommendations(spark, sf).groupBy("creator").agg(F.count("*").alias("n"), F.count_if(F.col("score") <= 2).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("creator", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {EV}, g AS (SELECT creator, count(*) AS n, count(*) FILTER (direction = 'neutral') AS unclear FROM ev GROUP BY 1), w AS (SELECT *, unclear / n AS rate, unclear / sum(unclear) OVER () AS part FROM g)
SELECT creator, n, round(rate, 6) AS rate, concat_ws(';', CASE WHEN n < 400 THEN 'thin' END, CASE WHEN rate > 0.35 THEN 'unclear' END, CASE WHEN part >= 0.03 THEN 'concentrated' END) AS flags FROM w""")
def ratio_warnings(spark, sf):
    from almanac.operators.confound import reasons

    g = recommendations(spark, sf).groupBy("creator").agg(F.count("*").alias("n"), F.count_if(F.col("direction") == "neutral").alias("unclear"))
    g = g.withColumns({"rate": F.col("unclear") / F.col("n"), "part": F.col("unclear") / F.sum("unclear").over(Window.partitionBy())})
    flags = reasons((F.col("n") < 400, "thin"), (F.col("rate") > 0.35, "unclear"), (F.col("part") >= 0.03, "concentrated"))
    return g.select("creator", "n", *r6("rate"), F.array_join(flags, ";").alias("flags"))


@query(f"""WITH {EV}, t AS (SELECT unnest([1, 2, 3, 4, 5]) AS threshold) SELECT threshold, count(event_id) FILTER (score >= threshold) AS n, count(DISTINCT CASE WHEN score >= threshold THEN ticker END) AS tickers, count(DISTINCT CASE WHEN score >= threshold THEN creator END) AS creators FROM ev CROSS JOIN t GROUP BY 1""")
def threshold_sensitivity(spark, sf):
    ev = recommendations(spark, sf).withColumn("threshold", F.explode(F.array(*[F.lit(k) for k in range(1, 6)]))).where("score >= threshold")
    return ev.groupBy("threshold").agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("creator").alias("creators"))


@query(f"""{RETURNS}, x AS (SELECT creator, sum(ar) AS s, count(ar) AS n FROM r5 GROUP BY 1) SELECT creator, n, round(s / sum(s) OVER (), 6) AS share FROM x WHERE n > 0""")
def contribution_share(spark, sf):
    x = returns5(spark, sf).groupBy("creator").agg(F.sum("ar").alias("s"), F.count("ar").alias("n")).where("n > 0")
    return x.select("creator", "n", F.round(F.col("s") / F.sum("s").over(Window.partitionBy()), 6).alias("share"))


@query(f"""{RETURNS} SELECT event_id, round(ar - avg(ar) OVER (PARTITION BY ticker), 6) AS residual FROM r5 WHERE ar IS NOT NULL""")
def group_residual(spark, sf):
    return stats.demean(returns5(spark, sf).where("ar is not null"), ["ticker"], ["ar"]).select("event_id", F.round("ar", 6).alias("residual"))
