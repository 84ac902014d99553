"""Selection queries: dedupe, caps, deciles, quantile buckets, clusters, greedy folds, samples, budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.operators import select, stats
from almanac.plans.registry import EV, query
from almanac.sources.tables import recommendations, table


@query(f"WITH {EV} SELECT event_id, creator, size FROM ev QUALIFY row_number() OVER (PARTITION BY creator ORDER BY size DESC, event_id) <= 3")
def cap_per_group(spark, sf):
    return select.cap(recommendations(spark, sf), ["creator"], [F.desc("size"), F.asc("event_id")], 3).select("event_id", "creator", "size")


@query(f"WITH {EV} SELECT event_id, ticker, event_date FROM ev QUALIFY row_number() OVER (PARTITION BY ticker, event_date ORDER BY size DESC, event_id) = 1")
def dedupe_keep_best(spark, sf):
    return select.keep_first(recommendations(spark, sf), ["ticker", "event_date"], [F.desc("size"), F.asc("event_id")]).select("event_id", "ticker", "event_date")


@query(f"WITH {EV}, k AS (SELECT count(*) // count(DISTINCT creator) AS k FROM ev) SELECT event_id, creator FROM ev, k QUALIFY row_number() OVER (PARTITION BY creator ORDER BY event_id) <= k")
def balanced_sample(spark, sf):
    return select.balanced_cap(recommendations(spark, sf), "creator", [F.asc("event_id")]).select("event_id", "creator")


@query(f"WITH {EV} SELECT event_id, ticker, CAST(least(10, 1 + floor(10 * (row_number() OVER (PARTITION BY ticker ORDER BY size, event_id) - 1) / count(*) OVER (PARTITION BY ticker))) AS BIGINT) AS decile FROM ev")
def deciles(spark, sf):
    ev = recommendations(spark, sf).select("event_id", "ticker", "size")
    return select.decile(ev, ["ticker"], [F.asc("size"), F.asc("event_id")], "decile").select("event_id", "ticker", "decile")


@query(f"""WITH {EV}, q AS (SELECT quantile_cont(size, 0.25) AS a, quantile_cont(size, 0.5) AS b, quantile_cont(size, 0.75) AS c FROM ev) SELECT event_id, CAST(1 + (size > a)::INT + (size > b)::INT + (size > c)::INT AS BIGINT) AS quartile FROM ev, q""")
def quartile_buckets(spark, sf):
    return select.quantile_bucket(recommendations(spark, sf), "size", 4, "quartile").select("event_id", "quartile")


@query(f"""WITH {EV}, m AS (SELECT median(size) AS m FROM ev) SELECT CASE WHEN size IS NULL THEN 'none' WHEN size > m THEN 'high' ELSE 'low' END AS bucket, CASE WHEN score <= 1 THEN 'a' WHEN score <= 3 THEN 'b' ELSE 'c' END AS band, count(*) AS n FROM ev, m GROUP BY 1, 2""")
def median_and_fixed_buckets(spark, sf):
    ev = recommendations(spark, sf)
    m = stats.quantiles(ev, [], "size", {"m": 0.5})
    bucket = F.when(F.col("size").isNull(), "none").when(F.col("size") > F.col("m"), "high").otherwise("low")
    band = F.when(F.col("score") <= 1, "a").when(F.col("score") <= 3, "b").otherwise("c")
    return ev.crossJoin(F.broadcast(m)).groupBy(bucket.alias("bucket"), band.alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT event_id, min(event_id) OVER w AS cluster, count(*) OVER w AS cluster_size, event_id = min(event_id) OVER w AS representative FROM ev WINDOW w AS (PARTITION BY creator, ticker, event_date)")
def duplicate_clusters(spark, sf):
    return select.clusters(recommendations(spark, sf), ["creator", "ticker", "event_date"], "event_id").select("event_id", "cluster", "cluster_size", "representative")


@query(f"""WITH RECURSIVE {EV}, d AS (SELECT DISTINCT creator, ticker, date_diff('day', DATE '1970-01-01', event_date) AS p FROM ev), k AS (SELECT creator, ticker, min(p) AS p FROM d GROUP BY 1, 2 UNION ALL SELECT creator, ticker, p FROM (SELECT d.creator, d.ticker, min(d.p) AS p FROM k JOIN d ON k.creator = d.creator AND k.ticker = d.ticker AND d.p >= k.p + 180 GROUP BY d.creator, d.ticker, k.p) z)
SELECT creator, ticker, CAST(DATE '1970-01-01' + CAST(p AS INTEGER) AS DATE) AS event_date FROM k""")
def greedy_non_overlap(spark, sf):
    return select.non_overlapping(recommendations(spark, sf), ["creator", "ticker"], "event_date", 180)


@query("""WITH RECURSIVE m AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS p FROM events), a AS (SELECT user_id, min(p) AS anchor FROM m GROUP BY 1 UNION ALL SELECT user_id, anchor FROM (SELECT m.user_id, min(m.p) AS anchor FROM a JOIN m ON a.user_id = m.user_id AND m.p > a.anchor + 24 GROUP BY m.user_id, a.anchor) z)
SELECT m.user_id, m.p, max(a.anchor) AS anchor FROM m JOIN a ON m.user_id = a.user_id AND a.anchor <= m.p GROUP BY 1, 2""")
def anchor_clusters(spark, sf):
    m = table(spark, sf, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("p")).distinct()
    return select.anchor_clusters(m, ["user_id"], "p", 24)


@query(f"WITH {EV} SELECT event_id, creator FROM ev ORDER BY sha256(CAST(event_id AS VARCHAR) || '|s1'), event_id LIMIT 100")
def seeded_sample(spark, sf):
    return recommendations(spark, sf).withColumn("h", select.seeded("event_id", seed="s1")).orderBy("h", "event_id").limit(100).select("event_id", "creator")


@query(f"WITH {EV}, t AS (SELECT event_id, direction, row_number() OVER (PARTITION BY direction ORDER BY sha256(CAST(event_id AS VARCHAR) || '|rr'), event_id) AS turn FROM ev) SELECT event_id, direction, turn FROM t ORDER BY turn, direction LIMIT 90")
def stratified_round_robin(spark, sf):
    ev = recommendations(spark, sf).withColumn("h", select.seeded("event_id", seed="rr"))
    return select.round_robin(ev, "direction", [F.asc("h"), F.asc("event_id")], 90).select("event_id", "direction", "turn")


@query(f"""WITH {EV}, g AS (SELECT creator, CAST(count(*) AS DOUBLE) AS need FROM ev GROUP BY 1), w AS (SELECT *, least(need, 100) AS want, coalesce(sum(least(need, 100)) OVER (ORDER BY creator ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT creator, need, least(want, greatest(0, 1550 - before)) AS granted FROM w""")
def running_budget(spark, sf):
    g = recommendations(spark, sf).groupBy("creator").agg(F.count("*").cast("double").alias("need"))
    return select.budget(g, "need", [F.asc("creator")], 1550.0, 100.0).select("creator", "need", "granted")


@query(f"""WITH {EV}, r AS (SELECT event_id, ticker, 'largest' AS side, row_number() OVER (PARTITION BY ticker ORDER BY size DESC, event_id) AS rank FROM ev UNION ALL SELECT event_id, ticker, 'smallest', row_number() OVER (PARTITION BY ticker ORDER BY size, event_id) FROM ev) SELECT * FROM r WHERE rank <= 5""")
def top_and_bottom(spark, sf):
    ev = recommendations(spark, sf)
    w = Window.partitionBy("ticker")
    sides = [ev.select("event_id", "ticker", F.lit(n).alias("side"), F.row_number().over(w.orderBy(o, F.asc("event_id"))).cast("long").alias("rank")) for n, o in (("largest", F.desc("size")), ("smallest", F.asc("size")))]
    return sides[0].unionByName(sides[1]).where("rank <= 5")


@query(f"""WITH {EV} SELECT ticker, CAST(date_trunc('week', event_date) AS DATE) AS week, min(event_id) AS event_id FROM ev GROUP BY 1, 2""")
def queue_by_week(spark, sf):
    return recommendations(spark, sf).groupBy("ticker", F.trunc("event_date", "week").alias("week")).agg(F.min("event_id").alias("event_id"))


@query(f"""WITH {EV}, s AS (SELECT event_id, 100 - 10 * score + CASE WHEN direction = 'positive' THEN 15 ELSE 0 END - CASE WHEN size < 50000 THEN 20 ELSE 0 END AS priority FROM ev), r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, event_id) AS rn FROM s) SELECT event_id, CAST(priority AS BIGINT) AS priority, (rn - 1) % 3 AS provider FROM r WHERE rn <= 200""")
def priority_queue(spark, sf):
    p = 100 - 10 * F.col("score") + F.when(F.col("direction") == "positive", 15).otherwise(0) - F.when(F.col("size") < 50000, 20).otherwise(0)
    top = recommendations(spark, sf).select("event_id", p.cast("long").alias("priority")).orderBy(F.desc("priority"), "event_id").limit(200)
    return top.withColumn("provider", ((F.row_number().over(Window.orderBy(F.desc("priority"), "event_id")) - 1) % 3).cast("long"))


@query(f"""WITH {EV} SELECT event_id, round((size - avg(size) OVER ()) / stddev_samp(size) OVER (), 6) AS z FROM ev""")
def global_z(spark, sf):
    ev = recommendations(spark, sf)
    m = ev.agg(F.avg("size").alias("m"), F.stddev_samp("size").alias("sd"))
    return ev.crossJoin(F.broadcast(m)).select("event_id", F.round(F.when(F.col("sd") > 0, (F.col("size") - F.col("m")) / F.col("sd")).otherwise(0.0), 6).alias("z"))
