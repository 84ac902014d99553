"""Streaming queries run to the end of what is there; their SQL is the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.plans.registry import query
from almanac.sources import shared
from almanac.sources.tables import table
from almanac.streaming import jobs, state


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need instants


def _run(spark, stream):
    folder = shared.folder(spark, "streams")
    jobs.run_once(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


_DONE = "(SELECT max(ts) - INTERVAL 7 DAY FROM events)"


@query(f"""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_DONE}""")
def stream_tumbling(spark, sf):
    """Daily counts of the days that the watermark has closed."""
    return _run(spark, jobs.tumbling(_stream(spark, sf), "1 day"))


@query(f"""WITH w AS (SELECT unnest(range(0, 7)) AS k), x AS (SELECT date_trunc('day', ts) - k * INTERVAL 1 DAY AS start, value FROM events CROSS JOIN w) SELECT start, start + INTERVAL 7 DAY AS "end", count(*) AS n, round(sum(value), 6) AS total FROM x GROUP BY 1 HAVING start + INTERVAL 7 DAY <= {_DONE}""")
def stream_sliding(spark, sf):
    return _run(spark, jobs.sliding(_stream(spark, sf), "7 days", "1 day"))


@query(f"""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {_DONE}""")
def stream_sessions(spark, sf):
    return _run(spark, jobs.sessions(_stream(spark, sf), "6 hours"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM (SELECT DISTINCT event_id FROM events)")
def stream_deduplicated(spark, sf):
    e = _stream(spark, sf)
    return _run(spark, jobs.deduplicated(e.unionByName(_stream(spark, sf)), ["event_id"]).select("event_id")).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("""WITH s AS (SELECT user_id, ts AS event_ts, event_id AS signup FROM events WHERE event_type = 'signup') SELECT e.event_id, s.signup FROM events e JOIN s ON e.user_id = s.user_id AND abs(epoch(e.ts) - epoch(s.event_ts)) <= 86400 WHERE e.event_type = 'purchase'""")
def stream_static_range_join(spark, sf):
    s = table(spark, sf, "events").where("event_type = 'signup'").select("user_id", F.col("ts").alias("event_ts"), F.col("event_id").alias("signup"))
    e = _stream(spark, sf).where("event_type = 'purchase'")
    return _run(spark, jobs.with_static(e, s, 1).select("event_id", "signup"))


@query("SELECT user_id, least(count(*), 20) AS n FROM events GROUP BY 1")
def stream_capped(spark, sf):
    """At most 20 rows of each user, kept by a count in state."""
    out = _run(spark, jobs.capped(_stream(spark, sf).select("user_id", "event_id", "ts"), 20))
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, least(count(DISTINCT event_id), 20) AS n FROM events GROUP BY 1")
def stream_resumed(spark, sf):
    """At most 20 different rows of each user, over a folder that gets its second half, and all of the first again, after a
    first run: the second goes on from the checkpoint with the state that was kept."""
    folder, e = shared.folder(spark, "streams"), table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_id", "ts")
    for half in (e.where("event_id % 2 = 0"), e):
        half.write.mode("append").parquet(f"{folder}/in")
        jobs.run_once(jobs.distinct_capped(jobs.source(spark, f"{folder}/in", e.schema, files=2), 20), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(e.schema).parquet(f"{folder}/out").groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_DONE}""")
def stream_late_rows(spark, sf):
    """Daily counts, to which rows that come again after their day was closed add nothing."""
    folder, e = shared.folder(spark, "streams"), table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = e.agg((F.max("ts") - F.expr("interval 9 days")).alias("t"))
    for rows in (e, e.crossJoin(F.broadcast(closed)).where("ts < t").drop("t")):
        rows.write.mode("append").parquet(f"{folder}/in")
        jobs.run_once(jobs.tumbling(jobs.source(spark, f"{folder}/in", e.schema, files=100), "1 day"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("start", "event_type", "n", "total")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark, sf):
    """The latest event of each user, merged batch by batch into a table; the rows come in three files, a batch each."""
    folder, e = shared.folder(spark, "streams"), table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts", "event_id")
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    jobs.upsert_once(jobs.source(spark, f"{folder}/in", e.schema), folder, f"{folder}/checkpoint", ["user_id"], "ts")
    return jobs.upserted(spark, folder).select("user_id", "ts", "event_id")


@query("""WITH e AS (SELECT DISTINCT user_id, event_id, ts FROM events), h AS (SELECT user_id, least(12, count(*)) AS had FROM e WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1) SELECT a.user_id, least(20, a.n) - coalesce(had, 0) AS n FROM a LEFT JOIN h USING (user_id) WHERE least(20, a.n) > coalesce(had, 0)""")
def stream_restored(spark, sf):
    """At most 20 different rows of each user, from a stream that begins with what an earlier run had let through: compact rows
    of up to 12 of the even ids."""
    at, e = shared.folder(spark, "streams"), table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_id", "ts")
    first = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), 1, 12).alias("k"))
    initial = first.select("user_id", F.transform("k", lambda x: x["event_id"]).alias("kept"), F.element_at("k", -1)["ts"].alias("ts"))
    e.write.parquet(f"{at}/in")
    with state.rocks(spark):
        jobs.run_once(state.recent_capped(jobs.source(spark, f"{at}/in", e.schema, files=1000), 20, 90 * 86_400_000, initial=initial), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(e.schema).parquet(f"{at}/out").groupBy("user_id").agg(F.count("*").alias("n"))
