"""Join queries: equality, semi, anti, outer with status, occurrence keys, first-wins, ranges, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.operators import select, substring
from almanac.operators.scan import Running, scan
from almanac.plans.registry import EV, query
from almanac.sources import tables
from almanac.sources.tables import recommendations, table


@query("""SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def star_join(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def left_join_counts(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    sums = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    return c.select("c_custkey").join(sums, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)""")
def anti_join(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)""")
def semi_join(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(li, "p_partkey", "left_semi").select("p_partkey", "p_brand")


@query(f"""WITH {EV}, a AS (SELECT creator, ticker, count(*) AS na FROM ev WHERE year(event_date) = 1996 GROUP BY 1, 2), b AS (SELECT creator, ticker, count(*) AS nb FROM ev WHERE year(event_date) = 1997 GROUP BY 1, 2)
SELECT creator, ticker, coalesce(na, 0) AS n_a, coalesce(nb, 0) AS n_b, CASE WHEN na IS NULL THEN 'expanded_only' WHEN nb IS NULL THEN 'baseline_only' ELSE 'both' END AS status FROM a FULL JOIN b USING (creator, ticker)""")
def full_outer_status(spark, sf):
    ev = recommendations(spark, sf)
    a, b = (ev.where(F.year("event_date") == y).groupBy("creator", "ticker").agg(F.count("*").alias(n)) for y, n in ((1996, "n_a"), (1997, "n_b")))
    status = F.when(F.col("n_a").isNull(), "expanded_only").when(F.col("n_b").isNull(), "baseline_only").otherwise("both")
    return a.join(b, ["creator", "ticker"], "full_outer").select("creator", "ticker", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), status.alias("status"))


@query(f"""WITH {EV}, a AS (SELECT *, row_number() OVER (PARTITION BY creator, ticker ORDER BY event_id) AS occurrence FROM ev WHERE score <= 2), b AS (SELECT *, row_number() OVER (PARTITION BY creator, ticker ORDER BY event_id) AS occurrence FROM ev WHERE score > 2)
SELECT creator, ticker, occurrence, a.event_id AS id_a, b.event_id AS id_b FROM a JOIN b USING (creator, ticker, occurrence)""")
def occurrence_key_join(spark, sf):
    ev, key = recommendations(spark, sf), ["creator", "ticker"]
    a, b = (select.occurrence(ev.where(c), key, [F.col("event_id")]).select(*key, "occurrence", F.col("event_id").alias(n)) for c, n in (("score <= 2", "id_a"), ("score > 2", "id_b")))
    return a.join(b, [*key, "occurrence"])


@query(f"WITH {EV} SELECT event_id, creator, event_date FROM ev QUALIFY count(*) OVER (PARTITION BY creator, event_date) = 1")
def unique_only_lookup(spark, sf):
    return select.unique_only(recommendations(spark, sf), ["creator", "event_date"]).select("event_id", "creator", "event_date")


@query(f"WITH {EV} SELECT creator, ticker, min(event_id) AS event_id, arg_min(size, event_id) AS size FROM ev GROUP BY 1, 2")
def first_wins(spark, sf):
    return recommendations(spark, sf).groupBy("creator", "ticker").agg(F.min("event_id").alias("event_id"), F.min_by("size", "event_id").alias("size"))


@query("""SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders o ON c_custkey = o_custkey WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders x WHERE x.o_custkey = c_custkey)""")
def greatest_per_group(spark, sf):
    latest = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"))
    return table(spark, sf, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("""SELECT s_suppkey, c_custkey FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey * 3 OR lower(right(s_name, 4)) = lower(right(c_name, 4))""")
def or_condition_join(spark, sf):
    """A left join on one key or, whatever the case, on another: the distinct union of two equality joins, and what has no
    partner in either."""
    s, c = table(spark, sf, "supplier").select("s_suppkey", "s_name"), table(spark, sf, "customer").select("c_custkey", "c_name")
    a = s.join(c, s.s_suppkey == 3 * c.c_custkey).select("s_suppkey", "c_custkey")
    b = s.join(c, F.lower(F.right("s_name", F.lit(4))) == F.lower(F.right("c_name", F.lit(4)))).select("s_suppkey", "c_custkey")
    return s.select("s_suppkey").join(a.union(b).distinct(), "s_suppkey", "left")


@query("""SELECT o_orderkey, c_name, n_name, r_name, s_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON o_orderkey = s_suppkey""")
def star_left_join(spark, sf):
    """Every order with what its dimensions have, null where one has nothing."""
    o, c, n, r, s = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region", "supplier"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n.where("n_nationkey % 2 = 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(s, F.col("o_orderkey") == F.col("s_suppkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name", "s_name")


@query(f"""WITH {EV}, d AS (SELECT ticker, event_date, creator, max(score) AS best FROM ev WHERE direction = 'positive' GROUP BY 1, 2, 3) SELECT event_id, best FROM ev LEFT JOIN d USING (ticker, event_date, creator)""")
def left_join_keys(spark, sf):
    """A left join on several keys."""
    ev = recommendations(spark, sf)
    d = ev.where("direction = 'positive'").groupBy("ticker", "event_date", "creator").agg(F.max("score").alias("best"))
    return ev.join(d, ["ticker", "event_date", "creator"], "left").select("event_id", "best")


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM documents), t AS (SELECT item_id, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS t FROM benchmark) SELECT item_id, word FROM t JOIN w ON contains(t, word)""")
def substring_match(spark, sf):
    """Compacted texts of the benchmark that contain a word of the documents: tens of thousands of words, which meet the texts
    by their rarest grams."""
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1))).alias("word")).distinct()
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("text_id"), F.lower(F.regexp_replace("text", "[^A-Za-z0-9]", "")).alias("text"))
    found = substring.containing(texts, words.withColumn("needle_id", F.col("word")))
    return found.select(F.col("text_id").alias("item_id"), F.col("needle_id").alias("word"))


@query("""SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_orderkey = c_custkey""")
def or_condition_join_keys(spark, sf):
    """All pairs that an OR of two key equalities gives, two for an order at most."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_custkey").union(o.join(c, o.o_orderkey == c.c_custkey).select("o_orderkey", "c_custkey")).distinct()


@query("""WITH c AS (SELECT c_custkey AS id, 'customer' AS kind, c_name AS name FROM customer), s AS (SELECT s_suppkey AS id, 'supplier' AS kind, s_name AS name FROM supplier), k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'customer' ELSE 'supplier' END AS kind, o_custkey AS id FROM orders)
SELECT o_orderkey, k.kind, coalesce(c.name, s.name) AS name FROM k LEFT JOIN c ON k.kind = c.kind AND k.id = c.id LEFT JOIN s ON k.kind = s.kind AND k.id = s.id""")
def polymorphic_join(spark, sf):
    """A key that refers to one table or another: both become one, with the kind in the key."""
    both = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    k = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "customer").otherwise("supplier").alias("kind"), F.col("o_custkey").alias("id"))
    return k.join(both, ["kind", "id"], "left").select("o_orderkey", "kind", "name")


@query("""WITH a AS (SELECT conv_id, turn, turn * 10 AS s, turn * 10 + 12 AS e FROM conversations), m AS (SELECT conv_id, turn, turn * 10 + 5 AS at FROM conversations WHERE role = 'user')
SELECT m.conv_id, m.turn, count(*) AS segments FROM m JOIN a ON m.conv_id = a.conv_id AND a.s <= m.at + 15 AND a.e >= m.at - 15 GROUP BY 1, 2""")
def interval_overlap_join(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.select("conv_id", (F.col("turn") * 10).alias("s"), (F.col("turn") * 10 + 12).alias("e"))
    m = c.where("role = 'user'").select("conv_id", "turn", (F.col("turn") * 10 + 5).alias("at"))
    return m.join(a, "conv_id").where("s <= at + 15 and e >= at - 15").groupBy("conv_id", "turn").agg(F.count("*").alias("segments"))


@query("""SELECT n_nationkey, h, cost, n_nationkey * h - cost AS x FROM nation CROSS JOIN (SELECT unnest([1, 5, 21]) AS h) CROSS JOIN (SELECT unnest([0, 10]) AS cost)""")
def grid_cross_join(spark, sf):
    grid = table(spark, sf, "nation").select("n_nationkey").withColumn("h", F.explode(F.array(F.lit(1), F.lit(5), F.lit(21)))).withColumn("cost", F.explode(F.array(F.lit(0), F.lit(10))))
    return grid.withColumn("x", F.col("n_nationkey") * F.col("h") - F.col("cost"))


_OLD = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer WHERE c_custkey % 4 <> 0"
_NEW = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'new' || c_custkey END AS c_name, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 2 = 0"


def _old_new(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_custkey % 4 <> 0").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("bal"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("new"), F.col("c_custkey").cast("string"))).alias("c_name"), (F.col("c_acctbal") + 1).alias("bal"))
    return old, new


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, round(coalesce(n.bal, o.bal), 2) AS bal FROM o FULL JOIN n USING (c_custkey)")
def upsert_coalesce(spark, sf):
    return tables.upsert(*_old_new(spark, sf), ["c_custkey"]).select("c_custkey", "c_name", F.round("bal", 2).alias("bal"))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT c_custkey, c_name, round(bal, 2) AS bal FROM o UNION ALL SELECT c_custkey, c_name, round(bal, 2) FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def insert_or_ignore(spark, sf):
    return tables.insert_or_ignore(*_old_new(spark, sf), ["c_custkey"], [F.col("c_name")]).select("c_custkey", "c_name", F.round("bal", 2).alias("bal"))


@query("""SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
def set_union(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("""SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000 INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice < 50000""")
def set_intersection(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")).intersect(o.where("o_totalprice < 50000").select("o_custkey"))


@query("""SELECT DISTINCT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def set_difference(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query(f"""WITH {EV}, w AS (SELECT a.event_id, b.event_id AS other, row_number() OVER (PARTITION BY a.event_id ORDER BY sha256(CAST(b.event_id AS VARCHAR) || '|m'), b.event_id) AS r FROM ev a JOIN ev b ON a.ticker = b.ticker AND b.event_date < a.event_date AND b.event_date >= a.event_date - 60 AND a.creator = b.creator)
SELECT event_id, other FROM w WHERE r = 1""")
def prior_event_match(spark, sf):
    """A seeded pick among the creator's earlier events of the ticker within 60 days: the first of each day, then the first of
    the 60 days before, so no two events are paired."""
    ev = recommendations(spark, sf).select("event_id", "ticker", "creator", "event_date").where("event_date is not null")
    daily = ev.withColumn("h", F.unhex(select.seeded("event_id", seed="m"))).groupBy("ticker", "creator", "event_date").agg(F.min(F.struct("h", F.col("event_id").alias("other"))).alias("first"))
    w = Window.partitionBy("ticker", "creator").orderBy(F.datediff("event_date", F.lit("1970-01-01").cast("date"))).rangeBetween(-60, -1)
    before = daily.select("ticker", "creator", "event_date", F.min("first").over(w).alias("pick")).where("pick is not null")
    return ev.join(before, ["ticker", "creator", "event_date"]).groupBy("event_id").agg(F.min("pick").alias("pick")).select("event_id", "pick.other")


@query(f"""WITH {EV}, t AS (SELECT event_id, creator, size AS treated FROM ev WHERE direction = 'positive'), c AS (SELECT creator, avg(size) AS control FROM ev WHERE direction <> 'positive' GROUP BY 1) SELECT creator, count(*) AS n, round(avg(treated - control), 4) AS diff FROM t JOIN c USING (creator) GROUP BY 1""")
def treated_vs_control(spark, sf):
    ev = recommendations(spark, sf)
    c = ev.where("direction <> 'positive'").groupBy("creator").agg(F.avg("size").alias("control"))
    return ev.where("direction = 'positive'").join(c, "creator").groupBy("creator").agg(F.count("*").alias("n"), F.round(F.avg(F.col("size") - F.col("control")), 4).alias("diff"))


@query("""WITH h AS (SELECT o_custkey, o_orderdate, o_orderstatus AS source, max(o_orderkey) AS record FROM orders GROUP BY 1, 2, 3), j AS (SELECT o.o_orderkey, h.source, h.record, CAST(date_diff('day', h.o_orderdate, o.o_orderdate) AS BIGINT) AS age, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY CASE h.source WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, h.o_orderdate DESC) AS r FROM orders o LEFT JOIN h ON o.o_custkey = h.o_custkey AND h.o_orderdate <= o.o_orderdate - INTERVAL 1 DAY)
SELECT o_orderkey, source, record, age FROM j WHERE r = 1""")
def source_priority_asof(spark, sf):
    """For each order the customer's latest earlier record of the best source that has one, and its age in days: one
    running last record for each source, all in one pass, of which the first that is there counts."""
    o = table(spark, sf, "orders")
    sources = ("F", "O", "P")
    h = o.groupBy("o_custkey", F.col("o_orderdate").alias("ts"), "o_orderstatus").agg(F.max("o_orderkey").alias("record")).withColumn("o_orderkey", F.lit(None).cast("long"))
    asked = o.select("o_custkey", (F.col("o_orderdate") - F.expr("interval 1 day")).alias("ts"), F.lit(None).cast("string").alias("o_orderstatus"), F.lit(None).cast("long").alias("record"), "o_orderkey")
    last = {f"_{s}": Running("max", F.when(F.col("o_orderstatus") == s, F.struct("ts", "record"))) for s in sources}
    out = scan(h.unionByName(asked), [F.asc("ts"), F.asc_nulls_first("o_orderkey"), F.asc("o_orderstatus")], last, ["o_custkey"]).where("o_orderkey is not null")
    first = lambda f: F.coalesce(*[F.when(F.col(f"_{s}").isNotNull(), f(s)) for s in sources])
    age = F.datediff(F.col("ts") + F.expr("interval 1 day"), first(lambda s: F.col(f"_{s}.ts"))).cast("long")
    return out.select("o_orderkey", first(F.lit).alias("source"), first(lambda s: F.col(f"_{s}.record")).alias("record"), age.alias("age"))
