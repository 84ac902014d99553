"""The registry of queries and the tables that their SQL forms share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators import returns
from almanac.operators.calendar import price_index
from almanac.sources.shared import written
from almanac.sources.tables import prices, recommendations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Prices, benchmark and index; events; events aligned to trading days; all as sources.tables and operators.calendar make them.
PX = """px0 AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS px FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
bm AS (SELECT date, avg(px) AS bench FROM px0 GROUP BY 1),
pi AS MATERIALIZED (SELECT ticker, date, px, bench, row_number() OVER (PARTITION BY ticker ORDER BY date) AS idx, count(*) OVER (PARTITION BY ticker) AS n FROM px0 JOIN bm USING (date)),
daily AS (SELECT *, px / lag(px) OVER w - 1 AS ret, bench / lag(bench) OVER w - 1 AS bret, (px / lag(px) OVER w - 1) - (bench / lag(bench) OVER w - 1) AS ar FROM pi WINDOW w AS (PARTITION BY ticker ORDER BY idx))"""
EV = """ev AS (SELECT o_orderkey AS event_id, 'Brand#' || CAST(1 + o_orderkey % 25 AS VARCHAR) AS ticker, o_custkey % 35 AS creator, CAST(o_orderdate AS DATE) AS event_date,
CASE o_orderstatus WHEN 'O' THEN 'positive' WHEN 'F' THEN 'negative' ELSE 'neutral' END AS direction, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS score, o_totalprice AS size FROM orders),
adj AS (SELECT *, CAST(event_date + CAST(CASE isodow(event_date) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER) AS DATE) AS adj_date FROM ev)"""
AL = "al AS MATERIALIZED (SELECT adj.*, pi.idx, pi.date AS trade_date FROM adj ASOF LEFT JOIN pi ON adj.ticker = pi.ticker AND adj.adj_date <= pi.date)"
AR5 = """r5 AS (SELECT al.*, b.px / a.px - 1 AS raw, b.bench / a.bench - 1 AS benchmark, (b.px / a.px - 1) - (b.bench / a.bench - 1) AS ar
FROM al LEFT JOIN pi a ON al.ticker = a.ticker AND al.idx = a.idx LEFT JOIN pi b ON al.ticker = b.ticker AND al.idx + 5 = b.idx)"""
EVENTS = f"WITH {PX},\n{EV},\n{AL}"
RETURNS = f"{EVENTS},\n{AR5}"


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL form."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return put


def index(spark: SparkSession, sf: str) -> DataFrame:
    """Prices with their ordinals, written once: a row a ticker and day, so what meets it needn't make it again, knows its size
    and meets it where events are as long as it may be broadcast."""
    return written(price_index(prices(spark, sf)), "index")


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    return returns.align(recommendations(spark, sf), index(spark, sf))


def returns5(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned events with their five-step returns."""
    i = index(spark, sf)
    return returns.horizon_returns(returns.align(recommendations(spark, sf), i), i, [5])


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]
