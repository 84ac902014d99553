"""Posts and videos about tickers, made from orders by phrases: texts that the rules tell apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.sources.tables import table

#: {t} is the ticker.
PHRASES = [
    "I am buying {t} stock today.", "I sold {t} shares and would avoid it.", "Analysts expect {t} to report earnings this year.", "If you had bought {t} in 2020 you would be rich.",
    "We have been bullish since {t} was at 20.", "I own {t}, not financial advice.", "{t} reported revenue, breaking news.", "{t} is a 10x generational opportunity, load up!",
    "I do not want to buy {t} here.", "{t} price target $250 with upside.", "Watching {t} for a breakout this week.", "RT @fan: giveaway of {t} calls",
    "The market closed flat.", "Downside risk and debt: {t} is overvalued, short it.", "Called it! My pick {t} is up since my last video.", "Long term I am holding {t} in my portfolio.",
    "Wall Street raised the {t} price target, investors bought.", "NYSE: {t} earnings beat, strong quarter for ${t}.", "What {t} should know about inflation and rate cuts.", "To the moon, squeeze: ${t} is ripping.",
    "Adding ${t} and long {t} into the merger.", "Thank {t} for the chart.", "Insiders sold {t} last year, the lawsuit is back in the news.", "Cheap on cash flow, {t} looks undervalued.",
    "My top stock for the decade is {t}, worth buying.", "{t} is too expensive, stay away from it.", "We are holding {t} and wait.", "If you know, on the other hand, {t} can wait.", "I am shorting {t} here and now, as said.",
]
TAILS = ["", "The valuation looks cheap on margin.", "According to the filing it files a report.", "Swing trade for tomorrow.", "My position is long ${t}.", "Buy now, last chance.", "Consensus upgrade, guidance and eps.", "Support and resistance on the chart, volatile."]


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, creator, symbol, published, size, text)."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    symbol = F.concat(F.lit("T"), F.char(65 + k % 25))
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (1 + F.floor(k / n) % len(values)).cast("int"))
    text = F.concat_ws(" ", pick(PHRASES, 25), pick(TAILS, 25 * len(PHRASES)))
    return o.select(k.alias("event_id"), (F.col("o_custkey") % 35).alias("creator"), symbol.alias("symbol"), F.col("o_orderdate").alias("published"), F.col("o_totalprice").alias("size"), F.replace(text, F.lit("{t}"), symbol).alias("text"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: The same in DuckDB.
POSTS = f"""posts AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t, string_split_regex(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[^a-z0-9]+') AS tk FROM
(SELECT event_id, creator, symbol, published, size, replace(a || ' ' || b, '{{t}}', symbol) AS text FROM
(SELECT o_orderkey AS event_id, o_custkey % 35 AS creator, 'T' || chr(CAST(65 + o_orderkey % 25 AS INTEGER)) AS symbol, o_orderdate AS published, o_totalprice AS size,
({_list(PHRASES)})[1 + CAST(o_orderkey // 25 % {len(PHRASES)} AS INTEGER)] AS a, ({_list(TAILS)})[1 + CAST(o_orderkey // {25 * len(PHRASES)} % {len(TAILS)} AS INTEGER)] AS b FROM orders)))"""
