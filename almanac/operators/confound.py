"""What else happened around an event: counts in calendar windows, provider panels, three-state flags, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(events: DataFrame, articles: DataFrame, days: int) -> DataFrame:
    """Pairs of an event and an article of its ticker at most `days` apart, with `gap` in days (negative: before). Both
    sides fall into buckets of days + 1 days and meet in the event's bucket and the two beside it, so the join is by
    equality and a ticker's rows spread over its buckets."""
    size = days + 1
    number = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / size)
    e = events.withColumn("_b", F.explode(F.array(*[number("event_date") + i for i in (-1, 0, 1)])))
    a = articles.withColumn("_b", number("article_date"))
    gap = F.datediff("article_date", "event_date")
    return e.join(a, ["ticker", "_b"]).withColumn("gap", gap).where(F.abs("gap") <= days).drop("_b")


def around(events: DataFrame, daily: DataFrame, windows: dict[str, tuple[str, int, int]]) -> DataFrame:
    """events with, for each name, the sum of a column of daily(ticker, article_date, ...) over the days from a to b around
    event_date, zero where there are none. Sums run over a ticker's days, so no pair of an event and an article is made and
    a window holds a row for each day."""
    measures = sorted({c for c, _, _ in windows.values()})
    days = daily.select("ticker", F.col("article_date").alias("event_date"), *measures)
    blank = events.select("ticker", "event_date").where("event_date is not null").distinct().select("ticker", "event_date", *[F.lit(0).cast(daily.schema[c].dataType).alias(c) for c in measures])
    both = days.unionByName(blank).groupBy("ticker", "event_date").agg(*[F.sum(c).alias(c) for c in measures])
    w = Window.partitionBy("ticker").orderBy(F.datediff("event_date", F.lit("1970-01-01").cast("date")))
    sums = both.select("ticker", "event_date", *[F.coalesce(F.sum(c).over(w.rangeBetween(a, b)), F.lit(0)).alias(n) for n, (c, a, b) in windows.items()])
    return events.join(sums, ["ticker", "event_date"], "left").na.fill(0, list(windows))


def window_counts(events: DataFrame, articles: DataFrame, windows: list[int]) -> DataFrame:
    """event_id with pre_<d>d in [-d, 0) and post_<d>d in [0, d], zero where there are none."""
    daily = articles.groupBy("ticker", "article_date").agg(F.count("*").alias("n"))
    named = {f"pre_{d}d": ("n", -d, -1) for d in windows} | {f"post_{d}d": ("n", 0, d) for d in windows}
    return around(events.select("event_id", "ticker", "event_date"), daily, named).select("event_id", *named)


def nearest(events: DataFrame, filings: DataFrame, days: int) -> DataFrame:
    """event_id with the number of filings within days and the gap of the nearest, the earlier of two as near. A day's
    filings of a ticker are one row."""
    daily = filings.groupBy("ticker", "article_date").agg(F.count("*").alias("n"))
    pairs = within(events.select("event_id", "ticker", "event_date"), daily, days)
    return pairs.groupBy("event_id").agg(F.sum("n").alias("n_near"), F.min_by("gap", F.struct(F.abs("gap"), "gap")).alias("nearest_gap"))


def capped_articles(events: DataFrame, articles: DataFrame, days: int, most: int, key: Column) -> DataFrame:
    """Per event the articles within days, one for each key, the first `most` by date and key. Keys are made, a day's equal
    ones become one and only its first `most` stay before they meet anything: before a later one come as many of its day, or
    the same ones earlier, at any event. What meets articles are a ticker's days that have events, not events: each event
    then takes its day's list, `most` articles at most, and one whose id is there several times the first of its lists."""
    keyed = articles.withColumn("key", key).select("ticker", "article_date", "key").distinct()
    place = F.row_number().over(Window.partitionBy("ticker", "article_date").orderBy("key"))
    keyed = keyed.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")
    pairs = within(events.select("ticker", "event_date").distinct(), keyed, days)
    one = pairs.groupBy("ticker", "event_date", "key").agg(F.min(F.struct("article_date", "gap")).alias("_a")).select("ticker", "event_date", "key", "_a.*")
    rank = F.row_number().over(Window.partitionBy("ticker", "event_date").orderBy("article_date", "key"))
    first = one.withColumn("_r", rank).where(F.col("_r") <= most)
    lists = first.groupBy("ticker", "event_date").agg(F.collect_list(F.struct("article_date", "key", "gap")).alias("_l"))
    own = events.select("event_id", "ticker", "event_date").join(lists, ["ticker", "event_date"]).groupBy("event_id").agg(F.array_sort(F.flatten(F.collect_list("_l"))).alias("_l"))
    keys = F.transform("_l", lambda x: x["key"])
    unique = F.filter("_l", lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    return own.select("event_id", F.inline(F.slice(unique, 1, most))).select("event_id", "key", "article_date", "gap")


def short_key(*columns: str, size: int = 28) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, size)


def three_state(found: Column, covered: Column) -> Column:
    """confounded if something is found; clean only if the provider covers the event; else unknown."""
    return F.when(F.coalesce(found, F.lit(False)), "confounded").when(F.coalesce(covered, F.lit(False)), "clean").otherwise("unknown")


def provider_states(events: DataFrame, daily: DataFrame, providers: list[str], days: int = 1, reach: int = 30, usual: float = 1.5) -> DataFrame:
    """events with `<provider>_state`, `_near`, `_reach` and `_usual` for each count column of daily(ticker,
    article_date, ...): an event is confounded if its days, `days` around it, hold more than `usual` times what as many days of
    its ticker hold on average; clean if not, but the provider has something on the ticker within `reach` days; else nobody
    knows."""
    windows = {f"{p}_near": (p, -days, days) for p in providers} | {f"{p}_reach": (p, -reach, reach) for p in providers}
    span = F.datediff(F.max("article_date"), F.min("article_date")) + 1
    means = daily.groupBy("ticker").agg(*[((2 * days + 1) * F.sum(p) / span).alias(f"{p}_usual") for p in providers])
    out = around(events, daily, windows).join(means, "ticker", "left")
    states = {f"{p}_state": three_state(F.col(f"{p}_near") > usual * F.col(f"{p}_usual"), F.col(f"{p}_reach") > 0) for p in providers}
    return out.withColumns(states)


def combined(*states: Column) -> Column:
    """One state of several: any confounded, else any unknown, else clean."""
    return F.when(F.greatest(*[(s == "confounded").cast("int") for s in states]) == 1, "confounded").when(F.greatest(*[(s == "unknown").cast("int") for s in states]) == 1, "unknown").otherwise("clean")


def first_label(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(otherwise)
    for condition, label in reversed(rules):
        out = F.when(condition, label).otherwise(out)
    return out


def reasons(*rules: tuple[Column, str]) -> Column:
    """The labels of all rules that hold, in order, as an array."""
    return F.array_compact(F.array(*[F.when(c, label) for c, label in rules]))
