"""Trading calendars: ordinals of an entity's rows, as-of steps to them, and rows a number of steps away.

An as-of step over days is an equi join: a series' gaps are filled with the row that the step leads to, which makes a table
of entities times days, and events meet it on (entity, day). So events spread over days however many an entity has, and no
task sorts an entity's events. Timestamps have no such table; there both sides are dealt out by ranges of (key, time), and each
range hands its last value to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.scan import asof


def roll_weekend(d: Column | str) -> Column:
    """Saturday and Sunday become Monday; other days, holidays too, stay."""
    d = F.col(d) if isinstance(d, str) else d
    day = F.weekday(d)
    return F.when(day == 5, F.date_add(d, 2)).when(day == 6, F.date_add(d, 1)).otherwise(d)


def timing_bucket(ts: Column | str) -> Column:
    """Where a UTC time falls in a session at UTC-5 without daylight saving; the weekend is that of the UTC date."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    minute = F.pmod(F.hour(ts) * 60 + F.minute(ts) - 300, F.lit(1440))
    return F.when(F.weekday(ts) >= 5, "weekend_or_holiday").when(minute < 570, "before_open").when(minute < 960, "during_market").otherwise("after_close")


def next_open(ts: Column | str, zone: str = "America/New_York") -> Column:
    """The next weekday's open, 9:30 at the exchange, after the day of a UTC time, in UTC."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    day = roll_weekend(F.date_add(F.to_date(F.from_utc_timestamp(ts, zone)), 1))
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr("interval 570 minutes"), zone)


def session_target(ts: Column | str, zone: str = "America/New_York") -> Column:
    """When the market can react to a UTC time: on weekends and after 16:00 at the exchange the next weekday's open, else the
    time itself, before the open too."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    local = F.from_utc_timestamp(ts, zone)
    closed = local > F.date_trunc("day", local) + F.expr("interval 960 minutes")
    return F.when((F.weekday(local) >= 5) | closed, next_open(ts, zone)).otherwise(ts)


def business_days(a: Column | str, b: Column | str) -> Column:
    """Weekdays in [a, b), by formula."""

    def upto(d: Column) -> Column:  # weekdays from Monday 1970-01-05 up to d
        days = F.datediff(d, F.lit("1970-01-05").cast("date"))
        return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))

    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return (upto(b) - upto(a)).cast("int")


def price_index(prices: DataFrame) -> DataFrame:
    """prices(ticker, date, ...) with idx, the row's ordinal, and n, the ticker's rows."""
    w = Window.partitionBy("ticker")
    return prices.withColumn("idx", F.row_number().over(w.orderBy("date")).cast("long")).withColumn("n", F.count("*").over(w))


def forward_days(index: DataFrame, first_day: DataFrame) -> DataFrame:
    """(ticker, day, idx, trade_date): for every day from first_day (one row, one date) to a ticker's last, the first row
    on or after it."""
    w = Window.partitionBy("ticker").orderBy("date")
    start = F.least(F.date_add(F.coalesce(F.lag("date").over(w), F.col("date")), F.when(F.lag("date").over(w).isNull(), 0).otherwise(1)), F.when(F.lag("date").over(w).isNull(), F.col("first_day")))
    gaps = index.crossJoin(F.broadcast(first_day.toDF("first_day"))).withColumn("start", start)
    return gaps.select("ticker", F.explode(F.sequence("start", "date")).alias("day"), "idx", F.col("date").alias("trade_date"))


def backward_days(index: DataFrame, last_day: DataFrame) -> DataFrame:
    """The mirror: for every day from a ticker's first to last_day, the last row on or before it."""
    w = Window.partitionBy("ticker").orderBy("date")
    end = F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.greatest("date", "last_day"))
    gaps = index.crossJoin(F.broadcast(last_day.toDF("last_day"))).withColumn("end", end)
    return gaps.select("ticker", F.explode(F.sequence("date", "end")).alias("day"), "idx", F.col("date").alias("trade_date"))


def asof_forward(events: DataFrame, index: DataFrame, day: str, tolerance: int | None = None) -> DataFrame:
    """events with idx and trade_date of the first row on or after `day`, null if there is none (within tolerance days)."""
    days = forward_days(index, events.agg(F.coalesce(F.min(day), F.current_date())))
    return _meet(events, days, day, F.datediff("trade_date", F.col(day)), tolerance)


def asof_backward(events: DataFrame, index: DataFrame, day: str, tolerance: int | None = None) -> DataFrame:
    days = backward_days(index, events.agg(F.coalesce(F.max(day), F.current_date())))
    return _meet(events, days, day, F.datediff(F.col(day), "trade_date"), tolerance)


def _meet(events: DataFrame, days: DataFrame, day: str, lag: Column, tolerance: int | None) -> DataFrame:
    out = events.join(days.withColumnRenamed("day", day), ["ticker", day], "left")
    if tolerance is None:
        return out
    near = lag <= tolerance
    return out.withColumns({"idx": F.when(near, F.col("idx")), "trade_date": F.when(near, F.col("trade_date"))})


def asof_time(events: DataFrame, series: DataFrame, key: str, ts: str, value: list[str], forward: bool = False) -> DataFrame:
    """events with the values, as `<name>_asof`, of the series' last row at or before ts (first at or after, if forward),
    matching on key."""
    found = asof(events, series, key, ts, value, before=None if forward else "_found", after="_found" if forward else None)
    return found.select(*events.columns, *[F.col(f"_found.{c}").alias(f"{c}_asof") for c in (ts, *value)])


def offset(events: DataFrame, index: DataFrame, steps: Column, columns: dict[str, str], how: str = "left") -> DataFrame:
    """events(ticker, idx, ...) with columns {new name: index column} of the row `steps` rows from idx."""
    target = index.select("ticker", F.col("idx").alias("_to"), *[F.col(c).alias(n) for n, c in columns.items()])
    return events.withColumn("_to", F.col("idx") + steps).join(target, ["ticker", "_to"], how).drop("_to")
