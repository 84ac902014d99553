"""Factor-adjusted returns: regressions on three factors over a window before each event, from running cross sums."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACTORS = ["mkt", "smb", "hml"]


def det3(m) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def running(daily: DataFrame, factors: DataFrame) -> DataFrame:
    """(ticker, idx, c, sums and cross sums of y and the factors, all up to idx); y is the return over the risk-free one.
    Rows without a return or factors add nothing."""
    j = daily.select("ticker", "idx", "date", "ret").join(factors, "date", "left")
    names = ["y", *FACTORS]
    sound = F.col("ret").isNotNull() & F.col("rf").isNotNull()
    j = j.withColumn("y", F.col("ret") - F.col("rf"))
    run = Window.partitionBy("ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    add = lambda e: F.sum(F.when(sound, e).otherwise(0.0)).over(run)
    sums = {f"s_{n}": add(F.col(n)) for n in names} | {f"q_{a}_{b}": add(F.col(a) * F.col(b)) for a, b in combinations_with_replacement(names, 2)}
    level = {f"l_{n}": F.sum(F.coalesce(n, F.lit(0.0))).over(run) for n in ("rf", *FACTORS)}
    level["l_k"] = F.count_if(F.col("rf").isNotNull()).over(run)
    return j.select("ticker", "idx", F.count_if(sound).over(run).cast("double").alias("c"), *[c.alias(n) for n, c in {**sums, **level}.items()])


def loadings(events: DataFrame, sums: DataFrame, start: int, end: int, least: int) -> DataFrame:
    """events(event_id, ticker, idx) with n, a and b_<factor>: least squares over rows idx + start to idx + end, null with
    fewer than `least` of them or if they don't tell the factors apart."""
    columns = [c for c in sums.columns if c not in ("ticker", "idx") and not c.startswith("l_")]
    to = sums.select("ticker", F.col("idx").alias("_to"), *[F.col(c).alias(f"{c}_1") for c in columns])
    before = sums.select("ticker", F.col("idx").alias("_from"), *[F.col(c).alias(f"{c}_0") for c in columns])
    e = events.withColumns({"_to": F.col("idx") + end, "_from": F.greatest(F.lit(0), F.col("idx") + start - 1)})
    j = e.join(to, ["ticker", "_to"], "left").join(before, ["ticker", "_from"], "left")
    d = {c: F.col(f"{c}_1") - F.coalesce(F.col(f"{c}_0"), F.lit(0.0)) for c in columns}
    j = j.select("event_id", "ticker", "idx", *[v.alias(c) for c, v in d.items()])
    n = F.col("c")
    cov = lambda a, b: F.col(f"q_{a}_{b}" if f"q_{a}_{b}" in columns else f"q_{b}_{a}") - F.try_divide(F.col(f"s_{a}") * F.col(f"s_{b}"), n)
    m = [[cov(a, b) for b in FACTORS] for a in FACTORS]
    v = [cov("y", a) for a in FACTORS]
    whole = det3(m)
    usable = (n >= least) & (F.abs(whole) > 1e-30)
    slopes = [F.when(usable, det3([[v[r] if k == c else m[r][c] for c in range(3)] for r in range(3)]) / whole) for k in range(3)]  # a window's moments and slopes
    j = j.withColumns({f"b_{f}": s for f, s in zip(FACTORS, slopes, strict=True)})
    a = F.try_divide("s_y", n)
    for f in FACTORS:
        a = a - F.try_divide(F.col(f"b_{f}") * F.col(f"s_{f}"), n)
    return j.select("event_id", "ticker", "idx", F.coalesce(n, F.lit(0.0)).cast("long").alias("n"), F.when(usable, a).alias("a"), *[f"b_{f}" for f in FACTORS])


def abnormal(loaded: DataFrame, sums: DataFrame, returns: DataFrame, h: int) -> DataFrame:
    """event_id with alpha (return less what the loadings make of the factors over the h rows after the event) and unit_alpha
    (less the factors themselves). returns(event_id, raw)."""
    names = ["k", "rf", *FACTORS]
    at = lambda s: sums.select("ticker", F.col("idx").alias(f"_{s}"), *[F.col(f"l_{n}").alias(f"{n}_{s}") for n in names])
    j = loaded.withColumns({"_0": F.col("idx"), "_1": F.col("idx") + h}).join(at(0), ["ticker", "_0"]).join(at(1), ["ticker", "_1"]).join(returns, "event_id")
    over = {n: F.col(f"{n}_1") - F.col(f"{n}_0") for n in names}
    expected, unit = over["rf"] + F.col("a") * h, over["rf"]
    for f in FACTORS:
        expected, unit = expected + F.col(f"b_{f}") * over[f], unit + over[f]
    whole = over["k"] == h  # factors on each of the rows
    return j.select("event_id", "n", F.when(whole, F.col("raw") - expected).alias("alpha"), F.when(whole, F.col("raw") - unit).alias("unit_alpha"))
