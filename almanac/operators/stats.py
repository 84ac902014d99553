"""Grouped inference. Sums are the only thing that leaves the executors; what is solved on the driver is k by k."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.scan import Running, scan
from almanac.sources.shared import written


#: Ranges that a ranking of all rows is cut into.
PARTS = 64


def normal_p(t: Column) -> Column:
    """Two-sided normal p-value, by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    z = F.abs(t) / math.sqrt(2)
    k = 1 / (1 + 0.3275911 * z)
    return k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * F.exp(-z * z)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t, by an Arrow function around the incomplete beta's continued fraction."""
    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([math.nan if x is None or n is None or math.isnan(x) or not n > 0 else incomplete_beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, df, strict=True)])

    return p(t.cast("double"), df.cast("double"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300), 0.0
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + num * d) or 1e-300), (1 + num / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def quantiles(df: DataFrame, keys: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """(keys, names of shares): exact quantiles of x by keys, between two values in proportion; nulls and NaN don't count. Equal
    values are counted first; a running sum over values in order, and one from behind, tell each value's places and the
    group's size, so no task sees a group and nothing is joined."""
    counts = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    c = F.col("_c")
    placed = scan(counts, [F.col("_x").asc()], {"_upto": Running("sum", c), "_rest": Running("sum", c, after=True, inclusive=False)}, keys)
    last = F.col("_upto") + F.coalesce("_rest", F.lit(0)) - 1

    def at(place: Column) -> Column:
        return F.max(F.when((place >= F.col("_upto") - c) & (place < F.col("_upto")), F.col("_x")))

    out = placed.groupBy(*keys).agg(*[v.alias(f"{name}{end}") for name, q in shares.items() for end, v in (("_lo", at(F.floor(q * last))), ("_hi", at(F.ceil(q * last))), ("_at", F.max(q * last - F.floor(q * last))))])
    return out.select(*keys, *[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_at")).alias(n) for n in shares])


def bundle(df: DataFrame, keys: list[str], x: str, least: int = 1, median: bool = False) -> DataFrame:
    """n, mean, median if asked for, win rate, standard deviation and error, t, p and the 95 % interval, by keys."""
    agg = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg(F.when(F.col(x) > 0, 1.0).when(F.col(x).isNotNull(), 0.0)).alias("win_rate"), F.stddev_samp(x).alias("sd"))
    if median:
        agg = meet(agg, quantiles(df, keys, x, {"median": 0.5}), keys, "left") if keys else agg.join(quantiles(df, keys, x, {"median": 0.5}))
    se = F.col("sd") / F.sqrt("n")
    t = F.when(F.col("sd") > 0, F.col("mean") / se)
    out = agg.where(F.col("n") >= least).withColumn("se", se).withColumn("t", t)
    return out.withColumns({"p": normal_p(F.col("t")), "low": F.col("mean") - 1.96 * F.col("se"), "high": F.col("mean") + 1.96 * F.col("se")})


def meet(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which a null meets a null; b's keys go."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(b, on, how).drop(*[f"_{k}" for k in keys])


def clustered_se(df: DataFrame, keys: list[str], x: str, cluster: list[str]) -> DataFrame:
    """Mean and its cluster-robust error: sqrt(G / (G - 1) * sum over clusters of (sum of residuals)^2) / n."""
    means = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.avg(x).alias("mean"), F.count(x).alias("n"))
    sums = df.where(F.col(x).isNotNull()).groupBy(*keys, *cluster).agg(F.sum(x).alias("s"), F.count(x).alias("m"))
    e = F.col("s") - F.col("m") * F.col("mean")
    g = F.count("*")
    j = meet(sums, means, keys) if keys else sums.crossJoin(F.broadcast(means))
    out = j.groupBy(*keys, "mean", "n").agg(g.alias("clusters"), F.sum(e * e).alias("ss"))
    return out.withColumn("se", F.when(F.col("clusters") > 1, F.sqrt(F.col("clusters") / (F.col("clusters") - 1) * F.col("ss")) / F.col("n"))).drop("ss")


def two_way_se(df: DataFrame, keys: list[str], x: str, a: list[str], b: list[str]) -> DataFrame:
    """Two-way clustering: the variances by a and by b less that by both, zero if that is negative."""
    parts = [clustered_se(df, keys, x, c).select(*keys, "mean", "n", F.col("se").alias(n)) for n, c in (("se_a", a), ("se_b", b), ("se_ab", a + b))]
    j = meet(meet(parts[0], parts[1].drop("mean", "n"), keys), parts[2].drop("mean", "n"), keys)
    v = F.col("se_a") ** 2 + F.col("se_b") ** 2 - F.col("se_ab") ** 2
    return j.withColumn("se", F.sqrt(F.greatest(F.lit(0.0), v)))


def adjust(df: DataFrame, p: str, order: str) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg over all rows, which are tests: a few thousand at most."""
    w = Window.orderBy(F.col(p).asc(), F.col(order).asc())
    ranked = df.where(F.col(p).isNotNull()).withColumns({"_r": F.row_number().over(w), "_m": F.count("*").over(Window.partitionBy())})
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    down = w.rowsBetween(0, Window.unboundedFollowing)
    return ranked.withColumns({
        "bonferroni": F.least(F.lit(1.0), F.col(p) * F.col("_m")),
        "holm": F.least(F.lit(1.0), F.max(F.col(p) * (F.col("_m") - F.col("_r") + 1)).over(up)),
        "bh": F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down)),
    }).drop("_r", "_m")


def winsorize(df: DataFrame, x: str, low: float, high: float, name: str) -> DataFrame:
    """x clipped to its exact quantiles."""
    edges = quantiles(df, [], x, {"_low": low, "_high": high})
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("_low")), F.col("_high")))).drop("_low", "_high")


def order_statistics(df: DataFrame, x: str, shares: list[float], few: int = 10_000) -> list[float]:
    """The values at places floor(share * (n - 1)) of x in order, without interpolation: counts by range narrow each down
    until few rows are left to be sorted."""
    values = df.where(F.col(x).isNotNull()).select(F.col(x).alias("v"))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    out = []
    for share in shares if n else []:
        a, b, place, size = low, high, int(math.floor(share * (n - 1))), n
        while size > few and a < b and (step := (b - a) / 512) > 0 and a + step > a:
            part = F.least(F.floor((F.col("v") - F.lit(a)) / F.lit(step)), F.lit(511))
            rows = values.where(F.col("v").between(a, b)).groupBy(part.alias("k")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("k").collect()
            for r in rows:
                if place < r["c"]:
                    a, b, size = r["a"], r["b"], r["c"]
                    break
                place -= r["c"]
        out.append(a if a == b else sorted(r["v"] for r in values.where(F.col("v").between(a, b)).collect())[place])
    return out


def leave_one_out(df: DataFrame, level: str, x: str) -> DataFrame:
    """Mean and t of x without each level, from the level's and the total's moments."""
    by = df.where(F.col(x).isNotNull()).groupBy(level).agg(F.count(x).alias("c"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    w = Window.partitionBy()
    n, s, q = (F.sum(c).over(w) - F.col(c) for c in ("c", "s", "q"))
    out = by.withColumns({"n_left": n, "mean_left": F.when(n > 0, s / n), "_v": F.when(n > 1, (q - s * s / n) / (n - 1))})
    return out.withColumn("t_left", F.when(F.col("_v") > 0, F.col("mean_left") / F.sqrt(F.col("_v") / F.col("n_left")))).select(level, "n_left", "mean_left", "t_left")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)


def shrink(df: DataFrame, group: str, x: str, k: float = 20.0) -> DataFrame:
    """Group means drawn to the mean of all by n / (n + k)."""
    by = df.where(F.col(x).isNotNull()).groupBy(group).agg(F.count(x).alias("n"), F.sum(x).alias("s"))
    w = Window.partitionBy()
    total = F.sum("s").over(w) / F.sum("n").over(w)
    weight = F.col("n") / (F.col("n") + k)
    return by.withColumns({"mean": F.col("s") / F.col("n"), "shrunk": weight * F.col("s") / F.col("n") + (1 - weight) * total}).drop("s")


# ---------------------------------------------------------------- regressions


def ols(df: DataFrame, y: str, xs: list[str], cluster: str | None = None, robust: bool = False, effects: int = 1) -> list[dict]:
    """Least squares with a constant from one pass of cross sums around the means; HC1 or cluster-robust errors take
    another. Rows with a null or NaN in y or xs are left out. A row for each coefficient: name, coef, se, t, p, n, r2. With
    one cluster there is no error. effects: how many constants have been taken out of the columns, the one included."""
    names = ["const", *xs]
    k = len(names)
    sound = df.where(" and ".join(f"`{c}` is not null and not isnan(cast(`{c}` as double))" for c in [y, *xs]))
    middle = sound.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate([y, *xs])]).first()
    my, mx = middle[0] or 0.0, np.array([m or 0.0 for m in middle[1:]])
    v = [F.lit(1.0), *[F.col(x).cast("double") - F.lit(float(m)) for x, m in zip(xs, mx, strict=True)]]
    yy = F.col(y).cast("double") - F.lit(float(my))
    sums = [F.sum(v[i] * v[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(v[i] * yy).alias(f"b{i}") for i in range(k)] + [F.sum(yy * yy).alias("yy"), F.sum(yy).alias("sy"), F.count("*").alias("n")]
    r = sound.agg(*sums).first()
    n, taken = r["n"], len(xs) + effects
    if n <= taken:
        return []
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    beta = np.linalg.pinv(a) @ np.array([r[f"b{i}"] for i in range(k)])
    inverse = np.linalg.pinv(a)
    sse = r["yy"] - beta @ np.array([r[f"b{i}"] for i in range(k)])
    if robust or cluster:
        e = yy - sum((F.lit(float(b)) * x for b, x in zip(beta, v, strict=True)), F.lit(0.0))
        scores = sound.select(*[(e * v[i]).alias(f"u{i}") for i in range(k)], *([F.col(cluster).alias("g")] if cluster else []))
        if cluster:
            scores = scores.groupBy("g").agg(*[F.sum(f"u{i}").alias(f"u{i}") for i in range(k)])
        m = scores.agg(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)], F.count("*").alias("g")).first()
        meat = np.array([[m[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        g = m["g"]
        scale = (g / (g - 1) * (n - 1) / (n - taken) if g > 1 else math.nan) if cluster else n / (n - taken)
        cov = scale * inverse @ meat @ inverse
    else:
        cov = inverse * sse / (n - taken)
    back = np.eye(k)  # from centred columns to the columns themselves
    back[0, 1:] = -mx
    beta, cov = back @ beta + np.array([my] + [0.0] * (k - 1)), back @ cov @ back.T
    se = np.sqrt(np.maximum(0, np.diag(cov)))
    spread = r["yy"] - r["sy"] ** 2 / n
    r2 = 1 - sse / spread if spread > 0 else 0.0
    sure = lambda s: s and not math.isnan(s)
    return [{"name": c, "coef": float(b), "se": float(s) if not math.isnan(s) else None, "t": float(b / s) if sure(s) else None, "p": math.erfc(abs(b / s) / math.sqrt(2)) if sure(s) else None, "n": n, "r2": float(r2)} for c, b, s in zip(names, beta, se, strict=True)]


def demean(df: DataFrame, groups: list[str], columns: list[str], tol: float = 1e-10, most: int = 1000) -> DataFrame:
    """df with columns less the effects of all groups, by alternating projections until no mean of a level is above tol of the
    column's spread. What the rounds work on is a row for each combination of levels, with sums; null levels are levels."""
    cells = df.groupBy(*groups).agg(F.count("*").alias("_n"), *[F.sum(F.col(c).cast("double")).alias(f"_s{i}") for i, c in enumerate(columns)])
    cells = written(cells.withColumns({f"_r{i}": F.col(f"_s{i}") for i in range(len(columns))}), "effects")
    spread = df.agg(*[F.coalesce(F.stddev_pop(F.col(c).cast("double")), F.lit(0.0)) for c in columns]).first()
    each = range(len(columns))
    for _ in range(most):
        for j, g in enumerate(groups):
            means = cells.groupBy(g).agg(*[(F.sum(f"_r{i}") / F.sum("_n")).alias(f"_m{j}_{i}") for i in each])
            cells = meet(cells, means, [g]).withColumns({f"_r{i}": F.col(f"_r{i}") - F.col("_n") * F.col(f"_m{j}_{i}") for i in each})
        cells = written(cells, "effects")
        means = [c for c in cells.columns if c.startswith("_m")]
        furthest = cells.agg(*[F.coalesce(F.max(F.abs(c)), F.lit(0.0)).alias(c) for c in means]).first()
        cells = cells.drop(*means)
        if len(groups) == 1 or all(furthest[c] <= tol * spread[int(c.split("_")[-1])] for c in means):
            break
    effects = cells.select(*groups, *[((F.col(f"_s{i}") - F.col(f"_r{i}")) / F.col("_n")).alias(f"_e{i}") for i in range(len(columns))])
    return meet(df, effects, groups).withColumns({c: F.col(c) - F.col(f"_e{i}") for i, c in enumerate(columns)}).drop(*[f"_e{i}" for i in range(len(columns))])


def absorbed(df: DataFrame, groups: list[str]) -> int:
    """Degrees of freedom that the effects of one or two groups take: levels, less, for two, the parts into which common rows
    tie them. Each part's smallest label is passed from one group's levels to the other's until none changes."""
    levels = df.agg(*[F.count_distinct(F.struct(g)) for g in groups]).first()
    if len(groups) == 1:
        return levels[0]
    a, b = groups
    cells = written(df.select(a, b).distinct().withColumn("_l", F.xxhash64(a)), "parts")
    while True:
        after = meet(cells, cells.groupBy(b).agg(F.min("_l").alias("_least_b")), [b])
        after = written(meet(after, after.groupBy(a).agg(F.min("_least_b").alias("_least")), [a]), "parts")
        if after.where("_least <> _l").isEmpty():
            return sum(levels) - after.agg(F.count_distinct("_least")).first()[0]
        cells = after.select(a, b, F.col("_least").alias("_l"))


def fixed_effects(df: DataFrame, y: str, xs: list[str], groups: list[str], cluster: str | None = None, robust: bool = False) -> list[dict]:
    """Least squares with effects of one or two groups taken out: the slopes and errors that dummies of all levels give. r2 is
    that within the groups."""
    sound = df.where(" and ".join(f"`{c}` is not null and not isnan(cast(`{c}` as double))" for c in [y, *xs]))
    sound = written(sound.select(*dict.fromkeys([y, *xs, *groups, *([cluster] if cluster else [])])), "design")  # it is gone over several times
    rows = ols(demean(sound, groups, [y, *xs]), y, xs, cluster, robust, absorbed(sound, groups))
    return [r for r in rows if r["name"] != "const"]


def newey_west(daily: DataFrame, day: str, y: str, xs: list[str], lags: int = 5) -> list[dict]:
    """Least squares on a daily series with Bartlett-weighted autocovariances: one row a day, so it is solved on the
    driver."""
    rows = daily.where(" and ".join(f"{c} is not null" for c in [y, *xs])).orderBy(day).select(y, *xs).toPandas().to_numpy(float)
    if len(rows) <= len(xs) + 1:
        return []
    x = np.concatenate([np.ones((len(rows), 1)), rows[:, 1:]], axis=1)
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ rows[:, 0]
    u = x * (rows[:, 0] - x @ beta)[:, None]
    meat = u.T @ u
    for lag in range(1, lags + 1):
        gamma = u[lag:].T @ u[:-lag]
        meat += (1 - lag / (lags + 1)) * (gamma + gamma.T)
    se = np.sqrt(np.maximum(0, np.diag(inverse @ meat @ inverse)))
    return [{"name": c, "coef": float(b), "se": float(s), "t": float(b / s) if s else None, "n": len(rows)} for c, b, s in zip(["alpha", *xs], beta, se, strict=True)]


def rank_area(df: DataFrame, keys: list[str], score: str, label: Column) -> DataFrame:
    """(keys, n, positives, area): the area under the curve of score for label, by keys, from the mean ranks of equal scores: the
    chance that a row with the label has the greater score, ties counting half. Null scores and labels don't count; without
    both labels the area is null."""
    rows = df.withColumn("_y", label.cast("int")).where(F.col(score).isNotNull() & F.col("_y").isNotNull())
    counts = rows.groupBy(*keys, F.col(score).alias("_x")).agg(F.count("*").alias("_c"), F.sum("_y").alias("_p"))
    placed = scan(counts, [F.col("_x").asc()], {"_below": Running("sum", F.col("_c"), inclusive=False)}, keys)
    rank = F.coalesce("_below", F.lit(0)) + (F.col("_c") + 1) / 2
    out = placed.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum("_p").alias("positives"), F.sum(F.col("_p") * rank).alias("_r"))
    p = F.col("positives")
    return out.withColumn("area", F.try_divide(F.col("_r") - p * (p + 1) / 2, p * (F.col("n") - p))).drop("_r")


def signed_rank(df: DataFrame, x: str) -> DataFrame:
    """Wilcoxon's signed ranks, ties at their mean rank, with the normal approximation. Rows of one magnitude are counted
    first; magnitudes fall into PARTS ranges by approximate quantiles, whose sizes, a row each, are added up, so each is
    ranked by itself."""
    values = df.where(f"{x} is not null and {x} <> 0").groupBy(F.abs(x).alias("v")).agg(F.count("*").alias("c"), F.count_if(F.col(x) > 0).alias("up"))
    edges = values.agg(F.percentile_approx("v", F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)])).alias("edges"))
    parted = values.crossJoin(F.broadcast(edges)).withColumn("part", F.size(F.filter(F.coalesce("edges", F.array().cast("array<double>")), lambda e: e < F.col("v")))).drop("edges")
    sizes = parted.groupBy("part").agg(F.sum("c").alias("size"))
    upto = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", upto("size", Window.orderBy("part")).alias("start"))
    ranked = parted.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + upto("c", Window.partitionBy("part").orderBy("v")) + (F.col("c") + 1) / 2)
    c = F.col("c").cast("double")  # cubes of counts leave the whole numbers beyond some two million rows
    out = ranked.agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(c * (c * c - 1)).alias("ties"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return out.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / sd).withColumn("p", normal_p(F.col("z"))).drop("ties")
