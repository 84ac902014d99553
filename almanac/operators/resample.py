"""Bootstraps and permutations. A row's draw comes from its number and the draw's, so draws are made where the rows are, any
engine makes the same, and what is shuffled is a row for each task and draw; within groups, two bytes for each row and draw."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.operators.scan import Running, scan
from almanac.sources.shared import written

PRIME = 2147483647


def uniform(number: Column, draw: Column, seed: int) -> Column:
    """In (0, 1), from whole numbers below 2**40: squares modulo a prime."""
    x = (number * 48271 + draw * 69621 + seed) % PRIME
    x = ((x * x + 12345) % PRIME * 16807) % PRIME
    return ((x * x + 54321) % PRIME + 0.5) / PRIME


def uniform_sql(number: str, draw: str, seed: int) -> str:
    x = f"(({number} * 48271 + {draw} * 69621 + {seed}) % {PRIME})"
    y = f"((({x} * {x} + 12345) % {PRIME} * 16807) % {PRIME})"
    return f"((({y} * {y} + 54321) % {PRIME} + 0.5) / {PRIME})"


def poisson(u: Column) -> Column:
    """How often a row is drawn: Poisson of mean one, up to seven."""
    out, total = F.lit(0), 0.0
    for k in range(7):
        total += math.exp(-1) / math.factorial(k)
        out = out + (u > total).cast("int")
    return out


def poisson_sql(u: str) -> str:
    steps, total = [], 0.0
    for k in range(7):
        total += math.exp(-1) / math.factorial(k)
        steps.append(f"CAST({u} > {total!r} AS INTEGER)")
    return "(" + " + ".join(steps) + ")"


def with_draws(df: DataFrame, draws: int) -> DataFrame:
    return df.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))


def bootstrap(df: DataFrame, number: str, x: str, draws: int, seed: int) -> DataFrame:
    """One row: the mean of x with its 95 % interval over draws with replacement."""
    rows = df.where(F.col(x).isNotNull())
    w = poisson(uniform(F.col(number), F.col("d"), seed))
    means = with_draws(rows.select(number, x), draws).groupBy("d").agg((F.sum(w * F.col(x)) / F.sum(w)).alias("m"))
    return rows.agg(F.avg(x).alias("mean"), F.count(x).alias("n")).crossJoin(F.broadcast(means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")))).select("n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def bootstrap_clusters(df: DataFrame, cluster: str, x: str, draws: int, seed: int) -> DataFrame:
    """One row: the mean of x with its 95 % interval; whole clusters, which are numbers, are drawn by their sums."""
    sums = df.where(F.col(x).isNotNull() & F.col(cluster).isNotNull()).groupBy(cluster).agg(F.sum(x).alias("s"), F.count(x).alias("c"))
    w = poisson(uniform(F.col(cluster), F.col("d"), seed))
    means = with_draws(sums, draws).groupBy("d").agg(F.try_divide(F.sum(w * F.col("s")), F.sum(w * F.col("c"))).alias("m"))
    q = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return sums.agg((F.sum("s") / F.sum("c")).alias("mean")).crossJoin(F.broadcast(q)).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def bootstrap_difference(df: DataFrame, cluster: str, number: str, x: str, a: Column, draws: int, seed: int) -> DataFrame:
    """One row: the mean of x where a holds less that where it doesn't, with its 95 % interval; whole clusters are drawn, of
    which sums are all that a draw needs."""
    is_a = F.coalesce(a, F.lit(False))
    sums = df.where(F.col(x).isNotNull() & F.col(cluster).isNotNull()).groupBy(cluster, number).agg(F.sum(F.when(is_a, F.col(x)).otherwise(0.0)).alias("sa"), F.count_if(is_a).alias("na"), F.sum(F.when(~is_a, F.col(x)).otherwise(0.0)).alias("sb"), F.count_if(~is_a).alias("nb"))
    w = poisson(uniform(F.col(number), F.col("d"), seed))
    ratio = lambda s, n, k: F.try_divide(F.sum(k * F.col(s)), F.sum(k * F.col(n)))
    means = with_draws(sums, draws).groupBy("d").agg((ratio("sa", "na", w) - ratio("sb", "nb", w)).alias("m"))
    one = F.lit(1)
    return sums.agg((ratio("sa", "na", one) - ratio("sb", "nb", one)).alias("diff"), F.count("*").alias("clusters")).crossJoin(F.broadcast(means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")))).select("clusters", "diff", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def sign_flips(df: DataFrame, number: str, x: str, draws: int, seed: int) -> DataFrame:
    """One row: how often the mean of x with random signs is as far from zero as the mean itself, one draw at least."""
    rows = df.where(F.col(x).isNotNull())
    flipped = F.when(uniform(F.col(number), F.col("d"), seed) < 0.5, -F.col(x)).otherwise(F.col(x))
    means = with_draws(rows.select(number, x), draws).groupBy("d").agg(F.avg(flipped).alias("m"))
    observed = rows.agg(F.avg(x).alias("mean"), F.count(x).alias("n"))
    far = means.crossJoin(F.broadcast(observed)).groupBy("n", "mean").agg(F.count_if(F.abs("m") >= F.abs("mean")).alias("k"))
    return far.select("n", "mean", F.greatest(F.col("k") / draws, F.lit(1 / draws)).alias("p"))


#: Places of a group that meet their draws at once, of which two bytes tell one.
BLOCK = 1 << 16


def within_group(df: DataFrame, group: str, number: str, x: str, draws: int, seed: int) -> DataFrame:
    """One row: the mean of x, and how often means are as far from zero if each row takes the value of a drawn row of its
    group, as `within_groups` finds them."""
    return within_groups(df, group, number, [x], draws, seed, [draws]).where("p is not null").select("n", "mean", "drawn_mean", "p")


def within_groups(df: DataFrame, group: str, number: str, xs: list[str], draws: int, seed: int, looks: list[int]) -> DataFrame:
    """(x, draws, n, mean, drawn_mean, p), for each of xs after each of looks, numbers of draws: the mean of x, that of the
    draws' means, and how often these are as far from zero if each row that has x takes the value of a drawn one of its group.
    What is drawn is a place in the group, by number; the columns share the number's draws, not the places. Places fall into
    blocks of BLOCK: a row's draws go there as two bytes each, many in one row, and a block's sums by draw are all that leaves
    it, so a group of any size is spread. Rows without a group take no part in draws; where there are none, p is null."""
    v, n = [F.col(f"v{i}") for i in range(len(xs))], range(len(xs))
    rows = df.select(F.col(group).alias("g"), F.col(number).cast("long").alias("k"), *[F.col(x).cast("double").alias(f"v{i}") for i, x in enumerate(xs)]).where(F.coalesce(*v).isNotNull())
    placed = scan(rows, [F.asc("k")], {f"place{i}": Running("sum", v[i].isNotNull().cast("long")) for i in n}, ["g"])
    placed = written(placed.withColumns({f"place{i}": F.when(v[i].isNotNull(), F.col(f"place{i}") - 1) for i in n}), "places")
    sizes = placed.groupBy("g").agg(*[F.count(v[i]).alias(f"size{i}") for i in n])

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d, step = np.arange(draws, dtype="int64")[:, None], max(1, (1 << 20) // draws)
        for part in parts:
            out = []
            for (g, _), of in part.groupby(["g", np.arange(len(part)) // step], sort=False):
                u = _uniform(of["k"].to_numpy("int64"), d, seed)
                for i in n:
                    there = of[f"place{i}"].notna().to_numpy()
                    if not there.any():
                        continue
                    own, x = of[f"place{i}"].to_numpy()[there].astype("int64"), of[f"v{i}"].to_numpy()[there]
                    out += [(g, i, b, own[at].astype("uint16").tobytes(), x[at].tobytes(), None) for b, at in _blocks(own)]
                    drawn = np.floor((u if there.all() else u[:, there]) * of[f"size{i}"].iloc[0]).astype("int64").ravel()
                    out += [(g, i, b, drawn[at].astype("uint16").tobytes(), None, np.bincount(at // len(own), minlength=draws).astype("int32").tobytes()) for b, at in _blocks(drawn)]
            yield pd.DataFrame(out, columns=["g", "x", "block", "places", "v", "by_draw"])

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        v, d, sums = np.zeros(BLOCK), np.arange(draws), np.zeros(draws)
        values = part["v"].notna()
        for r in part[values].itertuples():
            v[np.frombuffer(r.places, "uint16")] = np.frombuffer(r.v, "float64")
        for r in part[~values].itertuples():
            sums += np.bincount(np.repeat(d, np.frombuffer(r.by_draw, "int32")), v[np.frombuffer(r.places, "uint16")], draws)
        return pd.DataFrame({"x": part["x"].iloc[0], "d": d, "s": sums})

    kind = rows.schema["g"].dataType.simpleString()
    drawn = placed.join(sizes, "g").mapInPandas(draw, f"g {kind}, x int, block long, places binary, v binary, by_draw binary")
    sums = drawn.groupBy("g", "x", "block").applyInPandas(meet, "x int, d long, s double").groupBy("x", "d").agg(F.sum("s").alias("s"))
    each = [F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), F.count(v[i]).alias("n"), F.avg(v[i]).alias("mean"), F.count_if(v[i].isNotNull() & F.col("g").isNotNull()).alias("c")) for i, x in enumerate(xs)]
    observed = placed.agg(F.array(*each).alias("each")).select(F.inline("each")).withColumn("draws", F.explode(F.array(*[F.lit(k).cast("long") for k in looks])))
    means = written(sums, "draws").withColumnRenamed("x", "of")
    out = observed.join(F.broadcast(means), (F.col("i") == F.col("of")) & (F.col("d") < F.col("draws")), "left").withColumn("m", F.try_divide("s", "c"))
    return out.groupBy("x", "draws", "n", "mean").agg(F.avg("m").alias("drawn_mean"), F.avg((F.abs("m") >= F.abs("mean")).cast("double")).alias("p"))


def _blocks(places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks that places fall into, and where their places are, in order."""
    block = places // BLOCK
    order = np.argsort(block.astype("uint16") if block.max() < BLOCK else block, kind="stable")
    ends = np.cumsum(np.bincount(block))
    return ((b, at) for b, at in enumerate(np.split(order, ends[:-1])) if len(at))


def _uniform(number: np.ndarray, draw: np.ndarray, seed: int) -> np.ndarray:
    """The same as `uniform`, of arrays."""
    x = (number * 48271 + draw * 69621 + seed) % PRIME
    x = ((x * x + 12345) % PRIME * 16807) % PRIME
    return ((x * x + 54321) % PRIME + 0.5) / PRIME
