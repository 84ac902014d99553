"""Running values over rows in order: sums, extremes, row numbers and as-of values, without a task that sees all rows.

Rows are dealt out by ranges of (keys, order) and each range finds its own running values. What its rows lack is the value of
the ranges before it, or after it. Ranges adjoin, so only the first key of a range can have begun in an earlier one and only
its last key can go on in a later one: what is carried over is at most one row a range and direction, and that is broadcast.
A key with any share of the rows is spread over as many ranges as it fills.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.sources.shared import written


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


#: What can be carried over: an aggregate, and how two of its values make one.
KINDS = {"sum": (F.sum, _plus), "max": (F.max, F.greatest), "min": (F.min, F.least)}


@dataclass(frozen=True)
class Running:
    """A value over the rows up to this one (or from it on, if after); without this one itself, if not inclusive."""

    kind: str
    of: Column
    after: bool = False
    inclusive: bool = True

    @staticmethod
    def frame(w, beyond: int):
        """Rows up to this one of a window, which runs backwards for values after a row; `beyond` is how many of the nearest
        are left out. A frame that ends at the last row is made anew for each row, one that begins at the first grows."""
        return w.rowsBetween(Window.unboundedPreceding, -beyond)


def dealt(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df with `_part`, ranges of (keys, order) numbered in order, written, so that a row's range is settled."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *[F.col(k).asc() for k in keys], *order).withColumn("_part", F.spark_partition_id()), "scan")


def scan(df: DataFrame, order: list[Column], values: dict[str, Running], keys: list[str] | None = None) -> DataFrame:
    """df with the running values by keys, in order, under their names. order has to tell all rows of a key apart, or which
    of those that it doesn't comes first is open. Null keys are a key; null values are passed over; what has no row to be
    made of is null."""
    keys = keys or []
    held = dealt(df.withColumns({f"_of_{n}": v.of for n, v in values.items()}), keys, order)
    totals = held.groupBy(*keys, "_part").agg(*[KINDS[v.kind][0](f"_of_{n}").alias(f"_all_{n}") for n, v in values.items()])
    out = held
    for after in sorted({v.after for v in values.values()}):
        some = {n: v for n, v in values.items() if v.after == after}
        by_key = Window.partitionBy(*keys, F.lit(0)).orderBy(F.desc("_part") if after else F.asc("_part"))  # over ranges, not rows
        carried = totals.withColumn("_more", F.lag("_part", 1).over(by_key).isNotNull())
        for n, v in some.items():
            carried = carried.withColumn(f"_carried_{n}", KINDS[v.kind][0](f"_all_{n}").over(v.frame(by_key, 1)))
        carried = carried.where("_more").select(F.col("_part").alias("_in_part"), *[F.col(k).alias(f"_in_key{i}") for i, k in enumerate(keys)], *[f"_carried_{n}" for n in some])
        on = F.col("_part") == F.col("_in_part")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_in_key{i}"))
        out = out.join(F.broadcast(carried), on, "left").drop("_in_part", *[f"_in_key{i}" for i in range(len(keys))])
    there = Window.partitionBy(*keys, "_part")
    rows, back = there.orderBy(*order), there.orderBy(F.desc("_row_number"))
    if any(v.after for v in values.values()):
        out = out.withColumn("_row_number", F.row_number().over(rows))
    for n, v in values.items():
        own = KINDS[v.kind][0](f"_of_{n}").over(v.frame(back if v.after else rows, 0 if v.inclusive else 1))
        out = out.withColumn(n, KINDS[v.kind][1](F.col(f"_carried_{n}"), own))
    return out.select(*[c for c in df.columns if c not in values], *values)


def numbered(df: DataFrame, order: list[Column], name: str, keys: list[str] | None = None) -> DataFrame:
    """df with the rows' numbers, from 1, by keys, in order."""
    return scan(df, order, {name: Running("sum", F.lit(1).cast("long"))}, keys)


def asof(probes: DataFrame, series: DataFrame, key: str, ts: str, values: list[str], before: str | None = "before", after: str | None = None) -> DataFrame:
    """probes with, as structs of ts and values, the series' last row at or before a probe's ts under the name `before`, and
    its first one at or after under the name `after`; each is left out if its name is None, null if there is no such row.

    Both sides are dealt out together, once for both directions and for any number of probes. Of series' rows that share key
    and ts the one with the greatest values counts, in either direction. Null keys meet; a null ts meets nothing."""
    at = F.struct(F.col(ts), *[F.col(v) for v in values])
    kind = series.select(at.alias("s")).schema["s"].dataType
    left = probes.withColumn("_side", F.lit(1)).withColumn("_row", F.lit(None).cast(kind))
    rest = [c for c in probes.columns if c not in (key, ts)]
    right = series.where(F.col(ts).isNotNull()).select(F.col(key), F.col(ts), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in rest], F.lit(0).alias("_side"), at.alias("_row"))
    wanted = {"_before": Running("max", F.col("_row"))} | ({"_after": Running("min", F.col("_row"), after=True)} if after else {})
    out = scan(left.unionByName(right), [F.col(ts).asc_nulls_first(), F.col("_side").asc()], wanted, [key]).where("_side = 1")
    there = F.col(ts).isNotNull()
    found = {before: F.when(there, F.col("_before"))} if before else {}
    if after:
        found[after] = F.when(there, F.when(F.col(f"_before.{ts}") == F.col(ts), F.col("_before")).otherwise(F.col("_after")))
    return out.select(*probes.columns, *[c.alias(n) for n, c in found.items()])
