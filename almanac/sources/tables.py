"""Inputs: the driver's tables, the event-study tables derived from them, and file sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series (ticker, date, px, bench): a brand's mean unit price by ship date, and the mean over brands that day."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    daily = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("ticker", "date").agg(F.avg("unit").alias("px"))
    bench = daily.groupBy("date").agg(F.avg("px").alias("bench"))
    return daily.join(bench, "date").select("ticker", "date", "px", "bench")


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events (event_id, ticker, creator, event_date, direction, score, size) from orders."""
    orders = table(spark, sf_dir, "orders")
    direction = F.when(F.col("o_orderstatus") == "O", "positive").when(F.col("o_orderstatus") == "F", "negative").otherwise("neutral")
    return orders.select(
        F.col("o_orderkey").alias("event_id"),
        F.concat(F.lit("Brand#"), (1 + F.col("o_orderkey") % 25).cast("string")).alias("ticker"),
        (F.col("o_custkey") % 35).alias("creator"),
        F.to_date("o_orderdate").alias("event_date"),
        direction.alias("direction"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("score"),
        F.col("o_totalprice").alias("size"),
    )


# ---------------------------------------------------------------- file sources


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A header CSV with every field read as text and cast where it can be: what can't be is null. Missing columns are
    null, further ones are left out, a missing path is an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"', maxCharsPerColumn=-1)
    have = {c.lstrip("﻿"): c for c in raw.columns}
    return raw.select(*[(clean(F.col(f"`{have[f.name]}`"), f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def clean(c: Column, kind: T.DataType) -> Column:
    """Text as a typed value: blank, unparsable, NaN and infinite are null; dates are the first ten characters."""
    text = F.nullif(F.trim(c), F.lit(""))
    if isinstance(kind, T.DateType):
        return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(text)
    if isinstance(kind, T.BooleanType):
        return F.when(text.isNotNull(), F.lower(text).isin("true", "1", "yes"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = text.try_cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value).cast(kind)
    return text.try_cast(kind.simpleString())


def read_factors(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A factor file as its publisher writes it: prose, a header, rows `yyyymmdd, percent, ...`, prose. Rows whose first
    field is a date of eight digits are kept, percent become fractions."""
    lines = spark.read.text(path).select(F.split("value", ",").alias("f"))
    rows = lines.where(F.trim(F.col("f")[0]).rlike("^[0-9]{8}$"))
    numbers = [(F.trim(F.get("f", F.lit(i + 1))).try_cast("double") / 100).alias(c) for i, c in enumerate(columns)]
    return rows.select(F.to_date(F.trim(F.col("f")[0]), "yyyyMMdd").alias("date"), *numbers)


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """A submissions JSON file with parallel arrays form[], filingDate[] as rows."""
    schema = "ticker string, form array<string>, filingDate array<string>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select("ticker", F.inline(F.arrays_zip("form", "filingDate"))).select("ticker", "form", F.to_date("filingDate").alias("filed"))


# ---------------------------------------------------------------- sinks


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fixed columns in order: missing ones are null, further ones go."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    select_columns(df, columns).write.mode("overwrite").csv(path, header=True)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New values replace old ones, but a null never replaces a value; new keys are added."""
    rest = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*rest).alias("o"))
    n = new.select(*key, F.struct(*rest).alias("n"))
    return o.join(n, key, "full_outer").select(*key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest])


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first new row of each key that old doesn't have."""
    from almanac.operators.select import keep_first

    return old.unionByName(keep_first(new.join(old, key, "left_anti"), key, order).select(*old.columns))


def latest_wins(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Union in which the row with the greatest version stays for each key."""
    rest = [c for c in old.columns if c not in key]
    both = old.unionByName(new.select(*old.columns))
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*key, "r.*")


def validate(df: DataFrame, required: list[str], key: list[str]) -> DataFrame:
    """One row for each problem: a missing column, a key that repeats, nulls in a required column. Empty if all is well."""
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    if missing:
        return spark.createDataFrame([(f"missing column {c}", 1) for c in missing], "problem string, n long")
    repeated = df.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated key").alias("problem"), "n")
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required]).unpivot([], required, "c", "n").select(F.concat(F.lit("nulls in "), "c").alias("problem"), "n")
    return repeated.unionByName(nulls).where("n > 0")
