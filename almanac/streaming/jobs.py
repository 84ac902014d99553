"""Streaming forms of the batch operators: each takes a streaming DataFrame and returns one, or writes batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def source(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """A folder of Parquet files, so many of them in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, size: str, late: str = "7 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str = "7 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "7 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: list[str], late: str = "7 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def with_static(events: DataFrame, static: DataFrame, days: int) -> DataFrame:
    """Stream rows beside the static rows of their key at most so many days apart: equal on key and day bucket, then
    filtered, so the static side is joined by equality and may be of any size."""
    size = (days + 1) * 86400
    bucket = lambda c: F.floor(F.unix_timestamp(c) / size)
    s = static.withColumn("_b", F.explode(F.array(*[bucket("event_ts") + i for i in (-1, 0, 1)])))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    near = F.abs(micros("ts") - micros("event_ts")) <= days * 86400 * 1_000_000
    return events.withColumn("_b", bucket("ts")).join(s, ["user_id", "_b"]).where(near).drop("_b")


def capped(events: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of each user, in order of arrival: a count is all the state there is."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for part in parts:
            out = part.sort_values(["ts", "event_id"]).head(max(0, most - seen))
            seen += len(out)
            yield out[["user_id", "event_id", "ts"]]
        state.update((seen,))

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, ts timestamp", "seen long", "append", "NoTimeout")


#: Buckets of users: state and Python's calls are by bucket, so their number doesn't grow with the users.
BUCKETS = 1024


def bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int"))


def whole(column: pd.Series) -> list:
    """Whole numbers of a column, which nulls make one of doubles; nulls are None."""
    return [None if pd.isna(x) else int(x) for x in column] if column.hasnans else column.astype("int64").tolist()


def distinct_capped(events: DataFrame, most: int) -> DataFrame:
    """The first `most` different events of each user: the ids that are kept, so many at most, are all the state there is.
    Users of a bucket are one group, whose rows are passed through once."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = {}
        for user, event in zip(*state.get, strict=True) if state.exists else ():
            kept.setdefault(user, set()).add(event)
        for part in parts:
            part, out = part.sort_values(["ts", "event_id"]), []
            for i, (user, event) in enumerate(zip(whole(part["user_id"]), whole(part["event_id"]), strict=True)):
                ids = kept.setdefault(user, set())
                if len(ids) < most and event not in ids:
                    ids.add(event)
                    out.append(i)
            yield part.iloc[out][["user_id", "event_id", "ts"]]
        pairs = [(user, event) for user, ids in kept.items() for event in ids]
        state.update(([user for user, _ in pairs], [event for _, event in pairs]))

    return bucketed(events).groupBy("bucket").applyInPandasWithState(step, "user_id long, event_id long, ts timestamp", "users array<long>, ids array<long>", "append", "NoTimeout")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, exactly once, to Parquet. Run again with the same checkpoint it goes on from there, with the
    state that it had."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


#: Parts of an upserted table: a batch rewrites those that it has rows for.
PARTS = 64


def upsert_once(stream: DataFrame, path: str, checkpoint: str, key: list[str], version: str) -> None:
    """Each batch's rows replace those of their key in the table at path/table if they are newer. Rows are dealt into parts
    by key; a batch is merged with the parts that it touches beside the table first, and then takes their place, so a batch
    that is run again changes nothing."""
    from almanac.sources.tables import latest_wins

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int")
        new = keep_latest(batch, key, version).withColumn("_part", part)
        touched = [r[0] for r in new.select("_part").distinct().collect()]  # PARTS at most
        if not touched:
            return
        if (old := upserted(spark, path, parts=True)) is not None:
            new = latest_wins(old.where(F.col("_part").isin(touched)), new, [*key, "_part"], version)
        staged = f"{path}/staged/{number}"
        new.write.mode("overwrite").parquet(staged)
        spark.read.schema(new.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(f"{path}/table")

    def keep_latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
        rest = [c for c in df.columns if c not in key]
        return df.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*key, "r.*")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upserted(spark: SparkSession, path: str, parts: bool = False) -> DataFrame | None:
    """The table that upsert_once keeps, None before its first batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/table")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    out = spark.read.parquet(f"{path}/table")
    return out if parts else out.drop("_part")
