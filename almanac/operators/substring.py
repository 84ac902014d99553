"""Texts that contain words, by an inverted index of grams.

Every needle is looked up by its rarest gram of q characters: only texts that have it can contain the needle, and those few are
checked. Needles shorter than q are grams themselves. So the work is the grams of both sides and the candidates, not all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(c: str, q: int) -> Column:
    """The distinct runs of q characters of a column that holds an array of characters."""
    runs = F.transform(F.sequence(F.lit(0), F.size(c) - q), lambda i: F.concat(*[F.get(F.col(c), i + k) for k in range(q)]))
    return F.when(F.size(c) >= q, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, needles: DataFrame, q: int = 3) -> DataFrame:
    """(text_id, needle_id) of texts(text_id, text) and needles(needle_id, word) where the text contains the word. Nulls and
    empty words are contained in nothing; equal words under several ids are looked up once; ids tell rows apart."""
    words = needles.where("length(word) > 0").groupBy("word").agg(F.collect_set("needle_id").alias("needles"))
    chars = texts.select("text_id", F.split("text", "").alias("_c"))
    index = chars.select("text_id", F.explode(grams("_c", q)).alias("gram"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    long = words.where(F.length("word") >= q).withColumn("_c", F.split("word", ""))
    parts = long.select("word", F.explode(grams("_c", q)).alias("gram")).join(counts, "gram", "left")
    rarest = parts.groupBy("word").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("nowhere")).where("nowhere = 0")
    met = index.join(rarest.select("word", "gram"), "gram").select("text_id", "word")
    found = met.join(texts.select("text_id", "text"), "text_id").where(F.contains("text", F.col("word"))).select("text_id", "word")
    for size in range(1, q):
        short = words.where(F.length("word") == size).select("word")
        found = found.unionByName(chars.select("text_id", F.explode(grams("_c", size)).alias("word")).join(short, "word").select("text_id", "word"))
    return found.join(words, "word").select("text_id", F.explode("needles").alias("needle_id"))
