"""Text functions as Spark columns: keywords between boundaries, mentions, rule classifiers, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal(c: Column | str) -> Column:
    """Lower case, white space runs to one space, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def keyword(c: Column, word: str) -> Column:
    """Whether a word or phrase stands in c with no ASCII letter or digit beside it."""
    quoted = "".join(f"\\{x}" if not x.isalnum() and x != " " else x for x in word)
    return c.rlike(f"(^|[^a-z0-9]){quoted}($|[^a-z0-9])")


def keyword_hits(c: Column, words: list[str]) -> Column:
    """How many of the words stand in c, which is in lower case. Single words are looked up among c's, split once."""
    if all(w.isascii() and w.isalnum() and w == w.lower() for w in words):
        return F.size(F.array_intersect(F.split(c, "[^a-z0-9]+"), F.array(*map(F.lit, dict.fromkeys(words)))))
    return sum((keyword(c, w).cast("int") for w in words[1:]), keyword(c, words[0]).cast("int"))


def any_keyword(c: Column, words: list[str]) -> Column:
    quoted = "|".join("".join(f"\\{x}" if not x.isalnum() and x != " " else x for x in w) for w in words)
    return c.rlike(f"(^|[^a-z0-9])({quoted})($|[^a-z0-9])")


def tokens(c: Column | str) -> Column:
    """Words of letters and digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(c, F.lit(r"(\w+)"), F.lit(1))


def strip_html(c: Column | str) -> Column:
    """Tags to spaces, the five basic entities decoded, white space collapsed."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.regexp_replace(c, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def mentions(docs: DataFrame, id_column: str, text: str, symbols: DataFrame, deny: list[str]) -> DataFrame:
    """(id, symbol, hits): how often a text has a symbol of symbols(symbol) as an upper-case word or behind a $. Texts are
    cut into words that meet the symbols by equality, not by a pattern for each pair."""
    found = docs.select(id_column, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\$?\b([A-Z]{2,5})\b"), F.lit(1))).alias("symbol"))
    counted = found.where(~F.col("symbol").isin(deny)).groupBy(id_column, "symbol").agg(F.count("*").alias("hits"))
    return counted.join(symbols, "symbol", "left_semi")


def context(c: Column, at: Column, radius: int = 80) -> Column:
    """The text from radius characters before position `at` (from 1) to radius after it."""
    start = F.greatest(F.lit(1), at - radius)
    return F.substring(c, start, at + radius - start)


def placed(df: DataFrame, id_column: str, text: str, pattern: str) -> DataFrame:
    """(id, at, word): every match of pattern with its place, from 1. A match's place is the length of all pieces and
    matches before it, added up in a window of its text."""
    pieces, words = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = df.select(id_column, F.posexplode(F.arrays_zip(words.alias("word"), F.slice(pieces, 1, F.size(words)).alias("piece"))).alias("k", "m")).select(id_column, "k", "m.*")
    upto = F.sum(F.length("piece") + F.length("word")).over(Window.partitionBy(id_column).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("at", 1 + upto - F.length("word")).select(id_column, "at", "word")


def company_terms(c: Column, stop: list[str]) -> Column:
    """The words of a company's name that tell it apart: four letters at least, none of the stop list."""
    words = F.split(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(stop)))


def payload_items(c: Column, schema: str, names: list[str]) -> Column:
    """The objects of a payload that is a list of them, or an object that has such a list under one of the names."""
    as_list = F.when(F.startswith(F.ltrim(c), F.lit("[")), F.from_json(c, f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ", ")))
    inner = [F.from_json(F.get_json_object(c, f"$.{n}"), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ", ")) for n in names]
    usable = [F.when(F.startswith(F.get_json_object(c, f"$.{n}"), F.lit("[")), x) for n, x in zip(names, inner, strict=True)]
    return F.coalesce(as_list, *usable)


def clause(c: Column, word: Column) -> Column:
    """The first clause, between sentence ends and conjunctions, that holds the word; else the whole text."""
    parts = F.split(c, r"[.!?;\n]+|\s(?:but|while|although)\s")
    return F.coalesce(F.trim(F.get(F.filter(parts, lambda p: F.contains(F.lower(p), F.lower(word))), F.lit(0))), c)


def quality_tier(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").otherwise("D")


def evidence_score(rules: list[tuple[Column, int]], base: int = 50) -> Column:
    """base plus the points of the rules that hold, between 0 and 100."""
    total = F.lit(base)
    for condition, points in rules:
        total = total + F.when(condition, points).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def classify(c: Column, positive: list[str], negative: list[str], hedges: list[str]) -> DataFrame | Column:
    """A struct of stance and confidence: more positive than negative words, fewer, as many, or none; confidence grows with
    the lead and halves with a hedge."""
    up, down, hedge = keyword_hits(c, positive), keyword_hits(c, negative), any_keyword(c, hedges)
    stance = F.when(up > down, "positive").when(down > up, "negative").when(up > 0, "mixed").otherwise("none")
    lead = F.least(F.lit(1.0), 0.5 + 0.15 * F.abs(up - down))
    return F.struct(stance.alias("stance"), F.round(F.when(up + down == 0, 0.0).otherwise(F.when(hedge, lead / 2).otherwise(lead)), 3).alias("confidence"))


def json_first(c: Column, *paths: str) -> Column:
    """The first path of a JSON text that has a value."""
    return F.coalesce(*[F.get_json_object(c, p) for p in paths])


def alias_at(ticker: Column, day: Column, new: Column, effective: Column) -> Column:
    """A renamed ticker from its effective date on; a missing date counts as after it."""
    return F.when(new.isNotNull() & (day.isNull() | (day >= effective)), new).otherwise(ticker)
