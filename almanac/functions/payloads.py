"""Payloads of unknown shape as rows: VARIANT values, read by paths, of which what has another type is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where providers put a post's fields, in order of preference, and lists of posts.
LISTS = ["items", "data", "results", "tweets", "posts"]
PATHS = {
    "post_id": ["id", "tweet_id", "tweetId", "rest_id", "post_id", "tweet.id", "tweet.rest_id"],
    "text": ["text", "full_text", "fullText", "content", "tweetText", "body", "legacy.full_text", "tweet.text", "tweet.full_text", "data.text"],
    "created_at": ["created_at", "createdAt", "createdAtIso", "date", "timestamp", "time", "legacy.created_at", "tweet.created_at", "tweet.createdAt", "tweet.created_time"],
    "handle": ["author.username", "author.userName", "author.screen_name", "user.username", "user.userName", "username", "userName", "handle", "tweet.author.userName", "tweet.author.username", "user.legacy.screen_name", "screen_name"],
    "name": ["author.name", "user.name", "name", "author.displayName", "tweet.author.name"],
    "author_id": ["author.id", "authorId", "user.id", "userId", "tweet.author.id"],
    "language": ["lang", "language", "tweetLanguage", "legacy.lang", "tweet.lang"],
    "url": ["url", "tweetUrl", "twitterUrl", "tweet_url", "link", "tweet.tweetUrl", "legacy.url"],
    "likes": ["likeCount", "likes", "favorite_count", "favoriteCount", "legacy.favorite_count", "tweet.likeCount"],
}


def scalar(v: Column, path: str, kind: str) -> Column:
    """The value at a path, null if it is missing, an object, a list or not of that kind; blank strings are null."""
    there = F.try_variant_get(v, f"$.{path}", "variant")
    value = F.when(~F.schema_of_variant(there).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(v, f"$.{path}", kind))
    return F.nullif(F.trim(value), F.lit("")) if kind == "string" else value


def first_of(v: Column, field: str, kind: str = "string") -> Column:
    """The first path of a field that has a value of the kind."""
    return F.coalesce(*[scalar(v, p, kind) for p in PATHS[field]])


def items(payload: Column) -> Column:
    """The list of posts in a payload: itself, the list under one of the known names, or itself as the only one; null if it
    isn't JSON."""
    v = F.try_parse_json(payload)
    is_list = lambda x: F.schema_of_variant(x).startswith("ARRAY")
    under = [F.try_variant_get(v, f"$.{n}", "variant") for n in LISTS]
    alone = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]"))))
    return F.coalesce(F.when(is_list(v), v), *[F.when(is_list(x), x) for x in under], alone)


def posts_of(payloads: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, post_id, text, created_at, handle, name, author_id, language, url, likes) for each post of each payload. Rows that
    only fill a page (type mock_tweet) and those without a positive id, a text or a time are none."""
    spark = payloads.sparkSession
    lists = payloads.select(*keys, items(F.col(payload)).alias("_items"))
    rows = spark.sql("SELECT l.*, e.value AS _v FROM {lists} l, LATERAL variant_explode(l._items) e", lists=lists)
    v = F.col("_v")
    fields = {f: first_of(v, f) for f in ("text", "name", "author_id", "language", "url")}
    out = rows.where(F.lower(F.coalesce(scalar(v, "type", "string"), F.lit(""))) != "mock_tweet").select(
        *keys, first_of(v, "post_id").try_cast("long").alias("post_id"), F.try_to_timestamp(first_of(v, "created_at")).alias("created_at"), F.ltrim(first_of(v, "handle"), F.lit("@")).alias("handle"), *[c.alias(f) for f, c in fields.items()], first_of(v, "likes", "long").alias("likes")
    )
    return out.where("post_id > 0 and text is not null and created_at is not null").select(*keys, "post_id", "text", "created_at", "handle", "name", "author_id", "language", "url", "likes")
