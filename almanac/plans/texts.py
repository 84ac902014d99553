"""Text queries: normalising, keywords, mentions, classifier, scores, HTML, JSON, dates, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import text
from almanac.operators import mentions
from almanac.operators.confound import reasons, short_key
from almanac.plans.registry import EV, query
from almanac.sources.tables import recommendations, table

UP, DOWN, HEDGE = ["the", "for", "with", "und", "une"], ["that", "nicht", "pas", "pour"], ["or", "oder", "ou"]
SYMBOLS = ["NOT", "CC", "NC", "BY", "IT", "THE", "AND", "TO", "OF", "GNU", "MIT"]


def _kw(word: str) -> str:
    return f"regexp_matches(t, '(^|[^a-z0-9]){word}($|[^a-z0-9])')"


def _hits(words: list[str]) -> str:
    return "(" + " + ".join(f"CAST({_kw(w)} AS INTEGER)" for w in words) + ")"


_T = r"t AS (SELECT doc_id, lang, source, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r]+', ' ', 'g')) AS t, text FROM documents)"


def _lowered(spark, sf):
    t = F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[ \t\n\r]+", " "))
    return table(spark, sf, "documents").select("doc_id", "lang", "source", t.alias("t"), "text")


@query(f"WITH {_T} SELECT doc_id, {_hits(UP)} AS up, {_hits(DOWN)} AS down, {_kw('license')} AS license FROM t")
def keyword_hits(spark, sf):
    t = F.col("t")
    return _lowered(spark, sf).select("doc_id", text.keyword_hits(t, UP).alias("up"), text.keyword_hits(t, DOWN).alias("down"), text.keyword(t, "license").alias("license"))


@query(f"""WITH {_T}, x AS (SELECT doc_id, {_hits(UP)} AS u, {_hits(DOWN)} AS d, ({' OR '.join(_kw(w) for w in HEDGE)}) AS h FROM t)
SELECT doc_id, CASE WHEN u > d THEN 'positive' WHEN d > u THEN 'negative' WHEN u > 0 THEN 'mixed' ELSE 'none' END AS stance, CAST(round(CASE WHEN u + d = 0 THEN 0.0 WHEN h THEN least(1.0, 0.5 + 0.15 * abs(u - d)) / 2 ELSE least(1.0, 0.5 + 0.15 * abs(u - d)) END, 3) AS DOUBLE) AS confidence FROM x""")
def stance_classifier(spark, sf):
    return _lowered(spark, sf).select("doc_id", text.classify(F.col("t"), UP, DOWN, HEDGE).alias("c")).select("doc_id", "c.stance", F.col("c.confidence").cast("double").alias("confidence"))


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\$?\\b([A-Z]{{2,5}})\\b', 1)) AS symbol FROM documents) SELECT doc_id, symbol, count(*) AS hits FROM w WHERE symbol IN ({', '.join(f"'{s}'" for s in SYMBOLS)}) AND symbol NOT IN ('OF', 'TO') GROUP BY 1, 2""")
def symbol_mentions(spark, sf):
    symbols = spark.createDataFrame([(s,) for s in SYMBOLS], "symbol string")
    return text.mentions(table(spark, sf, "documents"), "doc_id", "text", symbols, ["OF", "TO"]).select("doc_id", "symbol", "hits")


@query(f"""WITH {_T}, w AS (SELECT doc_id, len(regexp_extract_all(t, '[a-z0-9]+')) AS words, len(regexp_extract_all(t, '[0-9]+')) AS numbers FROM t) SELECT doc_id, CAST(words AS BIGINT) AS words, CAST(numbers AS BIGINT) AS numbers, round(numbers / nullif(words, 0), 6) AS density FROM w""")
def mention_density(spark, sf):
    count = lambda p: F.regexp_count("t", F.lit(p)).cast("long")
    return _lowered(spark, sf).select("doc_id", count("[a-z0-9]+").alias("words"), count("[0-9]+").alias("numbers")).withColumn("density", F.round(F.try_divide("numbers", "words"), 6))


@query(f"""WITH {_T}, p AS (SELECT doc_id, t, strpos(t, 'license') AS found FROM t) SELECT doc_id, found AS "at", substr(t, greatest(1, found - 80), found + 80 - greatest(1, found - 80)) AS context FROM p WHERE found > 0""")
def context_window(spark, sf):
    p = _lowered(spark, sf).withColumn("at", F.instr("t", "license").cast("long")).where("at > 0")
    return p.select("doc_id", "at", text.context(F.col("t"), F.col("at")).alias("context"))


@query(f"""WITH {_T}, s AS (SELECT doc_id, 50 + CASE WHEN length(text) > 500 THEN 20 ELSE 0 END + CASE WHEN {_kw('license')} THEN -15 ELSE 0 END + CASE WHEN strpos(t, '@') > 0 THEN -10 ELSE 0 END + CASE WHEN {_hits(UP)} >= 2 THEN 25 ELSE 0 END AS raw, strpos(t, '@') > 0 AS mail, {_kw('license')} AS lic, length(text) > 500 AS long FROM t), q AS (SELECT *, greatest(0, least(100, raw)) AS score FROM s)
SELECT doc_id, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS tier, concat_ws(';', CASE WHEN long THEN 'long' END, CASE WHEN lic THEN 'license' END, CASE WHEN mail THEN 'mail' END) AS reasons FROM q""")
def evidence_quality(spark, sf):
    t = F.col("t")
    lic, mail, long = text.keyword(t, "license"), F.contains(t, F.lit("@")), F.length("text") > 500
    score = text.evidence_score([(long, 20), (lic, -15), (mail, -10), (text.keyword_hits(t, UP) >= 2, 25)])
    return _lowered(spark, sf).select("doc_id", score.alias("score"), text.quality_tier(score).alias("tier"), F.array_join(reasons((long, "long"), (lic, "license"), (mail, "mail")), ";").alias("reasons"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM pages""")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_html("html").alias("text"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.k')) AS label FROM events""")
def json_paths(spark, sf):
    p = F.col("props")
    return table(spark, sf, "events").select("event_id", text.json_first(p, "$.k").cast("long").alias("k"), text.json_first(p, "$.name", "$.k").alias("label"))


@query("""SELECT page_id, substr(sha256(url || '|' || CAST(page_id AS VARCHAR)), 1, 28) AS key, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""")
def short_keys(spark, sf):
    return table(spark, sf, "pages").withColumn("id", F.col("page_id").cast("string")).select("page_id", short_key("url", "id").alias("key"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))


@query(f"""WITH {EV} SELECT event_id, year(event_date) AS year, strftime(event_date, '%Y-%m') AS month, week(event_date) AS iso_week, isodow(event_date) - 1 AS weekday, CAST(date_diff('day', DATE '1995-01-01', event_date) AS BIGINT) AS day_number FROM ev""")
def date_parts(spark, sf):
    d = F.col("event_date")
    return recommendations(spark, sf).select("event_id", F.year(d).cast("long").alias("year"), F.date_format(d, "yyyy-MM").alias("month"), F.weekofyear(d).cast("long").alias("iso_week"), F.weekday(d).cast("long").alias("weekday"), F.datediff(d, F.lit("1995-01-01").cast("date")).cast("long").alias("day_number"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN CAST(s_acctbal AS DOUBLE) END AS value, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS whole FROM supplier""")
def safe_casts(spark, sf):
    """Text fields as numbers: blanks and words are null."""
    from pyspark.sql import types as T

    from almanac.sources.tables import clean

    raw = F.when(F.col("s_suppkey") % 3 == 0, F.lit("  ")).when(F.col("s_suppkey") % 3 == 1, F.col("s_acctbal").cast("string")).otherwise(F.lit("n/a"))
    whole = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise(F.lit("x"))
    return table(spark, sf, "supplier").select("s_suppkey", clean(raw, T.DoubleType()).alias("value"), clean(whole, T.LongType()).alias("whole"))


@query(f"""WITH {EV}, a AS (SELECT * FROM (VALUES ('Brand#1', 'Brand#2', DATE '1997-01-01'), ('Brand#3', 'Brand#4', DATE '1999-06-01')) t(old, new, since)) SELECT event_id, CASE WHEN new IS NOT NULL AND (event_date IS NULL OR event_date >= since) THEN new ELSE ticker END AS data_ticker FROM ev LEFT JOIN a ON ticker = old""")
def effective_alias(spark, sf):
    a = spark.createDataFrame([("Brand#1", "Brand#2", "1997-01-01"), ("Brand#3", "Brand#4", "1999-06-01")], "ticker string, new string, since string").withColumn("since", F.to_date("since"))
    return recommendations(spark, sf).join(F.broadcast(a), "ticker", "left").select("event_id", text.alias_at(F.col("ticker"), F.col("event_date"), F.col("new"), F.col("since")).alias("data_ticker"))


@query("""WITH c AS (SELECT conv_id, turn, string_split_regex(text, '[.!?;\\n]+') AS parts, text FROM conversations) SELECT conv_id, turn, coalesce(trim(list_filter(parts, lambda p: contains(lower(p), 'the'))[1]), text) AS clause FROM c""")
def clause_focus(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.clause(F.col("text"), F.lit("the")).alias("clause"))


@query("""WITH n AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) SELECT w AS term, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM n WHERE length(w) >= 4 GROUP BY 1""")
def name_terms(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.explode(F.filter(F.split("p_name", " "), lambda w: F.length(w) >= 4)).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("parts"))


_TOKEN = "[0-9A-Za-z\\x{C0}-\\x{24F}]+|[^ \\t-\\r]"
_FOLD = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH names AS (SELECT n_name AS phrase, 'nation' AS kind, CAST(n_nationkey AS VARCHAR) AS code FROM nation UNION SELECT r_name, 'region', CAST(r_regionkey AS VARCHAR) FROM region UNION SELECT s_name, 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier UNION SELECT p_name, 'part', p_brand FROM part
  UNION SELECT regexp_extract(text, '^[^ ]+ [^ ]+ [^ ]+'), 'item', CAST(item_id AS VARCHAR) FROM benchmark UNION SELECT regexp_extract(text, '^[^ ]+ [^ ]+'), 'alias', CAST(item_id AS VARCHAR) FROM benchmark),
d AS (SELECT phrase, kind, code, regexp_extract_all({_FOLD.format(c='phrase')}, '{_TOKEN}') AS tk FROM names), t AS (SELECT doc_id, text, regexp_extract_all({_FOLD.format(c='text')}, '[ \t-\r]+|{_TOKEN}') AS pieces FROM documents),
p AS (SELECT doc_id, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS k FROM t), q AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM p), w AS (SELECT doc_id, piece, upto, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k FROM q WHERE NOT regexp_matches(piece, '^[ \t-\r]')),
toks AS (SELECT doc_id, list(piece ORDER BY k) AS tk FROM w GROUP BY 1), m AS (SELECT w.doc_id, w.k, w.upto - length(w.piece) + 1 AS "at", d.* FROM w JOIN d ON len(d.tk) > 0 AND d.tk[1] = w.piece)
SELECT m.doc_id, CAST(m."at" AS BIGINT) AS "at", CAST(e.upto - m."at" + 1 AS BIGINT) AS size, m.phrase, m.kind, m.code FROM m JOIN toks ON m.doc_id = toks.doc_id AND list_slice(toks.tk, m.k, m.k + len(m.tk) - 1) = m.tk JOIN w e ON e.doc_id = m.doc_id AND e.k = m.k + len(m.tk) - 1""")
def dictionary_mentions(spark, sf):
    """Every place in the documents of the names of nations, regions, suppliers and parts, of the benchmark's items, which are
    called by their first three words, and of their aliases, the first two."""
    text_key = lambda c: F.col(c).cast("string").alias("code")
    names = None
    for t, phrase, kind, code in (("nation", "n_name", "nation", "n_nationkey"), ("region", "r_name", "region", "r_regionkey"), ("supplier", "s_name", "supplier", "s_suppkey"), ("part", "p_name", "part", "p_brand"), ("benchmark", F.regexp_extract("text", "^[^ ]+ [^ ]+ [^ ]+", 0), "item", "item_id"), ("benchmark", F.regexp_extract("text", "^[^ ]+ [^ ]+", 0), "alias", "item_id")):
        some = table(spark, sf, t).select((F.col(phrase) if isinstance(phrase, str) else phrase).alias("phrase"), F.lit(kind).alias("kind"), text_key(code))
        names = some if names is None else names.union(some)
    found = mentions.dictionary_mentions(table(spark, sf, "documents"), "doc_id", "text", names)
    return found.select("doc_id", "at", F.length("surface").cast("long").alias("size"), "phrase", "kind", "code")
