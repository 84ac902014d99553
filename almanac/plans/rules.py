"""Rule queries: recommendations, posts, exclusions, mentions in context, scores, grades, taxonomies, labels."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.functions import payloads, rules, text
from almanac.operators.confound import short_key
from almanac.plans.confounds import STATES, states
from almanac.plans.registry import EVENTS, query
from almanac.plans.samples import _H, _horizons
from almanac.sources.posts import POSTS, posts
from almanac.sources.tables import table


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _has(pattern: str, c: str = "t") -> str:
    return f"regexp_matches({c}, {_q(pattern)})"


def _count(words: list[str]) -> str:
    single, phrases = rules.split_words(words)
    parts = ([f"len(list_filter({_list(single)}, lambda w: list_contains(tk, w)))"] if single else []) + [f"CAST({_has(rules._phrase([p]))} AS INTEGER)" for p in phrases]
    return "(" + " + ".join(parts) + ")"


def _any(words: list[str]) -> str:
    return f"({_count(words)} > 0)"


def _contained(words: list[str], c: str = "t") -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({c}, w)))"


def _case(*rules_: tuple[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules_) + f" ELSE {otherwise} END"


_R = f"""r0 AS (SELECT *, {_count(rules.BULLISH)} AS n_up, {_count(rules.BEARISH)} AS n_down, {', '.join(f"{_any(w)} AS {n}" for n, w in dict(retrospective=rules.RETROSPECTIVE, disclosure=rules.DISCLOSURE, risk=rules.RISK, valuation=rules.VALUATION, third_party=rules.THIRD_PARTY, ambiguous=rules.AMBIGUOUS).items())} FROM posts),
r1 AS (SELECT *, CASE WHEN n_up > n_down THEN 'bullish' WHEN n_down > n_up THEN 'bearish' ELSE 'neutral' END AS stance FROM r0),
r2 AS (SELECT *, CASE WHEN stance = 'neutral' THEN 0 WHEN {_any(rules.HYPE)} THEN 5 WHEN {_any(rules.TARGET)} THEN 4 WHEN (stance = 'bullish' AND {_any(rules.EXPLICIT_BULLISH)}) OR (stance = 'bearish' AND {_any(rules.EXPLICIT_BEARISH)}) THEN 3 WHEN {_any(rules.SOFT)} THEN 2 ELSE 1 END AS score, stance = 'neutral' AND {_any(rules.NEWS_ONLY)} AS news_only FROM r1),
r3 AS (SELECT *, CASE WHEN third_party AND stance <> 'neutral' THEN 'third_party_attribution' WHEN ambiguous AND stance <> 'neutral' THEN 'ambiguous_reference' WHEN {_any(rules.STRONG_RETROSPECTIVE)} OR (retrospective AND score < 3) THEN 'retrospective_claim' WHEN disclosure AND stance = 'neutral' THEN 'portfolio_disclosure' WHEN news_only THEN 'news_only' WHEN stance = 'neutral' AND {_any(rules.HYPE)} THEN 'non_actionable_hype' WHEN stance = 'neutral' THEN 'neutral_mention' ELSE stance || '_recommendation' END AS label FROM r2),
rec AS (SELECT *, {_case(*[(f"{_contained(w)} > 0", _q(n)) for n, w in rules.HORIZONS], otherwise="'unspecified'")} AS horizon,
round(CAST(least(0.95, 0.35 + CASE WHEN stance <> 'neutral' THEN least(0.35, 0.12 * (n_up + n_down)) ELSE 0 END + CASE WHEN score >= 3 THEN 0.15 ELSE 0 END + CASE WHEN risk OR valuation THEN 0.05 ELSE 0 END + CASE WHEN retrospective AND label = 'retrospective_claim' THEN 0.1 ELSE 0 END) AS DOUBLE), 3) AS confidence,
stance <> 'neutral' AND score >= 2 AND label NOT IN ('retrospective_claim', 'news_only') AS candidate FROM r3)"""


def _recommended(spark, sf):
    return rules.recommendation(rules.prepared(posts(spark, sf), "text"))


@query(f"WITH {POSTS}, {_R} SELECT event_id, label, stance, CAST(score AS BIGINT) AS score, horizon, disclosure, risk, valuation, retrospective, news_only, third_party, ambiguous, confidence, candidate FROM rec")
def recommendation_classifier(spark, sf):
    """Counts, precedence of labels, actionability, horizon, confidence and the candidate gate."""
    return _recommended(spark, sf).select("event_id", "label", "stance", F.col("score").cast("long").alias("score"), "horizon", "disclosure", "risk", "valuation", "retrospective", "news_only", "third_party", "ambiguous", "confidence", "candidate")


_X = f"""x0 AS (SELECT *, contains(t, lower(symbol)) AS named, {_has(rules.NEGATED_ACTION)} AS negated FROM rec), x1 AS (SELECT *, candidate AND named AND NOT negated AND label NOT IN ('third_party_attribution', 'ambiguous_reference') AS accepted FROM x0)"""


@query(f"""WITH {POSTS}, {_R}, {_X} SELECT event_id, negated, accepted, CASE WHEN NOT accepted THEN CASE WHEN NOT named THEN 'cross_attributed_action' WHEN negated THEN 'negated_action' WHEN label IN ('third_party_attribution', 'ambiguous_reference', 'news_only', 'retrospective_claim', 'non_actionable_hype') THEN label WHEN label = 'portfolio_disclosure' THEN 'disclosure_only' ELSE 'no_actionable_recommendation' END END AS reason,
CASE WHEN NOT accepted THEN CASE WHEN label IN ('third_party_attribution', 'ambiguous_reference', 'news_only', 'retrospective_claim', 'portfolio_disclosure', 'non_actionable_hype') THEN 'exclude' ELSE 'low' END WHEN score >= 3 AND {_has(rules.EXPLICIT_ACTION)} THEN 'high' ELSE 'medium' END AS confidence_label FROM x1""")
def exclusion_reasons(spark, sf):
    """Why a candidate isn't accepted: negation, another's action, the past, news, disclosure, hype."""
    named = F.contains(F.col("t"), F.lower("symbol"))
    return rules.exclusion(_recommended(spark, sf), named).select("event_id", "negated", "accepted", "reason", "confidence_label")


def _post_rules() -> str:
    out = []
    for pattern, label, way, sure, act in rules.POST_RULES:
        holds = f"{_has(rules.POST_NEWS)} AND NOT {_has(rules.POST_ACTION)}" if pattern == "news" else _has(pattern)
        if label == "meme_or_noise":
            holds += f" AND {_has(rules.POST_MOOD)}"
        mood = "CASE WHEN contains(t, 'bearish') OR contains(t, 'dumping') THEN 'bearish' ELSE 'bullish' END"
        d = _q(way) if way else "CASE WHEN regexp_matches(t, '\\b(upside|raise|higher|bullish)\\b') THEN 'bullish' ELSE 'neutral' END" if label == "price_target" else mood
        out.append((holds, f"{{'label': {_q(label)}, 'direction': {d}, 'confidence': CAST({sure} AS DOUBLE), 'actionable': {str(act).lower()}}}"))
    return _case(*out, otherwise="{'label': 'unclear', 'direction': 'unclear', 'confidence': CAST(0.3 AS DOUBLE), 'actionable': false}")


@query(f"WITH {POSTS}, c AS (SELECT event_id, {_post_rules()} AS c FROM posts) SELECT event_id, c.label AS label, c.direction AS direction, c.confidence AS confidence, c.actionable AS actionable FROM c")
def post_classifier(spark, sf):
    """Ordered pattern rules over posts."""
    return rules.post_class(rules.prepared(posts(spark, sf), "text")).select("event_id", "c.*")


#: Words that make a window one about stocks.
CONTEXT = ["stock", "share", "equity", "buy", "bought", "sell", "avoid", "short", "long", "bullish", "bearish", "undervalued", "overvalued", "upside", "downside", "watchlist", "breakout", "calls", "puts", "earnings", "revenue", "price target", "valuation", "portfolio"]
HIGH_RISK = ["TO", "TV", "TX"]
_STRONG = ["{w} stock", "{w} shares", "{w} earnings", "{w} revenue", "long {w}", "short {w}", "buy {w}", "sell {w}", "{w} price target"]


@query(f"""WITH {POSTS}, pos AS (SELECT event_id, text, CAST(unnest(range(1, length(text) + 1)) AS BIGINT) AS "at" FROM posts), m AS (SELECT event_id, text, "at", regexp_extract(substr(text, "at"), '^\\$?[A-Z]{{2,5}}') AS found FROM pos WHERE regexp_matches(substr(text, "at"), '^\\$?[A-Z]{{2,5}}($|[^A-Za-z0-9_])') AND ("at" = 1 OR NOT regexp_matches(substr(text, "at" - 1, 1), '[A-Za-z0-9_$]'))),
w AS (SELECT *, found LIKE '$%' AS cashtag, replace(found, '$', '') AS symbol, lower(substr(text, greatest(1, "at" - 80), "at" + length(found) + 80 - greatest(1, "at" - 80))) AS around FROM m), u AS (SELECT DISTINCT symbol FROM posts), c AS (SELECT w.*, {_contained(CONTEXT, 'around')} > 0 AS context, {' OR '.join("contains(around, " + " || ".join(("lower(w.symbol)" if x == "{w}" else _q(x)) for x in __import__('re').split('(\\{w\\})', p) if x) + ")" for p in _STRONG)} AS strong FROM w JOIN u ON w.symbol = u.symbol)
SELECT event_id, "at", symbol, cashtag, CASE WHEN cashtag THEN 'cashtag' ELSE 'plain_context' END AS method, CAST(CASE WHEN cashtag THEN 0.95 ELSE 0.7 END AS DOUBLE) AS confidence, CASE WHEN symbol IN ('TO', 'TV', 'TX') THEN 'high' ELSE 'low' END AS risk FROM c WHERE CASE WHEN symbol IN ('TO', 'TV', 'TX') THEN context AND strong WHEN cashtag THEN true ELSE context END""")
def mentions_in_context(spark, sf):
    """Cashtags, and plain symbols of the universe whose surroundings are about stocks, each with its place; symbols that
    are everyday words need a stock phrase beside them."""
    p = posts(spark, sf)
    m = text.placed(p, "event_id", "text", r"\$?\b[A-Z]{2,5}\b")
    universe = p.select("symbol").distinct()
    m = m.withColumns({"cashtag": F.startswith("word", F.lit("$")), "symbol": F.replace("word", F.lit("$"), F.lit(""))}).join(universe, "symbol", "left_semi")
    start = F.greatest(F.lit(1), F.col("at") - 80)
    m = m.join(p.select("event_id", "text"), "event_id").withColumn("around", F.lower(F.substring("text", start.cast("int"), (F.col("at") + F.length("word") + 80 - start).cast("int"))))
    context, risky, strong = rules.contained(CONTEXT, "around") > 0, F.col("symbol").isin(HIGH_RISK), F.lit(False)
    for phrase in _STRONG:
        a, b = phrase.split("{w}")
        strong = strong | F.contains("around", F.concat(F.lit(a), F.lower("symbol"), F.lit(b)))
    m = m.where(F.when(risky, context & strong).when(F.col("cashtag"), True).otherwise(context))
    return m.select("event_id", "at", "symbol", "cashtag", F.when(F.col("cashtag"), "cashtag").otherwise("plain_context").alias("method"), F.when(F.col("cashtag"), 0.95).otherwise(0.7).alias("confidence"), F.when(risky, "high").otherwise("low").alias("risk"))


@query(f"""WITH {POSTS}, w AS (SELECT event_id, t, lower(symbol) AS s FROM posts) SELECT event_id, NOT (contains(t, '$' || s) OR {' OR '.join(f"contains(t, '{x}' || s)" for x in ('nyse: ', 'nasdaq: ', 'buy ', 'sell ', 'long ', 'short '))} OR {' OR '.join(f"contains(t, s || '{x}')" for x in (' stock', ' shares', ' earnings', ' revenue'))}) AND ({' OR '.join(f"contains(t, '{x} ' || s)" for x in ('if', 'when', 'what', 'how', 'why', 'that', 'and', 'for', 'with', 'to', 'of', 'do', 'thank', 'love', 'are'))} OR {' OR '.join(f"contains(t, s || '{x}')" for x in (' should', ' know', ' can'))}) AS quarantined FROM w""")
def false_positive_quarantine(spark, sf):
    """Posts whose ticker is used as a plain word."""
    return rules.prepared(posts(spark, sf), "text").select("event_id", rules.ordinary_word(F.col("t"), F.col("symbol")).alias("quarantined"))


@query(f"""WITH {POSTS} SELECT event_id, {', '.join(f"CAST({_contained(w)} AS BIGINT) AS {n}" for n, w in rules.NARRATIVE.items())}, CAST(length(t) AS BIGINT) AS size FROM posts""")
def narrative_scores(spark, sf):
    """Keyword groups that a text holds: whose news it relays, hype, urgency, valuation, charts, risk, disclosure."""
    return rules.prepared(posts(spark, sf), "text").select("event_id", *[rules.contained(w).cast("long").alias(n) for n, w in rules.NARRATIVE.items()], F.length("t").cast("long").alias("size"))


@query(f"""WITH {POSTS} SELECT event_id, {', '.join(f"{_contained(w)} > 0 AS {n}_news" for n, w in rules.NEWS_TOPICS.items())}, {_contained(rules.MATERIAL)} > 0 AS material, list_contains(tk, lower(symbol)) OR contains(t, 'market') AS relevant FROM posts""")
def news_flags(spark, sf):
    """Topics of a headline, whether it is material, and whether it is about the ticker or a term of the company's name."""
    terms = text.company_terms(F.lit("The Market Co Ltd"), rules.COMPANY_STOP)
    p = rules.prepared(posts(spark, sf), "text").withColumn("terms", terms)
    relevant = F.array_contains("tk", F.lower("symbol")) | F.exists("terms", lambda w: F.contains(F.col("t"), w))
    return p.select("event_id", *[(rules.contained(w) > 0).alias(f"{n}_news") for n, w in rules.NEWS_TOPICS.items()], (rules.contained(rules.MATERIAL) > 0).alias("material"), relevant.alias("relevant"))


_GRADE_TEXTS = ["Strong Buy", "buy", "Outperform", "Market-Perform", "weak hold", "N/A", "reiterated", "Upgraded from Hold to Buy", "sector perform / neutral", "Perform", "positive but sell", "speculative buy", "??", "to_underweight"]
_GRADE_WANT = [("bullish", "high", "exact"), ("bullish", "high", "exact"), ("bullish", "high", "exact"), ("neutral", "high", "exact"), ("bearish", "high", "exact"), ("unknown", "unknown", "missing"), ("unknown", "unknown", "ambiguous"), ("bullish", "medium", "to_grade"), ("neutral", "medium", "phrase"), ("neutral", "high", "exact"), ("unknown", "unknown", "conflicting"), ("bullish", "medium", "phrase"), ("unknown", "unknown", "missing"), ("bearish", "medium", "to_grade")]


@query(f"""WITH g AS (SELECT o_orderkey AS event_id, 1 + CAST(o_orderkey % {len(_GRADE_TEXTS)} AS INTEGER) AS k, o_orderkey % 5 AS buy, o_orderkey % 3 AS sell, o_orderkey % 4 AS hold, o_orderkey % 7 - 1 AS rating, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 41 - 20) / 200.0 END AS upside FROM orders)
SELECT event_id, ({_list(w[0] for w in _GRADE_WANT)})[k] AS stance, ({_list(w[1] for w in _GRADE_WANT)})[k] AS sure, ({_list(w[2] for w in _GRADE_WANT)})[k] AS rule,
CASE WHEN buy + sell + hold = 0 THEN 'unknown' WHEN buy >= greatest(sell, hold) AND buy >= 2 * sell THEN 'bullish' WHEN sell >= greatest(buy, hold) AND sell >= 2 * buy THEN 'bearish' ELSE 'neutral' END AS by_counts,
CASE WHEN upside >= 0.05 THEN 'bullish' WHEN upside <= -0.05 THEN 'bearish' WHEN rating >= 4 THEN 'bullish' WHEN rating <= 2 THEN 'bearish' ELSE 'neutral' END AS by_rating FROM g""")
def analyst_grades(spark, sf):
    """Grades as stances, by their words; and stances from counts of analysts and from ratings."""
    k = F.col("o_orderkey")
    raw = F.element_at(F.array(*map(F.lit, _GRADE_TEXTS)), (1 + k % len(_GRADE_TEXTS)).cast("int"))
    upside = F.when(k % 2 == 0, (k % 41 - 20) / 200.0)
    return rules.graded(table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")), "raw").select(k.alias("event_id"), "stance", "sure", "rule", rules.stance_of_counts(k % 5, k % 3, k % 4).alias("by_counts"), rules.stance_of_rating(k % 7 - 1, upside).alias("by_rating"))


@query(f"""WITH {POSTS}, {_R}, g AS (SELECT creator, count(*) AS items, count(*) FILTER (contains(text, '$')) AS mentions, count(*) FILTER (candidate) AS actionable, avg(size) AS engagement, count(DISTINCT symbol) AS diversity FROM rec GROUP BY 1)
SELECT creator, round(CAST(least(items / 50.0, 1.0) * 15 + least(mentions / CAST(items AS DOUBLE) / 2, 1.0) * 25 + least(actionable / CAST(items AS DOUBLE), 1.0) * 25 + least(log10(engagement + 1) / 6, 1.0) * 15 + least(diversity / 12.0, 1.0) * 10 + CASE WHEN creator % 2 = 0 THEN 10 ELSE 8 END AS DOUBLE), 3) AS relevance FROM g""")
def creator_relevance(spark, sf):
    g = _recommended(spark, sf).groupBy("creator").agg(F.count("*").alias("items"), F.count_if(F.contains("text", F.lit("$"))).alias("mentions"), F.count_if("candidate").alias("actionable"), F.avg("size").alias("engagement"), F.countDistinct("symbol").alias("diversity"))
    return g.select("creator", rules.creator_relevance(*[F.col(c) for c in ("items", "mentions", "actionable", "engagement", "diversity")], F.when(F.col("creator") % 2 == 0, 10).otherwise(8)).alias("relevance"))


_CATEGORIES = ["stock_picker", "meme_retail", "analytical_control", "macro_commentary", "news_attention", "unknown"]


def _table_sql(c: str, values: dict, otherwise: float) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in values.items()) + f" ELSE {otherwise} END"


@query(f"""WITH {POSTS}, {_R}, g AS (SELECT creator, ({_list(_CATEGORIES)})[1 + CAST(creator % 6 AS INTEGER)] AS category, CAST(count(*) % 60 AS DOUBLE) AS n, count(*) FILTER (contains(text, '$')) / CAST(count(*) AS DOUBLE) AS md, count(*) FILTER (candidate) / CAST(count(*) AS DOUBLE) / 4 AS ad FROM rec GROUP BY 1),
e AS (SELECT *, greatest(ad * n, n * {_table_sql('category', rules.ACTIONABLE, 0.1)}) AS est FROM g), s AS (SELECT *, round(CAST(least(n / 25, 2.0) * 18 + least(md, 1.0) * 15 + least(CASE WHEN ad > 0 THEN ad ELSE coalesce(est / nullif(n, 0), 0) END, 0.6) / 0.6 * 22 + {_table_sql('category', rules.ORIGINALITY, 0.35)} * 18 + least(coalesce(est / nullif(2 * n, 0) * 1000, 0) / 80, 1.0) * 12 AS DOUBLE), 3) AS score FROM e)
SELECT creator, category, CASE WHEN category = 'news_attention' THEN least(score, 49.0) ELSE score END AS score, CASE WHEN category = 'news_attention' THEN 'exclude_too_news_heavy' WHEN category = 'analytical_control' OR (category = 'macro_commentary' AND n >= 25) THEN 'include_control' WHEN category = 'macro_commentary' THEN 'needs_manual_review' WHEN n < 25 THEN 'exclude_too_low_signal' WHEN est < 8 THEN 'needs_manual_review' WHEN category IN ('stock_picker', 'meme_retail') THEN 'include_primary' ELSE 'needs_manual_review' END AS action, round(est, 6) AS estimated FROM s""")
def creator_selection(spark, sf):
    """Score of a creator for the sample, the action, and how many of its posts are likely actionable."""
    n = F.count("*")
    g = _recommended(spark, sf).groupBy("creator").agg((n % 60).cast("double").alias("n"), (F.count_if(F.contains("text", F.lit("$"))) / n).alias("md"), (F.count_if("candidate") / n / 4).alias("ad"))
    g = g.withColumn("category", F.element_at(F.array(*map(F.lit, _CATEGORIES)), (1 + F.col("creator") % 6).cast("int")))
    score, action, estimated = rules.creator_selection(F.col("category"), F.col("n"), F.col("md"), F.col("ad"), 2 * F.col("n"))
    return g.select("creator", "category", score.alias("score"), action.alias("action"), F.round(estimated, 6).alias("estimated"))


_TITLE_TERMS, _CONTROL_TERMS, _DEPRIORITIZE = ["buy", "sell", "price target", "watchlist", "10x", "bought", "undervalued"], ["news", "inflation", "update", "fed"], ["market update", "inflation", "rate cuts"]


@query(f"""WITH {POSTS}, v AS (SELECT *, 60 + event_id % 4000 AS seconds, (event_id % 10) / 20.0 AS conversion, event_id % 40 AS events, 'Channel ' || CASE WHEN creator % 3 = 0 THEN 'stock talk' ELSE 'news' END AS channel FROM posts), c AS (SELECT *, {_contained(_TITLE_TERMS)} AS hits, CASE WHEN list_contains(tk, lower(symbol)) THEN 1 ELSE 0 END AS tickers FROM v)
SELECT event_id, round(CAST(greatest(0, least(4, hits) * 14 + least(6, tickers) * 8 - {_contained(_DEPRIORITIZE)} * 10 + CASE WHEN contains(lower(channel), 'stock') THEN 8 ELSE 0 END + CASE WHEN seconds < 90 THEN -12 WHEN seconds > 7200 THEN -8 WHEN seconds BETWEEN 180 AND 3600 THEN 6 ELSE 0 END + least(25, conversion * 35) + least(15, events * 0.6) - CASE WHEN hits = 0 AND tickers = 0 AND length(t) < 80 THEN 8 ELSE 0 END) AS DOUBLE), 3) AS video_score,
round(CAST(greatest(0, CASE WHEN contains(lower(channel), 'stock') THEN 30 ELSE 0 END - CASE WHEN contains(lower(channel), 'news') AND NOT contains(lower(channel), 'stock') THEN 12 ELSE 0 END + least(30, events * 1.2) + least(18, conversion * 25)) AS DOUBLE), 3) AS creator_score,
CAST(greatest(0, CASE WHEN hits > 0 THEN 3 ELSE 0 END - CASE WHEN {_contained(_CONTROL_TERMS)} > 0 THEN 1 ELSE 0 END + 2 * least(tickers, 3)) AS DOUBLE) AS title_score FROM c""")
def video_scores(spark, sf):
    """How likely a video has a pick, how likely its channel gives picks, and how soon its title says to fetch it."""
    p = rules.prepared(posts(spark, sf), "text")
    channel, k = F.when(F.col("creator") % 3 == 0, "channel stock talk").otherwise("channel news"), F.col("event_id")
    seconds, conversion, events = 60 + k % 4000, (k % 10) / 20.0, k % 40
    hits, tickers, stock = rules.contained(_TITLE_TERMS), F.array_contains("tk", F.lower("symbol")).cast("int"), F.contains(channel, F.lit("stock"))
    zero, least = F.lit(0.0), lambda a, b: F.least(F.lit(a), b)
    length = F.when(seconds < 90, -12).when(seconds > 7200, -8).when(seconds.between(180, 3600), 6).otherwise(0)
    video = least(4, hits) * 14 + least(6, tickers) * 8 - rules.contained(_DEPRIORITIZE) * 10 + F.when(stock, 8).otherwise(0) + length + least(25.0, conversion * 35) + least(15.0, events * 0.6) - F.when((hits == 0) & (tickers == 0) & (F.length("t") < 80), 8).otherwise(0)
    creator = F.when(stock, 30).otherwise(0) - F.when(F.contains(channel, F.lit("news")) & ~stock, 12).otherwise(0) + least(30.0, events * 1.2) + least(18.0, conversion * 25)
    title = F.when(hits > 0, 3).otherwise(0) - F.when(rules.contained(_CONTROL_TERMS) > 0, 1).otherwise(0) + 2 * least(3, tickers)
    return p.select("event_id", F.round(F.greatest(zero, video), 3).alias("video_score"), F.round(F.greatest(zero, creator), 3).alias("creator_score"), F.greatest(zero, title.cast("double")).alias("title_score"))


@query(f"""{EVENTS}, {STATES}, {_H}, {POSTS}, s AS (SELECT posts.event_id, {', '.join(f"{_contained(w)} AS s_{n}" for n, w in rules.NARRATIVE.items())}, coalesce(av_state = 'unknown' AND gd_state = 'unknown', true) AS unknown, pre21 IS NOT NULL AS historical, coalesce(sec_state = 'confounded', false) AS sec, coalesce('confounded' IN (av_state, gd_state), false) AS conf, coalesce(av_near + gd_near = 0, true) AS quiet,
coalesce((h.direction = 'positive' AND pre21 < 0) OR (h.direction = 'negative' AND pre21 > 0), false) AS contrarian FROM posts LEFT JOIN st ON posts.event_id = st.event_id LEFT JOIN h ON posts.event_id = h.event_id)
SELECT event_id, CASE WHEN unknown AND NOT historical THEN 'insufficient_external_data' WHEN sec OR conf OR s_earnings_relay >= 2 OR s_news_relay >= 2 THEN 'official_news_relay' WHEN s_analyst_relay >= 2 THEN 'analyst_relay' WHEN s_market_move >= 2 AND NOT quiet THEN 'market_reaction_relay' WHEN s_retail_hype >= 2 OR s_urgency >= 2 THEN 'retail_hype_attention' WHEN s_valuation >= 2 THEN 'valuation_or_fundamental_original_like' WHEN contrarian AND historical THEN 'contrarian_original_like' ELSE 'ambiguous_mixed' END AS originality FROM s""")
def originality_taxonomy(spark, sf):
    """Where a post's information comes from: its words, what providers had around it, and whether it goes against the trend."""
    p = rules.prepared(posts(spark, sf), "text").select("event_id", "t", "tk")
    h = _horizons(spark, sf).select("event_id", "direction", "pre21")
    j = p.join(states(spark, sf).select("event_id", "av_state", "gd_state", "sec_state", (F.col("av_near") + F.col("gd_near")).alias("near")), "event_id", "left").join(h, "event_id", "left")
    is_state = lambda c, s: F.coalesce(F.col(f"{c}_state") == s, F.lit(s == "unknown"))
    against = ((F.col("direction") == "positive") & (F.col("pre21") < 0)) | ((F.col("direction") == "negative") & (F.col("pre21") > 0))
    f = {n: rules.contained(w) for n, w in rules.NARRATIVE.items()} | {"unknown": is_state("av", "unknown") & is_state("gd", "unknown"), "historical": F.col("pre21").isNotNull(), "sec": is_state("sec", "confounded"), "confounded": is_state("av", "confounded") | is_state("gd", "confounded"), "quiet": F.coalesce(F.col("near") == 0, F.lit(True)), "contrarian": F.coalesce(against, F.lit(False))}
    return j.select("event_id", rules.originality(f).alias("originality"))


@query(f"""WITH {POSTS}, {_R}, l AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN 'comment_context' WHEN event_id % 6 = 1 THEN 'transcript' WHEN contains(t, lower(symbol)) AND candidate THEN 'title' ELSE 'description' END AS layer FROM rec) SELECT event_id, layer, CASE WHEN layer = 'comment_context' THEN 'exclude' WHEN layer IN ('title', 'description') THEN CASE WHEN confidence >= 0.7 AND score >= 3 THEN 'medium' ELSE 'low' END WHEN confidence >= 0.75 AND score >= 3 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS confidence_label FROM l""")
def source_layers(spark, sf):
    """Which layer of a video an event comes from, and how sure that makes it."""
    k = F.col("event_id")
    layer = F.when(k % 6 == 0, "comment_context").when(k % 6 == 1, "transcript").when(F.contains("t", F.lower("symbol")) & F.col("candidate"), "title").otherwise("description")
    return _recommended(spark, sf).withColumn("layer", layer).select("event_id", "layer", rules.layer_confidence(F.col("layer"), F.col("confidence"), F.col("score")).alias("confidence_label"))


_WORDS = rules.AMBIGUOUS_TICKERS + HIGH_RISK


def _label_sql() -> str:
    def entry(true, kind, way, conviction, evidence, sure, flags, pattern):
        found = f"regexp_extract(t, {_q(pattern)})" if pattern else ""
        around = f"substr(trim(substr(t, greatest(1, strpos(t, {found}) - 90), strpos(t, {found}) + length({found}) + 110 - greatest(1, strpos(t, {found}) - 90))), 1, 240)" if pattern else "substr(t, 1, 240)"
        way = way if way.startswith("CASE") else _q(way)
        review = "true" if true == "unclear" else f"round(CAST({sure} AS DOUBLE), 3) < 0.75"
        return f"{{'is_true': {_q(true)}, 'type': {_q(kind)}, 'direction': {way}, 'conviction': {_q(conviction)}, 'evidence': {_q(evidence)}, 'confidence': round(CAST({sure} AS DOUBLE), 3), 'needs_review': {review}, 'flags': concat_ws(';', {', '.join(flags)}), 'quote': {around}}}"

    third, past, unnamed = "third", "past", "CASE WHEN NOT named THEN 'target_not_explicit_in_context' END"
    unclear = lambda flag, *first: entry("unclear", "unclear", "unclear", "unclear", "weak", "0.35", [*first, _q(flag)], None)
    out = [("length(t) < 40", unclear("insufficient_context"))]
    phrases = " OR ".join("contains(t, " + " || ".join("lower(symbol)" if x == "{w}" else _q(x) for x in re.split(r"(\{w\})", p) if x) + ")" for p in rules.STOCK_PHRASES)
    out.append((f"list_contains({_list(_WORDS)}, symbol) AND {_has(rules.ORDINARY_PATTERN)} AND NOT ({phrases})", entry("no", "false_positive", "unclear", "low", "strong", "0.9", [_q("ambiguous_ticker_false_positive")], rules.ORDINARY_PATTERN)))
    for pattern, kind, way, conviction, flag, base in rules.SIGNALS:
        own, sure, flags = flag.startswith(("first_person", "creator_")), f"{base} - CASE WHEN named THEN 0 ELSE 0.18 END", [unnamed, _q(flag)]
        if not own:
            sure, flags = f"{sure} - CASE WHEN {third} THEN 0.25 ELSE 0 END", [*flags, f"CASE WHEN {third} THEN 'possible_third_party_attribution' END"]
        if flag not in ("creator_bought", "creator_owns_position"):
            sure, flags = f"{sure} - CASE WHEN {past} THEN 0.12 ELSE 0 END", [*flags, f"CASE WHEN {past} THEN 'possible_historical_context' END"]
        if flag == "price_target_language":
            way = "CASE stance WHEN 'bullish' THEN 'positive' WHEN 'bearish' THEN 'negative' ELSE 'neutral' END"
        out.append((_has(pattern), entry("yes", kind, way, conviction, "strong" if own else "medium", f"greatest(0.6, {sure})", flags, pattern)))
    for pattern, kind, way, sure, evidence, flag in rules.OTHERWISE:
        out.append((_has(pattern), entry("no", kind, way, "low", evidence, str(sure), [unnamed, _q(flag)], pattern)))
    out.append(("named AND length(t) >= 25", unclear("no_clear_rule_match", unnamed)))
    return _case(*out, otherwise=unclear("insufficient_target_context", unnamed))


_LABELLED = f"{_R}, l0 AS (SELECT *, list_contains(tk, lower(symbol)) AS named, {_has(rules.THIRD_PARTY_PATTERN)} AS third, {_has(rules.HISTORICAL_PATTERN)} AS past FROM rec), l1 AS (SELECT *, {_label_sql()} AS d FROM l0)"


def _labels(spark, sf):
    return rules.labelled(_recommended(spark, sf), F.col("symbol"), F.col("stance"), ambiguous=_WORDS)


@query(f"WITH {POSTS}, {_LABELLED} SELECT event_id, d.is_true AS is_true, d.type AS type, d.direction AS direction, d.conviction AS conviction, d.evidence AS evidence, d.confidence AS confidence, d.needs_review AS needs_review, d.flags AS flags, d.quote AS quote FROM l1")
def rule_labels(spark, sf):
    """Words that are no tickers, ordered signals, then what is no recommendation; with the text around what decided."""
    return _labels(spark, sf).select("event_id", "d.*")


@query(f"""WITH {POSTS}, {_LABELLED}, c AS (SELECT event_id, creator, symbol, published, d.is_true AS y, d.direction AS w, d.confidence AS c, d.evidence AS e, d.needs_review AS review, d.type AS kind, d.quote AS quote FROM l1)
SELECT event_id, creator, symbol AS ticker, strftime(published, '%Y-%m-%d') AS event_date, kind, w AS direction, printf('%.3f', c) AS confidence, e AS evidence, quote, concat_ws(';', CASE WHEN y <> 'yes' THEN 'is_true_recommendation=' || y END, CASE WHEN w NOT IN ('positive', 'negative', 'neutral') THEN 'direction=' || w END, CASE WHEN c < 0.75 THEN 'confidence_below_0.75' END, CASE WHEN e NOT IN ('strong', 'medium') THEN 'evidence_quality=' || e END, CASE WHEN review THEN 'needs_review' END) AS reasons FROM c""")
def clean_projection(spark, sf):
    """Labelled events in the clean table's columns, with every reason that keeps one out of it."""
    d = _labels(spark, sf)
    reasons = rules.clean_reasons(*(F.col(f"d.{c}") for c in ("is_true", "direction", "confidence", "evidence", "needs_review")))
    return d.select("event_id", "creator", F.col("symbol").alias("ticker"), F.date_format("published", "yyyy-MM-dd").alias("event_date"), F.col("d.type").alias("kind"), "d.direction", F.format_string("%.3f", "d.confidence").alias("confidence"), "d.evidence", "d.quote", reasons.alias("reasons"))


@query(f"""WITH {POSTS}, {_R}, a AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'sell' WHEN 1 THEN 'avoid' WHEN 2 THEN 'portfolio' WHEN 3 THEN 'short' ELSE 'buy' END AS action FROM rec) SELECT event_id, CASE stance WHEN 'bullish' THEN 'positive' WHEN 'bearish' THEN 'negative' ELSE 'neutral' END AS direction, CASE WHEN action IN ('sell', 'short') THEN 'sell' WHEN action = 'avoid' THEN 'avoid' WHEN contains(t, 'target') THEN 'price_target' WHEN action = 'portfolio' OR contains(t, 'holding') THEN 'portfolio_update' ELSE 'buy' END AS kind,
CASE WHEN contains(stance, 'bear') OR contains(stance, 'sell') THEN 'sell' ELSE 'buy' END AS side, CASE WHEN score >= 3 AND confidence >= 0.7 THEN 'strong' WHEN score >= 2 THEN 'medium' ELSE 'weak' END AS evidence, event_id % 4 < 3 AND length(text) > 50 AS included, sha256(t) AS text_hash, substr(sha256(CAST(event_id AS VARCHAR) || '|' || symbol), 1, 16) AS row_key FROM a""")
def stance_mapping(spark, sf):
    """Stance and action as a recommendation; whether a transcript counts (status and more than 50 characters); hashes of
    the normal text and of the row's key."""
    k, has = F.col("event_id"), lambda x: F.contains("stance", F.lit(x))
    action = F.element_at(F.array(*map(F.lit, ["sell", "avoid", "portfolio", "short", "buy"])), (1 + k % 5).cast("int"))
    r = _recommended(spark, sf).withColumn("action", action).withColumn("id", k.cast("string"))
    direction = F.when(F.col("stance") == "bullish", "positive").when(F.col("stance") == "bearish", "negative").otherwise("neutral")
    evidence = F.when((F.col("score") >= 3) & (F.col("confidence") >= 0.7), "strong").when(F.col("score") >= 2, "medium").otherwise("weak")
    return r.select("event_id", direction.alias("direction"), rules.recommendation_kind(F.col("action"), F.col("t")).alias("kind"), F.when(has("bear") | has("sell"), "sell").otherwise("buy").alias("side"), evidence.alias("evidence"), ((k % 4 < 3) & (F.length("text") > 50)).alias("included"), F.sha2("t", 256).alias("text_hash"), short_key("id", "symbol", size=16).alias("row_key"))


@query("""WITH p AS (SELECT event_id, user_id, ts, props, CASE event_id % 3 WHEN 0 THEN '[{"id": ' || event_id || ', "likes": 3}]' WHEN 1 THEN '{"items": [{"id": ' || event_id || ', "likes": null}, {"id": -1, "likes": 2}]}' ELSE '{"data": {"x": 1}}' END AS payload FROM events), a AS (SELECT event_id, ts, user_id, CASE WHEN payload LIKE '[%' THEN json_extract(payload, '$[*]') WHEN json_extract(payload, '$.items') IS NOT NULL THEN json_extract(payload, '$.items[*]') ELSE [] END AS items FROM p)
SELECT event_id, CAST(user_id AS VARCHAR) AS author, strftime(ts, '%Y-%m-%d') AS day, CAST(json_extract_string(item, '$.id') AS BIGINT) AS post_id, coalesce(CAST(json_extract_string(item, '$.likes') AS BIGINT), 0) AS likes FROM (SELECT *, unnest(items) AS item FROM a)""")
def post_normalizer(spark, sf):
    """Posts of provider payloads, which are a list, or an object that has one under a known name, or neither."""
    k = F.col("event_id")
    number = k.cast("string")
    payload = F.when(k % 3 == 0, F.concat(F.lit('[{"id": '), number, F.lit(', "likes": 3}]'))).when(k % 3 == 1, F.concat(F.lit('{"items": [{"id": '), number, F.lit(', "likes": null}, {"id": -1, "likes": 2}]}'))).otherwise(F.lit('{"data": {"x": 1}}'))
    e = table(spark, sf, "events").withColumn("item", F.explode(text.payload_items(payload, "id long, likes long", ["items", "data"])))
    return e.select("event_id", F.col("user_id").cast("string").alias("author"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("item.id").alias("post_id"), F.coalesce("item.likes", F.lit(0)).alias("likes"))


def _at(field: str) -> str:
    """A field's first path with a plain value, as text."""
    one = lambda p: f"CASE WHEN json_type(v, '$.{p}') NOT IN ('OBJECT', 'ARRAY') THEN nullif(trim(json_extract_string(v, '$.{p}')), '') END"
    return f"coalesce({', '.join(map(one, payloads.PATHS[field]))})"


@query(f"""WITH c AS (SELECT *, conv_id * 1000 + turn + 1 AS n, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS made FROM conversations),
p AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN CAST(json_array(json_object('id', n, 'text', text, 'created_at', made, 'user', json_object('username', role, 'name', ' '), 'lang', 'fr', 'likes', turn)) AS VARCHAR)
  WHEN 1 THEN CAST(json_object('items', json_array(json_object('tweet', json_object('id', CAST(n AS VARCHAR), 'full_text', text, 'created_at', made, 'author', json_object('userName', '@' || role, 'id', 7)), 'favorite_count', '7', 'url', json_object('x', 1)), json_object('type', 'mock_tweet', 'id', -1), json_object('id', 0, 'text', 'x', 'created_at', made))) AS VARCHAR)
  WHEN 2 THEN CAST(json_object('data', json_array(json_object('tweetId', n, 'body', text, 'date', made, 'handle', role, 'language', 'de', 'likes', json_object('n', 1)), json_object('tweetId', json_array(1), 'body', text, 'date', made))) AS VARCHAR)
  WHEN 3 THEN '{{"items": [' ELSE CAST(json_object('id', n, 'content', text, 'time', CASE WHEN turn % 2 = 0 THEN made ELSE 'soon' END, 'likes', 'many') AS VARCHAR) END AS payload FROM c),
j AS (SELECT conv_id, turn, TRY_CAST(payload AS JSON) AS j FROM p WHERE json_valid(payload)), i AS (SELECT conv_id, turn, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') {' '.join(f"WHEN json_type(j, '$.{n}') = 'ARRAY' THEN json_extract(j, '$.{n}[*]')" for n in payloads.LISTS)} ELSE [j] END) AS v FROM j),
f AS (SELECT conv_id, turn, TRY_CAST({_at('post_id')} AS BIGINT) AS post_id, {_at('text')} AS text, TRY_CAST({_at('created_at')} AS TIMESTAMPTZ) AS created_at, ltrim({_at('handle')}, '@') AS handle, {', '.join(f'{_at(n)} AS {n}' for n in ('name', 'author_id', 'language', 'url'))}, TRY_CAST({_at('likes')} AS BIGINT) AS likes FROM i WHERE coalesce(json_extract_string(v, '$.type'), '') <> 'mock_tweet')
SELECT conv_id, turn, post_id, sha256(text) AS text_sha256, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created_at, handle, name, author_id, language, url, likes FROM f WHERE post_id > 0 AND text IS NOT NULL AND created_at IS NOT NULL""")
def payload_posts(spark, sf):
    """The turns of conversations as providers' payloads of five shapes, and the posts read back from them."""
    c = table(spark, sf, "conversations").withColumns({"n": F.col("conv_id") * 1000 + F.col("turn") + 1, "at": F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours="conv_id"), "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    post = lambda **f: F.struct(*[(v if not isinstance(v, (str, int)) else F.lit(v)).alias(k) for k, v in f.items()])
    n, said, at, role = (F.col(x) for x in ("n", "text", "at", "role"))
    text_of = lambda *ps: F.concat_ws(", ", *[F.to_json(p) for p in ps])
    shapes = [
        F.concat(F.lit("["), text_of(post(id=n, text=said, created_at=at, user=post(username=role, name=" "), lang="fr", likes=F.col("turn"))), F.lit("]")),
        F.concat(F.lit('{"items": ['), text_of(post(tweet=post(id=n.cast("string"), full_text=said, created_at=at, author=post(userName=F.concat(F.lit("@"), role), id=7)), favorite_count="7", url=post(x=1)), post(type="mock_tweet", id=-1), post(id=0, text="x", created_at=at)), F.lit("]}")),
        F.concat(F.lit('{"data": ['), text_of(post(tweetId=n, body=said, date=at, handle=role, language="de", likes=post(n=1)), post(tweetId=F.array(F.lit(1)), body=said, date=at)), F.lit("]}")),
        F.lit('{"items": ['),
        text_of(post(id=n, content=said, time=F.when(F.col("turn") % 2 == 0, at).otherwise("soon"), likes="many")),
    ]
    payload = F.element_at(F.array(*shapes), (F.col("conv_id") % 5 + 1).cast("int"))
    out = payloads.posts_of(c.select("conv_id", "turn", payload.alias("payload")), ["conv_id", "turn"], "payload")
    return out.withColumns({"text_sha256": F.sha2("text", 256), "created_at": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")}).drop("text")


@query(f"""WITH {POSTS}, d AS (SELECT symbol, CAST(published AS DATE) AS day, event_id, creator FROM posts), w AS (SELECT a.event_id, date_diff('day', a.day, b.day) AS gap FROM d a JOIN d b ON a.symbol = b.symbol AND a.event_id <> b.event_id AND abs(date_diff('day', a.day, b.day)) <= 7), c AS (SELECT event_id, count(*) FILTER (gap BETWEEN -7 AND -2) AS before_7d, count(*) FILTER (gap = -1) AS before_1d, count(*) FILTER (gap = 0) AS same_day, count(*) FILTER (gap = 1) AS after_1d, count(*) FILTER (gap BETWEEN 2 AND 7) AS after_7d FROM w GROUP BY 1)
SELECT event_id, before_7d, before_1d, same_day, after_1d, after_7d, CASE WHEN before_7d + before_1d > same_day + after_1d + after_7d THEN 'leads_elsewhere' WHEN after_1d + after_7d > 0 THEN 'followed' ELSE 'isolated' END AS category FROM c""")
def attention_windows(spark, sf):
    """Other posts on the ticker in five windows of days around each, from running daily counts: no pair is made."""
    p = posts(spark, sf).select("symbol", F.to_date("published").alias("day"), "event_id")
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    daily = p.groupBy("symbol", "day").agg(F.count("*").alias("n")).withColumn("d", number)
    w = Window.partitionBy("symbol").orderBy("d")
    between = lambda a, b: F.coalesce(F.sum("n").over(w.rangeBetween(a, b)), F.lit(0))
    c = daily.select("symbol", "day", between(-7, -2).alias("before_7d"), between(-1, -1).alias("before_1d"), (F.col("n") - 1).alias("same_day"), between(1, 1).alias("after_1d"), between(2, 7).alias("after_7d"))
    out = p.join(c, ["symbol", "day"]).where("before_7d + before_1d + same_day + after_1d + after_7d > 0")
    category = F.when(F.expr("before_7d + before_1d > same_day + after_1d + after_7d"), "leads_elsewhere").when(F.expr("after_1d + after_7d > 0"), "followed").otherwise("isolated")
    return out.select("event_id", "before_7d", "before_1d", "same_day", "after_1d", "after_7d", category.alias("category"))
