"""Rule sets over texts and figures, as Spark columns: recommendations, posts, exclusions, grades, scores, taxonomies.

Rules read a frame that prepared() has given `t`, the text in lower case with single spaces, and `tk`, its words of letters
and digits. Words are looked up in `tk`, which is split once; phrases are looked for in `t`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.text import normal

# The keyword sets of the recommendation classifier.
BULLISH = ["buy", "buying", "bought", "adding", "added", "long", "bullish", "undervalued", "cheap", "upside", "multibagger", "10x", "load up", "own it", "accumulation", "watchlist", "breakout", "calls", "price target", "pt"]
BEARISH = ["short", "puts", "sell", "selling", "avoid", "overvalued", "downside", "bubble", "fraud", "collapse", "bearish"]
RETROSPECTIVE = ["called it", "told you", "was right", "up since", "my pick", "from my last video", "i sent a course member signal", "i sent a signal", "we've been bullish since", "we have been bullish since", "since my last", "up 121% on the stock", "turned into multi", "turned into millions"]
STRONG_RETROSPECTIVE = ["i sent a course member signal", "we have been bullish since", "we've been bullish since", "turned into multi-millions", "turned into millions of"]
THIRD_PARTY = ["analysts are saying", "analysts said", "analysts expect", "analysts predict", "investors have suggested", "mutual funds", "according to the", "the information is reporting", "they reported", "they are reporting", "tom lee said", "tom lee just said", "dan ives said", "michael burry", "according to", "a report from"]
AMBIGUOUS = ["not even talking about that", "not even talking about", "if you had bought", "if you would have bought", "would have been", "if you had", "had you bought"]
DISCLOSURE = ["i own", "my position", "holding", "portfolio", "not financial advice", "sponsored", "affiliate"]
RISK = ["risk", "downside", "debt", "balance sheet"]
VALUATION = ["valuation", "dcf", "revenue", "earnings", "eps", "margin", "cash flow", "catalyst"]
NEWS_ONLY = ["reports", "reported", "announces", "announced", "breaking", "according to", "files", "sec filing", "earnings released"]
TARGET = ["target", "price target", "pt", "catalyst"]
HYPE = ["10x", "load up", "generational opportunity", "multibagger"]
SOFT = ["watchlist", "undervalued", "overvalued", "breakout", "cheap", "upside"]
EXPLICIT_BULLISH = ["buy", "buying", "bought", "adding", "added", "long", "own it", "calls"]
EXPLICIT_BEARISH = ["short", "puts", "sell", "selling", "avoid"]
HORIZONS = [("short_term", ["today", "tomorrow", "this week", "short term", "swing"]), ("medium_term", ["this year", "2025", "12 month", "medium term"]), ("long_term", ["long term", "multi-year", "5 year", "decade"])]
EXPLICIT_ACTION = "(^|[^a-z0-9])(buy|buying|bought|adding|added|long|own it|calls|sell|selling|short|avoid|puts|price target|pt|target)($|[^a-z0-9])"
NEGATED_ACTION = "(^|[^a-z0-9])(not (want(ing)? to |going to )?(buy|own|add|long)|(do not|don't|cannot|can't|won't) (want to )?(buy|own|add|go long))($|[^a-z0-9])"

# The keyword groups of the narrative scores.
NARRATIVE = {
    "analyst_relay": ["analyst", "wall street", "upgrade", "downgrade", "price target", "consensus", "outperform", "underperform", "initiated coverage"],
    "earnings_relay": ["earnings", "eps", "guidance", "quarter", "call", "revenue beat", "revenue miss"],
    "news_relay": ["report", "announcement", "lawsuit", "partnership", "fda", "merger", "acquisition", "headline"],
    "market_move": ["stock is up", "stock is down", "rallied", "sold off", "dropped", "breakout", "all-time high", "52-week"],
    "retail_hype": ["moon", "explode", "10x", "millionaire", "next tesla", "squeeze", "to the moon", "100x"],
    "urgency": ["buy now", "before it is too late", "don't miss", "dont miss", "act fast", "last chance"],
    "valuation": ["dcf", "cash flow", "multiple", "margin", "fair value", "valuation", "pe ratio", "free cash flow"],
    "technical": ["chart", "breakout", "support", "resistance", "rsi", "moving average", "macd"],
    "risk": ["risk", "downside", "overvalued", "uncertainty", "volatile", "could lose"],
    "disclosure": ["i own", "my position", "sponsor", "affiliate", "paid", "disclosure"],
}
NEWS_TOPICS = {
    "earnings": ["earnings", "revenue", "eps", "quarter"],
    "analyst": ["analyst", "upgrade", "downgrade", "price target"],
    "product": ["launch", "product", "chip", "ai", "ev", "iphone"],
    "legal": ["sec", "lawsuit", "probe", "investigation", "regulator", "ftc"],
    "macro": ["fed", "inflation", "rates", "nasdaq"],
}
MATERIAL = ["earnings", "eps", "revenue", "guidance", "forecast", "8-k", "10-q", "10-k", "6-k", "20-f", "merger", "acquisition", "lawsuit", "settlement", "investigation", "regulator", "sec", "fda", "product", "launch", "recall", "contract", "partnership"]
COMPANY_STOP = ["inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "holdings", "class", "common", "stock"]

# Analyst grades by stance.
GRADES = {
    "bullish": ["strong buy", "long term buy", "market outperform", "sector outperform", "outperform", "overweight", "accumulate", "positive", "add", "buy"],
    "neutral": ["market perform", "sector perform", "equal weight", "in line", "peer perform", "perform", "mixed", "neutral", "hold"],
    "bearish": ["strong sell", "weak hold", "underperform", "underweight", "reduce", "negative", "sell"],
}
GRADE_UNCLEAR = ["not rated", "no rating", "rating suspended", "suspended", "coverage suspended", "initiated", "initiate", "init", "main", "maintain", "maintained", "reiterate", "reiterated", "reit", "upgrade", "up", "downgrade", "down", "raises", "raised", "lowers", "lowered"]


def prepared(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("t", normal(text)).withColumn("tk", F.split("t", "[^a-z0-9]+"))


def _phrase(words: list[str]) -> str:
    quoted = "|".join("".join(x if x.isalnum() or x in " '" else f"\\{x}" for x in w) for w in words)
    return f"(^|[^a-z0-9])({quoted})($|[^a-z0-9])"


def split_words(words: list[str]) -> tuple[list[str], list[str]]:
    """Single words, and what is looked for as a phrase."""
    return [w for w in words if w.isalnum()], [w for w in words if not w.isalnum()]


def any_of(words: list[str]) -> Column:
    """Whether one of the words or phrases stands in the text with no letter or digit beside it."""
    single, phrases = split_words(words)
    parts = ([F.arrays_overlap("tk", F.array(*map(F.lit, single)))] if single else []) + ([F.col("t").rlike(_phrase(phrases))] if phrases else [])
    return parts[0] | parts[1] if len(parts) > 1 else parts[0]


def count_of(words: list[str]) -> Column:
    """How many of them stand there."""
    single, phrases = split_words(words)
    out = F.size(F.array_intersect("tk", F.array(*map(F.lit, single)))) if single else F.lit(0)
    for p in phrases:
        out = out + F.col("t").rlike(_phrase([p])).cast("int")
    return out


def contained(words: list[str], c: str = "t") -> Column:
    """How many of them are contained in the text, parts of words too."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(F.col(c), F.lit(w)).cast("int")
    return out


def first(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise)
    for condition, label in reversed(rules):
        out = F.when(condition, label).otherwise(out)
    return out


def horizon() -> Column:
    return first(*[(contained(words) > 0, name) for name, words in HORIZONS], otherwise="unspecified")


def recommendation(df: DataFrame) -> DataFrame:
    """df, prepared, with label, stance, score (0 to 5), horizon, the flags, confidence, and whether it is a candidate."""
    flags = {"retrospective": RETROSPECTIVE, "disclosure": DISCLOSURE, "risk": RISK, "valuation": VALUATION, "third_party": THIRD_PARTY, "ambiguous": AMBIGUOUS}
    df = df.withColumns({"n_up": count_of(BULLISH), "n_down": count_of(BEARISH)} | {n: any_of(w) for n, w in flags.items()})
    stance = F.when(F.col("n_up") > F.col("n_down"), "bullish").when(F.col("n_down") > F.col("n_up"), "bearish").otherwise("neutral")
    df = df.withColumn("stance", stance)
    taken = F.col("stance") != "neutral"
    explicit = F.when(F.col("stance") == "bullish", any_of(EXPLICIT_BULLISH)).otherwise(any_of(EXPLICIT_BEARISH))
    tiers = F.when(any_of(HYPE), 5).when(any_of(TARGET), 4).when(explicit, 3).when(any_of(SOFT), 2).otherwise(1)
    df = df.withColumns({"score": F.when(taken, tiers).otherwise(0), "news_only": any_of(NEWS_ONLY) & ~taken})
    label = first(
        (F.col("third_party") & taken, "third_party_attribution"),
        (F.col("ambiguous") & taken, "ambiguous_reference"),
        (any_of(STRONG_RETROSPECTIVE) | (F.col("retrospective") & (F.col("score") < 3)), "retrospective_claim"),
        (F.col("disclosure") & ~taken, "portfolio_disclosure"),
        (F.col("news_only"), "news_only"),
        (~taken & any_of(HYPE), "non_actionable_hype"),
        (F.col("stance") == "bullish", "bullish_recommendation"),
        (F.col("stance") == "bearish", "bearish_recommendation"),
        otherwise="neutral_mention",
    )
    df = df.withColumn("label", label)
    bonus = F.when(taken, F.least(F.lit(0.35), 0.12 * (F.col("n_up") + F.col("n_down")))).otherwise(0.0)
    confidence = 0.35 + bonus + F.when(F.col("score") >= 3, 0.15).otherwise(0.0) + F.when(F.col("risk") | F.col("valuation"), 0.05).otherwise(0.0)
    confidence = confidence + F.when(F.col("retrospective") & (F.col("label") == "retrospective_claim"), 0.1).otherwise(0.0)
    candidate = taken & (F.col("score") >= 2) & ~F.col("label").isin("retrospective_claim", "news_only")
    return df.withColumns({"horizon": horizon(), "confidence": F.round(F.least(F.lit(0.95), confidence), 3), "candidate": candidate})


def exclusion(df: DataFrame, named: Column) -> DataFrame:
    """What recommendation() gave with accepted, reason (null if accepted) and confidence_label. named: whether the clause
    names the ticker."""
    negated = F.col("t").rlike(NEGATED_ACTION)
    accepted = F.col("candidate") & named & ~negated & ~F.col("label").isin("third_party_attribution", "ambiguous_reference")
    same = ["third_party_attribution", "ambiguous_reference", "news_only", "retrospective_claim"]
    reason = first((~named, "cross_attributed_action"), (negated, "negated_action"), *[(F.col("label") == x, x) for x in same], (F.col("label") == "portfolio_disclosure", "disclosure_only"), (F.col("label") == "non_actionable_hype", "non_actionable_hype"), otherwise="no_actionable_recommendation")
    excluded = F.col("label").isin(*same, "portfolio_disclosure", "non_actionable_hype")
    sure = F.when(~accepted, F.when(excluded, "exclude").otherwise("low")).when((F.col("score") >= 3) & F.col("t").rlike(EXPLICIT_ACTION), "high").otherwise("medium")
    return df.withColumns({"negated": negated, "accepted": accepted, "reason": F.when(~accepted, reason), "confidence_label": sure})


#: The ordered rules of the post classifier: pattern, label, direction, confidence, actionable.
POST_RULES = [
    (r"^rt @|giveaway|airdrop", "false_positive", "unclear", 0.2, False),
    (r"\b(i|we) (own|have)\b|my position", "portfolio_disclosure", "neutral", 0.7, False),
    (r"\b(watching|watchlist|on watch|keeping an eye)\b", "watchlist", "neutral", 0.65, False),
    ("news", "news_or_earnings_discussion", "neutral", 0.65, False),
    (r"\b(selling|sold|sell|trimmed|exit|exiting|avoid|shorting|short)\b", "explicit_sell_or_avoid", "bearish", 0.85, True),
    (r"\b(buying|bought|buy|adding|added|accumulating|long)\b", "explicit_buy", "bullish", 0.85, True),
    (r"\b(hold|holding)\b", "hold", "neutral", 0.7, True),
    (r"\b(price target|pt)\b|\btarget ?[:=]? ?\$?\d", "price_target", None, 0.75, True),
    (r"\b(meme|lol|moon|squeeze)\b", "meme_or_noise", None, 0.5, False),
    (r"\b(bullish|bearish|breakout|ripping|dumping)\b", "sentiment_only", None, 0.5, False),
]
POST_NEWS, POST_ACTION = r"\b(earnings|guidance|revenue|eps|reported|announces|news)\b", r"\b(buy|buying|sell|selling|short|long|adding|avoid|price target|pt)\b"
POST_MOOD = r"\b(bullish|bearish|moon|squeeze|breakout|ripping|dumping)\b"


def post_class(df: DataFrame) -> DataFrame:
    """df, prepared, with a struct `c` of label, direction, confidence and actionable: the first rule that holds."""
    t = F.col("t")
    raised = F.when(t.rlike(r"\b(upside|raise|higher|bullish)\b"), "bullish").otherwise("neutral")
    mood = F.when(F.contains(t, F.lit("bearish")) | F.contains(t, F.lit("dumping")), "bearish").otherwise("bullish")
    directions = {"price_target": raised, "meme_or_noise": mood, "sentiment_only": mood}
    entry = lambda label, way, sure, act: F.struct(F.lit(label).alias("label"), (directions[label] if way is None else F.lit(way)).alias("direction"), F.lit(sure).alias("confidence"), F.lit(act).alias("actionable"))
    out = entry("unclear", "unclear", 0.3, False)
    for pattern, label, way, sure, act in reversed(POST_RULES):
        holds = t.rlike(POST_NEWS) & ~t.rlike(POST_ACTION) if pattern == "news" else t.rlike(pattern)
        if label == "meme_or_noise":
            holds = holds & t.rlike(POST_MOOD)
        out = F.when(holds, entry(label, way, sure, act)).otherwise(out)
    return df.withColumn("c", out)


def _grade_text(c: Column) -> Column:
    raw = F.lower(F.trim(c))
    text = F.when(raw.isin("", "nan", "none", "null", "na", "n/a"), "").otherwise(F.trim(F.regexp_replace(F.regexp_replace(F.translate(raw, "_-/", "   "), "[^a-z0-9+ ]+", " "), " +", " ")))
    return F.coalesce(text, F.lit(""))


def graded(df: DataFrame, column: str) -> DataFrame:
    """df with an analyst's grade as a stance, how sure that is, and by which rule. Each different grade is judged once, however
    many rows have it; its words are looked for by one pattern a stance."""
    text = F.col("_text")
    found = lambda *p: text.rlike(f"(^|[^a-z0-9])({'|'.join(p)})($|[^a-z0-9])")
    other_perform = ["outperform", "underperform", "market perform", "sector perform", "peer perform"]
    ordered = sorted(((p, stance) for stance, phrases in GRADES.items() for p in phrases), key=lambda x: -len(x[0]))

    def voted(stance: str) -> Column:
        out = found(*[p for p in GRADES[stance] if p not in ("hold", "perform")])
        if "hold" in GRADES[stance]:
            out = out | found("hold") & ~found("weak hold")
        if "perform" in GRADES[stance]:
            out = out | found("perform") & ~found(*other_perform)
        return out

    texts = df.select(F.col(column).alias("_grade")).distinct().withColumn("_text", _grade_text(F.col("_grade")))
    towards = first(*[(text.rlike(f"\\bto {p}\\b"), stance) for p, stance in ordered])
    judged = texts.withColumns({
        "_exact": first(*[(text.isin(*phrases), stance) for stance, phrases in GRADES.items()]),
        "_towards": F.when(text.rlike("\\bto "), towards),
        **{f"_{s}": voted(s) for s in GRADES},
    })
    votes = {s: F.col(f"_{s}") for s in GRADES}
    judged = judged.withColumn("_n", sum((v.cast("int") for v in votes.values()), F.lit(0))).withColumn("_phrase", F.when(F.col("_n") == 1, first(*[(v, s) for s, v in votes.items()])))
    exact, towards, phrase, n, unclear = F.col("_exact"), F.col("_towards"), F.col("_phrase"), F.col("_n"), (text == "") | text.isin(*GRADE_UNCLEAR)
    judged = judged.select(
        "_grade",
        F.when(unclear, "unknown").otherwise(F.coalesce(exact, towards, phrase, F.lit("unknown"))).alias("stance"),
        F.when(unclear, "unknown").when(exact.isNotNull(), "high").when(towards.isNotNull() | phrase.isNotNull(), "medium").otherwise("unknown").alias("sure"),
        F.when(text == "", "missing").when(text.isin(*GRADE_UNCLEAR), "ambiguous").when(exact.isNotNull(), "exact").when(towards.isNotNull(), "to_grade").when(n == 1, "phrase").when(n > 1, "conflicting").otherwise("unmapped").alias("rule"),
    )
    return df.join(judged, F.col(column).eqNullSafe(F.col("_grade"))).drop("_grade")


def stance_of_counts(buy: Column, sell: Column, hold: Column) -> Column:
    return first((buy + sell + hold == 0, "unknown"), ((buy >= F.greatest(sell, hold)) & (buy >= 2 * sell), "bullish"), ((sell >= F.greatest(buy, hold)) & (sell >= 2 * buy), "bearish"), otherwise="neutral")


def stance_of_rating(score: Column, upside: Column) -> Column:
    return first((upside >= 0.05, "bullish"), (upside <= -0.05, "bearish"), (score >= 4, "bullish"), (score <= 2, "bearish"), otherwise="neutral")


def creator_relevance(items: Column, mentions: Column, actionable: Column, engagement: Column, diversity: Column, platform_points: Column) -> Column:
    rate = lambda x: F.coalesce(F.try_divide(x, items), F.lit(0.0))
    one = F.lit(1.0)
    points = F.least(items / 50, one) * 15 + F.least(rate(mentions) / 2, one) * 25 + F.least(rate(actionable), one) * 25
    return F.round(points + F.least(F.log10(engagement + 1) / 6, one) * 15 + F.least(diversity / 12, one) * 10 + platform_points, 3)


#: By creator category, how original it is and how often its posts are actionable.
ORIGINALITY = {"stock_picker": 1.0, "meme_retail": 0.65, "analytical_control": 0.6, "macro_commentary": 0.35, "news_attention": 0.1}
ACTIONABLE = {"stock_picker": 0.4, "meme_retail": 0.28, "analytical_control": 0.16, "macro_commentary": 0.08, "news_attention": 0.04}


def creator_selection(category: Column, count: Column, mention_density: Column, actionable_density: Column, reads: Column, least: int = 25, least_actionable: float = 8.0) -> tuple[Column, Column, Column]:
    """Selection score, action, and the estimated number of actionable posts."""
    of = lambda table, other: first_number(category, table, other)
    estimated = F.greatest(actionable_density * count, count * of(ACTIONABLE, 0.1))
    density = F.when(actionable_density > 0, actionable_density).otherwise(F.coalesce(F.try_divide(estimated, count), F.lit(0.0)))
    efficiency = F.coalesce(F.try_divide(estimated, reads) * 1000, F.lit(0.0))
    one = F.lit(1.0)
    score = F.least(count / least, F.lit(2.0)) * 18 + F.least(mention_density, one) * 15 + F.least(density, F.lit(0.6)) / 0.6 * 22 + of(ORIGINALITY, 0.35) * 18 + F.least(efficiency / 80, one) * 12
    score = F.round(score, 3)
    action = first(
        (category == "news_attention", "exclude_too_news_heavy"),
        (category == "analytical_control", "include_control"),
        ((category == "macro_commentary") & (count >= least), "include_control"),
        (category == "macro_commentary", "needs_manual_review"),
        (count < least, "exclude_too_low_signal"),
        (estimated < least_actionable, "needs_manual_review"),
        (category.isin("stock_picker", "meme_retail"), "include_primary"),
        otherwise="needs_manual_review",
    )
    return F.when(category == "news_attention", F.least(score, F.lit(49.0))).otherwise(score), action, estimated


def first_number(c: Column, table: dict[str, float], otherwise: float) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def originality(f: dict[str, Column]) -> Column:
    """Where a recommendation's information comes from; f has the scores and flags by name."""
    return first(
        (f["unknown"] & ~f["historical"], "insufficient_external_data"),
        (f["sec"] | f["confounded"] | (f["earnings_relay"] >= 2) | (f["news_relay"] >= 2), "official_news_relay"),
        (f["analyst_relay"] >= 2, "analyst_relay"),
        ((f["market_move"] >= 2) & ~f["quiet"], "market_reaction_relay"),
        ((f["retail_hype"] >= 2) | (f["urgency"] >= 2), "retail_hype_attention"),
        (f["valuation"] >= 2, "valuation_or_fundamental_original_like"),
        (f["contrarian"] & f["historical"], "contrarian_original_like"),
        otherwise="ambiguous_mixed",
    )


def skill(n: Column, top_share: Column, b21: Column, b63: Column, prior21: Column, clean_share: Column) -> Column:
    b21, b63, prior21 = (F.coalesce(x, F.lit(0.0)) for x in (b21, b63, prior21))
    return first(
        (n < 5, "insufficient_sample"),
        ((b63 < -0.03) & (1 - top_share > 0.4), "antiskilled_like"),
        ((b21 > 0.02) & (top_share > 0.6) & (prior21 > 0.02), "momentum_rider"),
        ((b21 > 0.02) & (top_share < 0.5) & (clean_share > 0.05), "skilled_like"),
        (F.abs(b21) < 0.01, "noisy_neutral"),
        (b21 > 0, "momentum_rider"),
        otherwise="noisy_neutral",
    )


def layer_confidence(layer: Column, confidence: Column, score: Column) -> Column:
    confidence, score = F.coalesce(confidence, F.lit(0.0)), F.coalesce(score, F.lit(0))
    return first(
        (layer == "comment_context", "exclude"),
        (layer.isin("title", "description") & (confidence >= 0.7) & (score >= 3), "medium"),
        (layer.isin("title", "description"), "low"),
        (layer.isin("transcript", "manual", "x_text") & (confidence >= 0.75) & (score >= 3), "high"),
        (layer.isin("transcript", "manual", "x_text") & (score >= 2), "medium"),
        otherwise="low",
    )


def coverage_score(official: Column, external: Column, archive: Column, quiet: Column) -> Column:
    return F.when((external <= 0) & ~official, 0).when(external <= 0, 1).when(external == 1, 2).when(archive | F.coalesce(quiet, F.lit(False)), 4).otherwise(3)


def filing_flags(forms: Column, nearest: Column, material: Column, status: Column) -> dict[str, Column]:
    """Flags of the filings around an event, from the forms' names, and the reasons in order."""
    has = lambda *xs: sum((F.contains(forms, F.lit(x)).cast("int") for x in xs), F.lit(0)) > 0
    out = {"eight_k": has("8-K") | (nearest == "8-K"), "ten_qk": has("10-Q", "10-K") | nearest.isin("10-Q", "10-K"), "offering": has("S-1", "424B", "F-1"), "ownership": has("13D", "13G", "4")}
    unknown = ~F.lower(status).isin("ok", "cached")
    rules = [(out["eight_k"], "8k_window"), (out["ten_qk"], "10q_10k_window"), (out["offering"], "offering_registration_window"), (out["ownership"], "ownership_insider_window"), (material, "material_filing_flag"), (unknown, "sec_unknown")]
    out["confounded"] = out["eight_k"] | out["offering"]
    out["reasons"] = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in rules])), ";")
    return out


#: The labeller's ordered signals: words, type, direction, conviction, flag, base confidence; what tells that
#: another acted, that it is news, about the economy or the past; tickers that are words, and how words are used.
_NOW = r"(i am|i'm|im|we are|we're|i would|we would|i will|we will|i'm going to|i am going to|i'm gonna|we're going to)"
SIGNALS = [
    (rf"\b{_NOW}\s+(start\s+)?(buy|buying|add|adding|accumulate|accumulating)\b", "buy", "positive", "high", "first_person_buy", 0.93),
    (r"\b(i bought|we bought|i just bought|i've bought|we've bought)\b", "buy", "positive", "medium", "creator_bought", 0.91),
    (r"\b(i own|we own|i still own|we still own|my position|our position)\b", "portfolio_update", "positive", "medium", "creator_owns_position", 0.88),
    (r"\b(i recommend|we recommend|my top stock|our top stock|best stocks? to buy|top stocks? to buy|you may want to buy|worth buying)\b", "buy", "positive", "high", "direct_recommendation_language", 0.90),
    (r"\b(i am|i'm|im|we are|we're|i would|we would|i will|we will)\s+(sell|selling|trim|trimming|reduce|reducing)\b|\b(i sold|we sold|i trimmed|we trimmed)\b", "sell", "negative", "medium", "creator_sell_action", 0.92),
    (r"\b(i am|i'm|im|we are|we're|i would|we would)\s+(short|shorting)\b|\b(short this|would short)\b", "short", "negative", "medium", "creator_short_action", 0.92),
    (r"\b(avoid|stay away from|do not buy|don't buy)\b", "avoid", "negative", "medium", "avoid_language", 0.86),
    (r"\b(price target|my target|our target|target price)\b", "price_target", "neutral", "medium", "price_target_language", 0.84),
    (r"\b(undervalued|cheap at these levels|trading below intrinsic value)\b", "buy", "positive", "medium", "valuation_positive", 0.82),
    (r"\b(overvalued|too expensive|trading above intrinsic value)\b", "avoid", "negative", "medium", "valuation_negative", 0.82),
    (r"\b(i am|i'm|im|we are|we're|i would|we would)\s+(hold|holding)\b", "hold", "neutral", "medium", "creator_hold_action", 0.86),
]
THIRD_PARTY_PATTERN = r"(?s)\b(analysts?|wall street|warren buffett|berkshire|cathie wood|ark invest|the fed|federal reserve|vanguard|blackrock|state street|congress|senator|nancy pelosi|insiders?|shareholders?|investors?|hedge funds?|nvidia|microsoft|apple|google|alphabet|amazon|meta|tesla)\b.{0,80}\b(bought|buying|sold|selling|trimmed|added|loading up|recommend|upgraded|downgraded|raised|lowered|invested|stake|holding|holdings)\b"
NEWS_PATTERN = r"\b(reported|announced|earnings|revenue|guidance|lawsuit|investigation|merger|acquisition|partnership|clearance|approval|customer|supplier|competitor|comparable|compared to|reacts? to|in the news)\b"
MACRO_PATTERN = r"\b(inflation|interest rates?|rate cuts?|rate hikes?|recession|tariffs?|the economy|macro|s&p 500|index funds?|etfs?|benchmark|yield curve|dividend investors?|passive investors?)\b"
HISTORICAL_PATTERN = r"\b(used to|last year|last quarter|previously|historically|back in|in 20[0-9]{2}|was buying|were buying|was selling|were selling|shares are held|held by|largest shareholders?)\b"
AMBIGUOUS_TICKERS = ["ALL", "ARE", "BE", "BIG", "BY", "CAN", "CASH", "FOR", "GOOD", "LIFE", "LOVE", "LOW", "NOW", "ON", "OPEN", "OUT", "REAL", "SO", "TRUE", "UP", "VERY", "WELL", "YOU"]
ORDINARY_PATTERN = r"\b(you should|you know|you can|if you|when you|what you|how you|why you|that you|and you|for you|with you|to you|of you|do you|thank you|are you|did you|on the other hand|all of|right now|so that)\b"
STOCK_PHRASES = ["${w}", "{w} stock", "{w} shares", "{w} earnings", "buy {w}", "sell {w}", "short {w}", "long {w}"]
#: What is no recommendation: pattern, type, direction, confidence, evidence, flag.
OTHERWISE = [
    (THIRD_PARTY_PATTERN, "false_positive", "unclear", 0.89, "strong", "third_party_attribution"),
    (NEWS_PATTERN, "news_reaction", "neutral", 0.79, "medium", "news_only_or_business_context"),
    (MACRO_PATTERN, "macro_commentary", "neutral", 0.78, "medium", "macro_commentary"),
    (HISTORICAL_PATTERN, "false_positive", "unclear", 0.76, "medium", "historical_or_retrospective"),
]


def labelled(df: DataFrame, symbol: Column, detected: Column | None = None, company: Column | None = None, ambiguous: list[str] = AMBIGUOUS_TICKERS, sure_enough: float = 0.75) -> DataFrame:
    """df, prepared, with a struct `d`: is_true, type, direction, conviction, evidence, confidence, needs_review, flag, flags and
    a quote around what decided.

    Too short a text decides nothing. A ticker that is a word, used as one and never as a stock, is none. The first signal in
    order decides; of another's, of the past, or without the ticker or the company's name in the text it is less sure, 0.6 at
    least. A price target takes the direction that was detected, if any. Then come what others did, news, the economy and the
    past, which are no recommendations."""
    t, w = F.col("t"), F.lower(symbol)
    third, past = t.rlike(THIRD_PARTY_PATTERN), t.rlike(HISTORICAL_PATTERN)
    named = F.coalesce(F.array_contains("tk", w), F.lit(False))
    if company is not None:
        head = F.trim(F.split_part(F.split_part(F.lower(company), F.lit(","), F.lit(1)), F.lit(" inc"), F.lit(1)))
        named = named | F.coalesce((F.length(head) >= 4) & F.contains(t, head), F.lit(False))
    named = named | (symbol.isNull() & (company.isNull() if company is not None else F.lit(True)))
    unnamed = F.when(~named, F.lit("target_not_explicit_in_context"))

    def entry(true: str, kind: str, way: Column | str, conviction: str, evidence: str, sure: Column, flags: list[Column], pattern: str | None) -> Column:
        sure = F.round(sure, 3)
        way = F.lit(way) if isinstance(way, str) else way
        review = F.lit(True) if true == "unclear" else sure < sure_enough
        flags = F.array_compact(F.array(*flags))
        return F.struct(F.lit(true).alias("is_true"), F.lit(kind).alias("type"), way.alias("direction"), F.lit(conviction).alias("conviction"), F.lit(evidence).alias("evidence"), sure.alias("confidence"), review.alias("needs_review"), F.array_join(flags, ";").alias("flags"), quote(t, pattern).alias("quote"))

    unclear = lambda flag: entry("unclear", "unclear", "unclear", "unclear", "weak", F.lit(0.35), [unnamed, F.lit(flag)] if flag != "insufficient_context" else [F.lit(flag)], None)
    rest = F.when(named & (F.length("t") >= 25), unclear("no_clear_rule_match")).otherwise(unclear("insufficient_target_context"))
    for pattern, kind, way, sure, evidence, flag in reversed(OTHERWISE):
        rest = F.when(t.rlike(pattern), entry("no", kind, way, "low", evidence, F.lit(sure), [unnamed, F.lit(flag)], pattern)).otherwise(rest)
    for pattern, kind, way, conviction, flag, base in reversed(SIGNALS):
        own = flag.startswith(("first_person", "creator_"))
        sure, flags = F.lit(base) - F.when(named, 0.0).otherwise(0.18), [unnamed, F.lit(flag)]
        if not own:
            sure, flags = sure - F.when(third, 0.25).otherwise(0.0), [*flags, F.when(third, F.lit("possible_third_party_attribution"))]
        if flag not in ("creator_bought", "creator_owns_position"):
            sure, flags = sure - F.when(past, 0.12).otherwise(0.0), [*flags, F.when(past, F.lit("possible_historical_context"))]
        if flag == "price_target_language" and detected is not None:
            way = F.when(detected.isin("bullish", "positive"), "positive").when(detected.isin("bearish", "negative"), "negative").otherwise(way)
        rest = F.when(t.rlike(pattern), entry("yes", kind, way, conviction, "strong" if own else "medium", F.greatest(F.lit(0.6), sure), flags, pattern)).otherwise(rest)
    stock = F.lit(False)
    for phrase in STOCK_PHRASES:
        a, b = phrase.split("{w}")
        stock = stock | F.contains(t, F.concat(F.lit(a), w, F.lit(b)))
    word = symbol.isin(ambiguous) & t.rlike(ORDINARY_PATTERN) & ~stock
    rest = F.when(word, entry("no", "false_positive", "unclear", "low", "strong", F.lit(0.9), [F.lit("ambiguous_ticker_false_positive")], ORDINARY_PATTERN)).otherwise(rest)
    return df.withColumn("d", F.when(F.length("t") < 40, unclear("insufficient_context")).otherwise(rest))


def quote(c: Column, pattern: str | None, before: int = 90, after: int = 110, limit: int = 240) -> Column:
    """The text around a pattern's first match, trimmed; its beginning if there is none."""
    if pattern is None:
        return F.substring(c, 1, limit)
    at, size = F.regexp_instr(c, F.lit(pattern)), F.length(F.regexp_substr(c, F.lit(pattern)))
    start = F.greatest(F.lit(1), at - before)
    return F.substring(F.trim(F.substring(c, start, at + size + after - start)), 1, limit)


def ordinary_word(t: Column, word: Column) -> Column:
    """Whether a text uses a ticker as a plain word: none of its stock phrases, but an everyday one."""
    both = lambda *parts: F.contains(t, F.concat(*parts))
    w, none = F.lower(word), F.lit(False)
    stock = both(F.lit("$"), w)
    for x in ("nyse: ", "nasdaq: ", "buy ", "sell ", "long ", "short "):
        stock = stock | both(F.lit(x), w)
    for x in (" stock", " shares", " earnings", " revenue"):
        stock = stock | both(w, F.lit(x))
    plain = none
    for x in ("if", "when", "what", "how", "why", "that", "and", "for", "with", "to", "of", "do", "thank", "love", "are"):
        plain = plain | both(F.lit(x + " "), w)
    for x in (" should", " know", " can"):
        plain = plain | both(w, F.lit(x))
    return ~stock & plain


def clean_reasons(true: Column, direction: Column, confidence: Column, evidence: Column, review: Column, least: float = 0.75) -> Column:
    """Why a labelled event isn't clean, joined by ;. Empty if it is."""
    rules = [
        (F.when(true != "yes", F.concat(F.lit("is_true_recommendation="), true))),
        (F.when(~direction.isin("positive", "negative", "neutral"), F.concat(F.lit("direction="), direction))),
        (F.when(confidence < least, F.lit(f"confidence_below_{least:.2f}"))),
        (F.when(~evidence.isin("strong", "medium"), F.concat(F.lit("evidence_quality="), evidence))),
        (F.when(review, F.lit("needs_review"))),
    ]
    return F.array_join(F.array_compact(F.array(*rules)), ";")


def recommendation_kind(action: Column, text: Column) -> Column:
    holds = lambda c, x: F.contains(c, F.lit(x))
    return first((holds(action, "sell") | holds(action, "short"), "sell"), (holds(action, "avoid"), "avoid"), (holds(text, "target"), "price_target"), (holds(action, "portfolio") | holds(text, "holding"), "portfolio_update"), otherwise="buy")
