"""Names in texts: all places of a dictionary's phrases, found in one pass by a multi-pattern automaton.

A text is cut into tokens, runs of letters and digits or single other characters; white space between tokens doesn't count. The
automaton's states are token sequences that begin some phrase: it goes on by a token where it can, else fails over to the
longest end of what it has read that begins a phrase too, and at each state knows the phrases that end there. So a text costs
its tokens and its mentions, however many phrases there are. It runs as a table function joined laterally to the texts.
"""

from __future__ import annotations

import re
import uuid
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from almanac.functions.text import placed

#: A token: letters (Latin ones with marks too) and digits, or one other character that isn't white space.
TOKEN = "[0-9A-Za-zÀ-ɏ]+|[^ \t-\r]"
_TOKEN = re.compile(TOKEN)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Characters of phrases that go to every task; larger dictionaries are met token by token first.
MOST = 1 << 21


class Automaton:
    """Goto, failure and output links over tokens, with A-Z in lower case."""

    def __init__(self, phrases: list[tuple[str, ...]]):
        """phrases: the phrase itself and what is given with it."""
        self.goto: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, tuple]]] = [[]]
        for row in phrases:
            state, tokens = 0, _TOKEN.findall(row[0].translate(_LOWER))
            for token in tokens:
                following = self.goto[state].setdefault(token, len(self.goto))
                if following == len(self.goto):
                    self.goto.append({})
                    self.ends.append([])
                state = following
            if tokens:
                self.ends[state].append((len(tokens), row))
        self.fail, self.output = [0] * len(self.goto), [0] * len(self.goto)
        queue = deque(self.goto[0].values())
        while queue:  # states in order of their depth
            state = queue.popleft()
            back = self.fail[state]
            self.output[state] = back if self.ends[back] else self.output[back]
            for token, following in self.goto[state].items():
                self.fail[following] = self.step(back, token)
                queue.append(following)

    def step(self, state: int, token: str) -> int:
        while state and token not in self.goto[state]:
            state = self.fail[state]
        return self.goto[state].get(token, 0)

    def find(self, text: str):
        """(start, end, row) of each mention, nested and overlapping ones too, by its end."""
        state, starts = 0, []
        for m in _TOKEN.finditer(text.translate(_LOWER)):
            starts.append(m.start())
            state = self.step(state, m.group())
            at = state if self.ends[state] else self.output[state]
            while at:
                for size, row in self.ends[at]:
                    yield starts[-size], m.end(), row
                at = self.output[at]


_BUILT: dict[str, Automaton] = {}


def dictionary_mentions(docs: DataFrame, id_column: str, text: str, dictionary: DataFrame, most: int = MOST) -> DataFrame:
    """(id, at, surface, phrase, kind, code) for each place of each phrase of dictionary(phrase, kind, code) in the texts; at
    counts from 1. Phrases differ by kind and code; one that has no token is nowhere, a null text has none.

    A dictionary of at most `most` characters is broadcast and its automaton built once a worker. A larger one is met by
    equality first: each text with the phrases whose rarest token it has, from which its own automaton is built."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    phrases = dictionary.select("phrase", "kind", "code").where("phrase is not null").distinct()
    name = f"dictionary_mentions_{uuid.uuid4().hex}"
    returned = "start int, end int, phrase string, kind string, code string"
    if (phrases.agg(F.sum(F.length("phrase") + 16)).first()[0] or 0) <= most:
        held = spark.sparkContext.broadcast([tuple(r) for r in phrases.toLocalIterator()])

        class Mentions:
            def __init__(self):
                if name not in _BUILT:
                    _BUILT.clear()
                    _BUILT[name] = Automaton(held.value)

            def eval(self, text: str):
                for start, end, row in _BUILT[name].find(text or ""):
                    yield start, end, *row

        spark.udtf.register(name, udtf(Mentions, returnType=returned, useArrow=True))
        found = spark.sql(f"SELECT d.id, d.text, m.* FROM {{texts}} d, LATERAL {name}(d.text) m", texts=texts)
    else:

        class MentionsOf:
            def eval(self, text: str, some: list):
                for start, end, row in Automaton([tuple(r) for r in some]).find(text or ""):
                    yield start, end, *row

        spark.udtf.register(name, udtf(MentionsOf, returnType=returned))
        met = texts.join(candidates(texts, phrases), "id")
        found = spark.sql(f"SELECT d.id, d.text, m.* FROM {{met}} d, LATERAL {name}(d.text, d.phrases) m", met=met)
    surface = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return found.select(F.col("id").alias(id_column), (F.col("start") + 1).cast("long").alias("at"), surface.alias("surface"), "phrase", "kind", "code")


def _tokens(c: str) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(c, upper, lower), F.lit(f"({TOKEN})"), F.lit(1))


def candidates(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, phrases): for each text the phrases whose rarest token, of all texts' tokens, it has."""
    index = texts.select("id", F.explode(F.array_distinct(_tokens("text"))).alias("token"))
    counts = index.groupBy("token").agg(F.count("*").alias("n"))
    parts = phrases.select(F.struct("phrase", "kind", "code").alias("row"), F.explode(F.array_distinct(_tokens("phrase"))).alias("token"))
    known = parts.join(counts, "token", "left")
    rarest = known.groupBy("row").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.count_if(F.col("n").isNull()).alias("nowhere")).where("nowhere = 0")
    return index.join(rarest, "token").groupBy("id").agg(F.collect_list("row").alias("phrases"))


# ---------------------------------------------------------------- tickers

#: Words near a mention that make it one of a stock, capitals that are no tickers, tickers that are words.
STOCK_CONTEXT = ["stock", "stocks", "share", "shares", "equity", "buy", "buying", "bought", "sell", "selling", "avoid", "short", "long", "bullish", "bearish", "undervalued", "overvalued", "upside", "downside", "watchlist", "breakout", "calls", "puts", "target", "pt", "earnings", "revenue", "valuation", "portfolio", "position", "holding", "load", "accumulation"]
DENIED = ["CASH", "GDP", "CEO", "CFO", "IPO", "USA", "USD", "EPS", "PE", "AI", "ATH", "FOMO", "YOLO", "SEC", "ETF"]
WORDS = ["YOU", "ON", "ALL", "ARE", "CAN", "FOR", "IT", "NOW", "OUT", "SO", "USA", "LOVE", "GOOD", "BIG", "LIFE", "REAL", "OPEN"]
STRONG = ["{w} stock", "{w} shares", "{w} earnings", "{w} revenue", "{w} valuation", "long {w}", "short {w}", "buy {w}", "sell {w}", "{w} price target"]
EXCHANGE = r"(?i)(NYSE|NASDAQ|NYSEARCA|NYSEAMERICAN)\s*:\s*$"


def ticker_mentions(docs: DataFrame, id_column: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(id, at, surface, code, method, confidence, risk): tickers in texts. A $ before capitals is a mention of any ticker that
    isn't denied; symbols of the dictionary(phrase, kind: symbol or alias, code) are ones in capitals, and aliases as they
    are written, where a stock word is within 80 characters. Tickers that are everyday words need an exchange before them,
    an alias of theirs near or a phrase such as `buy on`."""
    known = dictionary.select("phrase", "kind", "code")
    found = dictionary_mentions(docs, id_column, text, known).where("surface = phrase").select(id_column, "at", "surface", "kind", "code")
    tags = placed(docs.where(F.col(text).isNotNull()), id_column, F.col(text), r"(?<![A-Za-z0-9])\$[A-Z]{1,5}(?![A-Za-z])").select(id_column, F.col("at").cast("long").alias("at"), F.col("word").alias("surface"), F.lit("cashtag").alias("kind"), F.substring("word", 2, 5).alias("code"))
    m = found.unionByName(tags).join(docs.select(id_column, F.col(text).alias("_text")), id_column)
    end = F.col("at") + F.length("surface")
    start = F.greatest(F.lit(1), F.col("at") - 80)
    around = F.substring("_text", start.cast("int"), (end + 80 - start).cast("int"))
    before = F.substring("_text", F.greatest(F.lit(1), F.col("at") - 20).cast("int"), F.least(F.lit(20), F.col("at") - 1).cast("int"))
    aliases = known.where("kind = 'alias'").groupBy("code").agg(F.collect_set(F.lower("phrase")).alias("_aliases"))
    symbols = known.where("kind = 'symbol'").select("code", F.lit(True).alias("_listed")).distinct()
    m = m.withColumns({"_around": F.lower(around), "_before": before}).join(aliases, "code", "left").join(symbols, "code", "left")
    context = F.lit(False)
    for word in STOCK_CONTEXT:
        context = context | F.contains("_around", F.lit(word))
    strong = F.lit(False)
    for phrase in STRONG:
        a, b = phrase.split("{w}")
        strong = strong | F.contains("_around", F.concat(F.lit(a), F.lower("code"), F.lit(b)))
    exchange = F.col("_before").rlike(EXCHANGE)
    named = F.coalesce(F.exists("_aliases", lambda a: F.contains(F.col("_around"), a)), F.lit(False))
    word = F.col("code").isin(WORDS) & (F.col("kind") != "alias")
    tag, listed = F.col("kind") == "cashtag", F.coalesce("_listed", F.lit(False))
    tagged = F.endswith("_before", F.lit("$"))  # a symbol behind a $ is the cashtag's
    held = F.when(tag, ~F.col("code").isin(DENIED) | listed | context).otherwise((context | exchange) & ~tagged)
    m = m.where(held & F.when(word, exchange | named | (context & strong)).otherwise(True))
    method = F.when(tag, "cashtag").when(F.col("kind") == "alias", "alias_context").when(exchange, "exchange_prefix").otherwise("plain_context")
    sure = F.when(tag, F.when(listed, 0.95).otherwise(0.85)).when(F.col("kind") == "alias", 0.75).when(exchange, 0.9).otherwise(0.7)
    return m.select(id_column, "at", "surface", "code", method.alias("method"), sure.alias("confidence"), F.when(word, "high").otherwise("low").alias("risk"))
