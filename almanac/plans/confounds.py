"""Confound queries: counts around events, nearest filings, capped articles, provider panels, precedence labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import rules
from almanac.operators import confound
from almanac.plans.registry import EV, query
from almanac.sources.tables import recommendations, table

_ART = """art AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS article_date, l_orderkey * 10 + l_linenumber AS article_id, l_returnflag AS flag, p_type AS topic FROM lineitem JOIN part ON l_partkey = p_partkey)"""

#: Providers as columns of daily counts: av and gd report news, sec filings. States, an event's neighbours and their reach.
STATES = f"""{_ART}, dl AS (SELECT ticker, article_date AS d, count(*) FILTER (flag = 'A') AS av, count(*) FILTER (flag = 'N') AS gd, count(*) FILTER (flag = 'R') AS sec FROM art GROUP BY 1, 2),
us AS (SELECT ticker, 3 * sum(av) / (max(d) - min(d) + 1) AS av, 3 * sum(gd) / (max(d) - min(d) + 1) AS gd, 3 * sum(sec) / (max(d) - min(d) + 1) AS sec FROM dl GROUP BY 1),
nr AS (SELECT ev.event_id, ev.ticker, {', '.join(f"coalesce(sum(dl.{p}) FILTER (abs(d - event_date) <= 1), 0) AS {p}_near, coalesce(sum(dl.{p}), 0) AS {p}_reach" for p in ('av', 'gd', 'sec'))} FROM ev LEFT JOIN dl ON ev.ticker = dl.ticker AND d BETWEEN event_date - 30 AND event_date + 30 GROUP BY 1, 2),
st AS (SELECT nr.* EXCLUDE (ticker), {', '.join(f"CASE WHEN {p}_near > 1.5 * us.{p} THEN 'confounded' WHEN {p}_reach > 0 THEN 'clean' ELSE 'unknown' END AS {p}_state" for p in ('av', 'gd', 'sec'))} FROM nr LEFT JOIN us ON nr.ticker = us.ticker)"""
PROVIDERS = {"av": "A", "gd": "N", "sec": "R"}


def states(spark, sf, events=None):
    """Events, or those given, with what three providers have around them, from the articles table."""
    daily = _articles(spark, sf).groupBy("ticker", "article_date").agg(*[F.count_if(F.col("flag") == f).alias(p) for p, f in PROVIDERS.items()])
    return confound.provider_states(recommendations(spark, sf) if events is None else events, daily, list(PROVIDERS))


def _articles(spark, sf):
    li = table(spark, sf, "lineitem")
    p = table(spark, sf, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("article_date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("article_id"), F.col("l_returnflag").alias("flag"), F.col("p_type").alias("topic"))


@query(f"""WITH {EV}, {_ART} SELECT ev.event_id, count(*) FILTER (d >= -1 AND d < 0) AS pre_1d, count(*) FILTER (d >= -3 AND d < 0) AS pre_3d, count(*) FILTER (d >= -7 AND d < 0) AS pre_7d, count(*) FILTER (d >= 0 AND d <= 1) AS post_1d, count(*) FILTER (d >= 0 AND d <= 3) AS post_3d, count(*) FILTER (d >= 0 AND d <= 7) AS post_7d
FROM ev LEFT JOIN (SELECT e.event_id, date_diff('day', e.event_date, a.article_date) AS d FROM ev e JOIN art a ON e.ticker = a.ticker AND abs(date_diff('day', e.event_date, a.article_date)) <= 7) x USING (event_id) GROUP BY 1""")
def news_window_counts(spark, sf):
    return confound.window_counts(recommendations(spark, sf), _articles(spark, sf), [1, 3, 7])


@query(f"""WITH {EV}, {_ART}, x AS (SELECT event_id, date_diff('day', event_date, article_date) AS gap FROM ev JOIN art USING (ticker) WHERE flag = 'R' AND abs(date_diff('day', event_date, article_date)) <= 5) SELECT event_id, count(*) AS n_near, CAST(arg_min(gap, abs(gap) * 100 + gap) AS INTEGER) AS nearest_gap FROM x GROUP BY 1""")
def filing_proximity(spark, sf):
    return confound.nearest(recommendations(spark, sf), _articles(spark, sf).where("flag = 'R'"), 5)


@query(f"""WITH {EV}, {_ART}, x AS (SELECT event_id, substr(sha256(topic || '|' || CAST(article_date AS VARCHAR)), 1, 28) AS key, article_date FROM ev JOIN art USING (ticker) WHERE abs(date_diff('day', event_date, article_date)) <= 7), o AS (SELECT event_id, key, min(article_date) AS article_date FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY article_date, key) AS rn FROM o) SELECT event_id, key, article_date FROM r WHERE rn <= 3""")
def capped_unique_articles(spark, sf):
    a = _articles(spark, sf).withColumn("day", F.col("article_date").cast("string"))
    return confound.capped_articles(recommendations(spark, sf), a, 7, 3, confound.short_key("topic", "day")).select("event_id", "key", "article_date")


@query(f"""WITH {EV}, {STATES}, m AS (SELECT *, CASE WHEN 'confounded' IN (sec_state, av_state, gd_state) THEN 'confounded' WHEN 'unknown' IN (sec_state, av_state, gd_state) THEN 'unknown' ELSE 'clean' END AS master FROM st)
SELECT event_id, sec_state AS official, av_state AS media, gd_state AS archive, CAST(av_near + gd_near AS BIGINT) AS near, master, CASE WHEN sec_state = 'confounded' THEN 'official_news' WHEN 'confounded' IN (av_state, gd_state) THEN 'media_news' ELSE master END AS label FROM m""")
def provider_panel(spark, sf):
    """Three providers' states at each event, their join, and the news label by precedence."""
    j = states(spark, sf)
    official, media, archive = (F.col(f"{p}_state") for p in ("sec", "av", "gd"))
    master = confound.combined(official, media, archive)
    label = confound.first_label((official == "confounded", "official_news"), ((media == "confounded") | (archive == "confounded"), "media_news"), otherwise="")
    label = F.when(label == "", master).otherwise(label)
    return j.select("event_id", official.alias("official"), media.alias("media"), archive.alias("archive"), (F.col("av_near") + F.col("gd_near")).alias("near"), master.alias("master"), label.alias("label"))


#: What a line's kind of part is as a filing.
_FORMS = {"ECONOMY": "8-K", "STANDARD": "10-Q", "MEDIUM": "4", "PROMO": "S-1", "LARGE": "10-K", "SMALL": "DEF 14A"}


@query(f"""WITH {EV}, {STATES}, fl AS (SELECT ticker, article_date AS d, CASE topic {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _FORMS.items())} END AS form, count(*) AS n FROM art WHERE flag = 'R' GROUP BY 1, 2, 3),
g AS (SELECT ev.event_id, coalesce(string_agg(DISTINCT form, ';' ORDER BY form), '') AS forms, arg_min(form, abs(d - event_date) * 1000 + (d - event_date) * 10 + CASE form {' '.join(f"WHEN '{f}' THEN {k}" for k, f in enumerate(sorted(_FORMS.values())))} END) AS near, coalesce(max(n) >= 2, false) AS material FROM ev LEFT JOIN fl ON ev.ticker = fl.ticker AND abs(d - event_date) <= 2 GROUP BY 1),
f AS (SELECT g.*, st.*, contains(forms, '8-K') OR coalesce(near = '8-K', false) AS eight_k, contains(forms, '10-Q') OR contains(forms, '10-K') OR coalesce(near IN ('10-Q', '10-K'), false) AS ten_qk, contains(forms, 'S-1') OR contains(forms, '424B') OR contains(forms, 'F-1') AS offering, contains(forms, '13D') OR contains(forms, '13G') OR contains(forms, '4') AS ownership, CAST(av_reach > 0 AS INT) + CAST(gd_reach > 0 AS INT) AS external FROM g JOIN st ON g.event_id = st.event_id)
SELECT f.event_id, forms, eight_k, ten_qk, offering, ownership, eight_k OR offering AS confounded, concat_ws(';', CASE WHEN eight_k THEN '8k_window' END, CASE WHEN ten_qk THEN '10q_10k_window' END, CASE WHEN offering THEN 'offering_registration_window' END, CASE WHEN ownership THEN 'ownership_insider_window' END, CASE WHEN material THEN 'material_filing_flag' END, CASE WHEN sec_state = 'unknown' THEN 'sec_unknown' END) AS reasons,
CAST(CASE WHEN external = 0 AND sec_reach = 0 THEN 0 WHEN external = 0 THEN 1 WHEN external = 1 THEN 2 WHEN gd_near > 0 OR av_near = 0 THEN 4 ELSE 3 END AS BIGINT) AS coverage FROM f""")
def filing_flags(spark, sf):
    """Flags of the forms filed within two days of an event with their reasons, and the coverage score of its news sources."""
    form = F.lit(None).cast("string")
    for kind, name in _FORMS.items():
        form = F.when(F.col("topic") == kind, name).otherwise(form)
    filed = _articles(spark, sf).where("flag = 'R'").withColumn("form", form).groupBy("ticker", "article_date", "form").agg(F.count("*").alias("n"))
    ev = states(spark, sf)
    near = confound.within(ev.select("event_id", "ticker", "event_date"), filed, 2)
    f = near.groupBy("event_id").agg(F.array_join(F.sort_array(F.collect_set("form")), ";").alias("forms"), F.min_by("form", F.struct(F.abs("gap"), "gap", "form")).alias("near"), (F.max("n") >= 2).alias("material"))
    j = ev.join(f, "event_id", "left").na.fill("", ["forms", "near"]).na.fill(False, ["material"])
    status = F.when(F.col("sec_state") == "unknown", "failed").otherwise("ok")
    external = (F.col("av_reach") > 0).cast("int") + (F.col("gd_reach") > 0).cast("int")
    flags = rules.filing_flags(F.col("forms"), F.col("near"), F.col("material"), status)
    return j.select("event_id", "forms", *[c.alias(n) for n, c in flags.items()], rules.coverage_score(F.col("sec_reach") > 0, external, F.col("gd_near") > 0, F.col("av_near") == 0).cast("long").alias("coverage"))


@query(f"""WITH {EV}, {_ART}, x AS (SELECT e.creator, year(e.event_date) AS year, count(DISTINCT e.event_id) AS covered FROM ev e JOIN art a ON e.ticker = a.ticker AND abs(date_diff('day', e.event_date, a.article_date)) <= 3 GROUP BY 1, 2), t AS (SELECT creator, year(event_date) AS year, count(*) AS n FROM ev GROUP BY 1, 2) SELECT t.creator, t.year, n, coalesce(covered, 0) AS covered, round(coalesce(covered, 0) / n, 6) AS rate FROM t LEFT JOIN x USING (creator, year)""")
def coverage_by_year(spark, sf):
    ev = recommendations(spark, sf).withColumn("year", F.year("event_date").cast("long"))
    daily = _articles(spark, sf).groupBy("ticker", "article_date").agg(F.count("*").alias("a"))
    near = confound.around(ev.select("creator", "year", "ticker", "event_date"), daily, {"near": ("a", -3, 3)})
    t = near.groupBy("creator", "year").agg(F.count("*").alias("n"), F.count_if(F.col("near") > 0).alias("covered"))
    return t.select("creator", "year", "n", "covered", F.round(F.col("covered") / F.col("n"), 6).alias("rate"))
