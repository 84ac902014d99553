"""Rule sets on texts whose labels are known, files of other forms, and resampling against closed forms."""

import math
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions import rules, text
from almanac.operators import calendar as cal
from almanac.operators import factors, resample, select, stats
from almanac.sources import files
from almanac.streaming import jobs


def frame(spark, texts):
    return rules.prepared(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string"), "text")


@pytest.mark.parametrize("said, label, stance, score", [
    ("I am buying TSLA today", "bullish_recommendation", "bullish", 3),
    ("Selling everything, avoid it", "bearish_recommendation", "bearish", 3),
    ("Price target 300, more upside", "bullish_recommendation", "bullish", 4),
    ("Load up, this is a 10x", "bullish_recommendation", "bullish", 5),
    ("Analysts expect upside", "third_party_attribution", "bullish", 2),
    ("if you had bought it then", "ambiguous_reference", "bullish", 3),
    ("We've been bullish since March", "retrospective_claim", "bullish", 1),
    ("called it, a breakout", "retrospective_claim", "bullish", 2),
    ("I own some", "portfolio_disclosure", "neutral", 0),
    ("They filed, breaking news", "news_only", "neutral", 0),
    ("a generational opportunity", "non_actionable_hype", "neutral", 0),
    ("buyers and longing", "neutral_mention", "neutral", 0),
    ("", "neutral_mention", "neutral", 0),
])
def test_recommendations(spark, said, label, stance, score):
    r = rules.recommendation(frame(spark, [said])).first()
    assert (r["label"], r["stance"], r["score"]) == (label, stance, score)


def test_negation_and_attribution_exclude(spark):
    said = ["I am buying TSLA", "I do not want to buy TSLA, long term", "I am buying it", "Analysts expect TSLA upside, buy"]
    rows = rules.exclusion(rules.recommendation(frame(spark, said)), F.contains("t", F.lit("tsla"))).orderBy("id").collect()
    assert [(r["accepted"], r["reason"], r["confidence_label"]) for r in rows] == [(True, None, "high"), (False, "negated_action", "low"), (False, "cross_attributed_action", "low"), (False, "third_party_attribution", "exclude")]


LONG = " as I said at the end of the show this week"


@pytest.mark.parametrize(("said", "symbol", "want"), [
    ("I am buying NVDA here because revenue is growing quickly.", "NVDA", ("yes", "buy", "positive", "high", "strong", 0.93, False, "first_person_buy")),
    ("Warren Buffett bought NVDA according to news reports.", "NVDA", ("no", "false_positive", "unclear", "low", "strong", 0.89, False, "third_party_attribution")),
    ("NVDA maybe.", "NVDA", ("unclear", "unclear", "unclear", "unclear", "weak", 0.35, True, "insufficient_context")),
    ("I just bought some of it in 2021" + LONG, "NVDA", ("yes", "buy", "positive", "medium", "strong", 0.73, True, "target_not_explicit_in_context;creator_bought")),
    ("Our top stock is NVDA" + LONG, "NVDA", ("yes", "buy", "positive", "high", "medium", 0.9, False, "direct_recommendation_language")),
    ("We trimmed NVDA last year" + LONG, "NVDA", ("yes", "sell", "negative", "medium", "strong", 0.8, False, "creator_sell_action;possible_historical_context")),
    ("I would short NVDA" + LONG, "NVDA", ("yes", "short", "negative", "medium", "strong", 0.92, False, "creator_short_action")),
    ("Stay away from NVDA" + LONG, "NVDA", ("yes", "avoid", "negative", "medium", "medium", 0.86, False, "avoid_language")),
    ("Analysts raised the price target on NVDA" + LONG, "NVDA", ("yes", "price_target", "positive", "medium", "medium", 0.6, True, "price_target_language;possible_third_party_attribution")),
    ("NVDA is cheap at these levels" + LONG, "NVDA", ("yes", "buy", "positive", "medium", "medium", 0.82, False, "valuation_positive")),
    ("NVDA is too expensive" + LONG, "NVDA", ("yes", "avoid", "negative", "medium", "medium", 0.82, False, "valuation_negative")),
    ("We're holding NVDA" + LONG, "NVDA", ("yes", "hold", "neutral", "medium", "strong", 0.86, False, "creator_hold_action")),
    ("NVDA announced a partnership" + LONG, "NVDA", ("no", "news_reaction", "neutral", "low", "medium", 0.79, False, "news_only_or_business_context")),
    ("Rate hikes hurt NVDA and the rest" + LONG, "NVDA", ("no", "macro_commentary", "neutral", "low", "medium", 0.78, False, "macro_commentary")),
    ("NVDA used to be smaller" + LONG, "NVDA", ("no", "false_positive", "unclear", "low", "medium", 0.76, False, "historical_or_retrospective")),
    ("NVDA was mentioned in passing" + LONG, "NVDA", ("unclear", "unclear", "unclear", "unclear", "weak", 0.35, True, "no_clear_rule_match")),
    ("Nothing at all was mentioned" + LONG, "NVDA", ("unclear", "unclear", "unclear", "unclear", "weak", 0.35, True, "target_not_explicit_in_context;insufficient_target_context")),
    ("Do you know what, it is time to go home" + LONG, "YOU", ("no", "false_positive", "unclear", "low", "strong", 0.9, False, "ambiguous_ticker_false_positive")),
    ("If you like, I am buying YOU stock" + LONG, "YOU", ("yes", "buy", "positive", "high", "strong", 0.93, False, "first_person_buy")),
])
def test_labels(spark, said, symbol, want):
    d = rules.labelled(frame(spark, [said]), F.lit(symbol), F.lit("bullish")).first()["d"]
    assert tuple(d)[:8] == want
    assert d["quote"] and d["quote"] in said.lower()


def test_a_companys_name_names_the_target(spark):
    said = "We're holding Nvidia" + LONG
    for company, flags in (("Nvidia Inc.", "creator_hold_action"), ("NVIDIA, of California", "creator_hold_action"), ("Nvi", "target_not_explicit_in_context;creator_hold_action"), (None, "target_not_explicit_in_context;creator_hold_action")):
        assert rules.labelled(frame(spark, [said]), F.lit("NVDA"), company=F.lit(company).cast("string")).first()["d"]["flags"] == flags


def test_places_are_those_of_the_matches(spark):
    import re

    said = ["AB cd $EF, AB", "", "no", "$XY", "a AB" * 500]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "id long, text string")
    got = sorted((r["id"], r["at"], r["word"]) for r in text.placed(df, "id", "text", r"\$?\b[A-Z]{2,5}\b").collect())
    assert got == sorted((k, m.start() + 1, m[0]) for k, t in enumerate(said) for m in re.finditer(r"\$?\b[A-Z]{2,5}\b", t))


def test_sessions_open_after_nights_and_weekends(spark):
    rows = [("2026-05-01 21:00:00", "2026-05-04 13:30:00"), ("2026-05-02 15:00:00", "2026-05-04 13:30:00"), ("2026-05-05 11:00:00", "2026-05-05 11:00:00"), ("2026-05-05 18:00:00", "2026-05-05 18:00:00"), ("2026-01-05 21:30:00", "2026-01-06 14:30:00")]
    df = spark.createDataFrame(rows, "ts string, want string").select(F.to_timestamp("ts").alias("ts"), F.to_timestamp("want").alias("want"))
    assert df.where(cal.session_target("ts") != F.col("want")).count() == 0


def test_intervals_and_permutations_agree_with_closed_forms(spark):
    x = np.random.default_rng(1).normal(0.3, 1.0, 800)
    df = spark.createDataFrame([(k, float(v), k % 40) for k, v in enumerate(x)], "n long, x double, g long")
    r = resample.bootstrap(df, "n", "x", 400, 42).first()
    se = x.std(ddof=1) / math.sqrt(len(x))
    assert r["n"] == 800 and r["mean"] == pytest.approx(x.mean()) and abs(r["low"] - (x.mean() - 1.96 * se)) < 0.4 * se and abs(r["high"] - (x.mean() + 1.96 * se)) < 0.4 * se
    assert resample.sign_flips(df, "n", "x", 200, 7).first()["p"] == 1 / 200
    centred = df.withColumn("x", F.col("x") - float(x.mean()))
    assert resample.sign_flips(centred, "n", "x", 200, 7).first()["p"] > 0.5
    p = resample.within_group(df, "g", "n", "x", 200, 3).first()
    assert abs(p["drawn_mean"] - x.mean()) < se and 0.2 < p["p"] < 0.8
    d = resample.bootstrap_difference(df, "g", "g", "x", F.col("n") % 2 == 0, 300, 5).first()
    want = x[::2].mean() - x[1::2].mean()
    assert d["diff"] == pytest.approx(want) and d["low"] < want < d["high"] and d["clusters"] == 40


def test_loadings_are_least_squares(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(0, 0.01, (60, 3))
    ret = 0.001 + f @ [1.2, -0.5, 0.3] + rng.normal(0, 0.001, 60) + 0.0001
    days = [(f"2024-01-{k + 1:02d}" if k < 31 else f"2024-02-{k - 30:02d}") for k in range(60)]
    daily = spark.createDataFrame([("A", k + 1, d, float(r)) for k, (d, r) in enumerate(zip(days, ret))], "ticker string, idx long, date string, ret double")
    table = spark.createDataFrame([(d, *map(float, v), 0.0001) for d, v in zip(days, f)], "date string, mkt double, smb double, hml double, rf double")
    sums = factors.running(daily, table)
    e = spark.createDataFrame([(1, "A", 51)], "event_id long, ticker string, idx long")
    got = factors.loadings(e, sums, -40, -1, 30).first()
    beta = np.linalg.lstsq(np.column_stack([np.ones(40), f[10:50]]), ret[10:50] - 0.0001, rcond=None)[0]
    assert [got["a"], got["b_mkt"], got["b_smb"], got["b_hml"]] == pytest.approx(beta.tolist(), rel=1e-6) and got["n"] == 40
    raw = spark.createDataFrame([(1, 0.05)], "event_id long, raw double")
    out = factors.abnormal(factors.loadings(e, sums, -40, -1, 30), sums, raw, 5).first()
    window = f[51:56].sum(axis=0)
    assert out["alpha"] == pytest.approx(0.05 - 0.0005 - 5 * beta[0] - window @ beta[1:]) and out["unit_alpha"] == pytest.approx(0.05 - 0.0005 - window.sum())
    assert factors.loadings(e, sums, -40, -1, 41).first()["a"] is None


def test_regressions_stand_on_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1.0, (300, 2))  # far from zero: sums of squares would lose the digits
    g = rng.integers(0, 12, 300)
    y = 5 + x @ [0.5, -2.0] + rng.normal(0, 1, 300) * (1 + (g > 6))
    df = spark.createDataFrame([(float(a), float(b), float(c), int(k)) for (a, b), c, k in zip(x, y, g)], "a double, b double, y double, g long")
    m = np.column_stack([np.ones(300), x - x.mean(axis=0)])
    inverse = np.linalg.inv(m.T @ m)
    beta = inverse @ m.T @ y
    e = y - m @ beta
    plain = inverse * (e @ e) / 297
    hc1 = 300 / 297 * inverse @ (m * e[:, None] ** 2).T @ m @ inverse
    sums = np.stack([(m[g == k] * e[g == k][:, None]).sum(axis=0) for k in range(12)])
    clustered = 12 / 11 * 299 / 297 * inverse @ sums.T @ sums @ inverse
    for cov, options in ((plain, {}), (hc1, {"robust": True}), (clustered, {"cluster": "g"})):
        got = stats.ols(df, "y", ["a", "b"], **options)
        assert [r["coef"] for r in got[1:]] == pytest.approx(beta[1:].tolist(), rel=1e-6)
        assert [r["se"] for r in got[1:]] == pytest.approx(np.sqrt(np.diag(cov))[1:].tolist(), rel=1e-5)
        assert got[0]["r2"] == pytest.approx(1 - e @ e / ((y - y.mean()) @ (y - y.mean())), rel=1e-6)
    one = stats.ols(df.withColumn("g", F.lit(1)), "y", ["a", "b"], cluster="g")
    assert all(r["se"] is None and r["t"] is None for r in one)
    d = stats.demean(df.where("g < 3").unionByName(df.where("g = 3").withColumn("g", F.lit(None).cast("long"))), ["g"], ["y"])
    assert d.count() == (g < 4).sum() and d.groupBy("g").agg(F.abs(F.avg("y")).alias("m")).where("m > 1e-6").count() == 0


def test_normal_tails_are_those_of_erfc(spark):
    ts = [0.0, 0.1, 1.0, 1.96, 2.5758, 4.0, 6.0]
    got = spark.createDataFrame([(t,) for t in ts], "t double").select(stats.normal_p(F.col("t"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.erfc(t / math.sqrt(2)) for t in ts], abs=2e-7)
    assert stats.incomplete_beta(2.5, 0.5, 5 / (5 + 2.015**2)) == pytest.approx(0.1, abs=1e-4)  # Student's t of five degrees at 2.015


def test_order_statistics_and_ranks(spark):
    x = np.round(np.random.default_rng(4).normal(0, 1, 5000), 3)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    s = np.sort(x)
    assert stats.order_statistics(df, "x", [0.0, 0.01, 0.5, 0.99, 1.0], few=50) == [s[int(p * 4999)] for p in (0.0, 0.01, 0.5, 0.99, 1.0)]
    nonzero = x[x != 0]
    order = np.abs(nonzero)
    ranks = np.array([(order < v).sum() + ((order == v).sum() + 1) / 2 for v in order])
    got = stats.signed_rank(df, "x").first()
    assert got["n"] == len(nonzero) and got["w_plus"] == pytest.approx(ranks[nonzero > 0].sum())


def test_chains_fold_like_whole_groups(spark):
    rng = np.random.default_rng(5)
    rows = {(int(g), int(p)) for g, p in zip(rng.integers(0, 3, 400), rng.integers(0, 2000, 400))}
    got = {(r["g"], r["p"]): r["anchor"] for r in select.anchor_clusters(spark.createDataFrame(sorted(rows), "g long, p long"), ["g"], "p", 20).collect()}
    for g in range(3):
        anchor = None
        for p in sorted(p for k, p in rows if k == g):
            anchor = p if anchor is None or p - anchor > 20 else anchor
            assert got[g, p] == anchor


# ---------------------------------------------------------------- files


def test_sqlite_tables_are_read_in_ranges(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("CREATE TABLE videos (id INTEGER, title TEXT)")
    con.executemany("INSERT INTO videos VALUES (?, ?)", [(k, f"t{k}" if k % 7 else None) for k in range(100)])
    con.execute("CREATE TABLE empty (id INTEGER)")
    con.commit()
    con.close()
    got = files.read_sqlite(spark, str(tmp_path / "a.db"), "videos", "id long, title string", parts=3)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(k, f"t{k}" if k % 7 else None) for k in range(100)]
    assert files.read_sqlite(spark, str(tmp_path / "a.db"), "empty", "id long").count() == 0
    with pytest.raises(ValueError):
        files.read_sqlite(spark, str(tmp_path / "a.db"), "videos; drop table videos", "id long")


def test_blocks_of_a_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v, kind: f'<c r="{r}" t="{kind}">' + (f"<is><t>{v}</t></is>" if kind == "inlineStr" else f"<v>{v}</v>") + "</c>"
    sheet = f'<worksheet {ns}><sheetData><row>{cell("A1", 0, "s")}{cell("C1", "BBB", "inlineStr")}</row><row>{cell("A2", "date", "inlineStr")}{cell("B2", "px", "inlineStr")}{cell("C2", "date", "inlineStr")}{cell("D2", "px", "inlineStr")}</row><row>{cell("A3", "2024-01-02", "inlineStr")}{cell("B3", 1.5, "n")}{cell("D3", 2.5, "n")}</row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>AAA</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    got = files.read_blocks(spark, f"file://{tmp_path}/*.xlsx", 2).drop("file")
    assert sorted(map(tuple, got.collect())) == [("AAA", 3, "date", "2024-01-02"), ("AAA", 3, "px", "1.5"), ("BBB", 3, "px", "2.5")]


def test_landed_files_reports_and_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("k,v\na,1\nb,2\n")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    for _ in range(2):
        jobs.run_once(files.stream_csv(spark, f"file://{tmp_path}/in", schema, F.col("v") > 1), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
        (tmp_path / "in/b.csv").write_text("k,v\nc,3\nd,0\n")
    assert sorted(map(tuple, spark.read.schema(schema).parquet(f"file://{tmp_path}/out").collect())) == [("b", 2), ("c", 3)]
    df = spark.createDataFrame([("x", "p|q"), ("x", None)], "a string, b string")
    assert files.markdown(df) == "| a | b |\n| --- | --- |\n| x | p\\|q |\n| x |  |\n"
    assert files.rebuild(df, f"file://{tmp_path}/t", True).count() == 2 and files.rebuild(df, f"file://{tmp_path}/t", False).count() == 4 and files.rebuild(df, f"file://{tmp_path}/t", True).count() == 2
    files.export_groups(df, ["a", "b"], f"file://{tmp_path}/g")
    assert sorted(map(tuple, spark.read.csv(f"file://{tmp_path}/g", header=True).select("grouping", "value", "n").collect()), key=str) == sorted([("a", "x", "2"), ("b", "p|q", "1"), ("b", None, "1")], key=str)
    tables = {"t": df, "u": df.where("b is not null")}
    problems = {(r["problem"], r["n"]) for r in files.check_package(tables, {"t": 3, "u": 1}, [("t", "b", "u", "b"), ("t", "a", "u", "b")], [("t", "b is not null")]).collect()}
    assert problems == {("t has too few rows", 2), ("t.a is not in u", 2), ("t: not b is not null", 1)}
    assert files.check_package(tables, {"t": 2}, [], []).count() == 0


def test_an_upserted_table_takes_batches_and_replays(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for k, rows in enumerate([[(1, 1, 10), (2, 1, 20)], [(1, 3, 11), (2, 0, 99), (3, 1, 30)], []]):
        spark.createDataFrame(rows, "user_id long, ts long, event_id long").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("user_id long, ts long, event_id long").parquet(f"{folder}/in")
        jobs.upsert_once(stream, folder, f"{folder}/check", ["user_id"], "ts")
        jobs.upsert_once(stream, folder, f"{folder}/other{k}", ["user_id"], "ts")  # all again, from the beginning
    assert sorted(map(tuple, jobs.upserted(spark, folder).select("user_id", "ts", "event_id").collect())) == [(1, 3, 11), (2, 1, 20), (3, 1, 30)]
