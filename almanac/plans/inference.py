"""Inference queries: t bundles, clustered errors, multiple testing, winsorised means, shrinkage, regressions, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import resample, returns, stats
from almanac.plans.registry import EVENTS, PX, RETURNS, index, query, r6, returns5
from almanac.sources.shared import written
from almanac.sources.tables import recommendations, table

def _normal_p(t: str) -> str:
    z = f"(abs({t}) / sqrt(2))"
    k = f"(1 / (1 + 0.3275911 * {z}))"
    return f"{k} * (0.254829592 + {k} * (-0.284496736 + {k} * (1.421413741 + {k} * (-1.453152027 + {k} * 1.061405429)))) * exp(-{z} * {z})"


@query(f"""{RETURNS}, g AS (SELECT direction, count(ar) AS n, avg(ar) AS mean, median(ar) AS median, avg(CASE WHEN ar > 0 THEN 1.0 WHEN ar IS NOT NULL THEN 0.0 END) AS win, stddev_samp(ar) AS sd FROM r5 GROUP BY 1), h AS (SELECT *, sd / sqrt(n) AS se, mean / (sd / sqrt(n)) AS t FROM g)
SELECT direction, n, round(mean, 6) AS mean, round(median, 6) AS median, round(CAST(win AS DOUBLE), 6) AS win_rate, round(se, 6) AS se, round(t, 4) AS t, round({_normal_p('t')}, 6) AS p, round(mean - 1.96 * se, 6) AS low, round(mean + 1.96 * se, 6) AS high FROM h""")
def t_bundle(spark, sf):
    return stats.bundle(returns5(spark, sf), ["direction"], "ar", median=True).select("direction", "n", *r6("mean", "median", "win_rate", "se"), F.round("t", 4).alias("t"), *r6("p", "low", "high"))


def _cluster_sql(keys: str, name: str) -> str:
    return f"""SELECT direction, max(m) AS mean, max(n) AS n, count(*) AS g, sqrt(count(*) / (count(*) - 1) * sum((s - k * m) * (s - k * m))) / max(n) AS {name}
FROM (SELECT direction, {keys}, sum(ar) AS s, count(ar) AS k FROM r5 WHERE ar IS NOT NULL GROUP BY ALL) JOIN (SELECT direction, avg(ar) AS m, count(ar) AS n FROM r5 WHERE ar IS NOT NULL GROUP BY 1) USING (direction) GROUP BY direction"""


@query(f"""{RETURNS}, c AS ({_cluster_sql('ticker', 'se')}) SELECT direction, n, g AS clusters, round(mean, 6) AS mean, round(se, 6) AS se FROM c""")
def clustered_errors(spark, sf):
    return stats.clustered_se(returns5(spark, sf), ["direction"], "ar", ["ticker"]).select("direction", "n", "clusters", *r6("mean", "se"))


@query(f"""{RETURNS}, a AS ({_cluster_sql('ticker', 'se_a')}), b AS ({_cluster_sql('trade_date', 'se_b')}), ab AS ({_cluster_sql('ticker, trade_date', 'se_ab')})
SELECT a.direction, a.n, round(se_a, 6) AS se_a, round(se_b, 6) AS se_b, round(se_ab, 6) AS se_ab, round(sqrt(greatest(0, se_a * se_a + se_b * se_b - se_ab * se_ab)), 6) AS se FROM a JOIN b USING (direction) JOIN ab USING (direction)""")
def two_way_errors(spark, sf):
    return stats.two_way_se(returns5(spark, sf), ["direction"], "ar", ["ticker"], ["trade_date"]).select("direction", "n", *r6("se_a", "se_b", "se_ab", "se"))


@query(f"""{RETURNS}, g AS (SELECT creator, avg(ar) / (stddev_samp(ar) / sqrt(count(ar))) AS t FROM r5 GROUP BY 1 HAVING count(ar) >= 3), p AS (SELECT creator, {_normal_p('t')} AS p FROM g WHERE t IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY p, creator) AS r, count(*) OVER () AS m FROM p)
SELECT creator, round(p, 6) AS p, round(least(1.0, p * m), 6) AS bonferroni, round(least(1.0, max(p * (m - r + 1)) OVER (ORDER BY p, creator)), 6) AS holm, round(least(1.0, min(p * m / r) OVER (ORDER BY p, creator ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh FROM r""")
def multiple_testing(spark, sf):
    tests = stats.bundle(returns5(spark, sf), ["creator"], "ar", least=3)
    return stats.adjust(tests, "p", "creator").select("creator", *r6("p", "bonferroni", "holm", "bh"))


@query(f"""{RETURNS}, q AS (SELECT quantile_cont(ar, 0.01) AS a, quantile_cont(ar, 0.99) AS b FROM r5 WHERE ar IS NOT NULL), w AS (SELECT direction, least(greatest(ar, a), b) AS x FROM r5, q WHERE ar IS NOT NULL) SELECT direction, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd FROM w GROUP BY 1""")
def winsorized_means(spark, sf):
    w = stats.winsorize(returns5(spark, sf).where("ar is not null"), "ar", 0.01, 0.99, "x")
    return w.groupBy("direction").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("sd"))


@query(f"""{RETURNS}, g AS (SELECT creator, count(ar) AS n, sum(ar) AS s FROM r5 WHERE ar IS NOT NULL GROUP BY 1) SELECT creator, n, round(s / n, 6) AS mean, round(n / (n + 20.0) * s / n + (1 - n / (n + 20.0)) * (sum(s) OVER () / sum(n) OVER ()), 6) AS shrunk FROM g""")
def shrunk_means(spark, sf):
    return stats.shrink(returns5(spark, sf), "creator", "ar").select("creator", "n", *r6("mean", "shrunk"))


@query(f"""{RETURNS} SELECT direction, count(*) AS n, count(*) FILTER (ar > 0) AS up, round((count(*) FILTER (ar > 0) - count(*) / 2.0) / sqrt(count(*) / 4.0), 6) AS z FROM r5 WHERE ar <> 0 GROUP BY 1""")
def sign_test(spark, sf):
    g = returns5(spark, sf).where("ar <> 0").groupBy("direction").agg(F.count("*").alias("n"), F.count_if(F.col("ar") > 0).alias("up"))
    return g.select("direction", "n", "up", F.round((F.col("up") - F.col("n") / 2) / F.sqrt(F.col("n") / 4), 6).alias("z"))


@query(f"""{RETURNS}, x AS (SELECT abs(round(ar, 9)) AS v, round(ar, 9) > 0 AS up FROM r5 WHERE ar IS NOT NULL AND round(ar, 9) <> 0), g AS (SELECT v, count(*) AS c, count(*) FILTER (up) AS u FROM x GROUP BY 1), r AS (SELECT *, coalesce(sum(c) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2.0 AS rank FROM g), s AS (SELECT sum(c) AS n, CAST(sum(rank * u) AS DOUBLE) AS w_plus, sum(c * (c * c - 1)) AS ties FROM r)
SELECT CAST(n AS BIGINT) AS n, round(w_plus, 2) AS w_plus, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s""")
def signed_rank(spark, sf):
    return stats.signed_rank(returns5(spark, sf).withColumn("ar", F.round("ar", 9)), "ar").select("n", F.round("w_plus", 2).alias("w_plus"), *r6("z"))


@query(f"""{RETURNS} SELECT ticker, regr_count(ar, score) AS n, round(regr_slope(ar, score), 5) AS slope, round(regr_intercept(ar, score), 5) AS intercept, round(regr_r2(ar, score), 5) AS r2 FROM r5 GROUP BY 1 HAVING regr_count(ar, score) >= 3""")
def simple_regression(spark, sf):
    return returns5(spark, sf).groupBy("ticker").agg(F.regr_count("ar", "score").alias("n"), F.round(F.regr_slope("ar", "score"), 5).alias("slope"), F.round(F.regr_intercept("ar", "score"), 5).alias("intercept"), F.round(F.regr_r2("ar", "score"), 5).alias("r2")).where("n >= 3")


def _design(spark, sf):
    r = returns5(spark, sf)
    return r.select("ticker", "creator", F.col("ar").alias("y"), F.col("score").cast("double").alias("score"), F.log("size").alias("log_size"), (F.col("direction") == "positive").cast("double").alias("positive"))


_COEF = "name string, coef double, se double, t double, p double, n long, r2 double"


def _inverse(k: int) -> list[list[str]]:
    """Entries of the inverse of the symmetric matrix a_00 ... by cofactors."""
    m = [[f"a_{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)]
    if k == 2:
        d = f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[0][1]})"
        return [[f"({m[1][1]} / {d})", f"(-{m[0][1]} / {d})"], [f"(-{m[0][1]} / {d})", f"({m[0][0]} / {d})"]]
    minor = lambda i, j: (lambda r, c: f"({m[r[0]][c[0]]} * {m[r[1]][c[1]]} - {m[r[0]][c[1]]} * {m[r[1]][c[0]]})")([x for x in range(3) if x != i], [x for x in range(3) if x != j])
    d = f"({m[0][0]} * {minor(0, 0)} - {m[0][1]} * {minor(0, 1)} + {m[0][2]} * {minor(0, 2)})"
    return [[f"({'-' if (i + j) % 2 else ''}{minor(i, j)} / {d})" for j in range(3)] for i in range(3)]


def _ols_sql(design: str, xs: list[str], kind: str = "plain", effects: str = "1") -> str:
    """Least squares in SQL: design is a query of y, xs and g. Sums are around the means; the constant's error follows."""
    k, inverse = len(xs), _inverse(len(xs))
    each = range(k)
    u = ["e", *[f"e * z{i}" for i in each]]
    sums = ", ".join(f"sum(u{i} * u{j}) AS m_{i}{j}" for i in range(k + 1) for j in range(i, k + 1))
    scores = f"SELECT {', '.join(f'{x} AS u{i}' for i, x in enumerate(u))}, g FROM r"
    if kind == "cluster":
        scores = f"SELECT {', '.join(f'sum({x}) AS u{i}' for i, x in enumerate(u))}, g FROM r GROUP BY g"
    inv = lambda i, j: "(1.0 / n)" if i == j == 0 else "0" if 0 in (i, j) else f"i_{min(i, j) - 1}{max(i, j) - 1}"
    meat = lambda i, j: f"m_{min(i, j)}{max(i, j)}"

    def v(i: int, j: int) -> str:
        if kind == "plain":
            return f"(sse / (n - {k} - {effects}) * {inv(i, j)})"
        scale = f"n / (n - {k + 1.0})" if kind == "robust" else f"(clusters / (clusters - 1.0)) * (n - 1.0) / (n - {k + 1.0})"
        terms = [f"{inv(i, a)} * {meat(a, b)} * {inv(b, j)}" for a in range(k + 1) for b in range(k + 1) if inv(i, a) != "0" and inv(b, j) != "0"]
        return f"({scale} * ({' + '.join(terms)}))"

    const = f"{v(0, 0)} - 2 * ({' + '.join(f'm{i} * {v(0, i + 1)}' for i in each)}) + ({' + '.join(f'm{i} * m{j} * {v(i + 1, j + 1)}' for i in each for j in each)})"
    rows = [("const", f"my - ({' + '.join(f'beta_{i} * m{i}' for i in each)})", const)] + [(x, f"beta_{i}", v(i + 1, i + 1)) for i, x in enumerate(xs)]
    out = " UNION ALL ".join(f"SELECT '{name}' AS name, {coef} AS coef, sqrt({var}) AS se, n, 1 - sse / yy AS r2 FROM f" for name, coef, var in rows)
    return f"""ols_d AS (SELECT * FROM ({design}) WHERE y IS NOT NULL {' '.join(f'AND {x} IS NOT NULL' for x in xs)}), ols_m AS (SELECT avg(y) AS my, {', '.join(f'avg({x}) AS m{i}' for i, x in enumerate(xs))} FROM ols_d),
c AS (SELECT y - my AS y, {', '.join(f'{x} - m{i} AS z{i}' for i, x in enumerate(xs))}, g FROM ols_d, ols_m), s AS (SELECT count(*) AS n, sum(y * y) AS yy, {', '.join(f'sum(z{i} * z{j}) AS a_{i}{j}' for i in each for j in range(i, k))}, {', '.join(f'sum(z{i} * y) AS b_{i}' for i in each)} FROM c),
i AS (SELECT *, {', '.join(f'{inverse[a][b]} AS i_{a}{b}' for a in each for b in range(a, k))} FROM s), b AS (SELECT *, {', '.join(f"{' + '.join(f'i_{min(a, j)}{max(a, j)} * b_{j}' for j in each)} AS beta_{a}" for a in each)} FROM i),
q AS (SELECT *, yy - ({' + '.join(f'beta_{a} * b_{a}' for a in each)}) AS sse FROM b), r AS (SELECT c.*, c.y - ({' + '.join(f'beta_{a} * z{a}' for a in each)}) AS e FROM c, q), u AS (SELECT count(*) AS clusters, {sums} FROM ({scores})), f AS (SELECT * FROM q, u, ols_m), o AS ({out})
SELECT name, round(coef, 6) AS coef, round(se, 6) AS se, round(coef / se, 3) AS t, round({_normal_p('coef / se')}, 4) AS p, n, round(r2, 6) AS r2 FROM o"""


_DESIGN = "SELECT ar AS y, CAST(score AS DOUBLE) AS score, ln(size) AS log_size, CASE WHEN direction = 'positive' THEN 1.0 ELSE 0.0 END AS positive, ticker AS g FROM r5"


def _coefficients(spark, rows):
    out = spark.createDataFrame(rows, _COEF)
    return out.select("name", *r6("coef", "se"), F.round("t", 3).alias("t"), F.round("p", 4).alias("p"), "n", *r6("r2"))


@query(f"{RETURNS}, {_ols_sql(_DESIGN, ['score', 'log_size', 'positive'])}")
def ols_plain(spark, sf):
    return _coefficients(spark, stats.ols(_design(spark, sf), "y", ["score", "log_size", "positive"]))


@query(f"{RETURNS}, {_ols_sql(_DESIGN, ['score', 'log_size', 'positive'], 'robust')}")
def ols_hc1(spark, sf):
    return _coefficients(spark, stats.ols(_design(spark, sf), "y", ["score", "log_size", "positive"], robust=True))


@query(f"{RETURNS}, {_ols_sql(_DESIGN, ['score', 'log_size', 'positive'], 'cluster')}")
def ols_clustered(spark, sf):
    return _coefficients(spark, stats.ols(_design(spark, sf), "y", ["score", "log_size", "positive"], cluster="ticker"))


def _demeaned(design: str, groups: tuple[str, str], columns: list[str], rounds: int = 12) -> str:
    """design's columns less their means by both groups in turn, as w<2 * rounds>."""
    out = [f"w0 AS MATERIALIZED (SELECT * FROM ({design}) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)})"]
    for n in range(2 * rounds):
        g = groups[n % 2]
        out.append(f"w{n + 1} AS MATERIALIZED (SELECT {', '.join(f'{c} - avg({c}) OVER (PARTITION BY {g}) AS {c}' for c in columns)}, {', '.join(groups)} FROM w{n})")
    return ", ".join(out)


def _effects_sql(design: str, groups: tuple[str, str], y: str, xs: list[str]) -> str:
    """Slopes within two groups that common rows tie into one part."""
    levels = f"(SELECT count(DISTINCT {groups[0]}) + count(DISTINCT {groups[1]}) - 1 FROM w0)"
    return f"{_demeaned(design, groups, [y, *xs])}, {_ols_sql(f'SELECT {y} AS y, ' + ', '.join(xs) + ', 0 AS g FROM w24', xs, effects=levels)} WHERE name <> 'const'"


@query(f"{RETURNS}, {_effects_sql('SELECT ar AS y, CAST(score AS DOUBLE) AS score, ln(size) AS log_size, ticker, creator FROM r5', ('ticker', 'creator'), 'y', ['score', 'log_size'])}")
def ols_fixed_effects(spark, sf):
    """Slopes within tickers and creators, with the degrees of freedom that their effects take."""
    return _coefficients(spark, stats.fixed_effects(_design(spark, sf), "y", ["score", "log_size"], ["ticker", "creator"]))


@query(f"""{RETURNS}, s AS (SELECT CAST(substr(ticker, 7) AS BIGINT) AS k, sum(ar) AS s, count(ar) AS c FROM r5 WHERE ar IS NOT NULL GROUP BY 1), m AS (SELECT d, sum(w * s) / sum(w * c) AS m FROM (SELECT s.*, d, {resample.poisson_sql(resample.uniform_sql('k', 'd', 42))} AS w FROM s CROSS JOIN (SELECT unnest(range(0, 500)) AS d)) GROUP BY 1)
SELECT round((SELECT sum(s) / sum(c) FROM s), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_by_ticker(spark, sf):
    r = returns5(spark, sf).withColumn("k", F.substring("ticker", 7, 9).cast("long"))
    return resample.bootstrap_clusters(r, "k", "ar", 500, 42).select(*r6("mean", "low", "high"))


@query(f"""{RETURNS}, g AS (SELECT ticker, count(ar) AS n, avg(ar) / (stddev_samp(ar) / sqrt(count(ar))) AS t FROM r5 GROUP BY 1 HAVING count(ar) >= 3),
v AS (SELECT *, n - 1 AS df, (n - 1) / (n - 1 + t * t) AS c, atan(abs(t) / sqrt(n - 1)) AS angle FROM g), j AS (SELECT *, unnest(range(0, df // 2)) AS j FROM v),
terms AS (SELECT *, sum(CASE WHEN j = 0 THEN 0.0 WHEN df % 2 = 1 THEN ln(2.0 * j / (2 * j + 1)) ELSE ln((2.0 * j - 1) / (2 * j)) END) OVER (PARTITION BY ticker ORDER BY j) + j * ln(c) AS l FROM j)
SELECT ticker, n, round(t, 4) AS t, round(1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (angle + sin(angle) * cos(angle) * sum(exp(l))) ELSE sin(angle) * sum(exp(l)) END, 6) AS p FROM terms GROUP BY ticker, n, t, df, angle""")
def student_p_values(spark, sf):
    """The SQL form is the distribution's finite series for whole degrees of freedom, not the incomplete beta's fraction."""
    b = stats.bundle(returns5(spark, sf), ["ticker"], "ar", least=3)
    p = stats.student_p(F.col("t"), (F.col("n") - 1).cast("double"))
    return b.select("ticker", "n", F.round("t", 4).alias("t"), F.round(p, 6).alias("p"))


def _newey_west_sql(lags: int = 5) -> str:
    lagged = ", ".join(f"lag(u0, {k}) OVER w AS u0_{k}, lag(u1, {k}) OVER w AS u1_{k}" for k in range(1, lags + 1))
    pair = lambda a, b, k: f"coalesce({a} * {b}_{k}, 0) + coalesce({b} * {a}_{k}, 0)"
    entry = lambda a, b: f"sum({a} * {b} + " + " + ".join(f"{1 - k / (lags + 1)!r} * ({pair(a, b, k)})" for k in range(1, lags + 1)) + ")"
    return f"""dd AS (SELECT date, avg(ret) AS y, avg(bret) AS x FROM daily GROUP BY 1), d AS (SELECT * FROM dd WHERE y IS NOT NULL AND x IS NOT NULL), f AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sum(x) AS sx, sum(x * x) AS sxx FROM d),
u AS (SELECT date, y - a - b * x AS u0, (y - a - b * x) * x AS u1 FROM d, f), l AS (SELECT *, {lagged} FROM u WINDOW w AS (ORDER BY date)), m AS (SELECT {entry('u0', 'u0')} AS m00, {entry('u0', 'u1')} AS m01, {entry('u1', 'u1')} AS m11 FROM l),
i AS (SELECT *, n * sxx - sx * sx AS det FROM f, m), v AS (SELECT *, (sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / (det * det) AS va, (sx * sx * m00 - 2 * sx * n * m01 + n * n * m11) / (det * det) AS vb FROM i)
SELECT 'alpha' AS name, round(a, 6) AS coef, round(sqrt(va), 6) AS se, round(a / sqrt(va), 3) AS t, n FROM v UNION ALL SELECT 'mkt', round(b, 6), round(sqrt(vb), 6), round(b / sqrt(vb), 3), n FROM v"""


@query(f"WITH {PX}, {_newey_west_sql()}")
def newey_west_alpha(spark, sf):
    daily = returns.with_daily(index(spark, sf)).groupBy("date").agg(F.avg("ret").alias("y"), F.avg("bret").alias("mkt"))
    out = spark.createDataFrame(stats.newey_west(daily, "date", "y", ["mkt"]), "name string, coef double, se double, t double, n long")
    return out.select("name", *r6("coef", "se"), F.round("t", 3).alias("t"), "n")


@query(f"""{EVENTS}, m AS (SELECT al.event_id, d.ret, d.bret FROM al JOIN daily d ON al.ticker = d.ticker AND d.idx BETWEEN al.idx - 130 AND al.idx - 1)
SELECT event_id, count(*) AS n, round(regr_slope(ret, bret), 4) AS beta, round(regr_intercept(ret, bret), 4) AS alpha FROM m WHERE ret IS NOT NULL AND bret IS NOT NULL GROUP BY 1 HAVING count(*) >= 40""")
def rolling_beta(spark, sf):
    """Market beta over the 130 rows before each event, from running cross sums: a window's moments are the difference of
    two rows, however long it is."""
    return betas(recommendations(spark, sf), returns.with_daily(index(spark, sf)))


def betas(events, daily):
    """event_id, n, beta and alpha of each event with 40 rows at least in its window; beta is null where the market stands still."""
    from pyspark.sql import Window

    run = Window.partitionBy("ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    x, y = F.coalesce("bret", F.lit(0.0)), F.coalesce("ret", F.lit(0.0))
    both = F.col("ret").isNotNull() & F.col("bret").isNotNull()
    cum = daily.select("ticker", "idx", F.count_if(both).over(run).alias("c"), *[F.sum(F.when(both, e).otherwise(0.0)).over(run).alias(n) for n, e in (("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y))])
    ev = returns.align(events, daily).where("idx is not null").select("event_id", "ticker", (F.col("idx") - 1).alias("i1"), F.greatest(F.lit(0), F.col("idx") - 131).alias("i0"))
    names = ["c", "sx", "sy", "sxx", "sxy"]
    a = cum.select("ticker", F.col("idx").alias("i0"), *[F.col(n).alias(n + "0") for n in names])
    b = cum.select("ticker", F.col("idx").alias("i1"), *[F.col(n).alias(n + "1") for n in names])
    j = ev.join(b, ["ticker", "i1"]).join(a, ["ticker", "i0"], "left")
    d = {n: F.col(n + "1") - F.coalesce(F.col(n + "0"), F.lit(0)) for n in names}
    slope = F.try_divide(d["c"] * d["sxy"] - d["sx"] * d["sy"], d["c"] * d["sxx"] - d["sx"] * d["sx"])
    out = j.select("event_id", d["c"].alias("n"), slope.alias("beta"), F.try_divide(d["sy"] - slope * d["sx"], d["c"]).alias("alpha")).where("n >= 40")
    return out.select("event_id", "n", F.round("beta", 4).alias("beta"), F.round("alpha", 4).alias("alpha"))


# ---------------------------------------------------------------- prediction


def _features(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    d = _design(spark, sf).where("y is not null").withColumn("label", (F.col("y") > 0).cast("double"))
    d = written(d.select("creator", "label", "score", "log_size", "positive"), "features")  # models pass over it many times
    return VectorAssembler(inputCols=["score", "log_size", "positive"], outputCol="features").transform(d)


@query()
def logistic_holdout(spark, sf):
    """Area under the curve on creators that the model hasn't seen."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    d = _features(spark, sf)
    train, test = d.where("creator % 10 < 7"), d.where("creator % 10 >= 7")
    out = LogisticRegression(regParam=0.01, maxIter=50).fit(train).transform(test)
    auc = BinaryClassificationEvaluator().evaluate(out)
    return spark.createDataFrame([(train.count(), test.count(), float(auc))], "n_train long, n_test long, auc double")


@query()
def forest_importances(spark, sf):
    from pyspark.ml.classification import RandomForestClassifier

    model = RandomForestClassifier(numTrees=30, maxDepth=4, seed=7).fit(_features(spark, sf))
    return spark.createDataFrame([(n, float(v)) for n, v in zip(["score", "log_size", "positive"], model.featureImportances, strict=True)], "feature string, importance double")


@query(f"""WITH {PX}, d AS (SELECT * FROM daily), f AS (SELECT ticker, covar_samp(ret, bret) / var_samp(bret) AS beta FROM d GROUP BY 1) SELECT ticker, round(beta, 5) AS beta FROM f""")
def beta_by_ticker(spark, sf):
    d = returns.with_daily(index(spark, sf)).where("ret is not null and bret is not null")
    return d.groupBy("ticker").agg(F.round(F.covar_samp("ret", "bret") / F.var_samp("bret"), 5).alias("beta"))


@query("""SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(stddev_samp(l_discount), 6) AS sd, round(skewness(l_tax), 2) AS skew FROM lineitem GROUP BY 1""")
def moments(spark, sf):
    n = F.count("l_tax")
    skew = F.skewness("l_tax") * F.sqrt(n * (n - 1)) / (n - 2)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("correlation"), F.round(F.stddev_samp("l_discount"), 6).alias("sd"), F.round(skew, 2).alias("skew"))
