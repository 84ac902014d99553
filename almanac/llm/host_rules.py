"""Host-level quality rules, in DataFrame functions alone.

Each document is held against rules. Failures are counted by host; a host's failure rate is shrunk towards the corpus' by
a beta prior fitted to all hosts' rates by their moments, and a host whose shrunk rate is high gives its verdict to its
documents. The host of a document is the column that names where it comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import pick, scratch

WINDOW = 8
#: Verdicts of so many bytes at most are broadcast; if there are more, a host's documents are dealt out over so many tasks.
BROADCAST_BYTES, SALTS = 8 << 20, 32
SPACE = r"[\x20\x09-\x0D]"


def _windows(words: Column) -> Column:
    """A 64-bit hash of each 8-word window, in order."""
    at = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    return F.transform(at, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))


def _covered(windows: Column) -> Column:
    """Words in the windows that occur twice or more: sorted, equal windows are neighbours; the positions of those, in
    order, cover 8 words each, less what the one before covers already."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(sorted_pairs: Column) -> Column:
        n = F.size(sorted_pairs)
        marked = F.transform(
            sorted_pairs,
            lambda p, k: F.when(((k > 0) & (F.get(sorted_pairs, k - 1)["h"] == p["h"])) | ((k < n - 1) & (F.get(sorted_pairs, k + 1)["h"] == p["h"])), p["i"]),
        )
        return F.array_sort(F.array_compact(marked))

    def length(positions: Column) -> Column:
        steps = F.transform(positions, lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(positions, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # an array of one element, transformed, names a value once for all its uses
    named = F.transform(F.array(pairs), repeated)
    return F.element_at(F.transform(named, length), 1)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host and the base measures of docs(doc_id, text, host)."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(F.col("t"), f"{SPACE}+"), "")
    out = docs.select("doc_id", "host", text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select(
        "doc_id",
        "host",
        words.alias("words"),
        F.length(F.regexp_replace("t", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0].alias("n_dup_lines"),
    )
    # windows are hashed once; where all differ, as in most texts, nothing is sorted
    def repeats(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w))

    windows = F.when(F.size("words") >= WINDOW, _windows(F.col("words"))).otherwise(F.array().cast("array<bigint>"))
    return out.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.transform(F.array(windows), repeats)[0].cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def host_verdicts(measured: DataFrame, most_failing: float = 0.5) -> DataFrame:
    """(host_key, host_docs, host_failures, host_rate, host_kept) from measured documents with `fails`.

    The prior beta(a, b) has the mean and variance of the hosts' raw rates, hosts weighing by documents; if they differ no
    more than chance has it, the prior is strong and all rates go to the mean. Rows are summed in each task before the
    shuffle, so a host with a third of all rows is one row for each task there."""
    hosts = measured.groupBy("host_key").agg(F.count("*").alias("host_docs"), F.count_if("fails").alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    m = F.sum("host_failures") / F.sum("host_docs")
    prior = hosts.agg(m.alias("m"), F.count("*").alias("k"), F.sum("host_docs").alias("n"), F.sum(F.col("host_docs") * rate * rate).alias("s2"), F.sum(F.col("host_docs") * F.col("host_docs")).alias("nn"))
    # between-host variance by the method of moments: weighted squares less what binomial noise adds
    squares = F.col("s2") - F.col("n") * F.col("m") * F.col("m")
    noise = (F.col("k") - 1) * F.col("m") * (1 - F.col("m"))
    spread = F.greatest(F.lit(1e-9), F.try_divide(squares - noise, F.greatest(F.lit(1e-9), F.col("n") - F.try_divide(F.col("nn"), F.col("n")) - (F.col("k") - 1))))
    strength = F.greatest(F.lit(1e-3), F.least(F.lit(1e6), F.col("m") * (1 - F.col("m")) / spread - 1))
    prior = prior.select("m", strength.alias("s"))
    joined = hosts.crossJoin(F.broadcast(prior))  # one row
    shrunk = (F.col("host_failures") + F.col("m") * F.col("s")) / (F.col("host_docs") + F.col("s"))
    return joined.select("host_key", "host_docs", "host_failures", shrunk.alias("host_rate"), (shrunk <= most_failing).alias("host_kept"))


def with_verdicts(measured: DataFrame, verdicts: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """measured with its host's verdict. No task gets a host whole."""
    size = verdicts.agg(F.coalesce(F.sum(F.octet_length("host_key") + 40), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        return measured.join(F.broadcast(verdicts), "host_key", "left")
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return measured.withColumn("salt", salt).join(salted, ["host_key", "salt"], "left").drop("salt")


def judge(docs: DataFrame, host: str = "source", most_failing: float = 0.5) -> DataFrame:
    """The measures, base_failed, the host's figures and kept for each row of docs(doc_id, text, host column).

    A document is kept unless it fails a rule itself or its host's shrunk failure rate is above most_failing; a rate that
    ties with it stays. Null and empty texts have no words and fail; very long ones are measured whole. Documents of a null
    host are one host. Repeated rows count one by one. An empty table gives an empty table; further columns take no part."""
    docs = pick(docs, doc_id="long", text="string", **{host: "string"}).withColumnRenamed(host, "host")
    measured = measures(docs).withColumn("host_key", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n")))
    measured = measured.withColumn("fails", base_failed())
    measured = scratch(measured, "measured")  # texts are read once, for the hosts and for the documents
    verdicts = scratch(host_verdicts(measured, most_failing), "verdicts")
    out = with_verdicts(measured, verdicts)
    return out.withColumn("base_failed", F.col("fails")).withColumn("kept", ~F.col("fails") & F.col("host_kept"))


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same result in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, hash(ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4], ws[i+5], ws[i+6], ws[i+7]) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(i - p, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS x FROM f GROUP BY source),
p AS (SELECT sum(x) / sum(n)::DOUBLE AS m, count(*) AS k, sum(n)::DOUBLE AS n, sum(n * (x / n::DOUBLE) * (x / n::DOUBLE)) AS s2, sum(n * n)::DOUBLE AS nn FROM h),
q AS (SELECT m, greatest(1e-3, least(1e6, m * (1 - m) / greatest(1e-9, (s2 - n * m * m - (k - 1) * m * (1 - m)) / greatest(1e-9, n - nn / n - (k - 1))) - 1)) AS s FROM p),
v AS (SELECT source, (x + m * s) / (n + s) <= 0.5 AS host_kept FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
