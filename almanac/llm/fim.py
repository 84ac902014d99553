"""Fill-in-middle transformation by look-around splitting.

A grammar says where units of a text end: classes of characters, each of which makes units of one character, units of a
whole run, or goes on into what follows. It becomes a zero-width regex of neighbouring classes, at which Spark's split cuts
without losing a character. Two cuts drawn from a hash of the document's id part a text into prefix, middle and suffix,
which are written with markers in one of two orders, or the text stays plain. All of it is DataFrame expressions on a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import pick

#: A unit of the class is one character; a whole run; or it goes on into whatever follows.
SINGLE, RUN, OPEN = "single", "run", "open"
#: Grammars: classes that part all characters among them, as the inside of a regex's brackets, and how each makes units.
UNITS = {
    "code": (("A-Za-z", RUN), ("^A-Za-z", SINGLE)),  # [A-Za-z]+|[^A-Za-z]
    "char": (("\\s\\S", SINGLE),),
    "word": ((" \\t-\\r", RUN), ("^ \\t-\\r", RUN)),  # [ \t-\r]+|[^ \t-\r]+
    "line": (("\\n", SINGLE), ("^\\n", OPEN)),  # [^\n]*\n|[^\n]+
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def boundary(grammar: tuple) -> str:
    """The regex of the places inside a text where one unit ends and the next begins: what the neighbours of each are."""
    places = []
    for inside, how in grammar:
        outside = inside[1:] if inside.startswith("^") else f"^{inside}"
        if how != OPEN:
            places.append(f"(?<=[{inside}])(?=[{outside if how == RUN else chr(92) + 's' + chr(92) + 'S'}])")
    return "|".join(places)


def units(text: Column, grammar: str = "code") -> Column:
    """The text's units in order, which joined give the text; none for an empty text, which split would take for one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(UNITS[grammar]), -1))


def draws(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """n numbers of 32 bits, at most 8, from the sha256 of seed:id; an id that is null is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def transform(docs: DataFrame, grammar: str = "code", seed: int = 1, plain: int = 10, spm: int = 20, also: dict[str, str] | None = None) -> DataFrame:
    """doc_id, the columns named in `also`, text, n (units), form, prefix, middle and output for each row of docs.

    `plain` of a hundred texts stay as they are, and so do empty ones and those that hold a marker; `spm` of a hundred
    others begin with the suffix. prefix and middle are null in plain rows.

    A null text is an empty one: n 0, form plain. Equal rows and rows that share a doc_id are cut alike, a null doc_id is
    hashed as no digits; no ties arise. A text of any length is cut whole and needs memory in proportion to it. An empty
    table gives an empty table; columns other than doc_id, text and those in `also` take no part."""
    also = also or {}
    docs = pick(docs, doc_id="long", text="string", **{c: t for c, t in also.items() if c not in ("doc_id", "text")})
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(marker))
    form = F.when((text == "") | marked | (h3 % 100 >= 100 - plain), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = docs.select("doc_id", *also, text.alias("text"), units(text, grammar).alias("_units"), form.alias("form"), h1.alias("_h1"), h2.alias("_h2"))
    rows = rows.withColumn("n", F.size("_units").cast("long"))
    a, b = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    rows = rows.withColumns({"_a": F.least(a, b).cast("int"), "_b": F.greatest(a, b).cast("int")})
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start, length), ""))
    rows = rows.withColumns({"prefix": part(F.lit(1), F.col("_a")), "middle": part(F.col("_a") + 1, F.col("_b") - F.col("_a")), "_suffix": part(F.col("_b") + 1, F.col("n").cast("int") - F.col("_b"))})
    spm_text = F.concat(F.lit(SUFFIX), "_suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm_text = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "_suffix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm_text).otherwise(psm_text)
    return rows.select("doc_id", *also, "text", "n", "form", "prefix", "middle", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of some form was made from. No marker can arise where a part meets another's marker, so an
    output that isn't plain holds each marker once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda *places: F.concat(*[F.element_at(parts, k) for k in places])
    return F.when(form == "plain", output).when(form == "spm", at(3, 4, 2)).otherwise(at(2, 4, 3))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hashes of the output and of the text restored from it."""
    out = transform(docs)
    restored = restore(F.col("output"), F.col("form"))
    chars = {f"{c}_chars": F.length(c).cast("long") for c in ("prefix", "middle")}
    return out.select("doc_id", "n", "form", *[v.alias(c) for c, v in chars.items()], F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


#: The cuts and the output anew from matched tokens; restored_sha256 has to be the text's own.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, [('0x' || substr(x, 8 * k + 1, 8))::BIGINT FOR k IN [0, 1, 2, 3]] AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, CASE WHEN a > 0 THEN array_to_string(u[1:a], '') ELSE '' END AS prefix, CASE WHEN b > a THEN array_to_string(u[a + 1:b], '') ELSE '' END AS middle, CASE WHEN n > b THEN array_to_string(u[b + 1:n], '') ELSE '' END AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
