"""The corpus pipeline: documents pass the quality classifier, line dedup, SimHash near-dedup, mixing and BPE encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import bpe, dsir, line_runs, mixing, vptree
from almanac.llm.common import pick, scratch
from almanac.llm.queries import table, tokenizer_path

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
ALSO = {c: t for c, t in COLUMNS.items() if c != "doc_id"}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. A null or empty text has the weight 0; a very long one weighs by all its words.
    Repeated rows, and rows that tie with the last one kept, are kept or go together. Without labels of both kinds all are
    kept. An empty table stays empty; further columns take no part."""
    return dsir.resample(docs, table(spark, sf_dir, "labels"), also=ALSO).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows. A null text is an empty line, which stays, and comes back as an
    empty text; very long texts and lines are taken whole. A repeated line stays in the smallest doc_id that holds it;
    rows of one doc_id count as one document, and one without doc_id owns and loses nothing. An empty table stays empty;
    further columns take no part."""
    also = {c: t for c, t in ALSO.items() if c not in ("text", "n_chars")}
    out = line_runs.dedup_lines(docs, also=also)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; of rows that share it, the one whose columns are smallest in
    order. Rows without a doc_id stay. Null and empty texts are one group, very long ones are taken whole. An empty table stays
    empty; further columns take no part."""
    kept = vptree.near_duplicates(docs).where("doc_id = component_id").select("doc_id")
    docs = pick(docs, **COLUMNS)
    rows = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    one = rows.groupBy("doc_id").agg(F.min(F.struct(*ALSO)).alias("row")).select("doc_id", "row.*")
    return one.unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it leaves out go, those that it takes twice come twice. Null and empty texts have the size 0 and
    come as often as their source is passed over; null sources are one source; texts of one length tie, and a seeded hash
    decides; a very long one is a length of its own. An empty table stays empty; further columns take no part."""
    return mixing.mixed(docs, ALSO).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and what they decode to as a hash. A null text is an empty one and has no ids; a very long one is
    encoded whole; equal rows come back equal. An empty table stays empty; further columns take no part."""
    return bpe.encode(docs, tokenizer_path(), also={"source": "string"})


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing to target weights", mix), ("BPE encoding", encode)]

#: SQL has no form of the classifier, the fingerprints, the fitted mix and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and reread as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch(docs, name.replace(" ", "-"))
    return docs
