"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The byte-level BPE's file: ALMANAC_BPE, or the public tokenizers' copy."""
    if path := os.environ.get("ALMANAC_BPE"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.llm import lm_bloom

    return lm_bloom.score(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.llm import mixing

    return mixing.digest(table(spark, sf_dir, "documents"))


def op3_dsir(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.llm import dsir

    return dsir.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.llm import host_rules

    return host_rules.digest(table(spark, sf_dir, "documents"))


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.llm import html_blocks

    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op6_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.llm import itq

    return itq.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_skipchain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.llm import skipchain

    return skipchain.find(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.llm import bpe

    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.llm import vptree

    return vptree.digest(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.llm import line_runs

    return line_runs.digest(table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.llm import fim

    return fim.digest(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.llm import hard_negatives

    return hard_negatives.digest(table(spark, sf_dir, "embeddings"))


def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanac.llm import imatch

    return imatch.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_bloom, op2_mixing, op3_dsir, op4_host_rules, op5_html_blocks, op6_itq, op7_skipchain, op8_bpe, op9_simhash_vptree, op10_line_dedup, op11_fim, op12_hard_negatives, op13_imatch)}


def oracle_sql() -> dict[str, str]:
    from almanac.llm import fim, hard_negatives, host_rules, line_runs

    return {"op4_host_rules": host_rules.ORACLE, "op10_line_dedup": line_runs.ORACLE, "op11_fim": fim.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
