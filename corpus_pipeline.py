"""A training corpus from ``documents``: quality rules, line dedup, near-duplicate join, benchmark
decontamination, tokens.  Each stage is written as Parquet in the shared folder and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelquilt.llm import bpe, decontaminate, line_dedup, partenum, quality_rules
from pixelquilt.llm.common import materialize, read_table, release

#: Near duplicates: shingles of five words, Jaccard similarity 80/100 or more.
SHINGLE, NUM, DEN = 5, 80, 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are similar to an earlier one."""
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return partenum.keep_one(docs, size=SHINGLE, num=NUM, den=DEN)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, token_ids) of every document."""
    out = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ids="token_ids")
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("decontaminate", benchmark), ("bpe", tokens)]

#: SQL can't express the tokenizer; the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark)
    return docs
