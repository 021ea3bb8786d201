"""From raw documents to packed sequences: language ID, quality rules, line dedup, near dedup, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmesh.llm import language, lines, neardup, packing, quality
from quillmesh.llm.common import read_table, stage_table

#: A document goes if its best language has a lower share than this.
MIN_LANGUAGE_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language, by a model of the labelled rows of ``docs``; null and letterless texts go."""
    return language.keep_known(docs, language.train(docs), min_score=MIN_LANGUAGE_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word-count and repetition rules."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their text less lines that repeat an earlier line; n_chars follows the text."""
    columns = docs.columns
    out = lines.dedup_lines(docs)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word Jaccard of 0.8 or more, by SimHash balls and then prefixes): that of the least doc_id."""
    return neardup.keep_one_similar(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.piece_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

#: A model fit, near duplicates and tokenizers are beyond SQL: a test holds the rows of ``run`` against plain Python stages
#: (which share the fit, the prediction and the tokenizer with them).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage_table(docs, name)
    return docs
