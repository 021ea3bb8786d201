"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quillmesh.llm import bpe, classifier, gif, language, lines, names, neardup, packing, pages, quality, sharding, tokenfile, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        quality.op1_quality_rules,
        tokenfile.op2_token_file,
        pages.op3_html_main_text,
        packing.op4_concat_packing,
        neardup.op5_simhash_neardup,
        gif.op6_gif_media,
        language.op7_language_id,
        lines.op8_line_dedup,
        bpe.op9_byte_bpe,
        sharding.op10_kd_sharding,
        names.op11_edit_name_join,
        classifier.op12_quality_classifier,
        trie.op13_conversation_trie,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.ORACLE, "op11_edit_name_join": names.ORACLE, "op13_conversation_trie": trie.ORACLE}
