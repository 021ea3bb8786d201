"""Operator 4, packing: concatenate and cut, by two-pass prefix sums and fixed windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillmesh.llm.common import TOKEN_SLICE_BYTES, doc_columns, partition_offsets, read_table, slices, stage_table, tidy
from quillmesh.llm.wordcache import split_ids, tokenizer_cache

SEQUENCE, END_ID, TOKENIZER = 2048, 1, "byte_bpe_50k.json"


def token_rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, part, part_start (ids before the document in its partition), ids (little-endian unsigned 32-bit, end id last)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, at = tokenizer_cache(tokenizer, spaced=True), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text", TOKEN_SLICE_BYTES):
                ids = [x + end for x in split_ids(*cache.encode(piece.column("text")))]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(len(ids), part, np.int64)), pa.array(starts), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "part_start", "ids"],
                )

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "part", "part_start")] + [T.StructField("ids", T.BinaryType())])
    return doc_columns(docs).mapInArrow(tidy(run, (tokenizer, True, "<u4")), schema)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences of ``size`` ids: doc_id, start, length, ids (bytes), ids_crc32, doc_tokens, sequence_id, offset.

    First pass: every partition encodes its documents once and writes ids with running totals. Second pass: the
    partitions' totals (a row each) are summed to offsets of one global stream, which is cut at multiples of ``size``;
    a document that crosses a cut has a piece on either side. Only the last sequence is not full. A null or empty text
    is its end id alone. Repeated and null ids are documents like others; an empty table gives no pieces.
    """
    import public_tokenizers

    rows = stage_table(token_rows(docs, tokenizer or public_tokenizers.path(TOKENIZER), end_id), "packing-ids")
    n = F.expr("cast(octet_length(ids) div 4 as bigint)")
    rows = rows.withColumn("doc_tokens", n)
    totals = rows.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    placed = rows.join(F.broadcast(partition_offsets(totals, "part", "total")), "part")  # a row for each task of the first pass
    placed = placed.withColumn("g", F.col("offset") + F.col("part_start")).select("doc_id", "ids", "doc_tokens", "g")
    cut = F.expr(
        f"""transform(sequence(g div {size}, (g + doc_tokens - 1) div {size}), w -> named_struct(
            'sequence_id', w, 'start', greatest(0L, w * {size}L - g),
            'length', least(doc_tokens, (w + 1) * {size}L - g) - greatest(0L, w * {size}L - g)))"""
    )
    full = F.expr("transform(cuts, c -> named_struct('c', c, 'piece', substring(ids, cast(4 * c.start + 1 as int), cast(4 * c.length as int))))")
    pieces = placed.withColumn("cuts", cut).select("doc_id", "doc_tokens", "g", F.inline(full))
    return pieces.select(
        "doc_id",
        F.col("c.start").alias("start"),
        F.col("c.length").alias("length"),
        F.col("piece").alias("ids"),
        F.crc32("piece").alias("ids_crc32"),
        "doc_tokens",
        F.col("c.sequence_id").alias("sequence_id"),
        F.expr(f"g + c.start - c.sequence_id * {size}L").alias("offset"),
    )


def piece_digests(docs: DataFrame) -> DataFrame:
    """:func:`pack` without the ids themselves; nulls, repeats and empty tables as there."""
    return pack(docs).drop("ids")


def op4_concat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, null texts as their end id alone."""
    return piece_digests(read_table(spark, sf_dir, "documents"))
