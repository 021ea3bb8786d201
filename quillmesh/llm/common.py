"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillmesh.runtime import remove, shared_dir, ship

#: Text bytes that one call of a batch function gets at most, unless one text alone is longer.
SLICE_BYTES = 1 << 20
#: The same for tokenizers: longer slices repeat more of their words.
TOKEN_SLICE_BYTES = 4 << 20
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: What one Python worker keeps between tasks: the state of the operator that ran last in it, and no other's.
_state: dict[Any, Any] = {}


def trim() -> None:
    """Give memory that a task has freed back to the system: a worker lives on, beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def worker_state(key: Any, make: Callable[[], Any]) -> Any:
    """The state that ``make`` builds, kept in this worker until another operator asks for its own."""
    if key not in _state:
        _state.clear()
        trim()
        _state[key] = make()
    return _state[key]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], key: Any = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``: it starts without other operators' state (but that of ``key``) and ends by :func:`trim`."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _state:
            _state.clear()
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def prepare(spark: SparkSession) -> None:
    """Ship the package, which also bounds Arrow batches."""
    ship(spark)


def drop_staged(df: DataFrame | None) -> None:
    """Remove a staged table that nothing reads any more."""
    path = getattr(df, "_qm_path", None)
    if path:
        remove(df.sparkSession, path)


def stage_table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage is cut, lost executors cost nothing.

    The write's shuffle files go when it ends, since nothing reads them again; the table goes when the session ends
    or by :func:`drop_staged`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmesh-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    atexit.register(remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._qm_path = path
    return back


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` so that ``column`` holds about ``limit`` bytes in each part."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def add_columns(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    work: Callable[[pa.RecordBatch], list],
    drop_input: bool = False,
    limit: int = SLICE_BYTES,
    keep: str | None = None,
    state: Any = None,
) -> DataFrame:
    """Append ``fields`` computed by ``work`` from Arrow slices of ``df``.

    ``drop_input`` leaves ``column`` out of the result. ``keep`` names an appended boolean field: only rows
    where it is true pass, and no appended field is returned. Appended names must not be among the input's.
    ``state`` is the key of the worker's state that ``work`` uses.
    """
    prepare(df.sparkSession)
    kept = [f for f in df.schema.fields if not (drop_input and f.name == column)]
    out = T.StructType(kept if keep else kept + fields)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                made = work(part)
                base = [part.column(f.name) for f in kept]
                if keep:
                    mask = made[names.index(keep)]
                    yield pa.RecordBatch.from_arrays(base, [f.name for f in kept]).filter(pa.array(mask, pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays(base + made, [f.name for f in kept] + names)

    return df.mapInArrow(tidy(run, state), out)


def doc_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, under fixed names, so that extra columns can't clash."""
    prepare(docs.sparkSession)
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partition_offsets(counts: DataFrame, part: str, total: str) -> DataFrame:
    """(part, offset): exclusive prefix sums of one total per partition. One row per partition goes to one task."""
    from pyspark.sql import Window

    order = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(part, F.coalesce(F.sum(total).over(order), F.lit(0)).alias("offset"))
