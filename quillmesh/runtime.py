"""Session helpers: shipping this package to executors, tables staged in the folder that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch between the JVM and Python, for both of which it is held whole.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES where the session allows more: else long texts come 10,000 at once."""
    held = spark.conf.get(_BATCH, None)
    if held is None or not held.rstrip("bB").isdigit() or not 0 < int(held.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Bound Arrow batches, and give the package to executors, once per application, unless their PYTHONPATH holds it already."""
    bound_batches(spark)
    context = spark.sparkContext
    root = Path(__file__).resolve().parent
    on_path = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if context.applicationId in _shipped or root.parent in on_path:
        return
    archive = Path(tempfile.mkdtemp(prefix="quillmesh-code-")) / "quillmesh.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one takes a temporary folder, a cluster raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if context.master.startswith("local-cluster") or not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillmesh-"))
    return context.getCheckpointDir().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder then stays for the cluster's own cleaning
        pass


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a write's shuffle files go when it ends: nothing reads them again."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut, and a lost executor costs no more than one stage.

    The table goes when the session ends.
    """
    path = f"{shared_dir(df.sparkSession)}/quillmesh-{name}-{uuid.uuid4().hex}"
    with tidy_shuffles(df.sparkSession):
        df.write.parquet(path)
    atexit.register(remove, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
