"""A search index that is kept up to date: generations of postings, tombstones, merges by size, statistics as sums.

A change (segments put in, replaced or taken out) is one generation: postings of the new texts, dealt to the buckets of
their terms, and tombstones of the segments whose older postings no longer count. No older file is touched. A bucket whose
files of one tier are FANOUT many is merged into one file of the next tier, without what tombstones have ended; other
buckets stay as they are. A manifest names the files that count, so readers see a generation whole or not at all.
"""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillmesh.operators.fts import BUCKETS, Index, n_tokens, postings, write_buckets
from quillmesh.runtime import remove, shared_dir, stage

#: Files of a tier in a bucket that are merged into one.
FANOUT = 4
#: Buckets that are merged at a time: beside the files that count, no more than their new ones are on disk.
_MERGED = 32
#: Marks that tell ids which no tombstone names, as a power of two: a table of 2^18 rows at most, whatever the data.
_MARK_BITS = 24
_MANIFEST = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("kind", "bucket", "gen", "tier")), *(T.StructField(c, T.LongType()) for c in ("n", "size"))])
_POSTINGS, _SEGMENTS, _DEAD, _SUMS = 0, 1, 2, 3
_NAMES = {_POSTINGS: "postings", _SEGMENTS: "segments", _DEAD: "dead"}


@dataclass(frozen=True)
class Live:
    """An index at one version of its manifest: ``n`` segments of ``size`` tokens in all; ``files`` has (kind, bucket, gen, tier), some for each bucket, whatever the data."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    version: int
    files: tuple[tuple[int, int, int, int], ...]
    n: int = 0
    size: int = 0

    def generation(self) -> int:
        return max((f[2] for f in self.files), default=0)


def _bucket_of_term():
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def _bucket_of_id():
    return F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")


def _folder(live: Live, kind: int, gen: int) -> str:
    return f"{live.path}/{_NAMES[kind]}/gen={gen}"


def _read(live: Live, kind: int, files: list[tuple[int, int, int, int]], schema: str) -> DataFrame:
    """The rows of some files with their bucket and gen."""
    if not files:
        return live.spark.createDataFrame([], f"{schema}, bucket int, gen int")
    base = f"{live.path}/{_NAMES[kind]}"
    return live.spark.read.schema(f"{schema}, bucket int, gen int").option("basePath", base).parquet(*(f"{base}/gen={g}/bucket={b}" for _, b, g, _ in files))


_POSTING, _SEGMENT = "term string, id long, ordinal long, size int, places array<bigint>", "id long, ordinal long, size int"


def _of(live: Live, kind: int) -> list[tuple[int, int, int, int]]:
    return [f for f in live.files if f[0] == kind]


def _write(live: Live, kind: int, gen: int, rows: DataFrame, sort: list[str]) -> list[tuple[int, int, int, int]]:
    """Write rows by bucket as one generation; the files' buckets. Postings are written where they are made; the bucket of other
    rows, which are short, is dealt to several tasks by segment."""
    if kind != _POSTINGS:
        parts = int(live.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(parts, "bucket", F.pmod(F.xxhash64("id", "ordinal"), F.lit(max(1, parts // 8)))).sortWithinPartitions("bucket", *sort)
    write_buckets(rows, _folder(live, kind, gen), "overwrite")
    schema = T.StructType([*rows.schema.fields])
    found = live.spark.read.schema(schema).parquet(_folder(live, kind, gen)).select("bucket").distinct().collect()  # BUCKETS rows at most
    return [(kind, r["bucket"], gen, 0) for r in found]


def _sums(live: Live, kind: int, gen: int, made: list) -> tuple[int, int]:
    """Segments and tokens of what a generation wrote."""
    files = [f for f in made if f[0] == kind and f[2] == gen]
    row = _read(live, kind, files, _SEGMENT).agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def _commit(live: Live, files: list[tuple[int, int, int, int]], n: int, size: int) -> Live:
    """The next version: one small file, which counts once its write has ended. What a failed write left there goes."""
    version = live.version + 1
    done = live.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{live.path}/manifest/v={version}/_SUCCESS")
    if done.getFileSystem(live.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        raise RuntimeError("another change of this index came first")
    rows = [(*f, None, None) for f in sorted(files)] + [(_SUMS, 0, 0, 0, n, size)]
    live.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{live.path}/manifest/v={version}")
    return Live(live.spark, live.path, live.columns, version, tuple(sorted(files)), n, size)


def create(spark: SparkSession, columns: tuple[str, ...] = ("text",), path: str | None = None) -> Live:
    """An empty index under ``path``, or in the shared folder until the session ends."""
    if path is None:
        path = f"{shared_dir(spark)}/quillmesh-live-{uuid.uuid4().hex}"
        atexit.register(remove, spark, path)
    return _commit(Live(spark, path, tuple(columns), -1, ()), [], 0, 0)


def open_live(spark: SparkSession, path: str, columns: tuple[str, ...] = ("text",)) -> Live:
    """The index at its last whole version."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    files = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/v={max(found)}").collect()
    total = next(r for r in files if r["kind"] == _SUMS)
    return Live(spark, path, tuple(columns), max(found), tuple(sorted(tuple(r)[:4] for r in files if r["kind"] != _SUMS)), total["n"], total["size"])


def _ended(live: Live) -> DataFrame:
    """(id, ordinal, ended): the last generation that took out or replaced each segment."""
    return _read(live, _DEAD, _of(live, _DEAD), _SEGMENT).groupBy("id", "ordinal").agg(F.max("gen").alias("ended"))


def _alive(rows: DataFrame, ended: DataFrame) -> DataFrame:
    """Rows that no later generation has ended; those of its own replace older ones."""
    # a hash table of what has ended: the many rows beside it are not sorted
    e = ended.select(F.col("id").alias("__id"), F.col("ordinal").alias("__ordinal"), "ended").hint("shuffle_hash")
    gone = (F.col("id") == F.col("__id")) & (F.col("ordinal") == F.col("__ordinal")) & (F.col("gen") < F.col("ended"))
    return rows.join(e, gone, "left_anti")


def _marked(rows: DataFrame, ended: DataFrame) -> DataFrame:
    """``rows`` with __may: false where no tombstone has the id. By a bit for the hash of each id, in words of 64 that are broadcast."""
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << _MARK_BITS))
    bit = F.expr("shiftleft(1L, cast(__mark & 63 as int))")
    words = ended.select(mark.alias("__mark")).groupBy(F.shiftright("__mark", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    met = rows.withColumn("__mark", mark).withColumn("__at", F.shiftright("__mark", 6)).join(F.broadcast(words), F.col("__at") == F.col("__word"), "left")
    return met.withColumn("__may", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).select(*rows.columns, "__may")


def _alive_here(rows: DataFrame, ended: DataFrame) -> DataFrame:
    """:func:`_alive` for many rows of which few have ended: those whose id no tombstone names stay where they are, the others meet the tombstones."""
    marked = _marked(rows, ended)
    return marked.where("NOT __may").drop("__may").unionByName(_alive(marked.where("__may").drop("__may"), ended))


def _once(put: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``put`` with each key once, with its greatest texts. Keys are counted without texts; only texts of repeated keys are gathered."""
    key = ["id", "ordinal"]
    again = stage(put.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key), "repeated-keys")
    if again.isEmpty():
        return put
    greatest = put.join(again, key, "left_semi").groupBy(*key).agg(F.max(F.struct(*columns)).alias("x")).select(*key, "x.*")
    return put.join(again, key, "left_anti").unionByName(greatest)


def _spread(put: DataFrame) -> DataFrame:
    """``put`` where it is; dealt by key if it comes in fewer parts than there are cores (one row group is one task)."""
    return put if put.rdd.getNumPartitions() >= put.sparkSession.sparkContext.defaultParallelism else put.repartition("id", "ordinal")


def segments(live: Live) -> DataFrame:
    """id, ordinal, size, gen of the segments that count."""
    return _alive(_read(live, _SEGMENTS, _of(live, _SEGMENTS), _SEGMENT), _ended(live)).drop("bucket")


def apply(live: Live, put: DataFrame | None = None, taken: DataFrame | None = None) -> Live:
    """A generation more: ``put`` (id, ordinal and the columns) comes in or replaces, ``taken`` (id, and ordinal unless all of the id's) goes.

    A key in both is put. Rows that repeat a key count once, with the greatest texts; rows without id or ordinal are left out.
    Tombstones are written for keys that were there, found in the buckets of the segments' ids. What is neither put nor taken
    is not read but for these keys, and nothing is rewritten.
    """
    gen, files = live.generation() + 1, list(live.files)
    old = segments(live).select("id", "ordinal", "size")
    ends = None
    if put is not None:
        keys = [F.col("id").cast("long").alias("id"), F.col("ordinal").cast("long").alias("ordinal")]
        put = put.select(*keys, *(F.col(c).cast("string").alias(c) for c in live.columns)).where("id IS NOT NULL AND ordinal IS NOT NULL")
        put = _once(put, live.columns)
        ends = put.select("id", "ordinal")
    if taken is not None:
        by = ["id", "ordinal"] if "ordinal" in taken.columns else ["id"]
        gone = old.join(taken.select(*(F.col(c).cast("long").alias(c) for c in by)).distinct(), by, "left_semi").select("id", "ordinal")
        ends = gone if ends is None else ends.unionByName(gone)
    if ends is None:
        return live
    made, more = [], (0, 0)
    if live.n:
        ends = old.join(ends.distinct(), ["id", "ordinal"], "left_semi").withColumn("bucket", _bucket_of_id())
        made = _write(live, _DEAD, gen, ends, ["id", "ordinal"])
    less = _sums(live, _DEAD, gen, made)
    if put is not None:
        put = _spread(put)
        rows = postings(put, live.columns).select("term", "id", "ordinal", "size", "places", _bucket_of_term().alias("bucket"))
        made += _write(live, _POSTINGS, gen, rows, ["term", "id", "ordinal"])
        size = sum((n_tokens(c) for c in live.columns), F.lit(0)).cast("int").alias("size")
        made += _write(live, _SEGMENTS, gen, put.select("id", "ordinal", size, _bucket_of_id().alias("bucket")), ["id", "ordinal"])
        more = _sums(live, _SEGMENTS, gen, made)
    return _commit(live, files + made, live.n - less[0] + more[0], live.size - less[1] + more[1])


def merge(live: Live, fanout: int = FANOUT, tidy: bool = False) -> Live:
    """Merge each bucket's files of a tier where they are ``fanout`` or more, until no tier has so many.

    _MERGED buckets at a time, a version each; ``tidy`` vacuums after each, so that the index is on disk once and a part of it twice.

    A merged file counts as of its youngest generation: what tombstones have ended is gone from it, so none is forgotten.
    Tombstones older than all other files are dropped. The files merged stay on disk until :func:`vacuum`.
    """
    while True:
        groups: dict[tuple[int, int, int], list] = {}
        for f in live.files:
            if f[0] != _DEAD:
                groups.setdefault((f[0], f[1], f[3]), []).append(f)
        due = {k: v for k, v in groups.items() if len(v) >= fanout}
        if not due:
            return live
        # the least buckets, each with its lowest tier that is due
        chosen = sorted({k[1] for k in due})[:_MERGED]
        due = {k: v for k, v in due.items() if k[1] in chosen}
        files, ended = list(live.files), stage(_ended(live), "ended")
        gen = live.generation() + 1
        # of all buckets that are due, those whose youngest generation is the same go together
        for kind, schema, sort in ((_POSTINGS, _POSTING, ["term", "id", "ordinal"]), (_SEGMENTS, _SEGMENT, ["id", "ordinal"])):
            own = {b: v for (k, b, _), v in sorted(due.items()) if k == kind}
            if not own:
                continue
            alive = _alive_here if kind == _POSTINGS else _alive
            rows = alive(_read(live, kind, [f for v in own.values() for f in v], schema), ended).drop("gen")
            tiers = {b: v[0][3] + 1 for b, v in own.items()}
            made = _write(live, kind, gen, rows, sort)
            files = [f for f in files if f not in {x for v in own.values() for x in v}] + [(k, b, g, tiers[b]) for k, b, g, _ in made]
        oldest = min((f[2] for f in files if f[0] != _DEAD), default=gen)
        live = _commit(live, [f for f in files if f[0] != _DEAD or f[2] > oldest], live.n, live.size)
        if tidy:
            vacuum(live)


def vacuum(live: Live) -> list[str]:
    """Remove folders that this version does not name (older versions can't be opened any more); their names."""
    jvm = live.spark.sparkContext._jvm
    named = {f"{_NAMES[k]}/gen={g}/bucket={b}" for k, b, g, _ in live.files} | {f"manifest/v={live.version}"}
    root = jvm.org.apache.hadoop.fs.Path(live.path)
    fs = root.getFileSystem(live.spark.sparkContext._jsc.hadoopConfiguration())
    listed = lambda p: [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    gone = []
    for kind in _NAMES.values():
        for g in listed(jvm.org.apache.hadoop.fs.Path(root, kind)):
            for b in listed(g):
                name = f"{kind}/{g.getName()}/{b.getName()}"
                if b.getName().startswith("bucket=") and name not in named:
                    fs.delete(b, True)
                    gone.append(name)
    for v in listed(jvm.org.apache.hadoop.fs.Path(root, "manifest")):
        if f"manifest/{v.getName()}" not in named:
            fs.delete(v, True)
            gone.append(f"manifest/{v.getName()}")
    return sorted(gone)


def index(live: Live) -> Index:
    """The index as queries read it: postings that count, and statistics from the sums that the manifest keeps."""
    rows = _alive(_read(live, _POSTINGS, _of(live, _POSTINGS), _POSTING), _ended(live))
    stats = live.spark.createDataFrame([(live.n, live.size / live.n if live.n else None)], "N long, avgdl double")
    return Index(rows.drop("gen"), stats, live.columns)
