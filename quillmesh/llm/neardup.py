"""Operator 5, SimHash near duplicates by meet-in-the-middle ball hashing, and the pipeline's exact Jaccard stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from quillmesh.llm.common import add_columns, doc_columns, drop_staged, prepare, read_table, slices, stage_table, tidy
from quillmesh.llm.components import components

RADIUS, SEED, SHINGLE = 2, 42, 3
#: The pipeline's stage: words of a shingle, least Jaccard similarity in tenths, counters of the shingle sketch.
STAGE_SHINGLE, TENTHS, COUNTERS = 5, 8, 1 << 17
#: Slots of sets by hash, and how many of them take part in each round of pairs; the last round has all.
SLOTS = 16
ROUNDS = (1, SLOTS)
#: Bits of a set's parity mask, 64 a column: bit k tells whether the set has an odd number of shingles whose hash falls on k.
PARITY = ("p0", "p1", "p2", "p3")
#: Shingle sets that one task remembers, so that most copies make no rows twice.
REMEMBERED = 1 << 17
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 values of all word shingles, repeats included; 0 without words."""
    return majority(shingle_hashes(text, shingle, seed))


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits set in over half of ``hashes``; 0 without any."""
    if not len(hashes):
        return 0
    bits = np.zeros(64, np.int64)
    values = np.array(hashes, ">u8").view(np.uint8)
    for at in range(0, len(values), 8 << 16):
        bits += np.unpackbits(values[at : at + (8 << 16)]).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> list[int]:
    """XXH64 values of all word shingles, repeats included; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    return [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(first, ends[size - 1 :].tolist(), strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long; null and wordless texts have 0."""

    def work(part: pa.RecordBatch) -> list:
        return [pa.array([_signed(simhash(t, shingle, seed)) for t in part.column("text").to_pylist()], pa.int64())]

    return add_columns(doc_columns(docs, key, text), "text", [T.StructField("fp", T.LongType())], work, drop_input=True)


def ball(radius: int) -> list[int]:
    """All 64-bit masks with at most ``radius`` bits set."""
    masks, layer = [0], [(0, 0)]
    for _ in range(radius):
        layer = [(m | 1 << b, b + 1) for m, low in layer for b in range(low, 64)]
        masks += [m for m, _ in layer]
    return masks


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) with a < b: links that connect all distinct fingerprints of ``fps`` at ``radius`` or fewer differing bits.

    Two values that close have a common variant within half the radius (rounded up) of each. A bucket of variants
    holds at most as many distinct fingerprints as the ball has masks, whatever the data. For an even radius all
    in a bucket are linked to each other, so links to its least member are enough; an odd radius pairs the bucket.
    """
    masks = F.array(*(F.lit(_signed(m)) for m in ball((radius + 1) // 2)))
    # every row becomes as many as the ball has masks, so few small partitions would make few large tasks
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    if radius % 2 == 0:
        lowest = variants.groupBy("variant").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n"), F.collect_list("fp").alias("fps"))
        pairs = lowest.where("n > 1").select("a", F.explode("fps").alias("b"))
    else:
        lowest = variants.groupBy("variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        pairs = lowest.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return pairs.where((F.col("a") < F.col("b")) & close).distinct()


def _classes(marked: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, class, component_id) of the distinct fingerprints of ``marked``; class is the least reachable over ``found``."""
    heads = marked.groupBy("fp").agg(F.min("doc_id").alias("head"))
    members = components(stage_table(found, "links"), "a", "b")  # only of fingerprints that have links
    grouped = heads.join(members, heads.fp == members.node, "left").select("fp", "head", F.coalesce("component", "fp").alias("class"))
    least = grouped.groupBy("class").agg(F.min("head").alias("component_id"))
    return grouped.join(least, "class").select("fp", "class", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: a row per input row.

    component_id is the least doc_id reachable over links. Copies share a fingerprint and are pre-aggregated: only
    distinct fingerprints are compared. Rows with a null doc_id get the least non-null id of their component, or null.
    """
    marked = stage_table(fingerprints(docs, key, text), "fingerprints")
    out = marked.join(_classes(marked, fingerprint_links(marked.select("fp").distinct(), radius)).select("fp", "component_id"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _marked(docs: DataFrame, key: str, text: str, mark: Callable[[str | None], int]) -> DataFrame:
    """(doc_id, h, fp): a hash of the text and its fingerprint by ``mark``, a row per input row."""

    def work(part: pa.RecordBatch) -> list:
        return [pa.array([_signed(mark(t)) for t in part.column("text").to_pylist()], pa.int64())]

    rows = doc_columns(docs, key, text).select("doc_id", F.xxhash64("text").alias("h"), "text")
    return stage_table(add_columns(rows, "text", [T.StructField("fp", T.LongType())], work, drop_input=True), "fingerprints")


def _survivors(docs: DataFrame, key: str, text: str, marked: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class: that of the least doc_id (nulls last), then the least text hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first")
    by_fp = marked.groupBy("fp").agg(first)
    heads = by_fp.join(classes.select("fp", "class"), "fp").groupBy("class").agg(F.min("first").alias("first"))
    heads = heads.select(F.col("class").alias("__qm_class"), F.col("first.doc_id").alias("__qm_id"), F.col("first.h").alias("__qm_head"))
    rows = docs.withColumn("__qm_h", F.xxhash64(docs[text].cast("string")))
    rows = rows.join(heads, (F.col("__qm_h") == F.col("__qm_head")) & rows[key].cast("long").eqNullSafe(F.col("__qm_id")))
    order = Window.partitionBy("__qm_class").orderBy("__qm_h")  # copies of a row that repeat its id
    return rows.withColumn("__qm_rank", F.row_number().over(order)).where("__qm_rank = 1").select(*docs.columns)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row, all columns, of each near-duplicate component of ``docs``: that of the least doc_id.

    Components are of texts, so rows that repeat a doc_id with other texts each count in their own.
    """
    marked = _marked(docs, key, text, simhash)
    links = fingerprint_links(marked.select("fp").distinct(), radius)
    return _survivors(docs, key, text, marked, _classes(marked, links))


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes of the pipeline's stage, ascending."""
    return np.unique(np.array(shingle_hashes(text, STAGE_SHINGLE), np.uint64))


def _set_key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def parity(found: np.ndarray) -> np.ndarray:
    """The set's parity mask as a signed number for each column of PARITY."""
    at = (found & np.uint64(64 * len(PARITY) - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * len(PARITY)) & 1).view(np.int64)


def _marked_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, h, fp, simhash, parity mask): a hash of the text, and key, SimHash fingerprint and mask of its shingle set, a row per input row."""

    def work(part: pa.RecordBatch) -> list:
        sets = [shingle_set(t) for t in part.column("text").to_pylist()]
        masks = np.array([parity(x) for x in sets], np.int64).reshape(-1, len(PARITY))
        prints = [_signed(majority(x)) for x in sets]
        return [pa.array([_signed(_set_key(x)) for x in sets], pa.int64()), pa.array(prints, pa.int64()), *(pa.array(masks[:, k].copy()) for k in range(len(PARITY)))]

    rows = doc_columns(docs, key, text).select("doc_id", F.xxhash64("text").alias("h"), "text")
    fields = [T.StructField(name, T.LongType()) for name in ("fp", "simhash", *PARITY)]
    return stage_table(add_columns(rows, "text", fields, work, drop_input=True), "fingerprints")


def _ball_pairs(marked: DataFrame) -> DataFrame:
    """(a, b) with a < b: sets of one SimHash fingerprint with the least of them, and the least sets of fingerprints that :func:`fingerprint_links` links."""
    of = marked.select("simhash", "fp").distinct()
    of = stage_table(of.join(of.groupBy("simhash").agg(F.min("fp").alias("least")), "simhash"), "prints")
    same = of.where("fp > least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    heads = of.where("fp = least").select("simhash", "fp")
    links = fingerprint_links(heads.select(F.col("simhash").alias("fp")))
    ends = links.join(heads.select(F.col("simhash").alias("a"), F.col("fp").alias("x")), "a").join(heads.select(F.col("simhash").alias("b"), F.col("fp").alias("y")), "b")
    return same.unionByName(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def _counter(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(47)).astype(np.int64)


def shingle_sketch(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rows by counter of shingle hashes: COUNTERS numbers, whatever the data. They order shingles and decide nothing."""
    chunks = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                np.add.at(total, _counter(shingle_set(t)), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), pa.array([x.tobytes() for x in total.reshape(chunks, -1)], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    prepare(docs.sparkSession)
    parts = docs.select(docs[text].cast("string").alias("text")).mapInArrow(tidy(count), "chunk int, counts binary")
    out = np.zeros((chunks, COUNTERS // chunks), np.int64)
    for r in parts.repartition(chunks, "chunk").mapInArrow(tidy(add), "chunk int, counts binary").collect():
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def jaccard_links(docs: DataFrame, marked: DataFrame, text: str = "text") -> DataFrame:
    """(a, b) with a < b: links that connect all distinct shingle sets, by key, whose Jaccard similarity is TENTHS / 10 or more.

    First SimHash: pairs that ball hashing finds by the sets' fingerprints are verified on whole sets, and those that are
    close make classes. An exact prefix join finds the links that fingerprints miss. In any one order of shingles, two such sets meet in the first n - ceil(0.8 n) + 1 of each. The
    order puts shingles of rare counters first. A first common place bounds what can follow it; pairs that pass are
    verified on whole sets. First each set meets the least set of most of its buckets, unless they are of one class; sets that are connected so are a
    class and make no more pairs among themselves. Then rounds make the pairs of classes that are still apart in a bucket:
    one with a sixteenth of the sets on one side, and, when its links have joined classes, one with all of them, less
    pairs that were tested before and pairs whose parity masks differ in more bits than close sets can. So a large group of close texts makes far fewer pairs than its square.
    """
    texts = docs.select(docs[text].cast("string").alias("text"))
    ids = marked.groupBy("fp").agg(F.min("h").alias("h"))  # copies go before any join
    balls = stage_table(_ball_pairs(marked), "ball-pairs")
    near = stage_table(_verified(texts, ids, balls), "links-of-balls")
    order = docs.sparkSession.sparkContext.broadcast(shingle_sketch(docs, text))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                keys, sizes, places, found = [], [], [], []
                for t in part.column("text").to_pylist():
                    x = shingle_set(t)
                    key = _set_key(x)
                    if not len(x) or key in done:
                        continue
                    if len(done) >= REMEMBERED:
                        done.clear()
                    done.add(key)
                    n = len(x)
                    first = x[np.lexsort((x, order.value[_counter(x)]))][: n - (TENTHS * n + 9) // 10 + 1]
                    keys.append(np.full(len(first), _signed(key), np.int64))
                    sizes.append(np.full(len(first), n, np.int32))
                    places.append(np.arange(len(first), dtype=np.int32))
                    found.append(first.view(np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (found, keys, sizes, places)], ["shingle", "fp", "n", "place"])

    rows = texts.mapInArrow(tidy(prefixes), "shingle long, fp long, n int, place int").repartition("shingle").dropDuplicates(["shingle", "fp"])
    # a shingle that one set alone has in its prefix joins nothing
    hub = rows.groupBy("shingle").agg(F.min(F.struct("fp", "n", "place")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    met = stage_table(rows.join(hub, "shingle").select("shingle", "fp", "n", "place", "hub"), "met")
    hubs = met.select(F.col("hub.fp").alias("a"), F.col("fp").alias("b"), *_sizes(F.col("hub"), F.struct("n", "place"))).where((F.col("a") < F.col("b")) & _may())
    # a set meets one hub, that of most of its buckets
    shared = hubs.groupBy("b", "a").agg(F.count(F.lit(1)).alias("k"))
    hubs = shared.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a").cast("decimal(20,0)"))).alias("a")).select("a", "b")
    known = stage_table(components(near, "a", "b"), "members")
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"class_{c}"))
    apart = hubs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("class_a IS NULL OR class_b IS NULL OR class_a <> class_b").select("a", "b")
    first = stage_table(apart.join(balls, ["a", "b"], "left_anti"), "candidates")
    close = stage_table(near.unionByName(_verified(texts, ids, first)), "links-of-hubs")
    # what is joined already needs no more pairs: the rest of a bucket meets the bucket's greatest class and itself, in the
    # first round by its members of a few slots alone, which join most of what can be joined before more pairs are made
    masks = marked.groupBy("fp").agg(*(F.min(c).alias(c) for c in PARITY))  # of one set all are equal
    tested, found = balls.unionByName(first), close
    for k, slots in enumerate(ROUNDS):
        members = stage_table(components(found, "a", "b"), "members")
        own = masks.join(members, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("class"), *PARITY)
        held = met.select("shingle", "fp", "n", "place").join(own, "fp")
        sizes = held.groupBy("shingle", "class").agg(F.count(F.lit(1)).alias("k"))
        greatest = sizes.groupBy("shingle").agg(F.max(F.struct("k", "class")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("shingle", F.col("top.class").alias("greatest"))
        mixed = stage_table(held.join(greatest, "shingle"), "met-mixed")
        x = mixed.where("class <> greatest").select("shingle", F.col("fp").alias("x"), F.col("class").alias("cx"), F.struct("n", "place", *PARITY).alias("sx"))
        y = mixed.where(F.pmod(F.xxhash64("fp"), F.lit(SLOTS)) < slots)
        y = y.select("shingle", F.col("fp").alias("y"), F.col("class").alias("cy"), F.struct("n", "place", *PARITY).alias("sy"), F.col("greatest"))
        # of two sets outside the greatest class, either may be the one with a slot of this round; when all slots count, one order is enough
        once = (F.col("x") < F.col("y")) if slots == SLOTS else F.lit(True)
        pair = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("greatest")) | once) & _may(F.col("sx"), F.col("sy")) & _even(F.col("sx"), F.col("sy"))
        made = x.join(y, "shingle").where(pair).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        made = stage_table(made.join(tested, ["a", "b"], "left_anti"), "candidates")
        drop_staged(mixed)
        stars = members.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        found = stage_table(stars.unionByName(_verified(texts, ids, made)), f"links-{k}")
        tested = tested.unionByName(made)
    drop_staged(met)
    return found


def _sizes(left: Column, right: Column) -> list[Column]:
    return [left["n"].alias("na"), left["place"].alias("pa"), right["n"].alias("nb"), right["place"].alias("pb")]


def _may(left: Column | None = None, right: Column | None = None) -> Column:
    """Can two sets be close whose first common shingle, in the order of prefixes, stands at these places?"""
    na, pa_, nb, pb = (F.col(c) for c in ("na", "pa", "nb", "pb")) if left is None else (left["n"], left["place"], right["n"], right["place"])
    most = F.least(na - pa_, nb - pb)  # in common, if this is the first place that is
    return F.lit(10 + TENTHS) * most >= F.lit(TENTHS) * (na + nb)


def _even(left: Column, right: Column) -> Column:
    """Can two sets be close whose parity masks are these? A shingle that one of them alone has turns one bit of their difference, so it has no more bits than such shingles."""
    apart = reduce(lambda a, b: a + b, [F.bit_count(left[c].bitwiseXOR(right[c])) for c in PARITY])
    return F.lit(10 + TENTHS) * apart <= F.lit(10 - TENTHS) * (left["n"] + right["n"])


def _verified(texts: DataFrame, ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole shingle sets are close; ``ids`` has a text hash of each set's key."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                made = [shingle_set(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_signed(_set_key(x)) for x in made], pa.int64()), pa.array([x.tobytes() for x in made], pa.binary())], ["fp", "found"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                mask.append((10 + TENTHS) * both >= TENTHS * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(mask, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("fp")).distinct().unionByName(pairs.select(F.col("b").alias("fp")).distinct()).distinct()
    wanted = ids.join(wanted, "fp", "left_semi").select("h").distinct()
    wanted = stage_table(wanted, "wanted")
    texts = texts.withColumn("h", F.xxhash64("text")).join(wanted, "h", "left_semi").dropDuplicates(["h"]).select("text")
    known = stage_table(texts.mapInArrow(tidy(sets), "fp long, found binary"), "sets")
    x = known.select(F.col("fp").alias("a"), F.col("found").alias("x"))
    y = known.select(F.col("fp").alias("b"), F.col("found").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(compared), "a long, b long")


def keep_one_similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, all columns, of each group of texts linked by 5-word Jaccard similarity of 0.8 or more: that of the least doc_id.

    Null, empty and wordless texts have equal (empty) shingle sets and are one group, of which one row stays. Texts of fewer than five words are
    one shingle each. Rows with a null doc_id come last in their group.
    """
    marked = _marked_sets(docs, key, text)
    return _survivors(docs, key, text, marked, _classes(marked, jaccard_links(docs, marked, text)))


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and wordless texts have fingerprint zero, linked like any other."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
