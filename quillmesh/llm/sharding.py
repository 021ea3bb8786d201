"""Operator 10, sharding by a k-d tree over metadata. DataFrame functions only.

Equal texts are one unit. Units of more than a PINNED-th of a shard are few, whatever the table's size: the driver deals
them to shards first, the heaviest to the emptiest. The tree then splits all other units so that each shard is filled up
to its equal part of the bytes.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillmesh.llm.common import read_table, stage_table

SHARDS, OVERHEAD = 40, 16
#: Bits of a dimension's value and of the tie-breaking hash in a split key; bits looked at in one histogram.
VALUE_BITS, TIE_BITS, STEP_BITS = 12, 24, 12
#: A split ends when its histogram bin holds at most this share of the node's bytes.
FINE = 1 / 1_000
#: Groups of equal texts above this share of a shard are dealt before the tree is built: at most SHARDS * PINNED groups.
PINNED = 16


@dataclass
class Node:
    """A box of the tree: a leaf with its place among the leaves, or a split of ``dim`` at ``key`` (rows below it go left)."""

    first: int
    leaves: int
    dim: str = ""
    key: int = 0
    children: list[Node] = field(default_factory=list)


DIMENSIONS = ("d_size", "d_source", "d_lang", "d_id")


def _points(docs: DataFrame) -> DataFrame:
    """A row per document: size, crc, group hash, and each metadata dimension as an unsigned VALUE_BITS integer."""
    top = (1 << VALUE_BITS) - 1
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    columns = {c.lower() for c in docs.columns}

    def hashed(name: str) -> Column:
        return F.coalesce(F.shiftrightunsigned(F.xxhash64(F.col(name).cast("string")), 64 - VALUE_BITS), F.lit(0)) if name in columns else F.lit(0).cast("long")

    base = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw, F.crc32(raw)).alias("group"),
        hashed("source").alias("d_source"),
        hashed("lang").alias("d_lang"),
    )
    return base.withColumn("d_size", F.least(F.lit(top), (F.log2("size") * F.lit(1 << 7)).cast("long"))).withColumn(
        "d_id", F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(7)), 64 - VALUE_BITS)
    )


_KEY = f"(shiftleft({{dim}}, {TIE_BITS}) | shiftrightunsigned(xxhash64(`group`), {64 - TIE_BITS}))"


def _key(dim: str) -> Column:
    """Split key: the dimension's value, ties in the order of the group's hash."""
    return F.expr(_KEY.format(dim=dim))


def _place(root: Node) -> Column:
    """The first leaf of the lowest box so far: a walk down the tree, whose nodes stand in literal arrays."""
    nodes, depth = [root], 0
    level = [root]
    while level := [c for x in level for c in x.children]:
        nodes += level
        depth += 1
    if not depth:
        return F.lit(root.first)
    at = {id(x): k for k, x in enumerate(nodes)}
    rows = ", ".join(
        f"named_struct('d', {DIMENSIONS.index(x.dim) if x.children else -1}, 'k', {x.key}L, 'l', {at[id(x.children[0])] if x.children else k}, 'r', {at[id(x.children[1])] if x.children else k}, 'f', {x.first})"
        for k, x in enumerate(nodes)
    )
    step = "if(n.d < 0, n, if(k[n.d] < n.k, t[n.l], t[n.r]))"
    # tables and keys are bound once a row
    walk = f"aggregate(sequence(1, {depth}), t[0], (n, i) -> {step}).f"
    keys = ", ".join(_KEY.format(dim=d) for d in DIMENSIONS)
    return F.expr(f"transform(array(array({rows})), t -> transform(array(array({keys})), k -> {walk})[0])[0]")


def _open(root: Node) -> list[Node]:
    return [x for c in root.children for x in _open(c)] if root.children else [root] if root.leaves > 1 else []


def build_tree(units: DataFrame, goals: list[float]) -> Node:
    """Split all open boxes of a level at once until every box is one leaf; the leaves' bytes are in proportion to ``goals``.

    A level's first aggregate has the bytes of each box by value of each dimension: it gives the spread of bytes around
    their mean, in units of the whole table's, so each box's widest dimension, and the bin of its weighted median.
    Further histograms narrow down medians whose bin is heavy, by the ties' hash. At most shards * dimensions *
    2**STEP_BITS aggregated rows come to the driver (shards: leaves), whatever the table's size.
    """
    root = Node(0, len(goals))
    all_bits = VALUE_BITS + TIE_BITS
    width: dict[str, float] = {}

    def narrow(goal: list, bins: list[tuple[int, int]]) -> bool:
        """Take one histogram's bin of the median into ``goal`` = [node, bytes wanted left, prefix, bits, total]; is it fine enough?"""
        last = len(bins) - 1
        for at, (bin_, weight) in enumerate(sorted(bins)):
            if weight >= goal[1] or at == last:
                break
            goal[1] -= weight
        goal[2], goal[3] = bin_, min(all_bits, goal[3] + STEP_BITS)
        fine = weight <= goal[4] * FINE or goal[3] == all_bits
        if fine:
            goal[0].key = (bin_ if goal[1] * 2 < weight else bin_ + 1) << (all_bits - goal[3])
        return fine

    while nodes := _open(root):
        placed = units.withColumn("node", _place(root))
        first = F.inline(F.array(*(F.struct(F.lit(k).alias("dim"), F.shiftrightunsigned(_key(d), all_bits - STEP_BITS).alias("bin")) for k, d in enumerate(DIMENSIONS))))
        found: dict[int, list[list]] = {}
        for r in placed.select("node", "bytes", first).groupBy("node", "dim", "bin").agg(F.sum("bytes").alias("bytes")).collect():
            found.setdefault(r["node"], [[] for _ in DIMENSIONS])[r["dim"]].append((int(r["bin"]), int(r["bytes"])))
        todo: dict[int, list] = {}
        for n in nodes:
            if n.first not in found:  # an empty box
                n.dim = DIMENSIONS[0]
                continue
            spread = {}
            for d, bins in zip(DIMENSIONS, found[n.first], strict=True):
                total = sum(w for _, w in bins)
                mean = sum(b * w for b, w in bins) / total
                spread[d] = (sum(w * (b - mean) ** 2 for b, w in bins) / total) ** 0.5
            if n is root:
                width = {d: s or 1.0 for d, s in spread.items()}
            n.dim = max(DIMENSIONS, key=lambda d: (spread[d] / width[d], d == "d_size"))
            share = sum(goals[n.first : n.first + n.leaves // 2]) / sum(goals[n.first : n.first + n.leaves])
            goal = [n, total * share, 0, 0, total]
            if not narrow(goal, found[n.first][DIMENSIONS.index(n.dim)]):
                todo[n.first] = goal
        while todo:
            # node -> its next bin, where the row is in the bin that holds the median
            chosen = F.lit(None).cast("long")
            for f, (n, _, known, bits, _) in todo.items():
                inside = (F.col("node") == f) & (F.shiftrightunsigned(_key(n.dim), all_bits - bits) == known)
                chosen = F.when(inside, F.shiftrightunsigned(_key(n.dim), max(0, all_bits - bits - STEP_BITS))).otherwise(chosen)
            rows = placed.select("node", chosen.alias("bin"), "bytes").where("bin IS NOT NULL").groupBy("node", "bin").agg(F.sum("bytes").alias("bytes")).collect()
            next_: dict[int, list] = {}
            for r in rows:
                next_.setdefault(r["node"], []).append((int(r["bin"]), int(r["bytes"])))
            todo = {f: goal for f, goal in todo.items() if not narrow(goal, next_[f])}
        for n in nodes:
            left = n.leaves // 2
            n.children = [Node(n.first, left), Node(n.first + left, n.leaves - left)]
    return root


def _pins(groups: list, shards: int, target: float) -> tuple[dict[int, list[int]], list[float]]:
    """Shards of each heavy group, one unless it outweighs a shard, and what all of them put into each shard."""
    parts = sorted(((r["bytes"] / n, r["group"]) for r in groups for n in [max(1, -(-r["bytes"] // max(1, int(target))))] for _ in range(n)), reverse=True)
    heap, pins, loads = [(0.0, k) for k in range(shards)], {}, [0.0] * shards
    for size, group in parts:
        load, k = heapq.heappop(heap)
        pins.setdefault(group, []).append(k)
        loads[k] = load + size
        heapq.heappush(heap, (loads[k], k))
    return pins, loads


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: a row per input row.

    Law ``bytes``: the shards' bytes are nearly equal. Equal texts stay in one shard unless all of them together are larger
    than a shard; such a group is dealt over as few shards as hold it. A null text has no bytes beyond the overhead; null
    metadata counts as one value; null ids are rows like others. An empty table gives no rows. Of other columns only source
    and lang are read.
    """
    spark = docs.sparkSession
    points = stage_table(_points(docs), "shard-points")
    rows, total = points.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    target = total / shards
    groups = stage_table(points.groupBy("group").agg(F.sum("size").alias("bytes"), *(F.min(d).alias(d) for d in DIMENSIONS)), "shard-groups")
    heavy = F.col("bytes") > max(1.0, target / PINNED)
    pins, loads = _pins(groups.where(heavy).select("group", "bytes").collect(), shards, target)  # at most shards * PINNED rows
    open_ = [k for k in range(shards) if loads[k] < target] or [0]
    units = groups.where(~heavy)
    root = build_tree(units, [max(target - loads[k], 1e-9) for k in open_])
    leaf = F.get(F.array(*map(F.lit, open_)), _place(root).cast("int"))
    pinned = spark.createDataFrame(list(pins.items()), "`group` long, shards array<int>")
    # heavy groups by a broadcast of their few pins, all others by the place of their group
    deal = F.get("shards", F.pmod(F.xxhash64("rid"), F.size("shards")).cast("int"))
    known = points.join(F.broadcast(pinned), "group").withColumn("shard", deal).drop("shards")
    homes = units.select("group", leaf.alias("shard"))
    dealt = known.unionByName(points.join(F.broadcast(pinned), "group", "left_anti").join(homes, "group"))
    # a shard's rows are numbered in buckets, whose counts are summed to offsets
    buckets = max(1, rows // shards // 20_000)
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("rid")).otherwise(F.xxhash64("doc_id", "text_crc32"))
    dealt = stage_table(dealt.select("doc_id", "size", "text_crc32", "shard", F.pmod(spread, F.lit(buckets)).alias("bucket")), "shard-dealt")
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("rank", F.row_number().over(order)).join(offsets, ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes; null texts count their overhead."""
    return shard(read_table(spark, sf_dir, "documents"))
