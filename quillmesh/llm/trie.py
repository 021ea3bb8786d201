"""Operator 13, the prefix trie of conversations that share their first turns, merged family by family.

A conversation takes its first turns from the base of its family, so a family (one base id) shares most of its prefixes.
Families are grouped first; each rebuilds its conversations and builds its small trie in one task; only its nodes, counted
by family, are shuffled for the global merge. Texts stay behind: a turn goes as a digest and a length, a node as the digest
of its parent's and its turn's. What a node sums over its subtree is made from chains: the nodes whose smallest member is
one conversation are the end of that conversation's path, so a trie is a tree of such chains, and sums go up chain by chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillmesh.llm.common import drop_staged, prepare, read_table, stage_table, tidy
from quillmesh.llm.names import _crc32_sql

FAMILY, HEADS = 100, 6
ROOT = bytes(16)
_NODE = "node binary, parent binary, depth long, length long, members long, conv_id long, ends binary"
_EMPTY_SHA = hashlib.sha256().hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, turn, h, digest, length): a row a turn, without its text; h is the number of turns taken from the base.

    The digest is 128 bits of a SHA-256 of role and text, nulls as empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    conv = F.col("conv_id").cast("long")
    return conversations.where("conv_id IS NOT NULL").select(
        (conv - conv % FAMILY).alias("family"),
        conv.alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int").alias("h"),
        F.unhex(F.substring(F.sha2(told, 256), 1, 32)).alias("digest"),
        F.length(text).cast("long").alias("length"),
    )


def family_trie(rows: pa.Table) -> pa.Table:
    """The nodes of one family: digest, parent's, depth, length of the last text, members, smallest member, and the ids that end there, ascending."""
    order = pc.sort_indices(rows, sort_keys=[("conv_id", "ascending"), ("turn", "ascending"), ("digest", "ascending")], null_placement="at_start")
    rows = rows.take(order)
    convs, digests, lengths = (rows.column(c).to_pylist() for c in ("conv_id", "digest", "length"))
    heads = rows.column("h").to_pylist()
    bounds = [i for i in range(len(convs)) if not i or convs[i] != convs[i - 1]] + [len(convs)]
    base = range(0)
    for a, b in zip(bounds, bounds[1:], strict=False):
        if convs[a] == rows.column("family")[0].as_py():
            base = range(a, b)
    # a node is its place in these lists; the root is the first
    parents, turns, depths, members, least, ends = [-1], [-1], [0], [0], [None], [[]]
    at: dict[tuple[int, bytes], int] = {}
    for a, b in zip(bounds, bounds[1:], strict=False):
        conv, h = convs[a], heads[a]
        node = 0
        for i in (None, *base[:h], *range(min(a + h, b), b)):
            if i is not None:
                key = (node, digests[i])
                if key not in at:
                    at[key] = len(parents)
                    parents.append(node)
                    turns.append(i)
                    depths.append(depths[node] + 1)
                    members.append(0)
                    least.append(None)
                    ends.append([])
                node = at[key]
            members[node] += 1
            least[node] = conv if least[node] is None else least[node]  # conversations come in ascending order
        ends[node].append(conv)
    names = [ROOT]
    for p, i in zip(parents[1:], turns[1:], strict=True):
        names.append(hashlib.sha256(names[p] + digests[i]).digest()[:16])
    return pa.table(
        [
            pa.array(names, pa.binary()),
            pa.array([names[p] if p >= 0 else None for p in parents], pa.binary()),
            pa.array(depths, pa.int64()),
            pa.array([lengths[i] if i >= 0 else 0 for i in turns], pa.int64()),
            pa.array(members, pa.int64()),
            pa.array(least, pa.int64()),
            pa.array([",".join(map(str, x)).encode() if x else None for x in ends], pa.binary()),
        ],
        ["node", "parent", "depth", "length", "members", "conv_id", "ends"],
    )


def _end_hashes(found: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end. Families hold ranges of ids that do not overlap, so their lists
    follow each other; a node's lists are read in order and hashed as they come, never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for node, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != last:
                    if digest is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = node, hashlib.sha256(ends)
                else:
                    digest.update(b"," + ends)
            if done:
                yield _pairs(done)
        if digest is not None:
            yield _pairs([(last, digest.hexdigest())])

    rows = found.where("ends IS NOT NULL").repartition("node").sortWithinPartitions("node", F.col("ends_from"))
    return rows.select("node", "ends").mapInArrow(tidy(run), "node binary, ends_sha256 string")


def _pairs(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["node", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text; other columns are not read. Rows without conv_id belong to no
    conversation. Turns are ordered by turn, null first; rows that share one are all turns, in the order of their
    contents' digests. An empty table has no nodes. A family (up to ``FAMILY`` conversations, as digests) is one task's work
    by the method; nothing else is gathered. The rounds of the sums are as many as branches are nested, not as turns.
    """
    prepare(conversations.sparkSession)
    families = turn_rows(conversations).groupBy("family").applyInArrow(family_trie, _NODE)
    # the first id of a list orders it among those of other families
    found = stage_table(families.withColumn("ends_from", F.substring_index(F.col("ends").cast("string"), ",", 1).cast("long")), "trie-families")
    merged = found.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("members").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("length").alias("length")
    )
    hashed = merged.join(_end_hashes(found), "node", "left")
    nodes = stage_table(hashed.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY_SHA))).withColumn("saved", (F.col("n_convs") - 1) * F.col("length")), "trie-nodes")
    drop_staged(found)

    # chains: the nodes of one smallest member; the topmost hangs on a node of another chain
    chains = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "parent")).alias("top"), F.max("depth").alias("low"), F.sum("saved").alias("saved"))
    tops = chains.select("conv_id", (F.col("top.depth") - 1).alias("at"), F.col("top.parent").alias("parent"), "low", "saved")
    # below the root hang as many chains as conversations begin differently; the root's chain is that of the least id
    first = F.lit(nodes.agg(F.min("conv_id")).first()[0]).cast("long")
    high = tops.where("at = 0").drop("parent").withColumn("over", first)
    rest = tops.where("at > 0").hint("merge").join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("over")), "parent").drop("parent")
    hung = stage_table(high.unionByName(rest).unionByName(tops.where("at < 0").drop("parent").withColumn("over", F.lit(None).cast("long"))), "trie-chains")
    below = hung.where("at >= 0")
    branches = below.groupBy("over", "at").agg(F.count(F.lit(1)).alias("branches")).withColumnsRenamed({"over": "conv_id", "at": "depth"})
    # a chain that nothing hangs on at its last node ends in a leaf
    tips = hung.join(branches.select("conv_id", F.col("depth").alias("low"), "branches"), ["conv_id", "low"], "left")
    weights = stage_table(tips.select("conv_id", "saved", F.when(F.col("branches").isNull(), 1).otherwise(0).cast("long").alias("leaves")), "trie-sums")
    places = below.select("conv_id", "over", "at")
    added, steps = None, []
    while True:
        up = places.join(weights, "conv_id").groupBy(F.col("over").alias("conv_id"), F.col("at").alias("depth"))
        step = stage_table(up.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")), "trie-added")
        drop_staged(weights)
        if step.isEmpty():
            drop_staged(step)
            break
        steps.append(step)
        weights = stage_table(step.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")), "trie-sums")
    for step in steps:
        added = step if added is None else added.unionByName(step)

    out = nodes.join(branches, ["conv_id", "depth"], "left").join(hung.select("conv_id", "low", "over"), "conv_id")
    if added is not None:
        total = added.groupBy("conv_id", "depth").agg(F.sum("saved").alias("more"), F.sum("leaves").alias("leaves"))
        out = out.join(total, ["conv_id", "depth"], "left")
    else:
        out = out.withColumns({"more": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long")})
    last = F.col("depth") == F.col("low")
    here = F.coalesce("leaves", F.lit(0)) + F.when(last & F.col("branches").isNull(), 1).otherwise(0)
    # a chain is no longer than its conversation
    down = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up_ = Window.partitionBy("conv_id").orderBy("depth")
    return out.select(
        "conv_id",
        "depth",
        F.when(F.row_number().over(up_) == 1, F.col("over")).otherwise(F.col("conv_id")).cast("long").alias("parent_conv_id"),
        F.col("n_convs").cast("long").alias("n_convs"),
        (F.coalesce("branches", F.lit(0)) + F.when(last, 0).otherwise(1)).cast("long").alias("n_children"),
        F.sum(here).over(down).cast("long").alias("n_leaves"),
        F.sum(F.col("saved") + F.coalesce("more", F.lit(0))).over(down).cast("long").alias("saved_tokens"),
        "ends_sha256",
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations, a row a node."""
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


#: Every prefix as a list of turns; subtree sums over all pairs of a node and a node below it.
ORACLE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % {FAMILY} AS base, {_crc32_sql("conv_id::VARCHAR")} % {HEADS} AS h FROM turns
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.k, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.k, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h
), paths AS (
  SELECT c.conv_id, coalesce(list({{'role': r.role, 'text': r.text}} ORDER BY part, k) FILTER (r.conv_id IS NOT NULL), []) AS path
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id, d AS depth, len(path) AS total, path[1:d] AS prefix FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM paths)
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(prefix[-1].text) END AS saved
  FROM prefixes GROUP BY prefix, depth
), kids AS (
  SELECT n.conv_id, n.depth, count(c.depth) AS n_children, min(p.conv_id) AS parent_conv_id
  FROM nodes n LEFT JOIN nodes c ON c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:p.depth] GROUP BY n.conv_id, n.depth
), sums AS (
  SELECT n.conv_id, n.depth, sum(b.saved) AS saved_tokens, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM nodes n JOIN nodes b ON b.depth >= n.depth AND b.prefix[1:n.depth] = n.prefix JOIN kids k ON k.conv_id = b.conv_id AND k.depth = b.depth
  GROUP BY n.conv_id, n.depth
)
SELECT conv_id, depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM nodes JOIN kids USING (conv_id, depth) JOIN sums USING (conv_id, depth)
"""
