"""Operator 11, an edit-distance join of names by symmetric deletion neighbourhoods.

Two names within k edits (insertions, deletions, substitutions, exchanges of neighbours) become equal when each loses k
code points or fewer: an edit takes at most one from either side. So the distinct names of both sides emit the hashes of all
variants with up to k code points left out, equal hashes meet in one equi-join, and each pair that meets is verified once
by exact banded distance. A hash collision makes a pair that fails there, never a wrong row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillmesh.llm.common import prepare, read_table, stage_table, tidy

MAX_DISTANCE = 2
#: Code points that variants are made of. Prefixes of two close names meet as whole names do: an edit within them takes at most
#: one code point from either prefix, and a shift moves as many code points across the end of one as the other lost.
PREFIX = 32
#: Names and cells of padded matrices that one step of a task works on.
NAMES_A_STEP, CELLS_A_STEP = 2048, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def name_form(name: Column) -> Column:
    """The form that names are compared in: A to Z lower-cased; null where the name is null or empty."""
    return F.nullif(F.translate(name.cast("string"), _UPPER, _LOWER), F.lit(""))


def misspelt(key: Column, name: Column) -> Column:
    """The name with two neighbours exchanged, if the crc32 of the key's decimal text is even and the name has two code points or more.

    A null key leaves the name as it is.
    """
    h, n = F.crc32(key.cast("string").cast("binary")), F.length(name)
    at = (h % F.greatest(n - 1, F.lit(1))).cast("int") + 1
    one = F.lit(1)
    swapped = F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, one), F.substring(name, at, one), F.substring(name, at + 2, n))
    return F.when((h % 2 == 0) & (n >= 2), swapped).otherwise(name)


def _codes(name: str) -> np.ndarray:
    return np.frombuffer(name.encode("utf-32-le", "surrogatepass"), np.uint32)


def variant_keys(names: list[str], deletions: int = MAX_DISTANCE, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): the hash of each distinct variant of ``names[row]`` with up to ``deletions`` code points of its prefix left out."""
    codes = [_codes(x)[:prefix] for x in names]
    lengths = np.array([len(x) for x in codes], np.int64)
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    inverse = pow(_BASE, -1, 1 << 64)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        powers = np.array([pow(_BASE, k, 1 << 64) for k in range(n)], np.uint64)
        values = (np.stack([codes[i] for i in at]).astype(np.uint64) + np.uint64(1)) * powers
        sums = np.concatenate([np.zeros((len(at), 1), np.uint64), np.cumsum(values, axis=1, dtype=np.uint64)], axis=1)
        made = []
        for d in range(min(deletions, n) + 1):
            gone = np.array(list(combinations(range(n), d)), np.int64).reshape(comb(n, d), d)
            # what stands between two left-out places moves down by as many places as were left out before it
            total, begin = np.zeros((len(at), len(gone)), np.uint64), np.zeros(len(gone), np.int64)
            for k in range(d + 1):
                end = gone[:, k] if k < d else np.full(len(gone), n)
                total += (sums[:, end] - sums[:, begin]) * np.uint64(pow(inverse, k, 1 << 64))
                begin = end + 1
            made.append(total)
        mixed = np.concatenate(made, axis=1)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = np.sort(mixed ^ (mixed >> np.uint64(29)), axis=1)
        fresh = np.concatenate([np.ones((len(at), 1), bool), mixed[:, 1:] != mixed[:, :-1]], axis=1)
        rows.append(np.repeat(at, fresh.sum(axis=1)))
        keys.append(mixed[fresh].view(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def variant_rows(names: DataFrame, deletions: int = MAX_DISTANCE, prefix: int = PREFIX) -> DataFrame:
    """(key, nid): a row for each variant of each name of ``names`` (nid, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, NAMES_A_STEP):
                part = batch.slice(start, NAMES_A_STEP)
                rows, keys = variant_keys(part.column("name").to_pylist(), deletions, prefix)
                ids = part.column("nid").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[rows])], ["key", "nid"])

    # a name becomes some hundred rows, so few small partitions would make few large tasks
    spread = names.select("nid", "name").repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "nid")
    return spread.mapInArrow(tidy(run), "key long, nid long")


def _padded(codes: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(codes), max(map(len, codes), default=0)), fill, np.int64)
    for row, x in zip(out, codes, strict=True):
        row[: len(x)] = x
    return out


def banded_distances(left: list[str], right: list[str], limit: int = MAX_DISTANCE) -> np.ndarray:
    """Optimal string alignment distance of each pair if at most ``limit``, else limit + 1.

    Only cells within ``limit`` of the diagonal are filled, a vector over all pairs at a time.
    """
    a, b = [_codes(x) for x in left], [_codes(x) for x in right]
    na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.full(len(a), limit + 1, np.int64)
    order = np.argsort(na, kind="stable")
    order = order[np.abs(na - nb)[order] <= limit]
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * (na[order[stop]] + limit + 1) <= CELLS_A_STEP:
            stop += 1
        at = order[start:stop]
        out[at] = _banded(_padded([a[i] for i in at], -1), na[at], _padded([b[i] for i in at], -2), nb[at], limit)
        start = stop
    return out


def _banded(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, k: int) -> np.ndarray:
    count, width, far = len(a), 2 * k + 1, k + 1
    b = np.pad(b, ((0, 0), (0, max(0, a.shape[1] + k - b.shape[1]))), constant_values=-2)
    out = np.full(count, far, np.int64)
    older: list[np.ndarray] = []
    row = [np.full(count, min(o - k, far) if o >= k else far, np.int64) for o in range(width)]
    for i in range(a.shape[1] + 1):
        if i:
            above, row = row, []
            for o in range(width):
                j = i + o - k
                if j <= 0:
                    row.append(np.full(count, min(i, far) if j == 0 else far, np.int64))
                    continue
                best = above[o] + (a[:, i - 1] != b[:, j - 1])
                if o + 1 < width:
                    best = np.minimum(best, above[o + 1] + 1)
                if o:
                    best = np.minimum(best, row[o - 1] + 1)
                if i > 1 and j > 1:
                    exchanged = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                    best = np.where(exchanged, np.minimum(best, older[o] + 1), best)
                row.append(np.minimum(best, far))
            older = above
        ends = np.flatnonzero(na == i)
        if len(ends):
            out[ends] = np.stack(row)[nb[ends] - i + k, ends]
    return out


def _numbered(names: DataFrame, name: str) -> DataFrame:
    """``names``, one row a name, staged with short ids, which hold from the write on."""
    return stage_table(names.withColumn("nid", F.monotonically_increasing_id()), name)


def close_names(left: DataFrame, right: DataFrame, limit: int = MAX_DISTANCE, prefix: int = PREFIX) -> DataFrame:
    """(l, r, distance): ids of all pairs of names (nid, name; one row a name, none null) that are at most ``limit`` apart, once each.

    The variants' join has no group that must stay in one task: a key that many names share is an ordinary skewed join key,
    whose rows adaptive execution deals to several tasks. Equal pairs go in an aggregation that begins before its shuffle.
    """
    prepare(left.sparkSession)
    x = variant_rows(left, limit, prefix).withColumnRenamed("nid", "l")
    y = variant_rows(right, limit, prefix).withColumnRenamed("nid", "r")
    # a side's size is not known before it runs, so no side is broadcast
    pairs = x.hint("merge").join(y, "key").select("l", "r").distinct()
    held = pairs.hint("merge").join(left.select(F.col("nid").alias("l"), F.col("name").alias("a")), "l")
    held = held.hint("merge").join(right.select(F.col("nid").alias("r"), F.col("name").alias("b")), "r")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = banded_distances(batch.column("a").to_pylist(), batch.column("b").to_pylist(), limit)
            made = pa.RecordBatch.from_arrays([batch.column("l"), batch.column("r"), pa.array(distance.astype(np.int32))], ["l", "r", "distance"])
            yield made.filter(pa.array(distance <= limit))

    return held.select("l", "r", "a", "b").mapInArrow(tidy(verify), "l long, r long, distance int")


def edit_join(clients: DataFrame, vendors: DataFrame, limit: int = MAX_DISTANCE, prefix: int = PREFIX) -> DataFrame:
    """vendor_id, distance, n_clients, first_client_id, clients_crc: a row per vendor id and distance that some pair has.

    ``clients`` (client_id, name) and ``vendors`` (vendor_id, name) are compared in :func:`name_form`. Rows whose name is null
    or empty take no part; other columns are not read. Rows of one name are counted before any variant is made, so equal names
    cost one. Every client row counts, repeated ones too; a null client_id counts in n_clients alone. Vendor rows that repeat
    id and name count once; an id with several names has the pairs of each. A null vendor_id is a vendor like others. Names of
    more than ``prefix`` code points meet by their prefixes and are verified whole. Empty tables give no rows.
    """
    prepare(clients.sparkSession)
    named = clients.select(F.col("client_id").cast("long").alias("client_id"), name_form(F.col("name")).alias("name")).where("name IS NOT NULL")
    counted = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("client_id").alias("first"), F.sum(F.crc32(F.col("client_id").cast("string").cast("binary"))).alias("crc"))
    left = _numbered(counted, "client-names")
    sold = vendors.select(F.col("vendor_id").cast("long").alias("vendor_id"), name_form(F.col("name")).alias("name")).where("name IS NOT NULL").distinct()
    right = _numbered(sold.select("name").distinct(), "vendor-names")
    close = close_names(left, right, limit, prefix)
    # sums by vendor name first: a name that many vendors have is joined to at most limit + 1 rows
    found = close.hint("merge").join(left.select(F.col("nid").alias("l"), "n", "first", "crc"), "l").groupBy("r", "distance")
    found = found.agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("crc").alias("crc"))
    by_name = found.hint("merge").join(right.select(F.col("nid").alias("r"), "name"), "r").select("name", "distance", "n", "first", "crc")
    joined = sold.hint("merge").join(by_name, "name")
    return joined.groupBy("vendor_id", "distance").agg(
        F.sum("n").cast("long").alias("n_clients"), F.min("first").alias("first_client_id"), F.coalesce(F.sum("crc"), F.lit(0)).cast("long").alias("clients_crc")
    )


def op11_edit_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients by vendor and distance, over vendor names misspelt as the contract says."""
    vendors = read_table(spark, sf_dir, "vendors").select("vendor_id", misspelt(F.col("vendor_id"), F.col("name")).alias("name"))
    return edit_join(read_table(spark, sf_dir, "clients"), vendors)


def _crc32_sql(text: str) -> str:
    """DuckDB expression: the unsigned crc32 of ASCII ``text``, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"[ord(ch)::BIGINT for ch in string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


#: The whole distance matrix of each pair of close lengths, a row of it at a time.
ORACLE = f"""
WITH c AS (
  SELECT translate(name, '{_UPPER}', '{_LOWER}') AS name, count(*) AS n, min(client_id) AS first, sum({_crc32_sql("client_id::VARCHAR")}) AS crc
  FROM clients WHERE name <> '' GROUP BY 1
), hashed AS (
  SELECT vendor_id, name, {_crc32_sql("vendor_id::VARCHAR")} AS h, length(name) AS n FROM vendors WHERE name <> ''
), v AS (
  SELECT vendor_id, translate(CASE WHEN h % 2 = 0 AND n >= 2
    THEN substring(name, 1, (h % (n - 1))::INT) || substring(name, (h % (n - 1))::INT + 2, 1) || substring(name, (h % (n - 1))::INT + 1, 1) || substring(name, (h % (n - 1))::INT + 3)
    ELSE name END, '{_UPPER}', '{_LOWER}') AS name
  FROM hashed
), pairs AS (
  SELECT v.vendor_id, c.n, c.first, c.crc, string_split(c.name, '') AS a, string_split(v.name, '') AS b
  FROM c JOIN v ON abs(length(c.name) - length(v.name)) <= 2
), measured AS (
  SELECT vendor_id, n, first, crc, list_reduce(
    list_prepend({{'i': 0, 'old': range(0, len(b) + 1), 'row': range(0, len(b) + 1)}}, [{{'i': i, 'old': []::BIGINT[], 'row': []::BIGINT[]}} for i in range(1, len(a) + 1)]),
    lambda s, t: {{'i': t.i, 'old': s.row, 'row': list_reduce(list_prepend([t.i], [[j] for j in range(1, len(b) + 1)]), lambda r, j: list_append(r, least(
      r[-1] + 1, s.row[j[1] + 1] + 1, s.row[j[1]] + CASE WHEN a[t.i] = b[j[1]] THEN 0 ELSE 1 END,
      CASE WHEN t.i > 1 AND j[1] > 1 AND a[t.i] = b[j[1] - 1] AND a[t.i - 1] = b[j[1]] THEN s.old[j[1] - 1] + 1 ELSE 1000000 END)))}}
  ).row[-1] AS distance
  FROM pairs
)
SELECT vendor_id, distance::INT AS distance, sum(n)::BIGINT AS n_clients, min(first) AS first_client_id, sum(crc)::BIGINT AS clients_crc
FROM measured WHERE distance <= 2 GROUP BY 1, 2
"""
