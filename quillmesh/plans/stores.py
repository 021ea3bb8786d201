"""Queries of stored state: counters, aliases, checkpoints, scans, snapshots, validation, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import catalog, store
from quillmesh.plans import adapters as v
from quillmesh.plans.base import query


@query("SELECT resource, tool, count(*)::BIGINT AS access_count, min(seen) AS first_access, max(seen) AS last_access FROM v_access GROUP BY 1, 2")
def access_merge(s, d):
    a = v.access(s, d)
    return store.merge_access(store.access_counts(a.where("seen % 3 = 0")), a.where("seen % 3 <> 0"))


@query("SELECT path, CASE WHEN mtime % 2 = 0 THEN NULL ELSE 'h' || mtime END AS hash, size + CASE WHEN mtime % 3 = 0 THEN 1 ELSE 0 END AS size FROM v_files")
def merge_file_rows(s, d):
    old = v.files(s, d).select("path", F.when(F.col("mtime") % 2 == 1, F.concat(F.lit("h"), F.col("mtime").cast("string"))).alias("hash"), "size")
    new = v.files(s, d).where("mtime % 3 = 0").select("path", F.lit(None).cast("string").alias("hash"), (F.col("size") + 1).alias("size"))
    return store.merge_metadata(old, new, "path", ["hash"])


@query("SELECT alias, uri, seen_at FROM (SELECT namespace || '/' || kind AS alias, uri, id AS seen_at, row_number() OVER (PARTITION BY namespace, kind ORDER BY id DESC) AS r FROM v_resources) WHERE r = 1")
def alias_upsert(s, d):
    r = v.resources(s, d).select(F.concat_ws("/", "namespace", "kind").alias("alias"), "uri", F.lit("seen").alias("reason"), F.col("id").alias("at"))
    first = r.groupBy("alias").agg(F.min_by(F.struct("uri", "reason", "at"), "at").alias("x")).select("alias", "x.*")
    return store.put_aliases(first, r).select("alias", "uri", F.col("at").alias("seen_at"))


@query("SELECT path, mtime % 4 <> 1 AND mtime % 3 <> 0 AS current FROM v_files")
def producer_states(s, d):
    f = v.files(s, d)
    state = lambda rows, h: rows.select("path", F.lit("symbols").alias("producer"), h.alias("hash"))
    states = store.mark_producers(state(f.where("mtime % 4 <> 1"), F.lit("old")), state(f.where("mtime % 3 <> 0 AND mtime % 4 <> 1"), F.lit("new")))
    return store.producer_current(f.select("path", F.lit("new").alias("hash")), states, "symbols")


@query("SELECT path, 2 AS scan, 'file' AS state FROM v_files WHERE mtime % 3 <> 0 AND mtime % 5 <> 0 UNION ALL SELECT path, NULL, 'unknown' FROM v_files WHERE mtime % 5 = 0")
def scan_marking(s, d):
    f = v.files(s, d)
    marked, unknown = store.mark_seen(f.where("mtime % 5 <> 0").select("path", F.lit(1).alias("scan")), f.where("mtime % 3 <> 0 OR mtime % 5 = 0").select("path"), 2)
    kept = store.complete_scan(marked, 2).withColumn("state", F.lit("file"))
    return kept.unionByName(unknown.select("path", F.lit(None).cast("int").alias("scan"), F.lit("unknown").alias("state")))


@query("SELECT 'segments' AS kind, id AS path, ordinal AS n FROM v_segments WHERE id % 4 <> 0 UNION ALL SELECT 'segments', id, -1 FROM v_resources WHERE id % 4 = 0 UNION ALL SELECT 'edges', id, 1 FROM v_resources WHERE id % 4 <> 0")
def replace_snapshot(s, d):
    segments = v.segments(s, d).select(F.col("id").alias("path"), F.col("ordinal").alias("n"))
    edges = v.resources(s, d).select(F.col("id").alias("path"), F.lit(1).cast("long").alias("n"))
    changed = v.resources(s, d).where("id % 4 = 0").select(F.col("id").alias("path"))
    out = store.replace_snapshot({"segments": segments, "edges": edges}, {"segments": changed.withColumn("n", F.lit(-1).cast("long")), "edges": edges.limit(0)}, changed)
    return out["segments"].select(F.lit("segments").alias("kind"), "path", "n").unionByName(out["edges"].select(F.lit("edges").alias("kind"), "path", "n"))


@query("SELECT uri, CASE WHEN id % 7 = 0 THEN 'kind is empty' WHEN id % 5 = 0 THEN 'unknown authority' ELSE 'unknown status' END AS problem FROM v_resources WHERE id % 7 = 0 OR id % 5 = 0 OR status = 'deprecated'")
def validate_resources(s, d):
    r = v.resources(s, d)
    kind, authority = F.when(F.col("id") % 7 == 0, " ").otherwise(F.col("kind")), F.when(F.col("id") % 5 == 0, "nobody").otherwise(F.col("authority"))
    return store.invalid_resources(r.withColumn("kind", kind).withColumn("authority", authority).withColumn("status", F.when(F.col("status") == "deprecated", "old").otherwise(F.col("status"))))


@query("SELECT edge, 'no target' AS problem FROM v_links WHERE dst_ref IS NOT NULL AND dst_ref <> 'gone:1' UNION ALL SELECT edge, 'unknown confidence' FROM v_links WHERE relation = 'calls' AND src = 'customer:7'")
def validate_edges(s, d):
    e = v.links(s, d).withColumn("confidence", F.when((F.col("relation") == "calls") & (F.col("src") == "customer:7"), "maybe").otherwise("resolved"))
    return store.invalid_edges(e.withColumn("dst_ref", F.when(F.col("dst_ref") == "gone:1", F.col("dst_ref"))))


@query("SELECT 'e' || id AS external_id, '---' || chr(10) || 'kind: ' || kind || chr(10) || '---' || chr(10) || CASE WHEN id % 2 = 0 THEN 'new ' ELSE 'old ' END || title AS document FROM v_resources WHERE namespace = 'src1'")
def origin_documents(s, d):
    r = v.resources(s, d).withColumn("origin", F.lit("docs")).withColumn("external_id", F.concat(F.lit("e"), F.col("id").cast("string")))
    at = lambda n, word: r.select(F.col("id").alias("resource"), F.lit(n).alias("version"), F.concat(F.lit("kind: "), "kind").alias("front"), F.concat(F.lit(word), "title").alias("body"))
    return store.origin_documents(r, at(1, "old ").unionByName(at(2, "new ").where("resource % 2 = 0")), "src1", "docs")


@query("SELECT 'e' || id AS external_id FROM v_resources WHERE namespace = 'src1'")
def origin_ids(s, d):
    r = v.resources(s, d).withColumn("origin", F.lit("docs")).withColumn("external_id", F.concat(F.lit("e"), F.col("id").cast("string")))
    return store.origin_ids(r, "src1", "docs")


@query("SELECT TRUE AS same, FALSE AS other")
def graph_fingerprint(s, d):
    nodes, e = v.resources(s, d).select("id", F.col("uri").alias("hash")), v.edges(s, d)
    a, b = store.fingerprint(nodes, e), store.fingerprint(nodes.unionByName(nodes.where("id % 2 = 0")).orderBy(F.desc("id")), e.repartition(5, "dst"))
    c = store.fingerprint(nodes, e.where("dst <> 'customer:1'"))
    x = a.crossJoin(b.withColumnRenamed("fingerprint", "b")).crossJoin(c.withColumnRenamed("fingerprint", "c"))  # a row each
    return x.select((F.col("fingerprint") == F.col("b")).alias("same"), (F.col("fingerprint") == F.col("c")).alias("other"))


@query("SELECT 'files' AS name, count(*) AS n FROM v_files UNION ALL SELECT 'segments', count(*) FROM v_segments")
def table_counts(s, d):
    return store.table_counts({"files": v.files(s, d), "segments": v.segments(s, d)})


@query("SELECT count(*) FILTER (authority = 'repository') AS resolved, count(*) FILTER (authority = 'derived') AS unresolved, count(*) FILTER (authority = 'gateway') AS ambiguous FROM v_resources")
def resolution_stats(s, d):
    word = F.when(F.col("authority") == "repository", "resolved").when(F.col("authority") == "gateway", "ambiguous").otherwise("extracted")
    return store.resolution_stats(v.resources(s, d).select(word.alias("confidence")))


@query("SELECT path AS key, CASE WHEN mtime % 3 = 0 THEN 'new' ELSE 'old' END AS value FROM v_files WHERE mtime % 5 <> 0 AND (mtime % 3 = 0 OR mtime % 2 = 0) AND mtime % 7 <> 0")
def kv_cache(s, d):
    f = v.files(s, d).withColumnRenamed("path", "key")
    old = f.select("key", F.lit("old").alias("value"), F.when(F.col("mtime") % 2 == 1, 100).cast("long").alias("expires_at"))
    cache = store.kv_set(old, f.where("mtime % 3 = 0").select("key", F.lit("new").alias("value")), 90, 60)
    cache = store.kv_remove(cache, f.where("mtime % 7 = 0"))
    return store.kv_get(cache, f.where("mtime % 5 <> 0").select("key"), 120)


@query("SELECT 'file' AS kind, path, size FROM v_files WHERE mtime % 3 <> 1 UNION ALL SELECT 'file', path, NULL FROM v_files WHERE mtime % 6 = 1 UNION ALL SELECT 'symbol', path, NULL FROM v_files WHERE mtime % 6 = 1 OR mtime % 3 = 0")
def legacy_import(s, d):
    f = v.files(s, d)
    rows = lambda test: f.where(test).select("path", "size")
    symbols = lambda test: f.where(test).select("path")
    files, found = store.import_legacy(rows("mtime % 3 = 0"), symbols("mtime % 3 = 0"), rows("mtime % 3 = 2"), symbols("mtime % 6 = 1 OR mtime % 6 = 0"))
    return files.select(F.lit("file").alias("kind"), "path", "size").unionByName(found.select(F.lit("symbol").alias("kind"), "path", F.lit(None).cast("long").alias("size")))


_NAMES = """, c AS (SELECT namespace AS name, uri, authority FROM v_resources WHERE id % 9 = 0 UNION ALL SELECT uri, uri, authority FROM v_resources WHERE id % 13 = 0 UNION ALL SELECT uri, 'x', 'repository' FROM v_resources WHERE id % 13 = 0),
 k AS (SELECT name, uri, CASE authority WHEN 'repository' THEN 0 WHEN 'gateway' THEN 1 ELSE 2 END AS r FROM c), a AS (SELECT DISTINCT namespace AS name FROM v_resources UNION SELECT uri FROM v_resources WHERE id % 13 = 0)"""


def _candidates(s, d):
    r = v.resources(s, d)
    uris = r.where("id % 13 = 0").select(F.col("uri").alias("name"), "uri", "authority")
    found = r.where("id % 9 = 0").select(F.col("namespace").alias("name"), "uri", "authority").unionByName(uris).unionByName(uris.select("name", F.lit("x").alias("uri"), F.lit("repository").alias("authority")))
    return r.select(F.col("namespace").alias("name")).unionByName(uris.select("name")), found


@query(_NAMES + """ SELECT a.name, CASE WHEN n IS NULL THEN 'not-found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN uri END AS uri, coalesce(n, 0) AS n FROM a
 LEFT JOIN (SELECT name, count(*) AS n, min(uri) AS uri FROM (SELECT *, min(r) OVER (PARTITION BY name) AS best FROM k) WHERE r = best GROUP BY 1) x ON x.name = a.name""")
def resolve_names(s, d):
    return store.outcomes(*_candidates(s, d))


@query(_NAMES + """ SELECT a.name, CASE WHEN n IS NULL THEN 'not-found' WHEN n = 1 OR same THEN 'found' ELSE 'ambiguous' END AS outcome, CASE WHEN same THEN a.name WHEN n = 1 THEN uri END AS uri, coalesce(n, 0) AS n FROM a
 LEFT JOIN (SELECT name, count(*) AS n, min(uri) AS uri, bool_or(uri = name) AS same FROM k GROUP BY 1) x ON x.name = a.name""")
def resolve_exact(s, d):
    return store.outcomes(*_candidates(s, d), narrow=False, exact_wins=True)


@query("SELECT v.id, uri, path, size, CASE WHEN v.id % 2 = 0 THEN n_name END AS symbol FROM v_resources v LEFT JOIN (SELECT mtime AS id, path, size FROM v_files WHERE mtime % 3 <> 0) f ON f.id = v.id LEFT JOIN nation ON n_nationkey = v.id % 25")
def optional_attributes(s, d):
    files = v.files(s, d).where("mtime % 3 <> 0").select(F.col("mtime").alias("id"), "path", "size")
    names = v.resources(s, d).where("id % 2 = 0").withColumn("k", F.col("id") % 25).join(v.table(s, d, "nation"), F.col("k") == F.col("n_nationkey")).select("id", F.col("n_name").alias("symbol"))
    return catalog.with_optional(v.resources(s, d).select("id", "uri"), [files, names], "id")


@query("""SELECT s.c_custkey AS id, s.c_name AS name, f.n_name AS path, p.s_name AS parent FROM customer s JOIN nation f ON f.n_nationkey = s.c_nationkey LEFT JOIN supplier p ON p.s_suppkey = s.c_custkey % 150 WHERE lower(c_name) LIKE '%1%'""")
def symbols_with_parents(s, d):
    symbols = v.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("file"), (F.col("c_custkey") % 150).alias("parent_id"))
    files = v.table(s, d, "nation").select(F.col("n_nationkey").alias("file"), F.col("n_name").alias("path"))
    parents = v.table(s, d, "supplier").select(F.col("s_suppkey").alias("parent_id"), F.col("s_name").alias("parent"))
    return catalog.symbol_rows(symbols.where(catalog.contains("name", "1")), files, parents).select("id", "name", "path", "parent")


@query("""SELECT uri, sum(access_count)::BIGINT AS uses FROM (SELECT resource, tool, count(*) AS access_count, max(seen) AS last_access FROM v_access GROUP BY 1, 2) JOIN v_resources ON id = resource WHERE last_access >= 1705000000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def recent_resources(s, d):
    return catalog.recent_resources(store.access_counts(v.access(s, d)), v.resources(s, d), 1705000000, 20)


@query("SELECT id, uri, hash FROM (SELECT id, uri, 'h' || id AS hash FROM v_resources) WHERE id = 12")
def point_lookup(s, d):
    r = v.resources(s, d).select("id", "uri", F.concat(F.lit("h"), F.col("id").cast("string")).alias("hash"))
    return catalog.lookup(r, uri="repo://docs/12")
