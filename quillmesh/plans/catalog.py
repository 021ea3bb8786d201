"""Registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmesh.functions import markdown, scalars, text
from quillmesh.operators import board, catalog, fts, graph, store
from quillmesh.plans import adapters as v
from quillmesh.plans.base import query
from quillmesh.sources import files as source_files

# files and resources


@query("SELECT path, extension, size, mtime FROM v_files WHERE lower(path) LIKE '%src1/%' AND extension = 'en' AND size >= 200 ORDER BY mtime DESC, path LIMIT 50")
def find_files(s, d):
    return catalog.find_files(v.files(s, d), "SRC1/", "en", 200, None, 50)


@query("SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM v_files")
def project_summary(s, d):
    return catalog.project_summary(v.files(s, d))


@query("SELECT extension, count(*) AS files, sum(size)::BIGINT AS bytes FROM v_files WHERE extension <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def language_breakdown(s, d):
    return catalog.language_breakdown(v.files(s, d))


@query("SELECT name, path FROM (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY path) AS r FROM v_files, (VALUES ('7.txt'), ('11.txt'), ('nope.md')) n(name) WHERE path LIKE '%' || name) WHERE r <= 3")
def key_files(s, d):
    return catalog.key_files(v.files(s, d), ["7.txt", "11.txt", "nope.md"])


@query("""SELECT p_name AS name, p_brand AS kind, p_type AS path, CASE WHEN p_name = 'S' THEN 0 WHEN lower(p_name) LIKE 's%' THEN 1 ELSE 2 END AS rank, p_partkey AS id
 FROM part WHERE lower(p_name) LIKE '%s%' AND p_brand = 'Brand#13' AND lower(p_type) LIKE '%e%' ORDER BY 4, 1, 3, 5 LIMIT 200""")
def symbol_search_rank(s, d):
    p = v.table(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.col("p_type").alias("path"), F.col("p_partkey").alias("id"))
    return catalog.symbol_search(p, "S", "Brand#13", "E", 200, last=["id"])


@query("""SELECT id, uri, CASE WHEN uri = 'repo://docs/12' THEN 0 WHEN title = 'repo://docs/12' THEN 1 WHEN ext = 'repo://docs/12' THEN 2 ELSE 3 END AS rank, 0 AS case_no FROM (SELECT *, 'x' || id AS ext FROM v_resources) WHERE uri = 'repo://docs/12'
 UNION ALL SELECT * FROM (SELECT id, uri, CASE WHEN ext = 'x7' THEN 2 ELSE 3 END, 1 FROM (SELECT *, 'x' || id AS ext FROM v_resources) WHERE lower(title) LIKE '%x7%' OR lower(ext) LIKE '%x7%' ORDER BY 3, 2 LIMIT 20)
 UNION ALL SELECT * FROM (SELECT id, uri, 3, 2 FROM v_resources WHERE lower(title) LIKE '%the%' AND namespace = 'src2' ORDER BY 2 LIMIT 20)""")
def resource_lookup(s, d):
    r = v.resources(s, d).withColumn("external_id", F.concat(F.lit("x"), F.col("id").cast("string")))
    found = [catalog.find_resources(r, "repo://docs/12"), catalog.find_resources(r, "X7").withColumn("rank", F.when(F.col("external_id") == "x7", 2).otherwise(F.col("rank"))), catalog.find_resources(r, "The", "src2")]
    parts = [f.select("id", "uri", "rank", F.lit(k).alias("case_no")) for k, f in enumerate(found)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT id, uri, authority FROM (SELECT *, CASE authority WHEN 'repository' THEN 0 WHEN 'gateway' THEN 1 ELSE 2 END AS r FROM v_resources WHERE kind = 'de')
 QUALIFY r = min(r) OVER ()""")
def most_authoritative(s, d):
    return catalog.most_authoritative(v.resources(s, d).where("kind = 'de'")).select("id", "uri", "authority")


@query("SELECT path FROM v_files WHERE regexp_matches(path, '^src1[0-9]/.*') AND NOT (regexp_matches(path, '^.*/fr/.*$') OR regexp_matches(split_part(path, '/', 3), '^[0-9]5.txt$'))")
def glob_filter(s, d):
    f = v.files(s, d).where(F.col("path").rlike("^src1[0-9]/"))
    return catalog.glob_filter(f, ["src1?/*"], ["*/fr/*", "?5.txt"]).select("path")


@query("SELECT DISTINCT lang AS name, TRUE AS is_dir, CAST(NULL AS BIGINT) AS size FROM documents WHERE source = 'src3'")
def list_dir(s, d):
    return catalog.list_dir(v.files(s, d), "src3")


@query("""SELECT '' AS parent, source AS name, TRUE AS is_dir, row_number() OVER (ORDER BY source) AS rank FROM (SELECT DISTINCT source FROM documents)
 UNION ALL SELECT source, lang, TRUE, row_number() OVER (PARTITION BY source ORDER BY lang) FROM (SELECT DISTINCT source, lang FROM documents)
 UNION ALL SELECT parent, name, FALSE, r FROM (SELECT source || '/' || lang AS parent, doc_id || '.txt' AS name, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id || '.txt') AS r FROM documents) WHERE r <= 2
 UNION ALL SELECT source || '/' || lang, '[+' || (count(*) - 2) || ' more]', FALSE, 3 FROM documents GROUP BY source, lang HAVING count(*) > 2""")
def tree_topn(s, d):
    return catalog.tree(v.files(s, d), 3, 2)


@query("""SELECT * FROM (SELECT 0 AS block, uri AS hit FROM v_resources WHERE kind = 'es' ORDER BY uri LIMIT 5)
 UNION ALL SELECT * FROM (SELECT 1, p_name || '#' || p_partkey FROM part ORDER BY 2 LIMIT 5) UNION ALL SELECT * FROM (SELECT 2, path FROM v_files ORDER BY path LIMIT 5)""")
def search_all(s, d):
    a = v.resources(s, d).where("kind = 'es'").select(F.col("uri").alias("hit"))
    b = v.table(s, d, "part").select(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("hit"))
    return catalog.search_all([a, b, v.files(s, d).select(F.col("path").alias("hit"))], ["hit"], 5)


# text

_LINES = """l0 AS (SELECT path, text, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS t, len(string_split(text, chr(10))) AS n FROM v_files),
 l AS (SELECT path, i + 1 AS line, t FROM l0 WHERE i < n - 1 OR t <> '')"""


@query(f""", {_LINES}, m AS (SELECT path, line, t, string_split_regex(t, 'th[ae]n?\\b') AS p, regexp_extract_all(t, 'th[ae]n?\\b') AS m FROM l WHERE regexp_matches(t, 'th[ae]n?\\b')),
 k AS (SELECT path, line, p, m, unnest(range(len(m))) AS i FROM m)
 SELECT path, line, (1 + coalesce(list_sum(list_transform(p[1:i + 1], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: strlen(x))), 0))::BIGINT AS byte, m[i + 1] AS match FROM k""")
def grep_matches(s, d):
    return text.matches(v.texts(s, d), text.check_regex(r"th[ae]n?\b"))


@query(f", {_LINES} SELECT f.path, coalesce(sum(len(regexp_extract_all(t, 'the '))), 0)::BIGINT AS n FROM v_files f LEFT JOIN l ON l.path = f.path GROUP BY 1")
def grep_count(s, d):
    return text.match_counts(v.texts(s, d), text.check_regex("the ", fixed=True))


@query(f", {_LINES} SELECT DISTINCT path FROM l WHERE regexp_matches(t, '\\| [a-z]+ \\|')")
def grep_files_with(s, d):
    return text.paths_with(v.texts(s, d), r"\| [a-z]+ \|")


@query(f", {_LINES} SELECT path FROM v_files WHERE path NOT IN (SELECT path FROM l WHERE regexp_matches(t, 'the'))")
def grep_files_without(s, d):
    return text.paths_with(v.texts(s, d), "the", inverse=True)


@query(f""", {_LINES} SELECT path, line, t AS text, regexp_matches(t, 'onha') AS is_match FROM l
 QUALIFY max(regexp_matches(t, 'onha')::INT) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) = 1""")
def grep_context(s, d):
    return text.context_lines(v.texts(s, d), "onha", before=1, after=2)


@query(f""", {_LINES} SELECT path, line, t AS old_text, regexp_replace(t, '(and) (the)', '\\2 \\1', 'g') AS new_text FROM l WHERE regexp_matches(t, '(and) (the)')""")
def sed_preview(s, d):
    return text.sed_preview(v.texts(s, d), "(and) (the)", text.escape_replacement("$2 $1", 2))


@query("SELECT path, regexp_replace(text, 'tion', 'TION', 'g') AS text, regexp_matches(text, 'tion') AS changed FROM v_files")
def sed_apply(s, d):
    return text.sed_apply(v.texts(s, d), "tion", "TION")


@query(f", {_LINES} SELECT path, line, t AS text FROM l WHERE line BETWEEN 2 AND 4")
def read_lines(s, d):
    return text.read_lines(v.texts(s, d), "2:4")


@query("SELECT path, size FROM v_files ORDER BY size DESC, path LIMIT 25 OFFSET 10")
def page_with_resume(s, d):
    return text.page(v.files(s, d), [F.desc("size"), "path"], 10, 25).select("path", "size")


# full text

_TOKENS = "t AS (SELECT id, ordinal, text, list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM v_segments)"


def _bm25(terms: list[str], test: str) -> str:
    f = [f"len(list_filter(t, lambda x: x = '{w}'))::DOUBLE AS f{k}" for k, w in enumerate(terms)]
    parts = " + ".join(f"CASE WHEN ln((N - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - n{k} + 0.5) / (n{k} + 0.5)) END * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * size / avgdl))" for k in range(len(terms)))
    stats = ", ".join(f"sum(CASE WHEN f{k} > 0 THEN 1 ELSE 0 END) AS n{k}" for k in range(len(terms)))
    return f""", {_TOKENS}, c AS (SELECT id, ordinal, text, len(t) AS size, {', '.join(f)} FROM t), s AS (SELECT count(*) AS N, avg(size) AS avgdl, {stats} FROM c),
 r AS (SELECT id, ordinal, text, -({parts}) AS rank FROM c, s WHERE {test})"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.round("rank", 6))


@query(_bm25(["the", "ouble"], "f0 > 0 OR f1 > 0") + " SELECT id, ordinal, round(rank, 6) AS rank FROM r")
def fts_or(s, d):
    return _rounded(fts.bm25(v.index(s, d), "the OR ouble")).select("id", "ordinal", "rank")


@query(_bm25(["and", "with"], "f0 > 0 AND f1 > 0") + " SELECT id, ordinal, round(rank, 6) AS rank FROM r")
def fts_and(s, d):
    return _rounded(fts.bm25(v.index(s, d), "and with")).select("id", "ordinal", "rank")


@query(_bm25(["er"], "f0 > 0") + " SELECT id, ordinal, round(rank, 6) AS rank FROM r ORDER BY r.rank, id, ordinal LIMIT 40")
def fts_bm25(s, d):
    return _rounded(fts.search_segments(v.index(s, d), "er", 40)).select("id", "ordinal", "rank")


@query(f", {_TOKENS} SELECT id, ordinal FROM t WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')")
def fts_phrase(s, d):
    return fts.bm25(v.index(s, d), '"of the"').select("id", "ordinal")


@query(
    _bm25(["thnt", "ouble", "ertion"], "f0 > 0 OR f1 > 0 OR f2 > 0")
    + """, b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, ordinal) AS rn FROM r)
 SELECT b.id, b.ordinal, round(b.rank, 6) AS rank, uri, authority, status FROM b JOIN v_resources v ON b.id = v.id WHERE rn = 1 AND kind = 'en'
 ORDER BY CASE authority WHEN 'repository' THEN 0 WHEN 'gateway' THEN 1 ELSE 2 END, CASE status WHEN 'stable' THEN 0 WHEN 'draft' THEN 1 ELSE 2 END, b.rank, uri LIMIT 30"""
)
def fts_filtered(s, d):
    found = fts.search(v.index(s, d), v.resources(s, d), "thnt OR ouble OR ertion", kind="en", limit=30)
    return _rounded(found).select("id", "ordinal", "rank", "uri", "authority", "status")


@query(f", {_TOKENS} SELECT term, count(*) AS segments, sum(tf)::BIGINT AS uses FROM (SELECT id, ordinal, term, count(*) AS tf FROM (SELECT id, ordinal, unnest(t) AS term FROM t) GROUP BY 1, 2, 3) GROUP BY 1")
def fts_vocabulary(s, d):
    return fts.postings(v.segments(s, d)).groupBy("term").agg(F.count(F.lit(1)).alias("segments"), F.sum("tf").alias("uses"))


# graph


@query("SELECT src, dst, relation FROM v_edges WHERE src IN ('nation:3', 'nation:7') AND relation = 'contains'")
def graph_out(s, d):
    return graph.hop(v.edges(s, d), s.createDataFrame([("nation:3",), ("nation:7",)], "node string"), "out", "contains")


@query("SELECT src, dst, relation FROM v_edges WHERE dst IN ('customer:5', 'order:9')")
def graph_in(s, d):
    return graph.hop_order(graph.hop(v.edges(s, d), s.createDataFrame([("customer:5",), ("order:9",)], "node string"), "in"))


@query("""SELECT src, dst, relation, 1 AS depth FROM v_edges WHERE src = 'region:2' UNION ALL
 SELECT src, dst, relation, 2 FROM v_edges WHERE src IN (SELECT dst FROM v_edges WHERE src = 'region:2')""")
def graph_bfs2(s, d):
    return graph.traverse(v.edges(s, d), s.createDataFrame([("region:2",)], "node string"), max_depth=2)


@query("""SELECT o_orderkey AS ref, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n IS NULL THEN 'extracted' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS confidence FROM orders LEFT JOIN
 (SELECT ref, count(*) AS n, min(target) AS target FROM (SELECT ref, target, score, max(score) OVER (PARTITION BY ref) AS best FROM (SELECT o_orderkey AS ref, c_custkey AS target,
 CASE WHEN o_custkey % 50 = c_custkey % 50 THEN 120 ELSE 20 END AS score FROM orders JOIN customer ON o_custkey % 400 = c_custkey % 400 AND o_custkey % 7 = c_nationkey % 7)) WHERE score = best GROUP BY ref) ON ref = o_orderkey""")
def edge_resolution(s, d):
    o = v.table(s, d, "orders").select(
        F.col("o_orderkey").alias("ref"), (F.col("o_custkey") % 400).cast("string").alias("name"), (F.col("o_custkey") % 7).cast("string").alias("language"), (F.col("o_custkey") % 50).cast("string").alias("file"), F.lit("calls").alias("relation")
    )
    c = v.table(s, d, "customer").select(
        F.col("c_custkey").alias("target"), (F.col("c_custkey") % 400).cast("string").alias("name"), (F.col("c_nationkey") % 7).cast("string").alias("language"), (F.col("c_custkey") % 50).cast("string").alias("file"), F.lit("class").alias("kind")
    )
    return graph.resolve(o, c, graph.symbol_score())


@query("""SELECT * FROM (SELECT src, dst, relation FROM (SELECT *, 0 AS b FROM v_edges WHERE relation = 'calls' AND src = 'customer:11' UNION ALL
 SELECT *, 1 FROM v_edges WHERE relation = 'contains' AND src = 'nation:1') ORDER BY b, src, dst LIMIT 20)""")
def impls_union(s, d):
    e = v.edges(s, d)
    return graph.union_fill(e.where("relation = 'calls' AND src = 'customer:11'"), e.where("relation = 'contains' AND src = 'nation:1'"), 20, ["src", "dst"])


@query("""SELECT o.id, uri, coalesce(n_segments, 0)::BIGINT AS n_segments, coalesce(uses, 0)::BIGINT AS uses FROM v_resources o
 LEFT JOIN (SELECT id, count(*) AS n_segments FROM v_segments GROUP BY 1) s ON s.id = o.id LEFT JOIN (SELECT resource, count(*) AS uses FROM v_access GROUP BY 1) a ON a.resource = o.id""")
def resource_detail(s, d):
    return catalog.resource_detail(v.resources(s, d), {"n_segments": v.segments(s, d).select("id")}, store.access_counts(v.access(s, d))).select("id", "uri", "n_segments", "uses")


_SPANS = "s AS (SELECT l_orderkey * 10 + l_linenumber AS owner, l_orderkey AS file, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity AS BIGINT) + l_linenumber * 5 AS b FROM lineitem)"


@query(f", {_SPANS} SELECT point, owner FROM (SELECT o_orderkey AS point, owner, row_number() OVER (PARTITION BY o_orderkey ORDER BY b - a, a, owner) AS r FROM orders JOIN s ON file = o_orderkey AND 25 BETWEEN a AND b) WHERE r = 1")
def span_owner(s, d):
    q = F.col("l_quantity").cast("long")
    spans = v.table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("owner"), F.col("l_orderkey").alias("file"), q.alias("start"), (q + F.col("l_linenumber") * 5).alias("end"))
    points = v.table(s, d, "orders").select(F.col("o_orderkey").alias("point"), F.col("o_orderkey").alias("file"), F.lit(25).alias("at"))
    return graph.smallest_enclosing(spans, points)


# store


@query("SELECT path, CASE WHEN mtime % 3 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN mtime % 3 = 0 AND mtime % 5 <> 0 THEN 2 ELSE 1 END AS created FROM v_files")
def upsert_nodes(s, d):
    f = v.files(s, d)
    old = f.where("mtime % 5 = 0 OR mtime % 3 <> 0").select("path", "size", F.lit(1).alias("created"))
    new = f.where("mtime % 3 = 0").select("path", (F.col("size") + 1).alias("size"), F.lit(2).alias("created"))
    return store.upsert(old, new, ["path"], ["created"])


@query("""SELECT path, CASE WHEN mtime % 11 = 0 THEN 'insert' WHEN mtime % 7 = 0 THEN 'delete' WHEN mtime % 3 = 0 THEN 'update' ELSE 'skip' END AS action FROM v_files""")
def scan_diff(s, d):
    f = v.files(s, d)
    old = f.where("mtime % 11 <> 0")
    new = f.where("mtime % 7 <> 0 OR mtime % 11 = 0").withColumn("size", F.when(F.col("mtime") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return store.scan_diff(old, new)


@query("SELECT id, uri FROM v_resources WHERE namespace <> 'src2' OR id % 4 = 0")
def prune_origin(s, d):
    r = v.resources(s, d)
    return store.prune_to_retained(r, r.where("id % 4 = 0").select("id"), {"namespace": "src2"}, "id").select("id", "uri")


@query("SELECT namespace, id FROM (SELECT namespace, id, row_number() OVER (PARTITION BY namespace ORDER BY id % 100 DESC, id DESC) AS r FROM v_resources) WHERE r <= 5")
def prune_recent(s, d):
    r = v.resources(s, d).withColumn("at", F.col("id") % 100)
    return store.prune_to_recent(r, ["namespace"], 5, "at", "id").select("namespace", "id")


@query("SELECT id AS resource, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN id % 2 = 0 THEN 'new' ELSE 'old' END AS hash FROM v_resources")
def current_version(s, d):
    r = v.resources(s, d).select(F.col("id").alias("resource"))
    stored = r.withColumn("hash", F.lit("old")).withColumn("version", F.lit(1))
    new = r.withColumn("hash", F.when(F.col("resource") % 2 == 0, "new").otherwise("old"))
    return store.current_versions(store.put_version(stored, new))


@query("SELECT uri AS source_ref, CASE WHEN id % 4 = 0 THEN 'create' WHEN id % 3 = 0 THEN 'update' ELSE 'reuse' END AS action FROM v_resources")
def publish_plan(s, d):
    r = v.resources(s, d)
    have = r.where("id % 4 <> 0").select(F.col("uri").alias("source_ref"), F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("version"))
    return store.publish_plan(r.select(F.col("uri").alias("source_ref"), F.lit(2).alias("version")), have)


@query("""SELECT coalesce(c.k, s.k) AS name, CASE WHEN c.k IS NULL THEN 'pull' WHEN s.k IS NULL THEN 'push' WHEN c.n <> s.n THEN 'push' ELSE 'none' END AS action FROM
 (SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_custkey % 3 <> 0) c FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) s ON c.k = s.k""")
def sync_plan(s, d):
    c = v.table(s, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("checksum"))
    return store.sync_plan(c, v.table(s, d, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("checksum")))


@query("SELECT resource, tool, count(*) AS access_count, min(seen) AS first_access, max(seen) AS last_access FROM v_access GROUP BY 1, 2")
def access_counts(s, d):
    return store.access_counts(v.access(s, d))


@query("SELECT id, kind AS tag FROM v_resources UNION SELECT id, namespace FROM v_resources WHERE id % 2 = 0")
def insert_tags(s, d):
    r = v.resources(s, d)
    old = r.select("id", F.col("kind").alias("tag"))
    more = r.where("id % 2 = 0").select("id", F.col("namespace").alias("tag"))
    return store.insert_or_ignore(old, more.unionByName(more).unionByName(old), ["id", "tag"])


@query("SELECT src, dst, relation FROM v_edges WHERE NOT (src = 'nation:4' AND relation = 'contains') UNION ALL SELECT 'nation:4', 'customer:0', 'contains'")
def replace_edges(s, d):
    return store.replace_owned(v.edges(s, d), s.createDataFrame([("nation:4", "customer:0", "contains")], "src string, dst string, relation string"), ["src", "relation"])


# boards


@query("""SELECT t.id, title, t.status, rank, coalesce(n, 0)::BIGINT AS comment_count, c.status_count, CASE t.status WHEN 'todo' THEN 0 WHEN 'in_progress' THEN 1 ELSE 2 END AS status_place FROM v_tasks t
 LEFT JOIN (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1) l ON l.id = t.id JOIN (SELECT status, count(*) AS status_count FROM v_tasks WHERE status <> 'done' GROUP BY 1) c ON c.status = t.status WHERE t.status <> 'done'""")
def task_board(s, d):
    t = board.list_tasks(v.tasks(s, d))
    return board.task_board(t, v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"))).select("id", "title", "status", "rank", "comment_count", "status_count", "status_place")


@query("""SELECT id, title, CASE WHEN contains(title, '1') THEN 1 ELSE 0 END + CASE WHEN contains(title, 'urgent') THEN 1 ELSE 0 END + CASE WHEN contains(title, '77') THEN 1 ELSE 0 END AS score
 FROM v_tasks WHERE score > 0 ORDER BY score DESC, id LIMIT 25""")
def task_score(s, d):
    return board.token_overlap(v.tasks(s, d), ["1", "urgent", "77", "1"], "title", 25).select("id", "title", "score")


@query("SELECT conv, id, sender FROM v_messages WHERE sender <> 'user' AND NOT (id % 4 = 1 AND conv % 2 = 0)")
def unread_messages(s, d):
    m = v.messages(s, d)
    return board.unread(m, m.where("id % 4 = 1 AND conv % 2 = 0").select("conv", "id"), "user").select("conv", "id", "sender")


@query("SELECT a.conv, a.id, a.sender, b.sender AS parent_sender FROM v_messages a JOIN v_messages b ON a.conv = b.conv AND a.parent = b.id")
def thread_join(s, d):
    return board.threads(v.messages(s, d)).select("conv", "id", "sender", "parent_sender")


@query("""SELECT uri, first(title ORDER BY position, gateway) AS title, first(hash ORDER BY position, gateway) AS hash, string_agg(DISTINCT gateway || '/' || authority, ',' ORDER BY gateway || '/' || authority) AS origins FROM
 (SELECT 'c' AS gateway, 'gateway' AS authority, 'n' || c_nationkey AS uri, c_name AS title, c_mktsegment AS hash, c_acctbal >= 0 AS authorized, c_custkey AS position FROM customer
  UNION ALL SELECT 's', 'repository', 'n' || s_nationkey, s_name, 'S', TRUE, s_suppkey FROM supplier) WHERE authorized GROUP BY uri""")
def federation_merge(s, d):
    c = v.table(s, d, "customer").select(F.lit("c").alias("gateway"), F.lit("gateway").alias("authority"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("uri"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("hash"), (F.col("c_acctbal") >= 0).alias("authorized"), F.col("c_custkey").alias("position"))
    p = v.table(s, d, "supplier").select(F.lit("s").alias("gateway"), F.lit("repository").alias("authority"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("uri"), F.col("s_name").alias("title"), F.lit("S").alias("hash"), F.lit(True).alias("authorized"), F.col("s_suppkey").alias("position"))
    return board.federate(c.unionByName(p))


@query("SELECT CASE WHEN namespace = 'src0' THEN 'default' ELSE namespace END AS space, count(*) AS n, min(id) AS first_id, first(title ORDER BY id) AS first_title FROM v_resources GROUP BY 1")
def docs_hierarchy(s, d):
    return board.docs_hierarchy(v.resources(s, d).withColumn("space", F.when(F.col("namespace") == "src0", "").otherwise(F.col("namespace"))))


@query("SELECT id, slug, version FROM v_patterns WHERE lower(body) LIKE '%the%' AND version = '1'")
def pattern_search(s, d):
    return board.search_patterns(v.patterns(s, d), "the", version="1").select("id", "slug", "version")


@query("SELECT p.slug, replace(p.state, 'superseded-by:', '') AS replacement, 'review ' || p.slug AS task_title, 'create' AS action FROM v_patterns p WHERE p.state LIKE 'superseded-by:%' AND p.id % 10 = 0")
def pattern_check(s, d):
    p = v.patterns(s, d)
    open_ = p.where("id % 10 <> 0").select(F.concat(F.lit("review "), F.col("slug")).alias("task_title"))
    return board.pattern_tasks(p, open_).where("action = 'create'").select("slug", "replacement", "task_title", "action")


# context


@query("SELECT resource, sum(access_count)::BIGINT AS uses FROM (SELECT resource, tool, count(*) AS access_count, max(seen) AS last_access FROM v_access GROUP BY 1, 2) WHERE last_access >= 1705000000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def recent_accesses(s, d):
    return board.recent_accesses(store.access_counts(v.access(s, d)), 1705000000, 20)


@query("SELECT id, ordinal, running FROM (SELECT id, ordinal, sum(length(text)) OVER (PARTITION BY id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM v_segments) WHERE running <= 3000")
def budgeted_snippets(s, d):
    return board.within_budget(v.segments(s, d), ["ordinal"], F.length("text"), 3000, ["id"]).select("id", "ordinal", F.col("running").cast("long").alias("running"))


# extraction and scalars


@query("SELECT page_id, m AS href, row_number() OVER (PARTITION BY page_id ORDER BY i) AS place FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS m, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) AS i FROM pages)")
def link_extract(s, d):
    hits = v.table(s, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("at", "href"))
    return hits.select("page_id", "href", (F.col("at") + 1).cast("long").alias("place"))


@query("SELECT id, ordinal, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::BIGINT AS token_count, sha256(text) AS content_hash FROM v_segments")
def md_segments(s, d):
    return v.segments(s, d).select("id", "ordinal", "text", F.size(F.filter(F.split("text", "\\s+"), lambda x: x != "")).cast("long").alias("token_count"), F.sha2("text", 256).alias("content_hash"))


@query("SELECT p_partkey AS id, rtrim(left(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 100), '-') AS name FROM part")
def name_sanitize(s, d):
    return v.table(s, d, "part").select(F.col("p_partkey").alias("id"), scalars.sanitize_name(F.concat_ws(" ", "p_name", "p_type")).alias("name"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z+]+://', ''), '^[^@/]+@', ''), '^([^/:]+):([^0-9/])', '\\1/\\2'), '(\\.git)?/*$', '') AS ident FROM pages")
def ident_normalize(s, d):
    return v.table(s, d, "pages").select("page_id", scalars.normalize_ident(F.col("url")).alias("ident"))


@query("""SELECT path, CASE WHEN size < 1024 THEN size || 'B' WHEN size < 1048576 THEN printf('%.1fK', size / 1024.0) ELSE printf('%.1fM', size / 1048576.0) END AS shown FROM v_files""")
def size_format(s, d):
    return v.files(s, d).select("path", scalars.format_size(F.col("size")).alias("shown"))


@query("SELECT id, ordinal, CASE WHEN length(t) <= 40 THEN t ELSE left(t, 39) || '…' END AS snippet FROM (SELECT id, ordinal, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM v_segments)")
def compact_snippet(s, d):
    return v.segments(s, d).select("id", "ordinal", scalars.compact(F.col("text"), 40).alias("snippet"))


@query("""SELECT path, 'text' AS class, starts_with(t, chr(65279)) AS has_bom, CASE WHEN n = 0 THEN 'none' WHEN c = 0 THEN 'lf' WHEN c = n THEN 'crlf' ELSE 'mixed' END AS line_ending,
 CASE WHEN suffix(t, chr(13) || chr(10)) THEN 'crlf' WHEN suffix(t, chr(10)) THEN 'lf' ELSE 'none' END AS trailing_newline
 FROM (SELECT path, coalesce(text, '') AS t, length(t) - length(replace(t, chr(10), '')) AS n, (length(t) - length(replace(t, chr(13) || chr(10), ''))) // 2 AS c FROM v_files)""")
def file_classes(s, d):
    classed = source_files.classify(v.texts(s, d).select("path", F.col("text").cast("binary").alias("content")))
    return classed.select("path", "class", "has_bom", "line_ending", "trailing_newline")


_HEADED = """d AS (SELECT path, 'before' || chr(10) || '# One' || chr(10) || text || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || '### Three [in](x/' || mtime || '.md) it' || chr(10) || 'end' AS text FROM v_files WHERE NOT regexp_matches(text, '(^|\n)\\s{0,3}(#|```|~~~)')),
 l AS (SELECT path, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM d),
 h AS (SELECT *, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte FROM l)"""


def _marked(docs):
    """Rows of path, text, mtime as Markdown: a preamble, two headings, a fence that holds a false one, and a link."""
    link = F.concat(F.lit("\n```\n# no heading\n```\n### Three [in](x/"), F.col("mtime").cast("string"), F.lit(".md) it\nend"))
    return docs.select("path", F.concat(F.lit("before\n# One\n"), F.col("text"), link).alias("text"))


def _headed(s, d):
    """Documents without headings or fences of their own, :func:`_marked`."""
    return _marked(v.texts(s, d).join(v.files(s, d).select("path", "mtime"), "path").where(~F.col("text").rlike("(^|\n)\\s{0,3}(#|```|~~~)")))


@query(f""", {_HEADED} SELECT path, 0 AS ordinal, path AS title, 1 AS start_line, 1 AS end_line, 0::BIGINT AS start_byte FROM d
 UNION ALL SELECT path, 1, 'One', 2, n - 2, byte FROM h WHERE i = 1 UNION ALL SELECT path, 2, regexp_extract(t, '^### (.*)$', 1), n - 1, n, byte FROM h WHERE i = n - 2""")
def heading_segments(s, d):
    return markdown.segments(_headed(s, d)).select("path", "ordinal", "title", "start_line", "end_line", "start_byte")


@query(f""", {_HEADED} SELECT path, 1::BIGINT AS level, 'One' AS title, 2::BIGINT AS line FROM d UNION ALL SELECT path, 3, regexp_extract(t, '^### (.*)$', 1), n - 1 FROM h WHERE i = n - 2""")
def heading_outline(s, d):
    found = markdown.outline(_headed(s, d)).select("path", F.explode("headings").alias("h"))
    return found.select("path", F.col("h.level").cast("long").alias("level"), F.col("h.text").alias("title"), F.col("h.line").cast("long").alias("line"))


# every document, with the headings and fences that its text has: a fold over its lines keeps the open fence and the next heading of level one
@query(r""", d AS (SELECT path, string_split('before' || chr(10) || '# One' || chr(10) || text || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || '### Three [in](x/' || mtime || '.md) it' || chr(10) || 'end', chr(10)) AS l FROM v_files WHERE text IS NOT NULL AND mtime IS NOT NULL),
 m AS (SELECT path, l, list_transform(l, lambda t, i: {'i': i, 'mark': regexp_extract(t, '^[\s\v\x1c-\x1f\x{85}\pZ]*(`{3,}|~{3,})', 1), 'top': i > 2 AND regexp_matches(t, '^[\s\v\x1c-\x1f\x{85}\pZ]*# ')}) AS m FROM d),
 c AS (SELECT path, l, list_reduce(m, lambda s, x: {'i': CASE WHEN s.i > 0 THEN s.i WHEN s.mark = '' AND x.mark = '' AND x.top THEN x.i ELSE 0 END,
  'mark': CASE WHEN x.mark = '' THEN s.mark WHEN s.mark = '' THEN x.mark WHEN x.mark[1] = s.mark[1] AND len(x.mark) >= len(s.mark) THEN '' ELSE s.mark END, 'top': FALSE}, {'i': 0::BIGINT, 'mark': '', 'top': FALSE}).i AS cut FROM m)
 SELECT path, array_to_string(list_transform(l[2:CASE WHEN cut > 0 THEN cut - 1 ELSE len(l) END], lambda t: regexp_replace(t, '\r$', '')), chr(10)) || chr(10) AS section FROM c""")
def doc_section(s, d):
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return markdown.section(_marked(v.table(s, d, "documents").select(path.alias("path"), "text", F.col("doc_id").alias("mtime"))), "oNE")


@query(f""", {_HEADED} SELECT path, 'in' AS label, 'x/' || regexp_extract(t, 'x/([0-9]+)', 1) || '.md' AS target, (n - 1)::BIGINT AS line FROM h WHERE i = n - 2""")
def inline_links(s, d):
    return markdown.inline_links(_headed(s, d)).select("path", "label", "target", F.col("line").cast("long").alias("line"))
