"""Queries of search: forms of the query language, filters, documents; traversals."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillmesh.operators import board, fts, ftsdelta, graph
from quillmesh.plans import adapters as v
from quillmesh.plans.base import query
from quillmesh.plans.catalog import _TOKENS, _bm25, _rounded

_RANKED = """, b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, ordinal) AS rn FROM r)
 SELECT b.id, b.ordinal, round(b.rank, 6) AS rank, uri FROM b JOIN v_resources v ON b.id = v.id WHERE rn = 1 AND {} ORDER BY CASE authority WHEN 'repository' THEN 0 WHEN 'gateway' THEN 1 ELSE 2 END,
 CASE status WHEN 'stable' THEN 0 WHEN 'draft' THEN 1 ELSE 2 END, b.rank, uri LIMIT {}"""


@query(_bm25(["cion", "asion"], "f0 > 0 OR f1 > 0") + " SELECT id, ordinal, round(rank, 6) AS rank FROM r")
def fts_diacritics(s, d):
    return _rounded(fts.bm25(v.index(s, d), "ción OR ASION"))


@query(f", {_TOKENS}" + """, p AS (SELECT id, ordinal, list_filter(range(len(t)), lambda i: t[i + 1] = 'the') AS a, list_filter(range(len(t)), lambda i: t[i + 1] = 'and') AS b FROM t)
 SELECT id, ordinal FROM p WHERE len(list_filter(a, lambda x: len(list_filter(b, lambda y: abs(y - x) - 1 <= 3)) > 0)) > 0""")
def fts_near(s, d):
    return fts.bm25(v.index(s, d), "NEAR(the and, 3)").select("id", "ordinal")


@query(f", {_TOKENS}" + """, h AS (SELECT t.id, ordinal, t, list_filter(string_split_regex(strip_accents(lower(title)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS h FROM t JOIN v_resources v ON v.id = t.id)
 SELECT id, ordinal FROM h WHERE list_contains(h, 'the') AND list_contains(t, 'and') AND NOT list_contains(h, 'of')""")
def fts_column(s, d):
    return fts.bm25(v.index(s, d, ("text", "title")), "title:the AND text:and NOT title:of").select("id", "ordinal")


@query(f", {_TOKENS} SELECT id, ordinal FROM t WHERE len(list_filter(t, lambda x: starts_with(x, 'thn'))) > 0 OR contains(' ' || array_to_string(t, ' ') || ' ', ' and the ')")
def fts_prefix(s, d):
    return fts.bm25(v.index(s, d), "thn* OR and_the").select("id", "ordinal")


@query(_bm25(["the"], "f0 > 0") + _RANKED.format("v.id IN (SELECT mtime FROM v_files WHERE path = 'src3/en/' || mtime || '.txt') AND b.id IN (SELECT mtime FROM v_files WHERE path = (SELECT min(path) FROM v_files WHERE path LIKE 'src3/en/%'))", 20))
def fts_path_filter(s, d):
    files = v.files(s, d).select(F.col("mtime").alias("id"), "path")
    path = files.where(F.col("path").startswith("src3/en/")).agg(F.min("path")).first()[0]
    return _rounded(fts.search(v.index(s, d), v.resources(s, d), "the", path=path, files=files)).select("id", "ordinal", "rank", "uri")


@query(_bm25(["the"], "f0 > 0") + _RANKED.format("(b.id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') OR b.id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')) AND kind = 'en' AND status = 'draft' AND namespace <> 'x'", 30))
def fts_relation_filter(s, d):
    edges = v.table(s, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderpriority").alias("relation"))
    found = fts.search(v.index(s, d), v.resources(s, d), "the", 30, relation="1-URGENT", edges=edges, kind="en", status="draft", namespace=None)
    return _rounded(found).select("id", "ordinal", "rank", "uri")


@query(_bm25(["and"], "f0 > 0") + ", b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, ordinal) AS rn FROM r)" + """
 SELECT b.id, title, uri, round(b.rank, 6) AS rank FROM b JOIN v_resources v ON b.id = v.id WHERE rn = 1 AND namespace = 'src1' ORDER BY CASE authority WHEN 'repository' THEN 0 WHEN 'gateway' THEN 1 ELSE 2 END,
 CASE status WHEN 'stable' THEN 0 WHEN 'draft' THEN 1 ELSE 2 END, b.rank, uri LIMIT 100""")
def docs_search(s, d):
    return _rounded(fts.search_docs(v.index(s, d), v.resources(s, d).where("namespace = 'src1'"), "and", 500))


@query(_bm25(["what", "is", "the"], "f0 > 0 OR f1 > 0 OR f2 > 0") + " SELECT id, ordinal, round(rank, 6) AS rank FROM r ORDER BY r.rank, id, ordinal LIMIT 15")
def prompt_search(s, d):
    return _rounded(fts.search_segments(v.index(s, d), fts.prompt_query("What is_the?"), 15))


#: Letters of other scripts for some of ours, so that texts hold Cyrillic, Greek and kana.
_OTHERS = ("aeiou", "\u0439\u03ad\u304c\u0451\u03cd")


@query((_bm25(["th\u03ad", "\u0439nd", "f\u0451r"], "f0 > 0 AND (f1 > 0 OR f2 > 0)") + " SELECT id, ordinal, round(rank, 6) AS rank FROM r").replace("strip_accents(lower(text))", f"translate(strip_accents(lower(text)), '{_OTHERS[0]}', '{_OTHERS[1]}')"))
def fts_scripts(s, d):
    rows = v.segments(s, d).withColumn("text", F.translate(fts.fold("text"), *_OTHERS))
    return _rounded(fts.bm25(fts.build_index(rows), "TH\u0388 (\u0419nd OR F\u0401r)"))


@query(f", {_TOKENS}" + """, h AS (SELECT t.id, ordinal, t, list_filter(string_split_regex(strip_accents(lower(title)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS h FROM t JOIN v_resources v ON v.id = t.id)
 SELECT id, ordinal FROM h WHERE ((t[1] = 'the' OR h[1] = 'the') AND list_contains(t, 'and')) OR contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') OR contains(' ' || array_to_string(h, ' ') || ' ', ' of the ')""")
def fts_forms(s, d):
    return fts.bm25(v.index(s, d, ("text", "title")), '^the AND -title:and OR {text title}: of + "the"').select("id", "ordinal")


def changed(s, d) -> ftsdelta.Live:
    """An index that starts with all segments; then texts of poor quality are replaced, toxic documents go, benchmark items and turns come in."""
    labels = v.table(s, d, "labels")
    items = v.table(s, d, "benchmark").select((-1 - F.col("item_id")).alias("id"), F.lit(0).alias("ordinal"), "text")
    turns = v.table(s, d, "conversations").select((-1_000_000_000 - F.col("conv_id")).alias("id"), F.col("turn").alias("ordinal"), "text")
    poor = v.segments(s, d).join(labels.where("quality = 0").select(F.col("doc_id").alias("id")), "id", "left_semi")
    live = ftsdelta.apply(ftsdelta.create(s), v.segments(s, d))
    live = ftsdelta.apply(live, poor.withColumn("text", F.concat(F.lit("reviewed the "), "text")))
    live = ftsdelta.apply(live, taken=labels.where("toxic = 1").select(F.col("doc_id").alias("id")))
    return ftsdelta.merge(ftsdelta.apply(ftsdelta.apply(live, items), turns), tidy=True)


_CHANGED = """, live AS (SELECT s.id, ordinal, CASE WHEN quality = 0 THEN 'reviewed the ' || text ELSE text END AS text FROM v_segments s LEFT JOIN labels l ON l.doc_id = s.id WHERE coalesce(toxic, 0) <> 1
 UNION ALL SELECT -1 - item_id, 0, text FROM benchmark UNION ALL SELECT -1000000000 - conv_id, turn, text FROM conversations)"""


@query(_CHANGED + _bm25(["the", "reviewed"], "f0 > 0 OR f1 > 0").replace("FROM v_segments", "FROM live") + " SELECT id, ordinal, round(rank, 6) AS rank FROM r")
def fts_incremental(s, d):
    return _rounded(fts.bm25(ftsdelta.index(changed(s, d)), "the OR reviewed"))


_ORDER = "CASE authority WHEN 'repository' THEN 0 WHEN 'gateway' THEN 1 ELSE 2 END, CASE status WHEN 'stable' THEN 0 WHEN 'draft' THEN 1 ELSE 2 END"


@query(_bm25(["the"], "f0 > 0") + f""", b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, ordinal) AS rn FROM r),
 k AS (SELECT b.id, authority, status, row_number() OVER (ORDER BY {_ORDER}, b.rank, uri) AS place FROM b JOIN v_resources v ON b.id = v.id WHERE rn = 1),
 u AS (SELECT resource, count(*) AS n FROM v_access GROUP BY 1)
 SELECT id, coalesce(n, 0)::BIGINT AS uses FROM k LEFT JOIN u ON resource = id WHERE place <= 80 ORDER BY {_ORDER}, coalesce(n, 0) DESC, place LIMIT 20""")
def usage_rerank(s, d):
    k = 20
    found = fts.search(v.index(s, d), v.resources(s, d), "the", limit=4 * k)
    place = F.row_number().over(Window.orderBy(fts.authority_rank(), fts.status_rank(), "rank", "uri"))  # 4 k rows
    uses = v.access(s, d).groupBy("resource").agg(F.count(F.lit(1)).alias("uses"))
    return board.usage_rerank(found.withColumn("place", place), uses, k).select("id", "uses")


# traversals: the reached nodes of each level, and their edges

def _bfs(start: str, depth: int, out: bool, into: bool) -> str:
    """SQL of a traversal, a step at a time: edges of nodes that are first met at each level."""
    steps = []
    for k in range(depth):
        sides = ([f"SELECT l.*, dst AS next FROM v_links l JOIN n{k} ON src = node"] if out else []) + ([f"SELECT l.*, src AS next FROM v_links l JOIN n{k} ON dst = node"] if into else [])
        steps.append(f"e{k} AS ({' UNION ALL '.join(sides)})")
        met = " UNION ALL ".join(f"SELECT node FROM n{i}" for i in range(k + 1))
        steps.append(f"n{k + 1} AS (SELECT DISTINCT next AS node FROM e{k} WHERE next IS NOT NULL AND next NOT IN ({met}))")
    every = " UNION ALL ".join(f"SELECT edge, src, dst, relation, dst_ref, {k + 1} AS depth FROM e{k}" for k in range(depth))
    return f""", n0 AS (SELECT '{start}' AS node), {', '.join(steps)}
 SELECT edge, src, dst, relation, dst_ref, min(depth) AS depth FROM ({every}) GROUP BY edge, src, dst, relation, dst_ref"""


def _from(s, node):
    return s.createDataFrame([(node,)], "node string")


@query(_bfs("customer:7", 3, True, True))
def graph_bfs_both(s, d):
    return graph.traverse(v.links(s, d), _from(s, "customer:7"), "both", max_depth=3)


@query(_bfs("region:1", 5, True, False))
def graph_bfs5(s, d):
    return graph.traverse(v.links(s, d), _from(s, "region:1"), "out", max_depth=5)


@query(_bfs("order:5", 4, False, True))
def graph_bfs_in(s, d):
    return graph.traverse(v.links(s, d), _from(s, "order:5"), "in", max_depth=4)


@query("SELECT * FROM (" + _bfs("nation:3", 5, True, True).replace(", n0 AS", "WITH n0 AS", 1) + ") ORDER BY depth, relation, src, coalesce(dst, dst_ref), edge LIMIT 100")
def graph_remote(s, d):
    return graph.remote_traverse(v.links(s, d), _from(s, "nation:3"), "both", None, 9, 1000)


@query("""SELECT node, coalesce(u, 0)::BIGINT AS uses, count(*) FILTER (direction = 'out') AS n_out, count(*) FILTER (direction = 'in') AS n_in, string_agg(direction || ' ' || relation || ' ' || other, '; ' ORDER BY direction || ' ' || relation || ' ' || other) AS near FROM
 (SELECT src AS node, 'out' AS direction, relation, coalesce(dst, dst_ref) AS other FROM v_links UNION ALL SELECT dst, 'in', relation, src FROM v_links)
 LEFT JOIN (SELECT 'nation:' || resource AS n, count(*) AS u FROM v_access GROUP BY 1) ON n = node WHERE node LIKE 'nation:%' GROUP BY node, u""")
def node_detail(s, d):
    nodes = v.table(s, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node"))
    uses = v.access(s, d).groupBy(F.concat(F.lit("nation:"), F.col("resource").cast("string")).alias("node")).agg(F.count(F.lit(1)).alias("uses"))
    return graph.neighbours(nodes, v.links(s, d), uses)
