"""Queries of observations, virtual documents, pattern catalogs and front matter."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import markdown
from quillmesh.operators import observe, virtual
from quillmesh.plans import adapters as v
from quillmesh.plans.base import query
from quillmesh.sources import documents

_LINKS = """, w AS (SELECT event_id AS work, CAST(floor(epoch(ts)) AS BIGINT) AS done_at FROM events WHERE event_type = 'purchase'),
 p AS (SELECT work, done_at, resource, tool, count(*) AS uses, max(seen) AS last FROM w JOIN v_access ON seen <= done_at GROUP BY ALL),
 t AS (SELECT work, done_at, resource, sum(uses)::BIGINT AS uses FROM p WHERE last >= done_at - 43200 GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY uses DESC, resource) AS rank FROM t)"""


def _work(s, d):
    return v.table(s, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("work"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))


@query(_LINKS + " SELECT work, rank, resource, uses FROM k WHERE rank <= 8")
def observation_links(s, d):
    return observe.observation_links(_work(s, d), v.access(s, d))


@query(_LINKS + """, l AS (SELECT work, string_agg('- ' || CASE WHEN resource % 3 = 0 THEN '`repo://docs/' || resource || '`' ELSE '[r' || resource || '](' || CASE resource % 3 WHEN 1 THEN '/x' || resource || '.md' ELSE '/code/f' || resource || '.md' END || ')' END
 || ' \u2014 read ' || uses || CASE WHEN uses = 1 THEN ' time' ELSE ' times' END || chr(10), '' ORDER BY rank) AS list FROM k WHERE rank <= 8 GROUP BY 1)
 SELECT work, 'draft' AS status, '# work ' || work || chr(10) || chr(10) || 'done' || chr(10) || chr(10) || '## Resources touched' || chr(10) || chr(10) || list AS body FROM l JOIN w USING (work) ORDER BY done_at DESC, work DESC LIMIT 200""")
def observations(s, d):
    work = _work(s, d).withColumns({"title": F.concat(F.lit("work "), F.col("work").cast("string")), "outcome": F.lit("done")})
    k, n = F.col("resource") % 3, F.col("resource").cast("string")
    space = F.when(k == 0, "doc").when(k == 1, "okf").otherwise("file")
    uri = F.when(k == 0, F.concat(F.lit("repo://docs/"), n)).when(k == 1, F.concat(F.lit("okf://p/o/x"), n, F.lit(".md"))).otherwise(F.concat(F.lit("repo://p/f"), n))
    rows = v.access(s, d).select("resource").distinct().select("resource", F.concat(F.lit("r"), n).alias("title"), uri.alias("uri"), space.alias("space"))
    rows = rows.withColumn("link", observe.concept_link(F.col("space"), F.col("uri"), F.lit("o"), F.col("title"), F.lit("p")))
    made = observe.observations(work, observe.observation_links(_work(s, d), v.access(s, d)), rows)
    return made.select("work", "status", "body")


_VERSIONS = "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 1 THEN 'type: note' || chr(10) || 'n: ' || doc_id || chr(10) || chr(10) END AS raw, text AS body FROM documents"


@query(f""", x AS ({_VERSIONS}), t AS (SELECT CASE WHEN raw IS NULL THEN coalesce(body, '') ELSE '---' || chr(10) || rtrim(raw, chr(10)) || chr(10) || '---' || chr(10) || coalesce(body, '') END AS t FROM x WHERE id = 41),
 l AS (SELECT t, string_split(t, chr(10)) AS p FROM t), r AS (SELECT unnest(range(1, len(p) + 1)) AS line, unnest(p) AS text, len(p) AS n FROM l)
 SELECT 'repo://docs/41' AS target, line, text || CASE WHEN line < n THEN chr(10) ELSE '' END AS text FROM r WHERE line BETWEEN 2 AND 9 AND (line < n OR text <> '')""")
def read_virtual(s, d):
    docs = v.table(s, d, "documents")
    raw = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("type: note\nn: "), F.col("doc_id").cast("string"), F.lit("\n\n")))
    versions = docs.select(F.col("doc_id").alias("id"), raw.alias("raw"), F.col("text").alias("body"))
    resources = v.resources(s, d).withColumn("external_id", F.concat(F.lit("x"), F.col("id").cast("string")))
    return virtual.read_virtual("repo://docs/41", "2:9", v.texts(s, d), resources, versions)


_CLEAN = "regexp_replace(translate(text, '#`~', ''), '\\s+$', '')"


@query(f""", c AS (SELECT path, mtime::VARCHAR AS k, {_CLEAN} AS t FROM v_files WHERE text IS NOT NULL)
 SELECT path, 'First' AS title, 'go-' || k AS slug, 'First line ' || k || ' second' AS summary, 'go' AS labels, 'programming-language/golang' AS categories, '## First' || chr(10) || '<!-- pattern-slug: go-' || k || ' -->' || chr(10) || chr(10) || '### Scope' || chr(10)
 || chr(10) || 'First line ' || k || chr(10) || '  second' || chr(10) || chr(10) || '~~~' || chr(10) || '## not one' || chr(10) || '```' || chr(10) || '~~~' || chr(10) AS body FROM c
 UNION ALL SELECT path, 'Text of ' || k, 'x-' || k, NULL, '', 'general', rtrim('## Text of ' || k || chr(10) || '<!-- pattern-slug: x-' || k || ' -->' || chr(10) || t, chr(10)) || chr(10) FROM c""")
def pattern_catalog(s, d):
    k, clean = F.col("doc_id").cast("string"), F.regexp_replace(F.translate("text", "#`~", ""), "\\s+$", "")
    text = F.concat(
        F.lit("# Catalog\n\n## First\n<!-- pattern-slug: go-"), k, F.lit(" -->\n\n### Scope\n\nFirst line "), k, F.lit("\n  second\n\n~~~\n## not one\n```\n~~~\n## Nameless\n<!-- pattern-slug: None -->\n\n## Text of "),
        k, F.lit("\n<!-- pattern-slug: x-"), k, F.lit(" -->\n"), clean, F.lit("\n"),
    )
    docs = v.table(s, d, "documents").select(F.concat_ws("/", "source", "lang", F.concat(k, F.lit(".txt"))).alias("path"), text.alias("text"))
    found = markdown.pattern_catalog(docs)
    return found.select("path", "title", "slug", "summary", "body", F.array_join("labels", ",").alias("labels"), F.array_join("categories", ",").alias("categories"))


def _fronts(s, d):
    k = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("---\ntype: note\nsources:\n  - {id: 7, resource: https://x.example/"), k, F.lit(", title: [no]}\n  - plain\n  - {title: none}\nverified:\n  human: ann"), k, F.lit("\n  count: 3\n  tool: {a: 1}\n  at: 2024-01-02\n"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("generated: {by: bot, at: t"), k, F.lit("}\n"))).otherwise(F.lit("generated: {by: 5}\n")), F.lit("timestamp: old\n---\n# Citations\n- https://c.example/"), k, F.lit("\n- local.md\n# End\n- https://no.example\n"),
        F.coalesce("text", F.lit("")),
    )
    docs = v.table(s, d, "documents").where("text IS NULL OR NOT contains(text, '# Citations')").select(F.concat(k, F.lit(".md")).alias("path"), text.alias("text"))
    return documents.with_front(documents.concepts(docs, front=True))


_D = "FROM documents WHERE text IS NULL OR NOT contains(text, '# Citations')"


@query(f" SELECT doc_id || '.md' AS path, '7' AS id, 'https://x.example/' || doc_id AS resource, NULL AS title {_D} UNION ALL SELECT doc_id || '.md', NULL, 'https://c.example/' || doc_id, NULL {_D}")
def front_sources(s, d):
    return documents.front_sources(_fronts(s, d)).select("path", "id", "resource", "title")


@query(f""" SELECT doc_id || '.md' AS path, kind, CASE kind WHEN 'human' THEN 'ann' || doc_id WHEN 'count' THEN '3' ELSE '{{"a":1}}' END AS actor, '2024-01-02' AS at FROM (SELECT doc_id {_D}), (VALUES ('human'), ('count'), ('tool')) x(kind)""")
def front_verified(s, d):
    return documents.front_verified(_fronts(s, d))


@query(f""" SELECT doc_id || '.md' AS path, CASE WHEN doc_id % 2 = 0 THEN 'bot' ELSE '5' END AS by, CASE WHEN doc_id % 2 = 0 THEN 't' || doc_id ELSE 'old' END AS at {_D}""")
def front_generated(s, d):
    return documents.front_generated(_fronts(s, d))
