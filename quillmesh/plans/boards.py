"""Queries of registries: tasks, documents, patterns, messages, gateways; text functions that they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import scalars
from quillmesh.operators import board, records, store
from quillmesh.plans import adapters as v
from quillmesh.plans.base import query

_TASKS = """, k AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'todo' WHEN 'P' THEN 'in_progress' ELSE 'done' END AS status, epoch_ms(o_orderdate) AS updated_at, o_orderpriority AS label FROM orders)"""


def _tasks(s, d):
    o = v.table(s, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "todo").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("done")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated_at"), F.array("o_orderpriority", F.lit("all")).alias("labels"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"))


@query(_TASKS + " SELECT id, status FROM k WHERE label = '1-URGENT' AND (status <> 'done' OR updated_at >= 850000000000 - 604800000)")
def tasks_fresh(s, d):
    return board.list_tasks(_tasks(s, d), ["todo", "in_progress", "done"], now=850_000_000_000, label="1-URGENT").select("id", "status")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'far' ELSE 'home' END AS gateway, coalesce(c, '') AS comments FROM (SELECT o_orderkey AS id FROM orders) LEFT JOIN (SELECT l_orderkey, string_agg('c' || l_linenumber, chr(10) ORDER BY l_linenumber) AS c FROM lineitem WHERE l_linenumber < 4 GROUP BY 1) ON l_orderkey = id")
def task_with_comments(s, d):
    t = _tasks(s, d).select("id")
    found = board.first_gateway(board.gateway_union({"far": t, "home": t.where("id % 3 <> 0")}), ["home", "far"])
    comments = v.table(s, d, "lineitem").where("l_linenumber < 4").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("at"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("body"))
    return board.with_comments(found, comments)


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'done' WHEN 2 THEN 'todo' ELSE 'todo' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'a' WHEN 2 THEN NULL ELSE 'c' END AS owner,
 CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS n_refused FROM orders""")
def task_states(s, d):
    # by the remainder: claim, claim again (refused), delegate / claim, done, done again, claim (both refused) / claim, release / release (refused), delegate
    logs = {0: [("claim", "a"), ("claim", "x"), ("delegate", "b")], 1: [("claim", "a"), ("done", "a"), ("done", "x"), ("claim", "y")], 2: [("claim", "a"), ("release", "a")], 3: [("release", "z"), ("delegate", "c")]}
    o = v.table(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    log = F.lit(None)
    for k, events in logs.items():
        log = F.when(F.col("id") % 4 == k, F.array(*(F.struct(F.lit(i).alias("at"), F.lit(e).alias("event"), F.lit(a).alias("agent")) for i, (e, a) in enumerate(events)))).otherwise(log)
    return board.fold_tasks(o.select("id", F.explode(log).alias("x")).select("id", "x.*"))


_DOCS = """, o AS (SELECT id, 'd-' || id AS slug, title, namespace AS app, kind, CASE WHEN id % 2 = 0 THEN 'local' ELSE 'global' END AS scope, uri FROM v_resources)"""


def _docs(s, d):
    return v.resources(s, d).select(
        "id", F.concat(F.lit("d-"), F.col("id").cast("string")).alias("slug"), "title", F.lit(None).cast("string").alias("summary"), F.col("namespace").alias("app"), "kind", F.when(F.col("id") % 2 == 0, "local").otherwise("global").alias("scope"),
        F.array("kind", F.lit("doc")).alias("labels"), "uri", F.lit("text").alias("body"),
    )


@query(_DOCS + " SELECT slug, title FROM o WHERE lower(title) LIKE '%e%' AND kind = 'en' AND scope = 'global' AND app = 'src1'")
def docs_list(s, d):
    return board.list_docs(_docs(s, d), "E", "src1", "en", "en", "global").select("slug", "title")


@query(_DOCS + " SELECT slug, CASE WHEN id % 3 = 0 THEN 'new' ELSE title END AS title FROM o WHERE id % 5 <> 0")
def docs_publish(s, d):
    docs = _docs(s, d).select("slug", "title", "id")
    new = docs.where("id % 3 = 0").withColumn("title", F.lit("new"))
    return board.publish_docs(docs, new, docs.where("id % 5 = 0")).select("slug", "title")


@query(_DOCS + " SELECT slug, CASE WHEN id % 6 = 0 THEN 'title,kind' WHEN id % 2 = 0 THEN 'title' ELSE 'kind' END AS missing FROM o WHERE id % 2 = 0 OR id % 3 = 0")
def docs_validate(s, d):
    docs = _docs(s, d).withColumn("title", F.when(F.col("id") % 2 == 0, " ").otherwise(F.concat(F.lit("t"), "title"))).withColumn("kind", F.when(F.col("id") % 3 != 0, F.col("kind")))
    return board.doc_problems(docs)


@query(_DOCS + " SELECT slug, CASE WHEN id % 4 = 0 THEN 'v1' ELSE 'v2' END AS version, 'docs/' || slug || CASE WHEN id % 3 = 0 THEN '.proposed.yaml' ELSE '.yaml' END AS path, sha256('text') AS sha256 FROM o")
def docs_export(s, d):
    docs = _docs(s, d).withColumn("accepted_version", F.when(F.col("id") % 4 == 0, "v1")).withColumn("current_version", F.lit("v2"))
    there = docs.where("id % 3 = 0").select(F.concat(F.lit("docs/"), "slug", F.lit(".yaml")).alias("path"))
    return board.export_manifest(docs, there)


@query(_DOCS + ", s AS (SELECT v.id, ordinal, text FROM v_segments v JOIN o ON o.id = v.id WHERE app = 'src2' AND scope = 'local') SELECT id, ordinal FROM s WHERE lower(text) LIKE '%the%'")
def docs_chunks(s, d):
    docs = board.list_docs(_docs(s, d), app="src2", scope="local").select("id")
    return v.segments(s, d).where(F.lower("text").contains("the")).join(docs, "id", "left_semi").select("id", "ordinal")


@query("SELECT slug FROM v_patterns WHERE id % 3 = 0 OR id % 4 = 0")
def pattern_categories(s, d):
    k = F.col("id")
    p = v.patterns(s, d).withColumn("categories", F.when(k % 3 == 0, F.array(F.lit("ui"))).otherwise(F.array().cast("array<string>"))).withColumn("labels", F.when(k % 4 == 0, F.array(F.lit("category: ui"), F.lit("x"))).otherwise(F.array(F.lit("ui"))))
    return p.where(F.array_contains(board.categories(p), "ui")).select("slug")


@query("SELECT slug FROM v_patterns WHERE lower(body) LIKE '%about%' OR id % 7 = 0 OR id % 11 = 0")
def pattern_search_all(s, d):
    k = F.col("id")
    p = v.patterns(s, d).withColumn("title", F.when(k % 7 == 0, "What ABOUT it")).withColumn("labels", F.when(k % 11 == 0, F.array(F.lit("x-about")))).withColumn("summary", F.lit(None).cast("string"))
    return board.search_patterns(p, "About").select("slug")


@query("SELECT conv, id, CASE WHEN sender = 'user' THEN 'USER' ELSE 'AGENT' END || CASE WHEN parent IS NOT NULL THEN ' REPLY:' || parent ELSE '' END || CASE WHEN id % 5 = 0 THEN ' ACTION' ELSE '' END AS tags FROM v_messages")
def message_tags(s, d):
    return board.message_tags(v.messages(s, d).withColumn("action", F.col("id") % 5 == 0))


@query("SELECT 'g' || n_regionkey AS gateway, CASE WHEN n_regionkey = 1 THEN 'fatal' WHEN n_regionkey = 3 THEN 'warning' ELSE 'unauthorized' END AS state, count(*) FILTER (n_nationkey % 4 = 0) AS n_hidden FROM nation GROUP BY n_regionkey HAVING n_regionkey IN (1, 3) OR count(*) FILTER (n_nationkey % 4 = 0) > 0")
def federation_report(s, d):
    n = v.table(s, d, "nation").select(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("gateway"), (F.col("n_nationkey") % 4 != 0).alias("authorized"), F.when(F.col("n_regionkey").isin(1, 3), "down").alias("error"))
    return board.federation_report(n, "g1")


@query("SELECT DISTINCT 'g' || n_regionkey AS gateway FROM nation WHERE n_regionkey % 2 = 0")
def gateway_capability(s, d):
    r = v.table(s, d, "region").select(F.concat(F.lit("g"), F.col("r_regionkey").cast("string")).alias("gateway"), F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit("docs"), F.lit("tasks"))).otherwise(F.array(F.lit("tasks"))).alias("read"))
    return board.capable(r, "docs").select("gateway")


@query("SELECT s_suppkey AS name, 'push' AS action FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey % 4 <> 0")
def sync_kinds(s, d):
    k = F.col("s_suppkey")
    rows = v.table(s, d, "supplier").select(k.alias("name"), F.concat(F.when(k % 3 == 1, "commands/").when(k % 3 == 2, "agents/").otherwise("skills/"), k.cast("string")).alias("path"), F.lit("h").alias("checksum"))
    plan = store.sync_plan(board.of_kind(rows, "command"), rows.limit(0))
    return store.sync_names(plan, rows.where("name % 4 = 0"))


@query("""SELECT row_number() OVER (ORDER BY p, i) AS place, line FROM (SELECT *, sum(length(line)) OVER (ORDER BY p, i ROWS UNBOUNDED PRECEDING) AS n FROM
 (SELECT * FROM (SELECT 0 AS p, row_number() OVER (ORDER BY score DESC, id) AS i, 'pattern ' || slug AS line FROM (SELECT *, (CASE WHEN contains(lower(body), 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(body), 'and') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(body), '77') THEN 1 ELSE 0 END) AS score FROM v_patterns) WHERE score > 0 ORDER BY score DESC, id LIMIT 3)
  UNION ALL SELECT * FROM (SELECT 1, row_number() OVER (ORDER BY o_orderkey), 'task order ' || o_orderkey FROM orders WHERE contains('order ' || o_orderkey, '77') ORDER BY o_orderkey LIMIT 3)
  UNION ALL SELECT 2, row_number() OVER (ORDER BY id), title || ': ' || kind FROM v_resources WHERE id < 40)) WHERE n <= 700""")
def prompt_context(s, d):
    knowledge = v.resources(s, d).where("id < 40").select("id", "title", F.col("kind").alias("text"))
    return board.prompt_context(_tasks(s, d), v.patterns(s, d), knowledge, ["the", "and", "77"], 700)


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS shown, epoch_ms(o_orderdate) AS a, epoch_ms(o_orderdate) AS b, CAST(NULL AS BIGINT) AS c FROM orders")
def time_text(s, d):
    o = v.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms")).withColumn("shown", scalars.rfc3339(F.col("ms")))
    return o.select("id", "shown", scalars.event_millis(F.col("ms").cast("string")).alias("a"), scalars.event_millis(F.col("shown")).alias("b"), scalars.event_millis(F.concat("shown", F.lit("x"))).alias("c"))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS first, event_type || ',' || user_id AS joined, contains('route', event_type) OR event_id % 2 = 0 AS api FROM events")
def event_fields(s, d):
    e = v.table(s, d, "events")
    words = F.concat(F.lit("The "), F.when(F.col("event_id") % 2 == 0, "REST-like").otherwise("resting"), F.lit(" x"))
    csv = scalars.csv_values(F.concat(F.lit(" "), "event_type", F.lit(",, "), F.col("user_id").cast("string"), F.lit(" ,")))
    return e.select(F.col("event_id").alias("id"), scalars.first_of(F.col("props"), ["none", "k"]).alias("first"), F.array_join(csv, ",").alias("joined"), scalars.is_api_query(words).alias("api"))


@query("SELECT event_id AS id, '{\"event\":\"' || event_type || '\",\"user\":' || user_id || CASE WHEN event_id % 2 = 0 THEN ',\"n\":' || event_id ELSE '' END || '}' AS envelope, 'a: 1' || chr(10) || 'k: ' || event_type AS front, event_type || '|b|x' AS labels FROM events")
def event_envelopes(s, d):
    e = v.table(s, d, "events")
    n = F.when(F.col("event_id") % 2 == 0, F.col("event_id"))
    labels = scalars.appended(F.array("event_type", F.lit("b"), F.col("event_type")), F.array(F.lit("b"), F.lit("x")))
    front = scalars.front_matter(F.create_map(F.lit("k"), F.col("event_type"), F.lit("a"), F.lit("1")))
    return e.select(F.col("event_id").alias("id"), scalars.envelope(F.col("event_type"), user=F.col("user_id"), n=n).alias("envelope"), front.alias("front"), F.array_join(labels, "|").alias("labels"))


@query("SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#13' AND p_size % 2 = 0 AND p_partkey % 3 = 0")
def artifacts_list(s, d):
    p = v.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.lit("x").alias("subkind"), F.when(F.col("p_size") % 2 == 0, "draft").otherwise("final").alias("lifecycle_state"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("labels"), F.lit("me").alias("actor_id"))
    return records.artifacts(p, "Brand#13", None, "draft", "b", "me").select("id")


@query("SELECT l_orderkey AS id, l_linenumber AS round FROM lineitem WHERE l_linenumber = 2 AND l_returnflag = 'A' AND l_orderkey % 2 = 0")
def review_contributions(s, d):
    k = v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("round"), F.col("l_returnflag").alias("phase"), F.lit("critic").alias("role"), F.lit("v1").alias("reviewed_version"), F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("p"))).otherwise(F.array(F.lit("q"))).alias("read_set"))
    return records.contributions(k, 2, "A", "critic", "v1", "p").select("id", "round")


@query("""SELECT n_nationkey AS artifact_id, 'v1' AS from_version, 'v2' AS to_version, '--- v1' || chr(10) || '+++ v2' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' same' || chr(10) || '-' || n_name || chr(10) || '+N' || n_regionkey AS diff FROM nation""")
def version_diffs(s, d):
    n = v.table(s, d, "nation").select(F.col("n_nationkey").alias("artifact_id"), F.concat(F.lit("same\n"), "n_name").alias("a"), F.concat(F.lit("same\nN"), F.col("n_regionkey").cast("string")).alias("b"))
    versions = n.select("artifact_id", F.lit("v1").alias("version"), F.col("a").alias("body")).unionByName(n.select("artifact_id", F.lit("v2").alias("version"), F.col("b").alias("body")))
    return records.version_diffs(versions, n.select("artifact_id", F.lit("v1").alias("from_version"), F.lit("v2").alias("to_version")))


@query("SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#21'")
def build_status(s, d):
    p = v.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("repo"))
    return records.builds(p, "Brand#21").select("id")
