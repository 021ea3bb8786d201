"""Queries of text records: matches with context, previews, pages, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.plans import adapters as v
from quillmesh.plans.base import query
from quillmesh.plans.catalog import _LINES

_PLACED = f""", {_LINES}, m AS (SELECT path, line, t, string_split_regex(t, 'P') AS p, regexp_extract_all(t, 'P') AS m FROM l WHERE regexp_matches(t, 'P')),
 k0 AS (SELECT path, line, t, p, m, unnest(range(len(m))) AS i FROM m),
 k AS (SELECT path, line, t, i + 1 AS k, (1 + coalesce(list_sum(list_transform(p[1:i + 1], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: strlen(x))), 0))::BIGINT AS byte, m[i + 1] AS match FROM k0)"""
# the hash of a path: 64 bits, by exclusive or and a product of each byte
_HASH = "lpad(lower(to_hex(list_reduce([14695981039346656037::HUGEINT] || list_transform(string_split(path, ''), lambda c: ord(c)::HUGEINT), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0')"


@query(_PLACED.replace("'P'", "'(wh)(on|at)'") + f" SELECT 'r:' || {_HASH} || ':' || line || ':' || byte || ':' || k AS record_id, path, line, byte, match AS old_text, regexp_replace(match, '(wh)(on|at)', '\\2-\\1') AS new_text FROM k WHERE line <= 9")
def sed_records(s, d):
    return text.sed_records(v.texts(s, d), "(wh)(on|at)", text.escape_replacement("$2-$1", 2), value=":9")


@query(_PLACED.replace("'P'", "'onha'") + """, n AS (SELECT path, max(line) AS n FROM l GROUP BY 1), f AS (SELECT k.path, line, byte, match, n, greatest(1, line - 2) AS low, least(line + 1, n) AS high,
 row_number() OVER (PARTITION BY k.path ORDER BY line, byte) AS seq FROM k JOIN n ON n.path = k.path),
 g AS (SELECT *, last_value(CASE WHEN high > line THEN 'after:' || high WHEN low < line THEN 'before:' || (line - 1) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM f),
 r AS (SELECT path, seq, unnest(range(low, line)) AS line, 'before' AS kind, NULL::BIGINT AS byte, NULL AS match, low AS edge, last FROM g
  UNION ALL SELECT path, seq, line, 'match', byte, match, NULL, NULL FROM g
  UNION ALL SELECT path, seq, unnest(range(line + 1, high + 1)), 'after', NULL, NULL, line + 1, CASE WHEN low = line THEN last END FROM g)
 SELECT r.path, row_number() OVER (PARTITION BY r.path ORDER BY seq, r.line) AS place, kind, r.line, byte, coalesce(match, t) AS text FROM r JOIN l ON l.path = r.path AND l.line = r.line
 WHERE NOT coalesce(r.line = edge AND last = kind || ':' || edge, false)""")
def grep_context_repeat(s, d):
    return text.match_context(v.texts(s, d), "onha", before=2, after=1)


@query(_PLACED.replace("'P'", "'tion'") + """, r AS (SELECT row_number() OVER (ORDER BY path, line, byte) AS place, printf('match: %s:%d:%d: %s', path, line, byte, match) AS text FROM k), n AS (SELECT count(*) AS n FROM r)
 SELECT place - 7 AS place, text FROM r WHERE place BETWEEN 8 AND 32 UNION ALL SELECT 26, printf('truncated: output-limit shown=%d remaining=%d', 25, n - 32) FROM n WHERE n > 32
 UNION ALL SELECT 27, printf('resume: --skip %d --limit %d', 32, 25) FROM n WHERE n > 32""")
def page_resume_rows(s, d):
    found = text.placed_matches(v.texts(s, d), "tion").withColumn("text", F.col("match"))
    return text.page_records(found.withColumn("text", text.rendered(found, "match")), ["path", "line", "byte"], 7, 25)


@query(_PLACED.replace("'P'", "'the(n|re)'") + """, c AS (SELECT path, count(*) AS n FROM k GROUP BY 1)
 SELECT kind, printf('match: %s:%d:%d: %s', path, line, byte, match) AS text FROM (SELECT 'match' AS kind, * FROM k) UNION ALL
 SELECT 'count', printf('count: %s: %d', v.path, coalesce(n, 0)) FROM v_files v LEFT JOIN c ON c.path = v.path UNION ALL SELECT 'path', 'path-match: ' || path FROM c
 UNION ALL SELECT 'no-path', 'path-no-match: ' || path FROM v_files WHERE path NOT IN (SELECT path FROM c)""")
def render_records(s, d):
    files, pattern = v.texts(s, d), "the(n|re)"
    kinds = {
        "match": text.placed_matches(files, pattern).withColumn("text", F.col("match")),
        "count": text.match_counts(files, pattern),
        "path": text.paths_with(files, pattern),
        "no-path": text.paths_with(files, pattern, inverse=True),
    }
    parts = [rows.select(F.lit(k).alias("kind"), text.rendered(rows, k).alias("text")) for k, rows in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f""", {_LINES}, c AS (SELECT v.path, mtime, coalesce(sum(len(regexp_extract_all(t, '(and) (the)'))), 0) AS n FROM v_files v LEFT JOIN l ON l.path = v.path GROUP BY 1, 2)
 SELECT count(*) FILTER (mtime % 9 <> 0) AS files, count(*) FILTER (mtime % 9 <> 0 AND n > 0) AS matched, count(*) FILTER (mtime % 9 <> 0 AND n > 0) AS changed, coalesce(sum(n) FILTER (mtime % 9 <> 0), 0)::BIGINT AS replacements,
 count(*) FILTER (mtime % 9 = 0) AS skipped, count(*) FILTER (mtime % 9 = 0) AS warnings, 0::BIGINT AS errors, coalesce(sum(n) FILTER (mtime % 9 <> 0), 0) > 100 AS truncated,
 CASE WHEN count(*) FILTER (mtime % 9 <> 0 AND n > 0) = 0 THEN 1 ELSE 0 END AS code FROM c""")
def run_counters(s, d):
    files = v.files(s, d).join(v.texts(s, d), "path").withColumn("class", F.when(F.col("mtime") % 9 == 0, "binary").otherwise("text"))
    pattern, replacement, every, _ = text.parse_sed("s/(and) (the)/$2 $1/g")
    changed = text.sed_apply(files, pattern, text.escape_replacement(replacement, 2), first_only=not every).select("path", "changed")
    results = files.select("path", "class").join(text.match_counts(files, pattern).withColumnRenamed("n", "matches"), "path").join(changed, "path").withColumn("error", F.lit(None).cast("string"))
    counters = text.run_counters(results, 100)
    return counters.withColumn("code", text.exit_code(grep=True))


@query("SELECT path, regexp_replace(text, '(?i)And', 'et') AS text, regexp_matches(text, '(?i)And') AS changed FROM (SELECT path, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM v_files)")
def sed_expression(s, d):
    pattern, replacement, every, fold = text.parse_sed("s|And|et|i")
    every_line = v.texts(s, d).select("path", F.explode(F.split("text", "\n", -1)).alias("text"))
    return text.sed_apply(every_line, text.check_regex(pattern, ignore_case=fold), text.escape_replacement(replacement, 0), first_only=not every)


@query("SELECT path, line, t AS text FROM l WHERE line >= 3".join([f", {_LINES} ", ""]))
def read_open_range(s, d):
    return text.read_lines(v.texts(s, d), "3:$")
