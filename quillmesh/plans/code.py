"""Queries of code: references to symbols and files, extraction of symbols and relations, concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import code, graph
from quillmesh.plans import adapters as v
from quillmesh.plans.base import ORACLES, query

# parts as files of code, customers as symbols in them, orders as references
_V = r""", f AS (SELECT p_partkey AS target, 'src' || (p_partkey % 7) || '/mod' || (p_partkey % 40) || '/' || CASE WHEN p_partkey % 3 = 0 THEN 'unit' || (p_partkey % 90) ELSE 'part_' || p_partkey END || CASE p_partkey % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.d.ts' ELSE '' END AS path FROM part),
 st AS (SELECT *, regexp_replace(path, '([^/])\.[^./]*$', '\1') AS bare FROM f),
 r AS (SELECT o_orderkey AS ref, 'src' || (o_custkey % 7) || '/mod' || (o_orderkey % 40) || '/main.rs' AS file,
  CASE o_orderkey % 6 WHEN 0 THEN '"./part_' || (o_orderkey % 300) || '"' WHEN 1 THEN 'crate::mod' || (o_orderkey % 40) || '::unit' || (o_custkey % 90) WHEN 2 THEN 'part_' || (o_orderkey % 300)
   WHEN 3 THEN 'src' || (o_orderkey % 7) || '.mod' || (o_orderkey % 40) || '.unit' || (o_orderkey % 90) WHEN 4 THEN '<lib/part_' || (o_orderkey % 200) || '.rs>' ELSE 'mod' || (o_orderkey % 40) || '/part_' || (o_orderkey % 300) || '.py' END AS raw FROM orders)"""


def _files(s, d):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("unit"), (k % 90).cast("string"))).otherwise(F.concat(F.lit("part_"), k.cast("string")))
    end = F.when(k % 4 == 0, ".rs").when(k % 4 == 1, ".py").when(k % 4 == 2, ".d.ts").otherwise("")
    return v.table(s, d, "part").select(k.alias("target"), F.concat(F.lit("src"), (k % 7).cast("string"), F.lit("/mod"), (k % 40).cast("string"), F.lit("/"), name, end).alias("path"))


def _imports(s, d):
    return s.sql(
        """SELECT o_orderkey AS ref, 'src' || (o_custkey % 7) || '/mod' || (o_orderkey % 40) || '/main.rs' AS file, 'imports' AS relation, 'Rust' AS language,
        CASE o_orderkey % 6 WHEN 0 THEN '"./part_' || (o_orderkey % 300) || '"' WHEN 1 THEN 'crate::mod' || (o_orderkey % 40) || '::unit' || (o_custkey % 90) WHEN 2 THEN 'part_' || (o_orderkey % 300)
        WHEN 3 THEN 'src' || (o_orderkey % 7) || '.mod' || (o_orderkey % 40) || '.unit' || (o_orderkey % 90) WHEN 4 THEN '<lib/part_' || (o_orderkey % 200) || '.rs>' ELSE 'mod' || (o_orderkey % 40) || '/part_' || (o_orderkey % 300) || '.py' END AS raw
        FROM {orders}""",
        orders=v.table(s, d, "orders"),
    )


@query(_V + r""", q AS (SELECT *, regexp_replace(regexp_replace(trim(raw), '^["''<>]+|["''<>]+$', '', 'g'), '^(crate|self|super)::', '') AS b FROM r),
 n AS (SELECT ref, file, CASE WHEN starts_with(replace(b, '::', '/'), '.') OR regexp_matches(replace(b, '::', '/'), '[^/]\.[^./]*$') THEN replace(b, '::', '/') ELSE replace(replace(b, '::', '/'), '.', '/') END AS norm FROM q),
 m AS (SELECT ref, target, CASE WHEN path = norm OR bare = norm THEN 120 WHEN path = rel OR bare = rel THEN 110 WHEN suffix(path, '/' || norm) OR suffix(bare, '/' || norm) THEN 80
  WHEN string_split(bare, '/')[-1] = string_split(norm, '/')[-1] THEN 40 END AS score FROM (SELECT *, regexp_extract(file, '^(.*)/', 1) || '/' || regexp_replace(norm, '^(\./)+', '') AS rel FROM n) x, st WHERE path <> file)
 SELECT ref, target, score FROM m WHERE score IS NOT NULL""")
def import_resolution(s, d):
    return graph.import_matches(_imports(s, d), _files(s, d))


_SYM = """, y AS (SELECT c_custkey AS target, 'L' || (c_nationkey % 3) AS language, CASE WHEN c_custkey % 2 = 0 THEN 'Name' ELSE 'name' END || (c_custkey % 200) AS name, 'src/mod' || (c_custkey % 50) || '.rs' AS file, CASE c_custkey % 5 WHEN 0 THEN 'fn' WHEN 1 THEN 'interface' ELSE 'class' END AS kind FROM customer),
 x AS (SELECT o_orderkey AS ref, 'L' || (o_custkey % 3) AS language, 'src/mod' || (o_custkey % 50) || '.rs' AS file, CASE o_orderkey % 3 WHEN 0 THEN 'calls' ELSE 'inherits' END AS relation,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'crate::mod' || (o_orderkey % 50) WHEN 2 THEN 'a.mod' || (o_orderkey % 50) ELSE 'mod' || (o_orderkey % 50) END AS q, 'name' || (o_custkey % 200) AS n FROM orders)"""


def _symbols(s, d):
    return s.sql(
        """SELECT c_custkey AS target, 'L' || (c_nationkey % 3) AS language, CASE WHEN c_custkey % 2 = 0 THEN 'Name' ELSE 'name' END || (c_custkey % 200) AS name, 'src/mod' || (c_custkey % 50) || '.rs' AS file,
        CASE c_custkey % 5 WHEN 0 THEN 'fn' WHEN 1 THEN 'interface' ELSE 'class' END AS kind FROM {customer}""",
        customer=v.table(s, d, "customer"),
    )


def _references(s, d):
    return s.sql(
        """SELECT o_orderkey AS ref, 'L' || (o_custkey % 3) AS language, 'src/mod' || (o_custkey % 50) || '.rs' AS file, CASE o_orderkey % 3 WHEN 0 THEN 'calls' ELSE 'inherits' END AS relation,
        CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'crate::mod' || (o_orderkey % 50) || '::' WHEN 2 THEN 'a.mod' || (o_orderkey % 50) || '.' ELSE 'mod' || (o_orderkey % 50) || '->' END || 'name' || (o_custkey % 200) || '<T>(x)' AS raw FROM {orders}""",
        orders=v.table(s, d, "orders"),
    )


@query(_SYM + r""", m AS (SELECT ref, target, kind, (CASE WHEN n = name THEN 20 ELSE 0 END) + (CASE WHEN x.file = y.file THEN 100 ELSE 0 END)
  + CASE WHEN q IS NOT NULL AND (suffix(regexp_replace(y.file, '\.rs$', ''), replace(replace(regexp_replace(q, '^crate::', ''), '::', '/'), '.', '/')) OR suffix(replace(replace(q, '::', '/'), '.', '/'), regexp_extract(y.file, '(mod[0-9]+)', 1))) THEN 60 ELSE 0 END AS score
  FROM x JOIN y ON x.language = y.language AND lower(n) = lower(name) WHERE relation = 'calls' OR kind <> 'fn'),
 b AS (SELECT ref, count(*) AS c, min(target) AS target FROM (SELECT *, max(score) OVER (PARTITION BY ref) AS best FROM m) WHERE score = best GROUP BY 1)
 SELECT x.ref, CASE WHEN c = 1 THEN target END AS target, CASE WHEN c IS NULL THEN 'extracted' WHEN c = 1 THEN 'resolved' ELSE 'ambiguous' END AS confidence FROM x LEFT JOIN b ON b.ref = x.ref""")
def symbol_qualifier(s, d):
    refs = _references(s, d)
    return graph.resolve_edges(refs, _symbols(s, d), _files(s, d).limit(0)).drop("relation")


_QUALIFIED = ORACLES["symbol_qualifier"].removeprefix(f"{v.VIEWS} ")


@query(_QUALIFIED)
def edge_update(s, d):
    """References resolved before customers of a negative balance moved to the files, kinds and names that they have now."""
    refs, now = _references(s, d), _symbols(s, d)
    poor = v.table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("target"))
    moved = now.join(poor, "target", "left_semi").withColumns({"name": F.concat(F.lit("old_"), "name"), "file": F.lit("src/old.rs"), "kind": F.lit("fn")})
    before = now.join(poor, "target", "left_anti").unionByName(moved)
    none = _files(s, d).limit(0)
    known = graph.resolve_edges(refs, before, none)
    return graph.resolve_changed(known, refs, refs, before, now, none, none).drop("relation")


@query(_SYM + r""" SELECT ref, CASE WHEN c = 1 THEN target END AS target, CASE WHEN c = 1 THEN CASE WHEN kind = 'interface' THEN 'implements' ELSE 'inherits' END ELSE 'inherits' END AS relation FROM
 (SELECT x.ref, count(y.target) AS c, min(y.target) AS target, min(kind) AS kind FROM x LEFT JOIN y ON y.name = x.n AND y.file = x.file AND kind <> 'fn' WHERE relation = 'inherits' GROUP BY 1)""")
def relation_fix(s, d):
    refs = _references(s, d).where("relation = 'inherits'").select("ref", F.concat_ws("|", "file", F.regexp_extract("raw", "(name[0-9]+)", 1)).alias("raw"), F.lit("C#").alias("language"), "file", "relation")
    symbols = _symbols(s, d).select("target", F.lit("C#").alias("language"), F.concat_ws("|", "file", "name").alias("name"), F.lit("one").alias("file"), "kind").where("name LIKE '%|name%'")
    # names with their file, so that a name meets the symbols of its file alone
    refs, symbols = refs.withColumn("raw", F.translate("raw", "./", "__")), symbols.withColumn("name", F.translate("name", "./", "__"))
    out = graph.resolve_edges(refs, symbols, _files(s, d))
    return out.select("ref", "target", "relation")


_SOURCE = r"""s AS (SELECT path, mtime, '// file ' || mtime || chr(10) || '//! about it' || chr(10) || 'use crate::mod' || (mtime % 7) || '::Thing;' || chr(10) || '/// Says ' || mtime || chr(10) || 'pub fn say_' || (mtime % 5) || '(x: u8) -> u8 {' || chr(10)
 || '    helper(x)' || chr(10) || '}' || chr(10) || 'struct Box' || (mtime % 3) || ' {' || chr(10) || '    a: u8,' || chr(10) || '}' || chr(10) || 'impl Show for Box' || (mtime % 3) || ' {' || chr(10) || '    fn show(&self) {' || chr(10) || '        say_' || (mtime % 5) || '(1);' || chr(10) || '    }' || chr(10) || '}' || chr(10) AS source FROM v_files)"""


def _sources(s, d):
    """Documents as Rust files of fifteen lines."""
    n = F.col("mtime").cast("string")
    k = lambda m: (F.col("mtime") % m).cast("string")
    text = F.concat(
        F.lit("// file "), n, F.lit("\n//! about it\nuse crate::mod"), k(7), F.lit("::Thing;\n/// Says "), n, F.lit("\npub fn say_"), k(5), F.lit("(x: u8) -> u8 {\n    helper(x)\n}\nstruct Box"), k(3),
        F.lit(" {\n    a: u8,\n}\nimpl Show for Box"), k(3), F.lit(" {\n    fn show(&self) {\n        say_"), k(5), F.lit("(1);\n    }\n}\n"),
    )
    return v.files(s, d).select(F.concat("path", F.lit(".rs")).alias("path"), text.alias("source"))


@query(f", {_SOURCE}" + r""" SELECT path || '.rs' AS path, 'say_' || (mtime % 5) AS name, 'fn' AS kind, 5 AS start_line, 7 AS end_line, NULL AS parent, TRUE AS exported, 'say_' || (mtime % 5) || ':fn' AS stable_key FROM s
 UNION ALL SELECT path || '.rs', 'Box' || (mtime % 3), 'struct', 8, 10, NULL, FALSE, 'Box' || (mtime % 3) || ':struct' FROM s UNION ALL SELECT path || '.rs', 'show', 'method', 12, 14, 'Show', FALSE, 'Show::show:method' FROM s
 UNION ALL SELECT path || '.rs', 'Show', 'impl', 11, 15, NULL, FALSE, 'Show:impl' FROM s""")
def symbol_extraction(s, d):
    return code.symbols(_sources(s, d)).select("path", "name", "kind", "start_line", "end_line", "parent", "exported", "stable_key")


@query(f", {_SOURCE}" + r""" SELECT path || '.rs' AS path, 'imports' AS relation, NULL AS source_symbol, 'crate::mod' || (mtime % 7) || '::Thing' AS target, 3 AS line FROM s UNION ALL SELECT path || '.rs', 'calls', 'say_' || (mtime % 5), 'helper', 6 FROM s
 UNION ALL SELECT path || '.rs', 'calls', 'show', 'say_' || (mtime % 5), 13 FROM s UNION ALL SELECT path || '.rs', 'implements', 'Box' || (mtime % 3), 'Show', 11 FROM s""")
def relation_extraction(s, d):
    return code.relations(_sources(s, d)).select("path", "relation", "source_symbol", "target", "line")


@query(f", {_SOURCE}" + r""" SELECT path || '.rs' AS path, 'say_' || (mtime % 5) AS name, 'Says ' || mtime AS doc, 'pub fn say_' || (mtime % 5) || '(x: u8) -> u8 {' AS signature FROM s""")
def symbol_docs(s, d):
    return code.symbols(_sources(s, d)).where("exported").select("path", "name", "doc", "signature")


@query(f", {_SOURCE}" + r""" SELECT path || '.rs' AS path, '    8 | struct Box' || (mtime % 3) || ' {' || chr(10) || '    9 |     a: u8,' || chr(10) || '   10 | }' AS shown FROM s WHERE mtime % 3 = 1""")
def symbol_source(s, d):
    return code.symbol_source(_sources(s, d), code.symbols(_sources(s, d)), "Box1")


@query("""SELECT path FROM v_files WHERE NOT (regexp_matches(path, '(^|/)(src2|fr)(/|$)') OR mtime % 10 = 3 OR mtime % 10 = 7)""")
def knowledge_paths(s, d):
    f = v.files(s, d).withColumn("was", F.col("path"))
    path = F.regexp_replace(F.regexp_replace("path", "(^|/)src2/", "$1tests/"), "/fr/", "/__mocks__/")
    path = F.regexp_replace(F.regexp_replace(path, "([0-9]*3)\\.txt$", "$1_test.txt"), "([0-9]*7)\\.txt$", "test_$1.txt")
    return f.where(code.is_knowledge(path)).select(F.col("was").alias("path"))


@query(f", {_SOURCE}" + r""", k AS (SELECT path || '.rs' AS path, 'say_' || (mtime % 5) || ':fn' AS stable_key, 'say_' || (mtime % 5) AS name FROM s)
 SELECT 'code/' || path || '/' || regexp_replace(stable_key, '[^A-Za-z0-9._-]', '-', 'g') || '-' || left(sha256(stable_key), 8) || '.md' AS id, 'symbol' AS kind, name AS title FROM k
 UNION ALL SELECT 'code/' || path || '.rs.md', 'module', path || '.rs' FROM s""")
def concept_synthesis(s, d):
    sources = _sources(s, d)
    return code.concepts(sources, code.symbols(sources), code.relations(sources)).select("id", "kind", "title")


@query("SELECT c_custkey AS id, n_name || ':' || c_mktsegment || CASE WHEN r > 1 THEN '~' || (r - 1) ELSE '' END AS stable_key FROM (SELECT *, row_number() OVER (PARTITION BY n_name, c_mktsegment ORDER BY c_custkey) AS r FROM customer JOIN nation ON n_nationkey = c_nationkey)")
def occurrence_keys(s, d):
    c = v.table(s, d, "customer").join(v.table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = c.select(F.col("c_custkey").alias("id"), F.lit("f").alias("path"), F.col("n_name").alias("name"), F.col("c_mktsegment").alias("kind"), F.lit(None).cast("string").alias("parent"), F.col("c_custkey").alias("start_byte"))
    return code.stable_keys(rows).select("id", "stable_key")


@query(f", {_SOURCE}" + r""", k AS (SELECT *, mtime % 4 AS m FROM s) SELECT path || '.rs' AS path, count(*) AS n, 'now' AS state FROM k, range(4) WHERE m <> 3 GROUP BY 1""")
def symbol_index(s, d):
    now = _sources(s, d).join(v.files(s, d).select(F.concat("path", F.lit(".rs")).alias("path"), "mtime"), "path")
    old = now.where("mtime % 4 <> 1").withColumn("source", F.when(F.col("mtime") % 4 == 2, F.concat("source", F.lit("fn more() {}\n"))).otherwise(F.col("source")))
    stored = old.select("path", F.sha2("source", 256).alias("hash"))
    _, found = code.build_symbol_index(now.where("mtime % 4 <> 3"), stored, code.symbols(old))
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("now"))


@query(f", {_SOURCE}" + """ SELECT count(*) FILTER (mtime % 4 <> 3) AS seen, count(*) FILTER (mtime % 4 IN (1, 2)) AS indexed, count(*) FILTER (mtime % 4 = 0) AS skipped, count(*) FILTER (mtime % 4 = 3) AS removed FROM s""")
def index_stats(s, d):
    f = v.files(s, d)
    old = f.where("mtime % 4 <> 1").select("path", F.when(F.col("mtime") % 4 == 2, "x").otherwise("y").alias("hash"))
    return code.index_stats(old, f.where("mtime % 4 <> 3").select("path", F.lit("y").alias("hash")))


@query(f", {_SOURCE}" + """ SELECT path || '.rs' AS path, 'say_' || (mtime % 5) AS name FROM s WHERE path = (SELECT min(path) FROM s)""")
def symbols_of_file(s, d):
    first = _sources(s, d).agg(F.min("path")).first()[0]
    return code.symbols_of(code.symbols(_sources(s, d)), first, "fn").select("path", "name")


#: By language: extension, comment mark, and a source whose declarations stand behind the document's text as comments.
_LANGUAGES = [
    ("rs", "//", "mod m{k} {\n    pub fn go(f: fn(u8) -> u8) { /* /* */ fn no() {} */ run(f(1)); }\n}\n"),
    ("py", "#", "class C{k}(Base):\n    def go(self, a=f(1)):\n        return run(a)\n"),
    ("go", "//", "const (\n\tA{k} = 1\n)\nfunc (t *T) Go(f func(int) error) error { return run(f) }\n"),
    ("cs", "//", "class C{k} : Base {\n    int Go(Func<int, int> f) => Run(f(1));\n}\n"),
    ("ts", "//", "class C{k} extends Base {\n  go(cb = make(1)) { return run(`${cb(\"}\")}`); }\n}\n"),
    ("js", "//", "class C{k} extends Base {\n  go(a) { const re = /[{\"]/; return run(a); }\n}\n"),
    ("cpp", "//", "struct S{k} : Base {\n  void go(std::function<void(int)> f) { run(f); }\n};\n"),
]
# number of the language, name, kind, line behind the text, parent
_DECLARED = """(VALUES (0, 'm{k}', 'mod', 1, NULL), (0, 'go', 'method', 2, 'm{k}'), (1, 'C{k}', 'class', 1, NULL), (1, 'go', 'method', 2, 'C{k}'), (2, 'A{k}', 'const', 2, NULL), (2, 'Go', 'method', 4, NULL),
 (3, 'C{k}', 'class', 1, NULL), (3, 'Go', 'method', 2, 'C{k}'), (4, 'C{k}', 'class', 1, NULL), (4, 'go', 'method', 2, 'C{k}'), (5, 'C{k}', 'class', 1, NULL), (5, 'go', 'method', 2, 'C{k}'), (5, 're', 'var', 2, 'go'),
 (6, 'S{k}', 'struct', 1, NULL), (6, 'go', 'method', 2, 'S{k}')) x(l, name, kind, off, parent)"""
_RELATED = """(VALUES (0, 'calls', 'go', 'run', 2), (0, 'calls', 'go', 'f', 2), (1, 'inherits', 'C{k}', 'Base', 1), (1, 'calls', 'go', 'run', 3), (1, 'calls', 'go', 'f', 2), (2, 'calls', 'Go', 'run', 4), (3, 'inherits', 'C{k}', 'Base', 1),
 (3, 'calls', 'Go', 'Run', 2), (3, 'calls', 'Go', 'f', 2), (4, 'inherits', 'C{k}', 'Base', 1), (4, 'calls', 'go', 'make', 2), (4, 'calls', 'go', 'run', 2), (5, 'inherits', 'C{k}', 'Base', 1), (5, 'calls', 'go', 'run', 2),
 (6, 'inherits', 'S{k}', 'Base', 1), (6, 'calls', 'go', 'run', 2)) x(l, relation, source, target, off)"""
_FILES_OF = "(SELECT path || '.' || (['rs', 'py', 'go', 'cs', 'ts', 'js', 'cpp'])[mtime % 7 + 1] AS path, mtime, len(string_split(text, chr(10))) AS lines FROM v_files WHERE text IS NOT NULL) f"


def _documented(s, d):
    """Documents as files of seven languages: the whole text in comments, then declarations."""
    docs = v.table(s, d, "documents").select(F.col("doc_id").alias("k"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in _LANGUAGES)), (F.col("k") % 7 + 1).cast("int"))
    mark = F.concat(pick(1), F.lit(" "))
    source = F.concat(mark, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), mark)), F.lit("\n"), F.replace(pick(2), F.lit("{k}"), F.col("k").cast("string")))
    return docs.select(F.concat("path", F.lit("."), pick(0)).alias("path"), source.alias("source"))


@query(f" SELECT path, replace(name, '{{k}}', mtime::VARCHAR) AS name, kind, replace(parent, '{{k}}', mtime::VARCHAR) AS parent, lines + off AS start_line FROM {_FILES_OF} JOIN {_DECLARED} ON l = mtime % 7")
def symbols_by_language(s, d):
    return code.symbols(_documented(s, d)).select("path", "name", "kind", "parent", "start_line")


@query(f" SELECT path, relation, replace(source, '{{k}}', mtime::VARCHAR) AS source_symbol, target, lines + off AS line FROM {_FILES_OF} JOIN {_RELATED} ON l = mtime % 7")
def relations_by_language(s, d):
    return code.relations(_documented(s, d)).select("path", "relation", "source_symbol", "target", "line")
