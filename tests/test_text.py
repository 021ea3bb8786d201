"""Golden facts of text, search and graph operators on small literal rows."""

import pytest

from quillmesh.functions import text
from quillmesh.operators import board, catalog, fts, graph, store

ALPHA = "first needle line\nsecond line with needle and needle\nfinal old value\n"
BETA = "beta comes later\nneedle in beta\n"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("alpha.txt", ALPHA), ("beta.txt", BETA), ("crlf.txt", "a\r\nneedle é needle\r\n"), ("empty.txt", "")], "path string, text string")


def test_needle(files):
    got = sorted((r.path, r.line, r.byte) for r in text.matches(files, "needle").collect())
    assert got == [("alpha.txt", 1, 7), ("alpha.txt", 2, 18), ("alpha.txt", 2, 29), ("beta.txt", 2, 1), ("crlf.txt", 2, 1), ("crlf.txt", 2, 11)]
    assert {r.path: r.n for r in text.match_counts(files, "needle").collect()} == {"alpha.txt": 3, "beta.txt": 1, "crlf.txt": 2, "empty.txt": 0}


def test_lines_and_ranges(files):
    assert text.lines(files.where("path = 'empty.txt'")).count() == 0
    assert text.parse_range("2:4") == (2, 4) and text.parse_range("3") == (3, 3)
    assert text.parse_range(":$") == (1, None) and text.parse_range("4:$") == (4, None) and text.parse_range("2,") == (2, None)
    for bad in ("5:2", "$", "$:$", "$:3", "0", "0:2", ":0", "", "a", "1:b", "-1"):
        with pytest.raises(ValueError):
            text.parse_range(bad)


def test_sed(files):
    alpha = files.where("path = 'alpha.txt'")
    assert text.sed_apply(alpha, "(n)eedle", "$1ail", first_only=True).first().text == ALPHA.replace("first needle", "first nail").replace("with needle", "with nail", 1)
    crlf = text.sed_apply(files.where("path = 'crlf.txt'"), "needle", "pin", line_range=(2, None)).first()
    assert crlf.text == "a\r\npin é pin\r\n" and crlf.changed
    with pytest.raises(ValueError):
        text.escape_replacement("$3", 2)
    with pytest.raises(ValueError):
        text.check_regex("(?=x)")


def test_fixed_pattern_quotes_signs():
    import re

    assert re.fullmatch(text.check_regex("a+b.$", fixed=True), "a+b.$")


def test_sed_keeps_terminators(spark):
    df = spark.createDataFrame([("a", "x  \r\ny \r\nz \n")], "path string, text string")
    assert text.sed_apply(df, "\\s+$", "").first().text == "x\r\ny\r\nz\n"


def test_sed_expressions():
    assert text.parse_sed("s/a/b/") == ("a", "b", False, False) and text.parse_sed("s|a/b|c\\|d|gi") == ("a/b", "c|d", True, True)
    assert text.parse_sed("s/a\\.b\\/c/$1/g") == ("a\\.b/c", "$1", True, False)
    for bad in ("", "y/a/b/", "s", "sxaxbx", "s/a", "s/a/b", "s//b/", "s/a/b/gg", "s/a/b/x", "s a b "):
        with pytest.raises(ValueError):
            text.parse_sed(bad)


def test_modes():
    text.check_modes()
    text.check_modes(with_matches=True, null=True)
    for bad in ({"count": True, "paths_only": True}, {"with_matches": True, "without_match": True}, {"null": True}, {"limit": 0}):
        with pytest.raises(ValueError):
            text.check_modes(**bad)


def _context(body, pattern, before, after):
    """Records of one file, a match at a time."""
    import re

    rows, found, last = body.removesuffix("\n").split("\n"), [], None
    for k, row in enumerate(rows, 1):
        for m in re.finditer(pattern, row):
            for kind, span in (("before", range(max(1, k - before), k)), ("match", [k]), ("after", range(k + 1, min(k + after, len(rows)) + 1))):
                for n in span:
                    if kind == "match":
                        found.append((kind, k, m.start() + 1, m[0]))
                    elif last != (kind, n):
                        found.append((kind, n, None, rows[n - 1]))
                        last = (kind, n)
    return found


def test_context_of_each_match(spark):
    import random

    rng = random.Random(3)
    bodies = {f"f{i}": "\n".join("".join(rng.choice("xab ") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 9))) + "z\n" for i in range(40)}
    df = spark.createDataFrame(list(bodies.items()), "path string, text string")
    for before, after in ((0, 0), (2, 1), (0, 2), (1, 0), (1, 1), (3, 3)):
        got: dict = {}
        for r in text.match_context(df, "x", before, after).orderBy("path", "place").collect():
            got.setdefault(r.path, []).append((r.kind, r.line, r.byte, r.text))
        assert got == {k: x for k, b in bodies.items() if (x := _context(b, "x", before, after))}


def test_pages_clamp(spark):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(5)], "k int, text string")
    shown = lambda skip, limit: [r.text for r in text.page_records(df, ["k"], skip, limit).orderBy("place").collect()]
    assert shown(1, 2) == ["t1", "t2", "truncated: output-limit shown=2 remaining=2", "resume: --skip 3 --limit 2"]
    assert shown(3, 2) == ["t3", "t4"] and shown(9, 2) == []


def test_query_parser():
    assert fts.parse('a b OR "c d" NOT e*') == [("phrase", ["a"], False, None), ("phrase", ["b"], False, None), "AND", ("phrase", ["c", "d"], False, None), ("phrase", ["e"], True, None), "NOT", "OR"]
    assert fts.parse("foo_bar") == [("phrase", ["foo", "bar"], False, None)] and fts.parse("Title:Café") == [("phrase", ["cafe"], False, "title")]
    assert fts.parse('NEAR("a b" c, 4)') == [("near", [("phrase", ["a", "b"], False, None), ("phrase", ["c"], False, None)], 4)]
    assert fts.prompt_query("What's foo_bar?") == '"what" OR "foo" OR "bar"'
    for bad in ("foo-bar", "a AND", '"open', "(a", "", "a:", ":a", "*", "NEAR(a b, x)", "_"):
        with pytest.raises(ValueError):
            fts.parse(bad)


def test_search_by_words(spark):
    rows = [(1, "Café au lait", "Menu"), (2, "CAFE noir; foo_bar", "Other"), (3, "one two three four five six", "two"), (4, "six five four three two one", "x"), (5, None, "cafe")]
    index = fts.build_index(spark.createDataFrame([(k, 0, a, b) for k, a, b in rows], "id long, ordinal long, text string, title string"), ("text", "title"))
    found = lambda q: sorted(r.id for r in fts.bm25(index, q).collect())
    assert found("cafe") == found("Café") == [1, 2, 5] and found("text:café") == [1, 2] and found("title:(cafe OR menu)") == [1, 5]
    assert found("foo_bar") == [2] and found('"bar foo"') == [] and found("foo bar") == [2] and found("caf*") == [1, 2, 5]
    assert found("NEAR(one three, 1)") == [3, 4] and found("NEAR(one four, 1)") == [] and found("NEAR(two six four, 3)") == [3, 4] and found("NEAR(one six four, 3)") == []
    assert found("two NOT title:two") == [4] and found("(one OR lait) AND six") == [3, 4]
    with pytest.raises(ValueError):
        found("body:x")


def test_edges_resolve(spark):
    symbols = [(1, "Rust", "run", "src/worker.rs", "fn"), (2, "Rust", "run", "src/other.rs", "fn"), (3, "C#", "IThing", "a.cs", "interface"), (4, "Rust", "Thing", "src/lib.rs", "struct")]
    files = [(11, "src/worker.rs"), (12, "src/other.rs"), (13, "pkg/util.py"), (14, "web/base.ts"), (15, "src/main.rs")]
    refs = [
        (1, "Rust", "worker::run", "src/main.rs", "calls"), (2, "Rust", "run", "src/main.rs", "calls"), (3, "C#", "IThing", "b.cs", "inherits"), (4, "Rust", "crate::worker", "src/main.rs", "imports"),
        (5, "Python", "pkg.util", "pkg/main.py", "imports"), (6, "TypeScript", "'./base'", "web/app.ts", "imports"), (7, "Rust", "crate::nowhere::Thing", "src/main.rs", "imports"), (8, "Rust", "missing", "src/main.rs", "calls"), (9, "Rust", "main", "src/main.rs", "imports"),
    ]
    out = graph.resolve_edges(
        spark.createDataFrame(refs, "ref long, language string, raw string, file string, relation string"), spark.createDataFrame(symbols, "target long, language string, name string, file string, kind string"), spark.createDataFrame(files, "target long, path string")
    )
    assert {r.ref: (r.target, r.confidence, r.relation) for r in out.collect()} == {
        1: (1, "resolved", "calls"), 2: (None, "ambiguous", "calls"), 3: (3, "resolved", "implements"), 4: (11, "resolved", "imports"), 5: (None, "extracted", "imports"),  # its last part reads as an extension
        6: (14, "resolved", "imports"), 7: (4, "resolved", "imports"), 8: (None, "extracted", "calls"), 9: (None, "extracted", "imports"),
    }


def test_traverse_directions_and_dangling_edges(spark):
    edges = [(1, "a", "b", "r", None), (2, "c", "b", "r", None), (3, "b", None, "r", "x"), (4, "b", None, "r", "x"), (5, "d", "c", "r", None), (6, "b", "b", "r", None)]
    df = spark.createDataFrame(edges, "edge int, src string, dst string, relation string, dst_ref string")
    start = spark.createDataFrame([("a",), (None,)], "node string")
    got = lambda direction, **k: sorted((r.edge, r.depth) for r in graph.traverse(df, start, direction, **k).collect())
    assert got("out", max_depth=5) == [(1, 1), (3, 2), (4, 2), (6, 2)]
    assert got("both", max_depth=5) == [(1, 1), (2, 2), (3, 2), (4, 2), (5, 3), (6, 2)]
    assert got("both", max_depth=2, limit=2) == [(1, 1), (6, 2)] and got("in") == [] and got("out", limit=0) == []
    with pytest.raises(ValueError):
        got("up")


def test_traverse_stops_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "a", "r"), ("b", "c", "r"), ("c", "d", "r"), ("c", None, "r")], "src string, dst string, relation string")
    start = spark.createDataFrame([("a",)], "node string")
    got = sorted((r.src, r.dst or "", r.depth) for r in graph.traverse(edges, start, max_depth=3).collect())
    assert got == [("a", "b", 1), ("b", "a", 2), ("b", "c", 2), ("c", "", 3), ("c", "d", 3)]
    assert graph.traverse(edges, start, max_depth=0).count() == 0


def test_store_and_board(spark):
    old = spark.createDataFrame([("p", 1, 10), ("q", 2, 20)], "k string, v int, created int")
    new = spark.createDataFrame([("q", 3, 99), ("r", 4, 99)], "k string, v int, created int")
    assert sorted(map(tuple, store.upsert(old, new, ["k"], ["created"]).collect())) == [("p", 1, 10), ("q", 3, 20), ("r", 4, 99)]
    rows = spark.createDataFrame([(i, 1000) for i in range(6)], "id int, n int")
    assert sorted(r.id for r in board.within_budget(rows, ["id"], rows.n, 3000).collect()) == [0, 1, 2]
    assert catalog.glob_filter(spark.createDataFrame([("a/b.txt",), ("c.md",)], "path string"), ["*.txt"]).count() == 1


def test_patterns_are_read_in_order():
    for legal in (r"\++", r"a\\1", "[*+]x", r"\p{L}+", r"\x{41}+", r"(?:a|b)+", "a+", r"[]*+]"):
        assert text.check_regex(legal) == legal
    for other in (r"a++", r"(a)\1", r"\\\1", "(?<=a)b", "(?>a)", "a{2}+", r"[a]*+", r"(?<n>a)\k<n>"):
        with pytest.raises(ValueError):
            text.check_regex(other)


def test_lines_of_null_and_empty_texts(spark):
    files = spark.createDataFrame([("a", None), ("b", ""), ("c", "\n"), ("d", "x\r\n\ny")], "path string, text string")
    assert sorted(tuple(r) for r in text.lines(files).collect()) == [("c", 1, ""), ("d", 1, "x"), ("d", 2, ""), ("d", 3, "y")]
