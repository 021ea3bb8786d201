"""File sets, byte classes, hashes and structured documents."""

import pytest

from quillmesh.functions import markdown
from quillmesh.sources import documents, files


def test_walk_honours_ignore_rules(tmp_path):
    for name in ("kept.txt", "ignored.txt", "a/x.log", "a/keep.log", "a/b/y.txt", "build/z.txt", ".secret", "sub/build.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    (tmp_path / ".gitignore").write_text("# names\n/ignored.txt\n*.log\n!keep.log\nbuild/\n")
    (tmp_path / "a/.ignore").write_text("b/*.txt\n")
    (tmp_path / "link.txt").symlink_to(tmp_path / "kept.txt")
    found, problems = files.walk(str(tmp_path))
    assert [f[len(str(tmp_path)) + 1 :] for f in found] == ["a/keep.log", "kept.txt", "sub/build.txt"] and problems == []
    assert files.walk(str(tmp_path / "none"))[1]


def test_classes_of_bytes(spark, tmp_path):
    content = {"lf": b"a\nb\n", "crlf": b"a\r\nb\r\n", "mixed": b"a\r\nb\n", "none": b"", "bom": b"\xef\xbb\xbfx", "nul": b"a\0b", "utf16": b"\xff\xfea", "bad": b"a\xffb", "one": b"x\r\ny"}
    for name, value in content.items():
        (tmp_path / f"{name}+1 2.txt").write_bytes(value)
    rows = {r["path"].split("/")[-1].split("+")[0]: r for r in files.text_files(spark, str(tmp_path)).collect()}
    assert {k: (r["class"], r["line_ending"], r["trailing_newline"], r["has_bom"]) for k, r in rows.items()} == {
        "lf": ("text", "lf", "lf", False), "crlf": ("text", "crlf", "crlf", False), "mixed": ("text", "mixed", "lf", False), "none": ("text", "none", "none", False),
        "bom": ("text", "none", "none", True), "nul": ("binary", None, None, False), "utf16": ("unsupported-encoding", None, None, False), "bad": ("invalid-utf8", None, None, False),
        "one": ("text", "crlf", "none", False),
    }
    assert rows["bom"]["decoded"] == "x" and rows["nul"]["label"] == "binary-skipped" and rows["lf"]["path"].endswith("lf+1 2.txt")
    assert files.read_bytes(spark, []).count() == 0


def test_hashes(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "p string")
    got = {r["p"]: (r["h"], r["w"]) for r in files.hash_column(files.hash_column(df, "p", "h", 1), "p", "w", 4).collect()}
    assert got[""][0] == "cbf29ce484222325" and got["a"][0] == "af63dc4c8601ec8c" and got["foobar"][0] == "85944171f73967e8" and got[None] == (None, None)
    for text, (one, four) in got.items():
        if text is not None:
            state = list(files.OFFSETS)
            for byte in text.encode():
                state = [((s ^ (byte + k)) * p) % 2**64 for k, (s, p) in enumerate(zip(state, files.PRIMES, strict=True))]
            assert four == "".join(f"{s:016x}" for s in state) and four.startswith(one)


def test_drift(spark):
    a = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")], "path string, size long, hash string")
    b = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("d", 1, "x")], "path string, size long, hash string")
    assert {r["path"]: r["state"] for r in files.drift(a, b).collect()} == {"a": "same", "b": "changed", "c": "gone", "d": "new"}


MD = "intro\n\n# One  \ntext\n```\n# not\n[no](x)\n~~~\n## Two é\nsee [a](b.md) and [c [d](http://e) []( )\n### Deep\nmore\n# three\nend\n"


def test_segments_and_links(spark):
    docs = spark.createDataFrame([("m", MD), ("h", "# First\nbody"), ("e", " \n"), ("n", None)], "path string, text string")
    rows = sorted(markdown.segments(docs).collect(), key=lambda r: (r["path"], r["ordinal"]))
    assert [(r["path"], r["title"], r["start_line"], r["end_line"]) for r in rows] == [
        ("h", "h", 1, 2), ("m", "m", 1, 2), ("m", "One", 3, 8), ("m", "Two é", 9, 10), ("m", "Deep", 11, 12), ("m", "three", 13, 14)
    ]
    assert all(r["token_count"] == len(r["text"].split()) for r in rows)
    for r in rows:
        whole = {"m": MD, "h": "# First\nbody"}[r["path"]].encode()
        assert whole[r["start_byte"] : r["end_byte"]].decode().strip() == r["text"]
    links = sorted(markdown.inline_links(docs).collect(), key=lambda r: r["n"])
    assert [(r["line"], r["label"], r["target"], r["external"]) for r in links] == [(10, "a", "b.md", False), (10, "c [d", "http://e", True)]


def test_outline_and_section(spark):
    text = "# A\n````\n# no\n```\n# no\n````\n## B\nx\n### C\ny\n## D\n"
    docs = spark.createDataFrame([("m", text), ("n", None), ("o", "plain")], "path string, text string")
    got = {r["path"]: r["headings"] for r in markdown.outline(docs).collect()}
    assert [tuple(h) for h in got["m"]] == [(1, "A", 1), (2, "B", 7), (3, "C", 9), (2, "D", 11)] and got["n"] is None and got["o"] == []
    assert [tuple(r) for r in markdown.section(docs, "b").collect()] == [("m", "## B\nx\n### C\ny\n")]
    assert [tuple(r) for r in markdown.section(docs, "D").collect()] == [("m", "## D\n")]


def test_bundle(spark, tmp_path):
    good = "---\ntype: note\ntitle: T\ntags: [a, b]\nstale_after: 2026-01-02\n---\n# H\nsee [x](../b.md) and [y](none.md) and [z](https://e)\n"
    docs = spark.createDataFrame(
        [("d/a.md", good), ("b.md", "---\ntype: x\ntimestamp: 1\n---\n# Head\n# Citations\n"), ("c.md", "---\ntitle: no\n---\n"), ("p.md", "plain"), ("y.md", "---\n[: \n---\n"), ("z.txt", good)],
        "path string, text string",
    )
    parsed = documents.bundle(docs)
    got = {r["path"]: r for r in parsed.collect()}
    a = got["d/a.md"]
    assert (a["kind"], a["title"], a["tags"], a["stale_after"], a["status"], a["id"]) == ("note", "T", ["a", "b"], "2026-01-02", "stable", "d/a")
    assert got["b.md"]["title"] == "Head" and [d["code"] for d in got["b.md"]["diagnostics"]] == ["okf-0.1-timestamp", "okf-0.1-citations"]
    assert (got["c.md"]["error"], got["p.md"]["error"], got["y.md"]["error"]) == ("type is missing", "no front matter", "invalid front matter") and "z.txt" not in got
    assert sorted((r["target"], r["resolved"]) for r in documents.concept_links(parsed).collect()) == [("../b.md", "b.md"), ("https://e", None), ("none.md", None)]
    documents.export_bundle(parsed, str(tmp_path / "out"))
    again = {r["path"]: r["document"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert again["d/a.md"] == good
    assert {r["kind"]: [tuple(e) for e in r["entries"]] for r in documents.bundle_index(parsed).collect()} == {"note": [("d/a", "T")], "x": [("b", "Head")]}
    with pytest.raises(ValueError):
        documents.bundle(docs, documents.Limits(files=2))


def test_usage_files(spark):
    text = "one\ntwo: a, b\nthree:\n  - x\n  - y\n\ntwo: b, c\n"
    usage = documents.parse_usage(text)
    assert usage == {"one": [], "two": ["a", "b", "c"], "three": ["x", "y"]} and documents.parse_usage(documents.render_usage(usage)) == usage
    for bad in ("# no\n", "  - x\n", "a:\n  x\n"):
        with pytest.raises(ValueError):
            documents.parse_usage(bad)
    df = spark.createDataFrame([("p", text), ("q", "# no"), ("r", None)], "path string, text string")
    assert sorted((r["path"], r["id"] or r["error"]) for r in documents.pattern_usages(df).collect()) == [("p", "one"), ("p", "three"), ("p", "two"), ("q", "line 1: comments are not supported")]


def test_structured_files(spark):
    api = "paths:\n  /a:\n    get: {operationId: ga, summary: s}\n    parameters: []\n  /b:\n    post: {operation_id: pb}\n"
    spec = '{"items": [{"spec_file": "x.md"}], "phases": [{"tasks": [{"file_path": "y.md"}, {"spec_file": "x.md"}]}]}'
    src = spark.createDataFrame([("api.yaml", api), ("s/m.json", spec), ("bad.json", "{"), ("bad.yml", "[: ")], "path string, text string")
    value = documents.as_json(src)
    assert {r["path"] for r in value.where("value IS NULL").collect()} == {"bad.json", "bad.yml"}
    assert sorted((r["method"], r["route"], r["operation_id"], r["summary"]) for r in documents.endpoints(value).collect()) == [("GET", "/a", "ga", "s"), ("POST", "/b", "pb", None)]
    bodies = spark.createDataFrame([("s/x.md", "X")], "path string, text string")
    assert sorted((r["file"], r["body"]) for r in documents.spec_bodies(value, bodies).collect()) == [("x.md", "X"), ("y.md", None)]
