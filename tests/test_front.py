"""Front matter: read once a document, by libyaml's events where both parsers agree."""

import json
import random

from quillmesh.sources import documents


def test_fast_loader_gives_what_the_plain_one_gives():
    yaml, plain, fast, errors = documents._loader()
    if fast is None:
        return
    rng = random.Random(3)
    bits = ["a: ", "b:\n", "- ", "\n  ", "{x: ", "}", "[", "]", ", ", "#", '"q"', "'it''s'", "&k ", "*k", "|\n  ", "~", "1.5", "2024-01-02", "é", "<<: ", "text\n", "- 7\n", ": ", "---\n", "%1", "!", "? ", "\t"]

    def read(load):
        try:
            return repr(load())
        except errors + (ValueError,):
            return "error"

    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 10)))
        assert read(lambda: documents.load_yaml(text)) == read(lambda: yaml.load(text, plain)), text
    for text in ("!", "a\t", "%1\n---\né", "a: " + "[" * 200_000):
        assert read(lambda: documents.load_yaml(text)) == read(lambda: yaml.load(text, plain)), text[:20]


def test_front_is_read_once_a_document(spark, monkeypatch):
    loads = []
    load = documents.load_yaml
    monkeypatch.setattr(documents, "load_yaml", lambda raw: (loads.append(raw), load(raw))[1])
    row = documents.parse_concept("a.md", "---\ntype: t\nat: [1, é]\n---\nbody", front=True)
    assert len(loads) == 1 and json.loads(row["front_json"]) == {"type": "t", "at": [1, "é"]}
    assert documents.parse_concept("a.md", "---\ntype: t\n? [1]\n: 2\n---\n", front=True)["error"] == "invalid front matter"
    monkeypatch.undo()
    docs = spark.createDataFrame([("a.md", "---\ntype: t\nsources: [{resource: r}]\n---\n# Citations\r\n- https://a\r\n"), ("b.md", "no")], "path string, text string")
    parsed = documents.concepts(docs, front=True)
    fronts = documents.with_front(parsed)
    plain = documents.with_front(documents.concepts(docs))
    assert fronts.columns == plain.columns
    shown = lambda df: sorted(map(str, df.collect()))
    for derive in (documents.front_sources, documents.front_verified, documents.front_generated):
        assert shown(derive(fronts)) == shown(derive(plain))
    plan = documents.front_sources(fronts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_citations_by_lines(spark):
    """The section starts at the mark alone, with white space around, and ends at a heading; items count wherever they stand in it."""
    bodies = {
        "mark": " \t# Citations\u2003\r\n-  https://a\n\n text\n\t- https://b\n## deeper\n- https://c\n# Citations\n- https://d\n#\n- https://e",
        "ended": "- https://no\n# Citations\n- https://a\n# Other # Citations\n- https://no\n# Citations of\n- https://no\n # Citations\n- https://b",
        "many": "# Citations\n" + "".join(f"- https://{k}\n" for k in range(20_000)) + "- https://" + "x" * (1 << 21),
    }
    docs = spark.createDataFrame([(k, f"---\ntype: t\n---\n{b}") for k, b in bodies.items()], "path string, text string")
    found = {}
    for r in documents.front_sources(documents.with_front(documents.concepts(docs, front=True))).orderBy("path", "ordinal").collect():
        found.setdefault(r.path, []).append(r.resource)
    assert found["mark"] == [" https://a"] + [f"https://{c}" for c in "bcde"] and found["ended"] == ["https://a", "https://b"]
    assert found["many"] == [f"https://{k}" for k in range(20_000)] + ["https://" + "x" * (1 << 21)]
