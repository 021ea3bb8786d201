"""Observations, virtual documents, pattern catalogs and front matter against plain Python and hand-made cases."""

import random
from collections import defaultdict


from quillmesh.functions import markdown
from quillmesh.operators import observe, virtual
from quillmesh.sources import documents


def brute(work, accesses, window, limit):
    out = set()
    for w, at in {x for x in work if None not in x}:
        tools = defaultdict(list)
        for r, t, s in accesses:
            if r is not None and s is not None and s <= at:
                tools[r, t].append(s)
        uses = defaultdict(int)
        for (r, _), times in tools.items():
            if max(times) >= at - window:
                uses[r] += len(times)
        for rank, (n, r) in enumerate(sorted((-n, r) for r, n in uses.items())[:limit], 1):
            out.add((w, rank, r, -n))
    return out


def test_observation_links_match_brute_force(spark):
    r = random.Random(3)
    accesses = [(r.choice(["a", "b", "c", "d", None]), r.choice(["read", "grep", None]), r.choice([None, *range(0, 40_000, 97)])) for _ in range(400)]
    accesses += [("hot", "read", r.randrange(40_000)) for _ in range(200)] + [("edge", "read", 7200), ("edge", "read", 3599), ("edge2", "read", 10_800)]
    work = [(k, r.randrange(0, 42_000)) for k in range(40)] + [(100, 10_800), (101, 3599), (102, 3600), (103, 0), (104, None), (None, 5), (100, 10_800)]
    w, a = spark.createDataFrame(work, "work long, at long"), spark.createDataFrame(accesses, "resource string, tool string, seen long")
    for window, limit in ((3600, 3), (10_000, 8)):
        assert {tuple(x) for x in observe.observation_links(w, a, window, limit).collect()} == brute(work, accesses, window, limit)
    assert observe.observation_links(w, a.limit(0)).count() == 0 and observe.observation_links(w.limit(0), a).count() == 0


def test_only_the_latest_observations_are_kept(spark):
    work = spark.createDataFrame([(k, k % 3, f"t{k}", "done") for k in range(6)], "work long, at long, title string, outcome string")
    links = spark.createDataFrame([(k, n, f"r{n}", 3 - n) for k in range(5) for n in (1, 2)], "work long, rank int, resource string, uses long")
    rows = spark.createDataFrame([("r1", "One", "u1", "/x.md"), ("r2", "Two", "u2", None)], "resource string, title string, uri string, link string")
    out = observe.observations(work, links, rows, 2).collect()
    assert [r.work for r in out] == [2, 4]
    assert out[0].body == "# t2\n\ndone\n\n## Resources touched\n\n- [One](/x.md) — read 2 times\n- `u2` — read 1 time\n"


def test_documents_by_name(spark):
    files = spark.createDataFrame([("a.md", "real\r\ntext"), ("empty.md", None)], "path string, text string")
    rows = [(1, "repo://p/a.md", "a.md", "x1"), (2, "repo://p/b", "Guide", "x2"), (3, "repo://p/c", "Guide two", "x3"), (4, "Guide", "z", "x4"), (5, "repo://p/e", "solo", "x5")]
    resources = spark.createDataFrame([(*r, "n") for r in rows], "id long, uri string, title string, external_id string, namespace string")
    versions = spark.createDataFrame([(2, "k: v\n\n", "body\n"), (4, None, "four"), (5, "", None)], "id long, raw string, body string")
    read = lambda t: tuple(virtual.read_document(t, files, resources, versions).first())[1:]
    assert read("a.md") == ("file", "real\r\ntext", None) and read("empty.md")[:2] == ("file", "")
    assert read("repo://p/b") == ("resource", "---\nk: v\n---\nbody\n", None) and read("solo")[:2] == ("resource", "---\n\n---\n")
    assert read("Guide") == ("resource", "four", None)  # a uri of that name is never ambiguous
    assert read("Guid") == ("ambiguous", None, ["repo://p/b", "repo://p/c"]) and read("nothing")[0] == read("  ")[0] == "none"
    lines = lambda t, v: [(r.line, r.text) for r in virtual.read_virtual(t, v, files, resources, versions).orderBy("line").collect()]
    assert lines("a.md", None) == [(1, "real\r\n"), (2, "text")] and lines("repo://p/b", "2:3") == [(2, "k: v\n"), (3, "---\n")] and lines("nothing", None) == []


CATALOG = """# Patterns
<!-- pattern-slug: outside -->
 ## Go one\t
text
<!-- pattern-slug: none -->
  <!-- pattern-slug:  go-x -->
### SCOPE

 first
 second

third
### Scope
other
````
## fenced
~~~
```
## go-y
<!-- pattern-slug:go-y-->
###  Scope
## Last
<!-- pattern-slug: fullstack-go- -->

### Scope
### Scope
end
"""


def test_pattern_catalogs(spark):
    df = spark.createDataFrame([("a", CATALOG), ("crlf", CATALOG.replace("\n", "\r\n")), ("none", None), ("empty", ""), ("open", "```\n## x\n<!-- pattern-slug: x -->\n")], "path string, text string")
    rows = markdown.pattern_catalog(df).orderBy("path", "ordinal").collect()
    assert [(r.path, r.slug, r.title, r.summary) for r in rows if r.path == "a"] == [
        ("a", "go-x", "Go one", "first second"), ("a", "go-y", "go-y", None), ("a", "fullstack-go-", "Last", None),
    ]
    assert [tuple(r)[1:] for r in rows if r.path == "crlf"] == [tuple(r)[1:] for r in rows if r.path == "a"] and {r.path for r in rows} == {"a", "crlf"}
    assert rows[0].body.startswith(" ## Go one\t\ntext\n") and rows[0].body.endswith("~~~\n```\n") and rows[2].body.endswith("### Scope\nend\n")
    assert (rows[0].labels, rows[0].categories, rows[2].labels) == (["go"], ["programming-language/golang"], ["fullstack"])
    own = markdown.pattern_catalog(df, {"go-": ("a", "b"), "go-x": ("c", "d")})
    assert own.where("slug = 'go-x'").first().labels == ["c"] and own.where("slug = 'fullstack-go-'").first().categories == ["general"]


def test_front_matter(spark):
    text = lambda front, body="": f"---\ntype: t\n{front}---\n{body}"
    docs = [
        ("a.md", text("sources: [{id: 1.5, resource: true}, {resource: {a: 1}}, 3]\nverified: {at: [1], x: null, y: [1, 2]}\ngenerated: none\n", "x\n  # Citations  \n- https://a\n-https://b\n - https://c\n# Other\n- https://d\n# Citations\n- mailto:x@y\n")),
        ("b.md", text("verified: no\nsources: {a: 1}\ntimestamp: 12\n", "- https://e\n")), ("c.md", "no front"), ("d.md", None),
    ]
    fronts = documents.with_front(documents.concepts(spark.createDataFrame(docs, "path string, text string")))
    sources = [(r.path, r.id, r.resource, r.title) for r in documents.front_sources(fronts).orderBy("path", "ordinal").collect()]
    assert sources == [("a.md", "1.5", "true", None), ("a.md", None, "https://a", None), ("a.md", None, "https://c", None), ("a.md", None, "mailto:x@y", None)]
    assert sorted(tuple(r) for r in documents.front_verified(fronts).collect()) == [("a.md", "x", "null", None), ("a.md", "y", "[1,2]", None)]
    assert sorted(tuple(r) for r in documents.front_generated(fronts).collect())[:2] == [("a.md", None, None), ("b.md", None, "12")]


def test_spans_of_uses(spark):
    """Work and what its window holds are not paired: stretches are twice the accesses at most, and links come out of them."""
    accesses = [(1, "a", 10), (1, "b", 12), (1, "a", 15), (1, None, 15), (1, "a", 30), (2, "a", 15), (None, "a", 3), (2, "a", None)]
    out = [tuple(r) for r in observe.spans(spark.createDataFrame(accesses, "resource long, tool string, seen long"), 5).collect()]
    assert len(out) <= 2 * len(accesses)
    want = {(r, t): sum(sum(x[:2] == (r, k) and x[2] <= t for x in accesses[:6]) for k in {x[1] for x in accesses[:6] if x[0] == r and t - 5 <= x[2] <= t}) for r in (1, 2) for t in range(50)}
    got = {(r, t): n for r, start, end, n in out for t in range(start, end + 1)}
    assert got == {k: n for k, n in want.items() if n} and len(got) == sum(end - start + 1 for _, start, end, _ in out)
    # all 60 work pieces end within reach of all 60 resources: the plan has no join of the two by time
    a = spark.createDataFrame([(k, "t", k) for k in range(60)], "resource long, tool string, seen long")
    w = spark.createDataFrame([(k, 100 + k) for k in range(60)], "work long, at long")
    links = observe.observation_links(w, a, 1000, 2).collect()
    assert {tuple(r) for r in links} == {(k, n, n - 1, 1) for k in range(60) for n in (1, 2)}
