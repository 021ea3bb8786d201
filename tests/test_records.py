from quillmesh.operators import records


def test_artifact_filters(spark):
    rows = [("a", "doc", "spec", "draft", ["x", "y"], "me"), ("b", "doc", None, "final", [], "me"), ("c", None, "spec", "draft", None, None)]
    df = spark.createDataFrame(rows, "id string, kind string, subkind string, lifecycle_state string, labels array<string>, actor_id string")
    ids = lambda out: sorted(r.id for r in out.collect())
    assert ids(records.artifacts(df)) == ["a", "b", "c"]
    assert ids(records.artifacts(df, kind="doc")) == ["a", "b"]
    assert ids(records.artifacts(df, subkind="spec", lifecycle_state="draft")) == ["a", "c"]
    assert ids(records.artifacts(df, label="y", actor_id="me")) == ["a"]


def test_contribution_filters(spark):
    rows = [(1, 1, "read", "critic", "v1", ["p", "q"]), (2, 2, "write", "critic", "v2", ["p"]), (3, 2, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, round int, phase string, role string, reviewed_version string, read_set array<string>")
    ids = lambda out: sorted(r.id for r in out.collect())
    assert ids(records.contributions(df, round_=2)) == [2, 3]
    assert ids(records.contributions(df, role="critic", read_set_contains="q")) == [1]
    assert ids(records.contributions(df, phase="write", reviewed_version="v2")) == [2]


def test_version_diffs(spark):
    versions = spark.createDataFrame([(1, "v1", "one\ntwo"), (1, "v2", "one\n2"), (1, "v3", None)], "artifact_id int, version string, body string")
    pairs = spark.createDataFrame([(1, "v1", "v2"), (1, "v2", "v2"), (1, "v1", "v3"), (1, "v1", "v9")], "artifact_id int, from_version string, to_version string")
    got = {(r.from_version, r.to_version): r["diff"] for r in records.version_diffs(versions, pairs).collect()}
    assert set(got) == {("v1", "v2"), ("v2", "v2"), ("v1", "v3")} and got["v2", "v2"] == ""
    assert got["v1", "v2"].split("\n")[2:] == ["@@ -1,2 +1,2 @@", " one", "-two", "+2"] and "-one" in got["v1", "v3"]
