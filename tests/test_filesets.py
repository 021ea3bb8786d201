"""Walks by executors against the local walk, operands, and rewrites that meet changed files."""

import os
import stat

import pytest
from pyspark.sql import functions as F

from quillmesh.sources import files, filesets


def tree(root, entries):
    for name, text in entries.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode() if isinstance(text, str) else text)


def paths(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.select("path").collect())


def test_walk_equals_the_local_one(spark, tmp_path):
    tree(tmp_path / "p", {
        "a.txt": "x", "b/c.py": "x", "b/d/e.rs": "x", "b/d/skip.log": "x", "target/x": "x", "b/target/y": "x", ".hidden": "x", ".dir/z": "x", "b/.gitignore": "*.log\n/d/only\n", "b/d/only": "x", "only": "x",
        ".gitignore": "target/\n!keep\n", "deep/1/2/3/4/5/6/f": "x", "empty.txt": "",
    })
    os.symlink(tmp_path / "p/a.txt", tmp_path / "p/link")
    os.symlink(tmp_path / "p/b", tmp_path / "p/linked")
    for hidden in (False, True):
        found, problems = filesets.walk_folders(spark, [str(tmp_path / "p")], hidden)
        assert sorted(r.path for r in found.collect()) == sorted(files.walk(str(tmp_path / "p"), hidden)[0]) and problems.count() == 0


def test_ignore_files_by_kind_and_depth(spark, tmp_path):
    tree(tmp_path, {
        ".gitignore": "*.out\nup/\n", "p/.gitignore": "*.tmp\n!x.out\n", "p/.ignore": "!a.tmp\nz*\n", "p/sub/.gitignore": "!z1\n*.md\n", "p/sub/.ignore": "!n.md\n", "p/.git/info/exclude": "ex\n", "p/a.tmp": "", "p/b.tmp": "", "p/x.out": "",
        "p/y.out": "", "p/up/f": "", "p/sub/z1": "", "p/sub/m.md": "", "p/sub/n.md": "", "p/sub/ex": "", "p/sub/glob": "", "p/keep": "",
    })
    found, _ = filesets.walk_folders(spark, [str(tmp_path / "p")], global_ignore="glob\nkeep\n")
    assert paths(found, tmp_path / "p") == ["a.tmp", "sub/n.md", "x.out"]


def test_operands_and_filters(spark, tmp_path):
    tree(tmp_path, {".gitignore": "named.log\n", "named.log": "log\n", "a/b.txt": "b\r\n", "a/c.bin": b"\0", "a/d.txt": "d"})
    cwd = str(tmp_path)
    assert filesets.resolve_operands(cwd, []) == [("default", cwd)] and filesets.resolve_operands(cwd, ["-"]) == [("stdin", "-")]
    for bad in (["-", "a"], ["nope"]):
        with pytest.raises(ValueError):
            filesets.resolve_operands(cwd, bad)
    with pytest.raises(ValueError):
        filesets.resolve_operands(cwd, ["-"], allow_stdin=False)
    found, problems = filesets.file_set(spark, cwd, ["named.log", "a"], exclude=["a/d*"])
    rows = {os.path.relpath(r.path, cwd): (r.source, r["class"], r.label, r.decoded) for r in found.collect()}
    assert rows == {
        "named.log": ("file", "text", None, "log\n"), "a/b.txt": ("folder", "text", None, "b\r\n"), "a/c.bin": ("folder", "binary", "binary-skipped", None), "a/d.txt": ("folder", "skipped", "excluded by explicit filter", None),
    }
    assert problems.count() == 0
    every, _ = filesets.file_set(spark, cwd, include=["*.txt"])
    assert sorted((os.path.relpath(r.path, cwd), r.source, r["class"]) for r in every.collect()) == [("a/b.txt", "default", "text"), ("a/c.bin", "default", "skipped"), ("a/d.txt", "default", "text")]
    (one,) = filesets.file_set(spark, cwd, ["-"], stdin=b"\xef\xbb\xbfhi")[0].collect()
    assert (one.path, one.source, one.decoded, one.has_bom) == ("-", "stdin", "hi", True)


def read_and_change(spark, root, new="new {}"):
    found = filesets.walk_folders(spark, [str(root)])[0]
    snap = filesets.read_contents(found).collect()
    rows = [(r.path, r.size, r.sha256, r.identity, bytearray(new.format(os.path.basename(r.path)).encode())) for r in snap]
    return spark.createDataFrame(rows, "path string, size long, sha256 string, identity string, new binary")


def left(root):
    return [f for _, _, names in os.walk(root) for f in names if f.endswith(filesets.SUFFIX)]


def test_changed_files_are_kept(spark, tmp_path):
    tree(tmp_path, {f"d/f{k}": f"old {k}" for k in range(8)})
    os.chmod(tmp_path / "d/f0", 0o640)
    changes = read_and_change(spark, tmp_path)
    (tmp_path / "d/f1").write_text("other size")
    (tmp_path / "d/f2").write_text("odd 2")
    (tmp_path / "d/f3").unlink()
    os.rename(tmp_path / "d/f4", tmp_path / "moved")
    (tmp_path / "d/f4").write_text("old 4")
    changes = changes.unionByName(changes.where(F.col("path").endswith("f5"))).unionByName(changes.where(F.col("path").endswith("f6")).withColumn("new", F.lit(None).cast("binary")))
    out = {os.path.basename(r.path): (r.state, r.reason) for r in filesets.rewrite_files(changes).collect()}
    assert {k: v[0] for k, v in out.items()} == {"f0": "written", "f1": "drifted", "f2": "drifted", "f3": "missing", "f4": "drifted", "f5": "written", "f6": "written", "f7": "written"}
    assert (out["f1"][1], out["f2"][1], out["f4"][1]) == ("file size changed (5 -> 10)", "file content changed", "file was replaced")
    assert (tmp_path / "d/f0").read_text() == "new f0" and (tmp_path / "d/f2").read_text() == "odd 2" and not (tmp_path / "d/f3").exists()
    assert stat.S_IMODE(os.stat(tmp_path / "d/f0").st_mode) == 0o640 and left(tmp_path) == []


def test_a_failed_rewrite_leaves_all_as_it_was(spark, tmp_path):
    tree(tmp_path, {f"f{k}": f"old {k}" for k in range(6)})
    changes = read_and_change(spark, tmp_path)
    broken = changes.withColumn("new", F.when(F.col("path").endswith("f5"), F.raise_error(F.lit("killed")).cast("binary")).otherwise(F.col("new")))
    with pytest.raises(Exception, match="killed"):
        filesets.rewrite_files(broken)
    assert all((tmp_path / f"f{k}").read_text() == f"old {k}" for k in range(6)) and left(tmp_path) == []
    assert filesets.rewrite_files(changes.limit(0)).count() == 0


def test_unreadable_things_are_problems(spark, tmp_path):
    tree(tmp_path, {"a": "x"})
    gone = spark.createDataFrame([(str(tmp_path / "a"),), (str(tmp_path / "gone"),)], "path string")
    rows = {os.path.basename(r.path): r.problem for r in filesets.read_contents(gone).collect()}
    assert rows["a"] is None and rows["gone"]
    found, problems = filesets.walk_folders(spark, [str(tmp_path / "nowhere"), str(tmp_path)])
    assert paths(found, tmp_path) == ["a"] and [os.path.basename(r.path) for r in problems.collect()] == ["nowhere"]
