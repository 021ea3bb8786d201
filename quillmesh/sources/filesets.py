"""File sets of any size: walks by executors level by level, contents, and rewrites that keep what has changed meanwhile.

Paths are of a file system that all machines mount. The driver holds what the caller names and never a list of files.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import stat
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmesh.operators.catalog import glob_regex
from quillmesh.runtime import ship, stage
from quillmesh.sources.files import Rule, classify, parse_ignore

STDIN = "-"
#: Ignore files by precedence: a match in the first kind, of the deepest folder that has one, decides.
KINDS = (".ignore", ".gitignore", ".git/info/exclude", "global")
#: Levels of folders at most; a deeper tree raises.
MAX_LEVELS = 4096
_ENTRY = "root string, path string, folder boolean, rules string, problem string"
CONTENT = "path string, size long, mtime_secs long, identity string, content binary, sha256 string, problem string"
SUFFIX = ".qmtmp"


@lru_cache(4096)
def _rules(text: str) -> list[Rule]:
    return parse_ignore(text)


def _own_rules(folder: str) -> list[list[str]]:
    """[kind, folder, text] of a folder's ignore files."""
    out = []
    for kind in KINDS[:3]:
        with contextlib.suppress(OSError):
            if os.path.isfile(name := os.path.join(folder, kind)):
                out.append([kind, folder, Path(name).read_text("utf-8", "replace")])
    return out


def ignored(path: str, is_folder: bool, rules: list[list[str]]) -> bool:
    """Does a rule rule the path out? The last match in a file decides for it, deeper folders before outer ones, kinds in order."""
    for kind in KINDS:
        for own, base, text in reversed(rules):  # outer folders come first
            if own != kind:
                continue
            below = os.path.relpath(path, base)
            found = [rule for rule in _rules(text) if (is_folder or not rule.folders_only) and rule.regex.match(below)]
            if found:
                return not found[-1].keeps
    return False


def _listed(root: str, folder: str, rules: str, hidden: bool) -> list[tuple]:
    """Entries of one folder: files and folders that no rule rules out, without links and special files."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name))
        here = [*json.loads(rules), *_own_rules(folder)]
    except OSError as e:
        return [(root, folder, None, None, e.strerror or "can't be read")]
    out, packed = [], json.dumps(here)
    for e in entries:
        if not hidden and e.name.startswith("."):
            continue
        try:
            is_folder, is_file = e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)
        except OSError as error:
            out.append((root, e.path, None, None, error.strerror or "can't be read"))
            continue
        if (is_folder or is_file) and not ignored(e.path, is_folder, here):
            out.append((root, e.path, is_folder, packed if is_folder else None, None))
    return out


def walk_folders(spark: SparkSession, roots: list[str], hidden: bool = False, global_ignore: str = "") -> tuple[DataFrame, DataFrame]:
    """(files, problems): root and path of each file below ``roots``, and path and reason of what can't be read.

    Each level of folders is one job whose tasks list folders; folders carry the ignore rules that hold in them, those of
    folders above a root and ``global_ignore`` (an ignore file for all) included. Levels are staged, so a lost executor lists
    only its part again, and the driver learns of a level no more than whether it has folders.
    """
    ship(spark)

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame(_listed(row.root, row.path, row.rules, hidden), columns=["root", "path", "folder", "rules", "problem"]).astype({"folder": "boolean"})

    start = []
    for root in dict.fromkeys(os.path.abspath(r) for r in roots):
        above = [r for p in reversed(Path(root).parents) for r in _own_rules(str(p))]
        start.append((root, root, json.dumps([*([["global", root, global_ignore]] if global_ignore else []), *above])))
    frontier = spark.createDataFrame(start, "root string, path string, rules string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels: list[DataFrame] = []
    for _ in range(MAX_LEVELS):
        found = stage(frontier.repartition(parts, "path").mapInPandas(level, _ENTRY), "walk")
        levels.append(found)
        frontier = found.where("folder").select("root", "path", "rules")
        if frontier.isEmpty():
            break
    else:
        raise RuntimeError(f"folders are nested more than {MAX_LEVELS} deep")
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    return every.where("NOT folder").select("root", "path"), every.where("problem IS NOT NULL").select("path", F.col("problem").alias("reason"))


def _snapshot(path: str) -> tuple:
    with open(path, "rb") as f:
        content, seen = f.read(), os.fstat(f.fileno())
    return len(content), int(seen.st_mtime), f"{seen.st_dev}:{seen.st_ino}", content, hashlib.sha256(content).hexdigest()


def read_contents(files: DataFrame) -> DataFrame:
    """CONTENT of each file of ``files`` (path), read where the row is; what can't be read has null values and a ``problem``."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CONTENT.split(", ")]
        for batch in batches:
            for path in batch["path"]:  # a file is a batch of its own, so that no more than one is held
                try:
                    row = (path, *_snapshot(path), None)
                except OSError as e:
                    row = (path, None, None, None, None, None, e.strerror or "can't be read")
                yield pd.DataFrame([row], columns=names).astype({"size": "Int64", "mtime_secs": "Int64"})

    return files.select("path").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInPandas(run, CONTENT)


def resolve_operands(cwd: str, operands: list[str], allow_stdin: bool = True) -> list[tuple[str, str]]:
    """(kind, path) of what a caller names: ``stdin``, ``file`` or ``folder``; nothing named is ``default``, the working folder.

    ValueError for ``-`` beside others or where it is not allowed, and for what is neither a file nor a folder.
    """
    if not operands:
        return [("default", os.path.abspath(cwd))]
    if STDIN in operands:
        if not allow_stdin:
            raise ValueError("invalid-input: stdin marker is not accepted in this mode")
        if len(operands) > 1:
            raise ValueError("invalid-input: stdin marker cannot be combined with paths")
        return [("stdin", STDIN)]
    out = []
    for operand in operands:
        path = os.path.abspath(os.path.join(cwd, operand))
        try:
            mode = os.stat(path).st_mode
        except OSError as e:
            raise ValueError(f"invalid-path: {operand}") from e
        if not stat.S_ISDIR(mode) and not stat.S_ISREG(mode):
            raise ValueError(f"invalid-path: unsupported file type: {operand}")
        out.append(("folder" if stat.S_ISDIR(mode) else "file", path))
    return out


def file_set(
    spark: SparkSession, cwd: str, operands: list[str] = (), stdin: bytes | None = None, hidden: bool = False, global_ignore: str = "", include: list[str] = (), exclude: list[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(files, problems): classified files with ``source`` (stdin, file, folder or default), and what can't be read.

    ``include`` and ``exclude`` are patterns over whole paths, paths below ``cwd`` or names; files that they leave out keep a row
    with the label ``skipped`` and are not read. A file that is named by itself is read whatever ignore rules say. A file that is
    reached twice has a row for each way, as ``source`` tells.
    """
    inputs = resolve_operands(cwd, list(operands), stdin is not None)
    kinds = {kind for kind, _ in inputs}
    none = spark.createDataFrame([], "path string, reason string")
    if kinds == {"stdin"}:
        row = [(STDIN, len(stdin), None, None, bytearray(stdin), hashlib.sha256(stdin).hexdigest(), None)]
        return classify(spark.createDataFrame(row, CONTENT)).withColumn("source", F.lit("stdin")), none
    named = spark.createDataFrame([(p, "file") for k, p in inputs if k == "file"], "path string, source string")
    problems = none
    folders = [p for k, p in inputs if k != "file"]
    if folders:
        found, problems = walk_folders(spark, folders, hidden, global_ignore)
        named = named.unionByName(found.select("path", F.lit("default" if "default" in kinds else "folder").alias("source")))
    head = os.path.abspath(cwd).rstrip("/") + "/"
    below = F.when(F.startswith("path", F.lit(head)), F.substring("path", len(head) + 1, 1 << 20)).otherwise(F.col("path"))
    name = F.element_at(F.split("path", "/"), -1)
    fits = lambda globs: reduce(lambda a, b: a | b, [c.rlike(glob_regex(g)) for g in globs for c in (F.col("path"), below, name)], F.lit(False))
    skip = (~fits(include) if include else F.lit(False)) | fits(exclude)
    marked = stage(named.withColumn("skip", skip), "files")
    read = read_contents(marked.where("NOT skip").select("path").distinct())
    problems = problems.unionByName(read.where("problem IS NOT NULL").select("path", F.col("problem").alias("reason")))
    kept = classify(read.where("problem IS NULL")).join(marked.where("NOT skip").select("path", "source"), "path")
    out = marked.where("skip").select("path", "source", F.lit("skipped").alias("class"), F.lit("excluded by explicit filter").alias("label"))
    return kept.unionByName(out, allowMissingColumns=True), problems


def _staged(path: str, run: str) -> str:
    """The new file beside an old one: the same for each attempt of a run, so that a task that starts again overwrites it."""
    folder, name = os.path.split(path)
    return os.path.join(folder, f".{name[:100]}.{hashlib.sha256(path.encode('utf-8', 'surrogateescape')).hexdigest()[:16]}.{run}{SUFFIX}")


def _drift(path: str, size: int, sha256: str, identity: str | None) -> str | None:
    """Why a file is not what was read, or None."""
    try:
        now = _snapshot(path)
    except OSError as e:
        return f"missing: {e.strerror}"
    if now[0] != size:
        return f"drifted: file size changed ({size} -> {now[0]})"
    if now[4] != sha256:
        return "drifted: file content changed"
    if identity is not None and now[2] != identity:
        return "drifted: file was replaced"
    return None


def rewrite_files(changes: DataFrame) -> DataFrame:
    """path, state, reason: ``written``, ``drifted``, ``missing`` or ``failed`` for each file of ``changes`` (path, size, sha256, identity, new).

    Two jobs. The first stages each new content beside its file. The second compares a file with what was read and renames
    the new one over it, or removes the new one and keeps the file. A rename is whole or not at all; a task that runs again
    finds what it has already written by its contents. If the first job fails, nothing was renamed, and what it staged is
    removed. Of rows that repeat a path the one of the least ``new`` counts; a null ``new`` changes nothing and has no row.
    """
    spark, run = changes.sparkSession, uuid.uuid4().hex[:12]
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = changes.where("path IS NOT NULL AND new IS NOT NULL").select("path", F.struct(F.col("new").cast("binary").alias("new"), "size", "sha256", "identity").alias("c"))
    rows = rows.groupBy("path").agg(F.min("c").alias("c")).select("path", "c.*").repartition(parts, "path")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                new, problem = bytes(r.new), None
                if (problem := _drift(r.path, r.size, r.sha256, r.identity)) is None:
                    try:
                        with open(_staged(r.path, run), "wb") as f:
                            f.write(new)
                        os.chmod(_staged(r.path, run), stat.S_IMODE(os.stat(r.path).st_mode))
                    except OSError as e:
                        problem = f"failed: {e.strerror}"
                out.append((r.path, r.size, r.sha256, r.identity, hashlib.sha256(new).hexdigest(), problem))
            yield pd.DataFrame(out, columns=["path", "size", "sha256", "identity", "made", "problem"])

    def swap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                new, problem = _staged(r.path, run), r.problem
                if not problem and not os.path.exists(new):  # an earlier attempt has renamed it, or it is lost
                    done = os.path.isfile(r.path) and _snapshot(r.path)[4] == r.made
                    problem = None if done else "failed: the staged file is gone"
                elif not problem and (problem := _drift(r.path, r.size, r.sha256, r.identity)) is None:
                    try:
                        os.replace(new, r.path)
                    except OSError as e:
                        problem = f"failed: {e.strerror}"
                if problem:
                    with contextlib.suppress(OSError):
                        os.remove(new)
                state, _, reason = (problem or "written").partition(": ")
                out.append((r.path, state, reason or None))
            yield pd.DataFrame(out, columns=["path", "state", "reason"])

    def undo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with contextlib.suppress(OSError):
                    os.remove(_staged(path, run))
            yield pd.DataFrame({"path": batch["path"][:0]})

    kind = "path string, size long, sha256 string, identity string, made string, problem string"
    try:
        staged = stage(rows.mapInPandas(put, kind), "rewrite")
    except Exception:
        changes.where("path IS NOT NULL").select("path").distinct().mapInPandas(undo, "path string").write.format("noop").mode("overwrite").save()
        raise
    return stage(staged.repartition(parts, "path").mapInPandas(swap, "path string, state string, reason string"), "rewritten")
