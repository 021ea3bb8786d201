"""File sets: walks that honour ignore rules, decoding and classification of bytes, hashes of contents and paths."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillmesh.runtime import ship

IGNORE_FILES = (".gitignore", ".ignore")

# Starts and multipliers of the four lanes of the content hash; the first pair is FNV-1a's.
OFFSETS = (0xCBF29CE484222325, 0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0x100000001B3)
PRIMES = (0x100000001B3, 0x100000001C3, 0x100000001D3, 0x100000001F3)


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file, as a pattern over paths below that file's folder."""

    regex: re.Pattern
    folders_only: bool
    keeps: bool


def _pattern(glob: str) -> str:
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        elif glob[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif glob[at] == "?":
            out, at = out + "[^/]", at + 1
        elif glob[at] == "[" and (end := glob.find("]", at + 2)) > 0:
            inside = glob[at + 1 : end].replace("\\", "\\\\")
            out, at = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end + 1
        else:
            at += glob[at] == "\\" and at + 1 < len(glob)
            out, at = out + re.escape(glob[at]), at + 1
    return out


def parse_ignore(text: str) -> list[Rule]:
    """Rules in file order: ``#`` comments, ``!`` keeps, a final slash means folders, a slash elsewhere anchors."""
    rules = []
    for raw in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", raw)
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        line = line[keeps:]
        folders = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        rules.append(Rule(re.compile(("" if anchored else "(?:.*/)?") + _pattern(line.lstrip("/")) + "$"), folders, keeps))
    return rules


def _ignored(path: Path, is_folder: bool, scopes: list[tuple[Path, list[Rule]]]) -> bool:
    """The last rule that matches decides; rules of deeper folders come later."""
    verdict = False
    for base, rules in scopes:
        below = path.relative_to(base).as_posix()
        for rule in rules:
            if (is_folder or not rule.folders_only) and rule.regex.match(below):
                verdict = not rule.keeps
    return verdict


def walk(root: str, hidden: bool = False) -> tuple[list[str], list[str]]:
    """(files, diagnostics) below a local ``root``, bytewise ordered: without links, hidden names and what ignore files rule out.

    A folder that can't be read gives a diagnostic, not an error. Only names are gathered on the driver; contents are read
    by executors (``read_bytes``).
    """
    found: list[str] = []
    problems: list[str] = []

    def visit(folder: Path, scopes: list[tuple[Path, list[Rule]]]) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name))
            rules = [r for n in IGNORE_FILES if (folder / n).is_file() for r in parse_ignore((folder / n).read_text("utf-8", "replace"))]
        except OSError as e:
            problems.append(f"{folder}: {e.strerror}")
            return
        here = [*scopes, (folder, rules)] if rules else scopes
        for entry in entries:
            if entry.is_symlink() or (not hidden and entry.name.startswith(".")):
                continue
            path, is_folder = Path(entry.path), entry.is_dir(follow_symlinks=False)
            if _ignored(path, is_folder, here):
                continue
            if is_folder:
                visit(path, here)
            elif entry.is_file(follow_symlinks=False):
                found.append(entry.path)

    visit(Path(root), [])
    return sorted(found, key=os.fsencode), problems


def read_bytes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size, mtime_secs, content. ``path`` has no scheme for local files. No paths, no rows.

    The reader skips files of no bytes; those of local paths are added from their names, those of other stores have no row.
    """
    local = [os.path.abspath(p) for p in paths if "://" not in p]
    blank = [(p, 0, int(st.st_mtime), b"") for p in local if not (st := os.stat(p)).st_size]
    empty = spark.createDataFrame(blank, "path string, size long, mtime_secs long, content binary")
    if len(blank) == len(paths):
        return empty
    raw = spark.read.format("binaryFile").load(["file://" + os.path.abspath(p) if "://" not in p else p for p in paths])
    plain = F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), "^file:/+", "/").alias("path")
    full = raw.select(plain, F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime_secs"), "content")
    return full.unionByName(empty) if blank else full


def _begins(content: Column, prefix: bytes) -> Column:
    return F.startswith(content, F.lit(prefix))


def classify(files: DataFrame) -> DataFrame:
    """``files`` (with binary ``content``) with class, decoded (null unless text), has_bom, line_ending, trailing_newline and label.

    A zero byte makes a file binary, a UTF-16 mark unsupported; a UTF-8 mark is taken off; bytes that are not UTF-8 are
    invalid. A null content is an empty text.
    """
    content = F.coalesce(F.col("content"), F.lit(b""))
    bom = _begins(content, b"\xef\xbb\xbf")
    body = F.when(bom, F.substring(content, 4, 2147483647)).otherwise(content)
    text = body.cast("string")
    kind = (
        F.when(F.position(F.lit(b"\x00"), content) > 0, "binary")
        .when(_begins(content, b"\xff\xfe") | _begins(content, b"\xfe\xff"), "unsupported-encoding")
        .when(~F.is_valid_utf8(text), "invalid-utf8")
        .otherwise("text")
    )
    is_text = F.col("class") == "text"
    all_, crlf = F.regexp_count("decoded", F.lit("\n")), F.regexp_count("decoded", F.lit("\r\n"))
    ending = F.when(all_ == 0, "none").when(crlf == 0, "lf").when(crlf == all_, "crlf").otherwise("mixed")
    tail = F.when(F.col("decoded").endswith("\r\n"), "crlf").when(F.col("decoded").endswith("\n"), "lf").otherwise("none")
    out = files.withColumn("class", kind).withColumn("decoded", F.when(is_text, text)).withColumn("has_bom", is_text & bom)
    label = F.when(F.col("class") == "binary", "binary-skipped").when(~is_text, F.col("class"))
    return out.withColumn("line_ending", F.when(is_text, ending)).withColumn("trailing_newline", F.when(is_text, tail)).withColumn("label", label)


def text_files(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """Classified files of a walk, ordered by path, then class."""
    return classify(read_bytes(spark, walk(root, hidden)[0])).orderBy("path", "class")


def _lanes(values: list[bytes], lanes: int) -> np.ndarray:
    """Hash states (values x lanes): all values advance a byte at a time, the longest first, so that those done fall off the end."""
    order = sorted(range(len(values)), key=lambda k: -len(values[k]))
    state = np.tile(np.array(OFFSETS[:lanes], np.uint64), (len(values), 1))
    prime, add = np.array(PRIMES[:lanes], np.uint64), np.arange(lanes, dtype=np.uint64)
    data = [np.frombuffer(values[k], np.uint8) for k in order]
    sizes = np.array([-len(x) for x in data])
    for at in range(len(data[0]) if data else 0):
        live = int(np.searchsorted(sizes, -at, side="left"))
        byte = np.fromiter((x[at] for x in data[:live]), np.uint64, live)
        state[:live] = (state[:live] ^ (byte[:, None] + add)) * prime
    out = np.empty_like(state)
    out[order] = state
    return out


def hash_column(df: DataFrame, column: str, name: str, lanes: int) -> DataFrame:
    """``df`` with ``name``: 16 hex digits a lane of the UTF-8 or raw bytes of ``column``; one lane for paths, four for contents. Null stays null."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = batch.notna()
            values = [bytes(v) for v in batch[known]]
            made = ["".join(f"{int(x):016x}" for x in row) for row in _lanes(values, lanes)]
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            out[known] = made
            yield out

    return df.withColumn(name, digest(F.col(column).cast("binary")))


def drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, state: ``same``, ``changed``, ``gone`` or ``new``, by size and hash of two scans (path, size, hash)."""
    a, b = before.select("path", F.struct("size", "hash").alias("a")), now.select("path", F.struct("size", "hash").alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, "path", "full").select("path", state.alias("state"))
