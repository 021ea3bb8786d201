"""File and symbol lookups: conjunctive filters, summaries, ranked matches, listings and trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: file names that a project summary looks for
KEY_NAMES = ["README.md", "Cargo.toml", "package.json", "pyproject.toml", "go.mod", "Makefile", "Dockerfile", "main.rs", "lib.rs", "main.py", "index.ts", "main.go", "CLAUDE.md"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column | str) -> Column:
    return F.translate(c if isinstance(c, Column) else F.col(c), _UPPER, _LOWER)


def like_fold(c: str, pattern: str) -> Column:
    """LIKE with ASCII case folding; ``%`` and ``_`` of the pattern are wildcards."""
    return ascii_fold(c).like(pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\"))


def contains(c: str, query: str) -> Column:
    return like_fold(c, f"%{query}%")


def find_files(files: DataFrame, name: str | None = None, extension: str | None = None, min_size: int | None = None, max_size: int | None = None, limit: int = 100) -> DataFrame:
    """Files that meet all filters that are set, newest first."""
    tests = []
    if name is not None:
        tests.append(contains("path", name))
    if extension is not None:
        tests.append(F.col("extension") == extension.lstrip("."))
    if min_size is not None:
        tests.append(F.col("size") >= min_size)
    if max_size is not None:
        tests.append(F.col("size") <= max_size)
    out = files.where(reduce(lambda a, b: a & b, tests)) if tests else files
    return out.orderBy(F.desc("mtime"), "path").limit(limit)


def project_summary(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def language_breakdown(files: DataFrame, limit: int = 20) -> DataFrame:
    known = files.where(F.col("extension") != "")
    return known.groupBy("extension").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("files"), "extension").limit(limit)


def key_files(files: DataFrame, names: list[str] = KEY_NAMES, each: int = 3) -> DataFrame:
    """The first paths, by order, of each name: one pass that gives a file the names it ends with."""
    hits = F.filter(F.array(*(F.when(like_fold("path", f"%{n}"), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    ranked = files.select("path", F.explode(hits).alias("name")).withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("path")))
    return ranked.where(F.col("rank") <= each).select("name", "path")


def symbol_search(symbols: DataFrame, query: str, kind: str | None = None, file: str | None = None, limit: int = 20, last: list[str] = ()) -> DataFrame:
    """Names that contain ``query``: exact first, then prefixes, then others, by name, path and the columns of ``last``."""
    out = symbols.where(contains("name", query))
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if file is not None:
        out = out.where(contains("path", file))
    rank = F.when(F.col("name") == query, 0).when(like_fold("name", f"{query}%"), 1).otherwise(2)
    return out.withColumn("rank", rank).orderBy("rank", "name", "path", *last).limit(limit)


def search_all(blocks: list[DataFrame], order: list[str], limit: int) -> DataFrame:
    """block (its number) and rows of each block, ``limit`` of each in its own order: there is no common rank."""
    parts = [b.withColumn("block", F.lit(k)).orderBy(*order).limit(limit) for k, b in enumerate(blocks)]
    return reduce(DataFrame.unionByName, parts)


def resource_detail(resources: DataFrame, parts: dict[str, DataFrame], uses: DataFrame) -> DataFrame:
    """``resources`` with the number of rows (id) of each of ``parts`` and the sum of uses (resource, access_count); none is 0."""
    out = resources
    for name, rows in parts.items():
        out = out.join(rows.groupBy("id").agg(F.count(F.lit(1)).alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    total = uses.groupBy(F.col("resource").alias("id")).agg(F.sum("access_count").alias("uses"))
    return out.join(total, "id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def find_resources(resources: DataFrame, query: str, namespace: str | None = None, limit: int = 20) -> DataFrame:
    """Resources by uri, or by part of title or id; uri matches first, then equal titles, then equal ids."""
    if not query or limit <= 0:
        return resources.withColumn("rank", F.lit(0)).limit(0)
    out = resources.where((F.col("uri") == query) | contains("title", query) | contains("external_id", query))
    if namespace is not None:
        out = out.where(F.col("namespace") == namespace)
    rank = F.when(F.col("uri") == query, 0).when(F.col("title") == query, 1).when(F.col("external_id") == query, 2).otherwise(3)
    return out.withColumn("rank", rank).orderBy("rank", "uri").limit(limit)


def most_authoritative(matches: DataFrame) -> DataFrame:
    """Only the rows of the best authority that is there."""
    rank = F.when(F.col("authority") == "repository", 0).when(F.col("authority") == "gateway", 1).otherwise(2)
    ranked = matches.withColumn("__r", rank)
    best = ranked.agg(F.min("__r").alias("__m"))  # one row
    return ranked.join(F.broadcast(best), F.col("__r") == F.col("__m")).drop("__r", "__m")


def resolve_unique(matches: DataFrame) -> DataFrame:
    """The single row of ``matches``; LookupError if there is none, or names of two candidates if there are more."""
    found = matches.limit(2).collect()
    if len(found) != 1:
        raise LookupError("not found" if not found else "ambiguous: " + ", ".join(str(r["uri"]) for r in found))
    return matches


def glob_regex(pattern: str) -> str:
    """``*`` is any run, slashes included; ``?`` is one character; matched against a whole path or file name."""
    return "^(?s:" + "".join(".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E" for c in pattern) + ")$"


def glob_filter(files: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Files that an include pattern (if any are given) and no exclude pattern matches, by path or base name."""
    base = F.element_at(F.split("path", "/"), -1)
    hit = lambda ps: reduce(lambda a, b: a | b, [F.col("path").rlike(glob_regex(p)) | base.rlike(glob_regex(p)) for p in ps], F.lit(False))
    out = files.where(hit(include)) if include else files
    return out.where(~hit(exclude)) if exclude else out


def entries(files: DataFrame, depth: int) -> DataFrame:
    """parent, name, is_dir, level, size of all files and folders down to ``depth`` levels."""
    cut = F.split("path", "/")
    levels = files.select(cut.alias("c"), "size", F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size(cut)))).alias("level"))
    rows = levels.select(
        F.array_join(F.slice("c", 1, F.col("level") - 1), "/").alias("parent"), F.get("c", F.col("level") - 1).alias("name"), (F.col("level") < F.size("c")).alias("is_dir"), F.col("level").cast("long").alias("level"), "size"
    )
    return rows.groupBy("parent", "name", "is_dir", "level").agg(F.sum(F.when(~F.col("is_dir"), F.col("size"))).alias("size"))


def list_dir(files: DataFrame, parent: str, hidden: bool = False) -> DataFrame:
    """Entries of one folder, folders first, sizes for files alone."""
    depth = parent.count("/") + 2 if parent else 1
    below = files.where(F.col("path").startswith(f"{parent}/")) if parent else files
    out = entries(below, depth).where(F.col("parent") == parent)
    out = out if hidden else out.where(~F.col("name").startswith("."))
    return out.select("name", "is_dir", "size").orderBy(F.desc("is_dir"), "name")


def tree(files: DataFrame, depth: int, per_dir: int) -> DataFrame:
    """parent, rank, name, is_dir: the first files of each folder, all folders, and a row that counts what is left out."""
    rows = entries(files, depth)
    rank = lambda by: F.row_number().over(Window.partitionBy("parent").orderBy(by)).cast("long")
    folders = rows.where("is_dir").withColumn("rank", rank("name")).select("parent", "name", "is_dir", "rank")
    # files alone, so that only the first of a folder are sorted; names and their number in one aggregate would hold them all
    names = rows.where("NOT is_dir")
    shown = names.withColumn("rank", rank("name")).where(F.col("rank") <= per_dir).select("parent", "name", "is_dir", "rank")
    over = names.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_dir)
    more = over.select("parent", F.concat(F.lit("[+"), (F.col("n") - per_dir).cast("string"), F.lit(" more]")).alias("name"), F.lit(False).alias("is_dir"), F.lit(per_dir + 1).cast("long").alias("rank"))
    return folders.unionByName(shown).unionByName(more)


def with_optional(rows: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """``rows`` with the columns of each part that has their key, null where it hasn't."""
    return reduce(lambda a, b: a.join(b, key, "left"), parts, rows)


def symbol_rows(symbols: DataFrame, files: DataFrame, parents: DataFrame) -> DataFrame:
    """Symbols with their file's columns, and their parent's where they have one; symbols without a file are left out."""
    return symbols.join(files, "file").join(parents, "parent_id", "left")


def recent_resources(counts: DataFrame, resources: DataFrame, since: int, limit: int) -> DataFrame:
    """uri, uses of resources used since then, the most used first, then by uri."""
    used = counts.where(F.col("last_access") >= since).groupBy(F.col("resource").alias("id")).agg(F.sum("access_count").alias("uses"))
    return used.join(resources.select("id", "uri"), "id").select("uri", "uses").orderBy(F.desc("uses"), "uri").limit(limit)


def lookup(rows: DataFrame, **keys: object) -> DataFrame:
    """The row with these values; one at most."""
    return reduce(lambda df, k: df.where(F.col(k) == keys[k]), keys, rows).limit(1)
