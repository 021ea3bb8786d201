"""Markdown as rows: segments, inline links, outlines and sections. Input frames have ``path`` and ``text``; a null text has no rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quillmesh.functions.scalars import is_external
from quillmesh.runtime import ship

_HEADING = "^#{1,6} "
OUTLINE = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("line", T.LongType())]))


def _strip(c: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def _fenced_lines(docs: DataFrame) -> DataFrame:
    """path, i (from 0), line, last, bare (no white space before), fence, open: any line of three backticks or tildes opens or closes."""
    cut = docs.select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"), (F.size(F.split("text", "\n", -1)) - 1).alias("last"))
    bare = cut.withColumn("bare", F.regexp_replace("line", "(?U)^\\s+", ""))
    bare = bare.withColumn("fence", F.col("bare").rlike("^(```|~~~)"))
    return bare.withColumn("open", F.sum(F.col("fence").cast("int")).over(Window.partitionBy("path").orderBy("i")) % 2 == 1)


def segments(docs: DataFrame, fallback: Column | str = "path") -> DataFrame:
    """path, ordinal, title, text, start_line, end_line, start_byte, end_byte, token_count: what precedes the first heading, then a row a heading.

    The first segment, even if it starts with a heading, is named by ``fallback``. Segments of white space alone are left
    out; lines count from 1, bytes from 0, ends of bytes are exclusive. ``path`` must be unique.
    """
    order = Window.partitionBy("path").orderBy("i")
    rows = _fenced_lines(docs)
    heading = ~F.col("fence") & ~F.col("open") & F.col("bare").rlike(_HEADING) & (F.col("i") > 0)
    size = F.octet_length("line") + F.when(F.col("i") < F.col("last"), 1).otherwise(0)
    rows = rows.withColumn("heading", heading).withColumn("seg", F.sum(heading.cast("int")).over(order)).withColumn("end_byte", F.sum(size).over(order)).withColumn("size", size)
    ended = (F.col("i") < F.col("last")) | (F.col("line") != "")  # nothing after a final line feed is no line
    found = rows.groupBy("path", "seg").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"),
        F.max(F.when(F.col("heading"), _strip(F.regexp_replace("bare", "^#+", "")))).alias("title"),
        (F.min("i") + 1).cast("long").alias("start_line"),
        F.max(F.when(ended, F.col("i") + 1)).cast("long").alias("end_line"),
        F.min(F.col("end_byte") - F.col("size")).cast("long").alias("start_byte"),
        F.max("end_byte").cast("long").alias("end_byte"),
    )
    found = found.withColumn("text", _strip(F.col("text"))).where("text <> ''")
    named = found.join(docs.select("path", (F.col(fallback) if isinstance(fallback, str) else fallback).alias("__name")), "path")
    return named.select(
        "path",
        (F.row_number().over(Window.partitionBy("path").orderBy("seg")) - 1).cast("long").alias("ordinal"),
        F.when(F.col("seg") == 0, F.col("__name")).otherwise(F.col("title")).alias("title"),
        "text", "start_line", F.greatest("end_line", "start_line").alias("end_line"), "start_byte", "end_byte",
        F.size(F.split("text", "(?U)\\s+")).cast("long").alias("token_count"),
    )


def inline_links(docs: DataFrame) -> DataFrame:
    """path, line, n, label, target, external: ``[label](target)`` outside fences, from left to right; empty targets are left out."""
    rows = _fenced_lines(docs).where("NOT fence AND NOT open AND line LIKE '%](%'")
    shape = "\\[((?:(?!\\]\\().)*)\\]\\(([^)]*)\\)"
    found = rows.select("path", (F.col("i") + 1).cast("long").alias("line"), F.posexplode(F.regexp_extract_all("line", F.lit(f"(?s){shape}"), F.lit(0))).alias("n", "m"))
    target = _strip(F.regexp_extract("m", f"(?s)^{shape}$", 2))
    return found.select("path", "line", "n", F.regexp_extract("m", f"(?s)^{shape}$", 1).alias("label"), target.alias("target"), is_external(target).alias("external")).where("target <> ''")


def _outline(text: str | None) -> list[dict] | None:
    """Headings outside fences; a fence is closed only by the same character, at least as often."""
    if text is None:
        return None
    found, open_ = [], None
    for number, line in enumerate(text.split("\n"), 1):
        bare = line.strip() if line.isspace() else line.lstrip()
        mark = re.match(r"(`{3,}|~{3,})", bare)
        if mark:
            if open_ is None:
                open_ = mark[1]
            elif mark[1][0] == open_[0] and len(mark[1]) >= len(open_):
                open_ = None
        elif open_ is None and (m := re.match(r"(#{1,6}) (.*)", bare)):
            found.append({"level": len(m[1]), "text": m[2].strip(), "line": number})
    return found


def outline(docs: DataFrame) -> DataFrame:
    """path, text, headings: an array of (level, text, line), with fences as CommonMark has them. In Arrow batches, since the fence is a state."""
    ship(docs.sparkSession)

    @F.pandas_udf(OUTLINE)
    def headings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(_outline, na_action=None)

    return docs.select("path", "text", headings("text").alias("headings"))


def section(docs: DataFrame, name: str) -> DataFrame:
    """path, section: from the first heading ``name`` (ASCII letters of any case) to the next of the same or a higher level; no row where there is none."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = F.get(F.filter("headings", lambda h: fold(h["text"]) == fold(F.lit(name))), F.lit(0))
    at = outline(docs).withColumn("first", first).where("first IS NOT NULL")
    after = F.get(F.filter("headings", lambda h: (h["line"] > F.col("first.line")) & (h["level"] <= F.col("first.level"))), F.lit(0))
    cut = F.split(F.regexp_replace("text", "\r?\n$", ""), "\r?\n", -1)
    size = F.coalesce(F.col("after.line") - F.col("first.line"), F.size(cut) - F.col("first.line") + 1)
    return at.withColumn("after", after).select("path", F.concat(F.array_join(F.slice(cut, F.col("first.line").cast("int"), size.cast("int")), "\n"), F.lit("\n")).alias("section"))


#: Labels and categories of patterns by the start of their slug; the longest start wins. A caller may give its own.
PATTERN_PREFIXES = {"go-": ("go", "programming-language/golang"), "fullstack-": ("fullstack", "application-architecture/fullstack")}


def pattern_catalog(docs: DataFrame, prefixes: dict[str, tuple[str, str]] = PATTERN_PREFIXES) -> DataFrame:
    """path, ordinal, title, slug, summary, body, labels, categories, version, state: the patterns of each catalog (path, text).

    A pattern is a section of level two, outside fences, that names itself in a line ``<!-- pattern-slug: name -->``; sections
    without a name, or with the name ``none``, are no patterns. A fence closes with its own character only. The summary is the
    first paragraph under the heading ``### Scope``. State of fences is folded over the lines that are marks or headings, so
    a text is read once and its sections are cut by line numbers.
    """
    lines = F.split("text", "\r?\n", -1)
    cut = docs.where("text IS NOT NULL").select("path", F.when(F.endswith("text", F.lit("\n")), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines).alias("lines"))
    mark = lambda x: F.regexp_extract(x, "(?U)^\\s*(```|~~~|## )", 1)
    marks = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), mark(x).alias("m"))), lambda x: x["m"] != "")
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<int>").alias("at"))
    toggled = lambda s, m: F.when(m == "## ", s["fence"]).when(s["fence"] == "", m).when(s["fence"] == m, F.lit("")).otherwise(s["fence"])
    step = lambda s, x: F.struct(toggled(s, x["m"]).alias("fence"), F.when((x["m"] == "## ") & (s["fence"] == ""), F.array_append(s["at"], x["i"])).otherwise(s["at"]).alias("at"))
    found = cut.withColumn("at", F.aggregate(marks, start, step, lambda s: s["at"]))
    ends = F.transform("at", lambda a, k: F.struct((a + 1).alias("a"), F.coalesce(F.get("at", k + 1), F.size("lines")).alias("b")))
    rows = found.select("path", "lines", F.posexplode(ends).alias("ordinal", "s")).select("path", "ordinal", F.expr("slice(lines, s.a, s.b - s.a + 1)").alias("own"))
    # the start of a section is counted from 1, its end is exclusive and from 0
    rows = rows.withColumn("bare", F.transform("own", _strip))
    slugs = F.transform(F.filter("bare", lambda x: x.rlike("^<!-- pattern-slug:.*-->$")), lambda x: _strip(F.regexp_extract(x, "^<!-- pattern-slug:(.*)-->$", 1)))
    rows = rows.withColumn("slug", F.get(F.filter(slugs, lambda x: (x != "") & (F.lower(x) != "none")), F.lit(0))).where("slug IS NOT NULL")
    after = lambda c, test: F.expr(f"slice({c}, 1 + coalesce(nullif(array_position(transform({c}, x -> {test}), true), 0) - 1, size({c})), size({c}))")
    upto = lambda c, test: F.expr(f"slice({c}, 1, coalesce(nullif(array_position(transform({c}, x -> {test}), true), 0) - 1, size({c})))")
    rows = rows.withColumn("scope", after("bare", "lower(x) rlike '^### +scope$'")).withColumn("scope", F.expr("slice(scope, 2, size(scope))"))
    rows = rows.withColumn("scope", upto("scope", "x rlike '^### '")).withColumn("scope", after("scope", "x <> ''")).withColumn("scope", upto("scope", "x = ''"))
    body = F.concat(F.regexp_replace(F.array_join("own", "\n"), "(?U)\\s+$", ""), F.lit("\n"))
    known = lambda k, other: _chosen(prefixes, k, other)
    return rows.select(
        "path", "ordinal", _strip(F.regexp_replace(F.get("bare", F.lit(0)), "^## ", "")).alias("title"), "slug", F.when(F.size("scope") > 0, F.array_join("scope", " ")).alias("summary"), body.alias("body"),
        known(0, F.array().cast("array<string>")).alias("labels"), known(1, F.array(F.lit("general"))).alias("categories"), F.lit("latest").alias("version"), F.lit("active").alias("state"),
    )


def _chosen(prefixes: dict[str, tuple[str, str]], k: int, other: Column) -> Column:
    out = other
    for prefix in sorted(prefixes, key=len):  # the longest is asked first
        out = F.when(F.col("slug").startswith(prefix), F.array(F.lit(prefixes[prefix][k]))).otherwise(out)
    return out
