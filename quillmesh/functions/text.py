"""Text operators over files: lines, matches, counts, context, rewrites, ranges and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmesh.sources.files import hash_column

#: One piece of a pattern, read in order: what the dialect lacks, or an escape, a class or any other character.
_PIECE = re.compile(r"(?P<advanced>\\[1-9]|\\k<|\(\?(?:[=!>]|<[=!])|[*+?}]\+)|\\[pPx]\{[^}]*\}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.S)


def check_regex(pattern: str, fixed: bool = False, ignore_case: bool = False) -> str:
    """A pattern in the dialect without look-around, back references and possessive repeats; ValueError otherwise."""
    if fixed:
        pattern = re.sub(r"([\\.+*?()|\[\]{}^$#&~-])", r"\\\1", pattern)
    elif any(piece["advanced"] for piece in _PIECE.finditer(pattern)):
        raise ValueError("look-around, back references and possessive repeats are not supported")
    return ("(?i)" if ignore_case else "") + pattern


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text: a final terminator makes no line, and a carriage return before it is left out."""
    parts = files.select("path", F.split("text", "\n", -1).alias("parts")).select("path", "parts", F.size("parts").alias("n"))
    # outer, since a plain one would split again to skip empty arrays; a null text has a null place, which goes with the filter
    cut = parts.select("path", "n", F.posexplode_outer("parts").alias("at", "text"))
    out = cut.where((F.col("at") < F.col("n") - 1) | (F.col("text") != ""))
    return out.select("path", (F.col("at") + 1).cast("long").alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def matches(files: DataFrame, pattern: str) -> DataFrame:
    """path, line, byte (from 1), match: every non-overlapping match; the pattern never matches nothing."""
    regex = F.lit(pattern)
    hit = lines(files).where(F.col("text").rlike(pattern)).withColumn("p", F.split("text", pattern, -1)).withColumn("m", F.regexp_extract_all("text", regex, F.lit(0)))
    place = F.expr("transform(m, (x, i) -> named_struct('match', x, 'byte', 1 + aggregate(slice(p, 1, i + 1), 0, (a, s) -> a + octet_length(s)) + aggregate(slice(m, 1, i), 0, (a, s) -> a + octet_length(s))))")
    return hit.select("path", "line", F.explode(place).alias("x")).select("path", "line", F.col("x.byte").cast("long").alias("byte"), F.col("x.match").alias("match"))


def placed_matches(files: DataFrame, pattern: str) -> DataFrame:
    """path, line, text, k (from 1, in the line), byte and at (characters, both from 1), match."""
    hit = lines(files).where(F.col("text").rlike(pattern)).withColumn("p", F.split("text", pattern, -1)).withColumn("m", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    before = "aggregate(slice(p, 1, i + 1), 1, (a, s) -> a + {0}(s)) + aggregate(slice(m, 1, i), 0, (a, s) -> a + {0}(s))"
    place = F.expr(f"transform(m, (x, i) -> named_struct('k', i + 1, 'byte', {before.format('octet_length')}, 'at', {before.format('length')}, 'match', x))")
    out = hit.select("path", "line", "text", F.explode(place).alias("x"))
    return out.select("path", "line", "text", *(F.col(f"x.{c}").cast("long").alias(c) for c in ("k", "byte", "at")), F.col("x.match").alias("match"))


def match_context(files: DataFrame, pattern: str, before: int, after: int) -> DataFrame:
    """path, place, kind (before, match, after), line, byte (matches alone), text: each match with the lines around it, by ``place``.

    Lines between two matches come for both; only a context line that repeats the kind and line of the context line just
    before it is left out. What that was follows from the last match that had context, so one window over matches is enough.
    """
    own = lines(files)
    total = own.groupBy("path").agg(F.max("line").alias("n"))
    found = placed_matches(files, pattern).select("path", "line", "byte", "match").join(total, "path")
    order = Window.partitionBy("path").orderBy("line", "byte")
    low, high = F.greatest(F.lit(1), F.col("line") - before), F.least(F.col("line") + after, F.col("n"))
    found = found.withColumn("seq", F.row_number().over(order)).withColumn("low", low).withColumn("high", high)
    has_before, has_after = F.col("low") < F.col("line"), F.col("high") > F.col("line")
    key = F.when(has_after, F.struct(F.lit("after").alias("kind"), F.col("high").alias("at"))).when(has_before, F.struct(F.lit("before").alias("kind"), (F.col("line") - 1).alias("at")))
    found = found.withColumn("last", F.last(key, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    again = lambda kind, at: F.coalesce((F.col("last.kind") == kind) & (F.col("last.at") == at), F.lit(False)).cast("int")
    first = F.col("low") + again("before", F.col("low"))
    then = F.col("line") + 1 + F.when(has_before, 0).otherwise(again("after", F.col("line") + 1))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    rows = F.concat(
        F.transform(span(first, F.col("line") - 1), lambda x: F.struct(F.lit("before").alias("kind"), x.alias("line"))),
        F.array(F.struct(F.lit("match").alias("kind"), F.col("line").alias("line"))),
        F.transform(span(then, F.col("high")), lambda x: F.struct(F.lit("after").alias("kind"), x.alias("line"))),
    )
    out = found.select("path", "seq", "byte", "match", F.posexplode(rows).alias("i", "x"))
    out = out.select("path", "seq", "i", F.col("x.kind").alias("kind"), F.col("x.line").alias("line"), "byte", "match").join(own, ["path", "line"])
    place = F.row_number().over(Window.partitionBy("path").orderBy("seq", "i")).cast("long")
    is_match = F.col("kind") == "match"
    return out.select("path", place.alias("place"), "kind", "line", F.when(is_match, F.col("byte")).alias("byte"), F.when(is_match, F.col("match")).otherwise(F.col("text")).alias("text"))


def match_counts(files: DataFrame, pattern: str) -> DataFrame:
    """path, n: matches (not lines) of each file, zeros too."""
    n = F.aggregate(F.split("text", "\n", -1), F.lit(0).cast("long"), lambda a, x: a + F.regexp_count(x, F.lit(pattern)).cast("long"))
    return files.select("path", n.alias("n"))


def paths_with(files: DataFrame, pattern: str, inverse: bool = False) -> DataFrame:
    hit = F.exists(F.split("text", "\n", -1), lambda x: x.rlike(pattern))
    return files.where(~hit if inverse else hit).select("path")


def context_lines(files: DataFrame, pattern: str, before: int, after: int) -> DataFrame:
    """path, line, text, is_match: matching lines and those around them, each once; one window over a file's lines."""
    order = Window.partitionBy("path").orderBy("line")
    hit = lines(files).withColumn("is_match", F.col("text").rlike(pattern))
    near = F.max("is_match").over(order.rowsBetween(-after, before))
    return hit.withColumn("near", near).where("near").select("path", "line", "text", "is_match")


def sed_preview(files: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """path, line, old_text, new_text of lines that a rewrite of all matches would change."""
    new = lines(files).where(F.col("text").rlike(pattern)).withColumn("new_text", F.regexp_replace("text", pattern, replacement))
    return new.where("new_text <> text").select("path", "line", F.col("text").alias("old_text"), "new_text")


def sed_records(files: DataFrame, pattern: str, replacement: str, every: bool = True, value: str = ":") -> DataFrame:
    """record_id, path, line, byte, old_text, new_text: a row for each match, or each line's first one, in a line range.

    record_id is ``r:`` with the path's hash, line, byte and the match's number in its line, so it holds between runs. Groups
    are expanded where the match stands, with what follows it in the line in sight.
    """
    low, high = parse_range(value)
    found = placed_matches(files, pattern).where(F.col("line") >= (low or 1))
    found = found if high is None else found.where(F.col("line") <= high)
    found = found if every else found.where("k = 1")
    rest = F.expr("substring(text, cast(at as int))")
    shifted = re.sub(r"\$(\d+)|\\\\.", lambda m: f"${int(m[1]) + 1}" if m[1] else m[0], replacement)
    swapped = F.regexp_replace(rest, f"^({pattern})", shifted)
    new = F.expr("substring(swapped, 1, length(swapped) - length(rest) + length(match))")
    hashes = hash_column(found.select("path").distinct(), "path", "path_hash", 1)
    out = found.withColumn("rest", rest).withColumn("swapped", swapped).withColumn("new_text", new).join(hashes, "path")
    id_ = F.concat_ws(":", F.lit("r"), "path_hash", F.col("line").cast("string"), F.col("byte").cast("string"), F.col("k").cast("string"))
    return out.select(id_.alias("record_id"), "path", "line", "byte", F.col("match").alias("old_text"), "new_text")


def parse_sed(expression: str) -> tuple[str, str, bool, bool]:
    """(pattern, replacement, every match, ignore case) of ``s/pattern/replacement/flags``; ValueError for another form.

    The sign after ``s`` parts the fields and is escaped in them by a backslash; other escapes stay as they are. What follows a third such sign is not read.
    """
    if expression[:1] != "s":
        raise ValueError("only substitutions are known")
    mark = expression[1:2]
    if not mark or mark.isalnum() or mark == "\\" or mark.isspace():
        raise ValueError("the delimiter must be a sign")
    fields, quoted = re.findall(rf"((?:\\.|[^\\{re.escape(mark)}]|\\$)*)({re.escape(mark)}|$)", expression[2:], re.S), re.escape(mark)
    cut = [f for f, _ in fields]
    ends = sum(1 for _, end in fields if end)
    if ends < 2:
        raise ValueError("the form is s<delimiter>pattern<delimiter>replacement<delimiter>flags")
    pattern, replacement, flags = (re.sub(rf"\\({quoted})", r"\1", x) for x in cut[:3])
    if len(set(flags)) < len(flags) or set(flags) - set("gi"):
        raise ValueError("a flag is repeated or unknown")
    if not pattern:
        raise ValueError("the pattern is empty")
    return pattern, replacement, "g" in flags, "i" in flags


def check_modes(count: bool = False, with_matches: bool = False, without_match: bool = False, paths_only: bool = False, null: bool = False, limit: int = 1000) -> None:
    """ValueError unless at most one of count and the three path modes is asked for, null has a path mode, and limit is above 0."""
    paths = with_matches + without_match + paths_only
    if paths > 1 or count and paths:
        raise ValueError("only one output mode is possible")
    if null and not paths:
        raise ValueError("null ends need a mode of paths")
    if limit < 1:
        raise ValueError("the limit must be above 0")


def run_counters(results: DataFrame, limit: int | None = None) -> DataFrame:
    """One row of counters over a row per file: files, matched, changed, replacements, skipped, warnings, errors, truncated.

    ``results`` has class, matches, changed (boolean) and error (null without one). Files that are not text are skipped with
    a warning. truncated tells whether more matches were found than ``limit``.
    """
    is_text = F.col("class") == "text"
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    matches_ = F.coalesce(F.sum(F.when(is_text, F.col("matches"))), F.lit(0))
    return results.agg(
        count(is_text).alias("files"),
        count(is_text & (F.col("matches") > 0)).alias("matched"),
        count(is_text & F.col("changed")).alias("changed"),
        F.coalesce(F.sum(F.when(is_text & F.col("changed"), F.col("matches"))), F.lit(0)).alias("replacements"),
        count(~is_text).alias("skipped"),
        count(~is_text).alias("warnings"),
        count(F.col("error").isNotNull()).alias("errors"),
        (F.lit(False) if limit is None else matches_ > limit).alias("truncated"),
    )


def exit_code(grep: bool, invalid: Column | None = None) -> Column:
    """Of counters: 2 for invalid input, 3 if something failed, 1 if a search found nothing, else 0."""
    out = F.when(F.col("errors") > 0, 3)
    out = out.when(F.col("matched") == 0, 1) if grep else out
    return out.otherwise(0) if invalid is None else F.when(invalid, 2).otherwise(out.otherwise(0))


# fixed values: forms of text records
FORMS = {
    "match": ("match: %s:%d:%d: %s", ["path", "line", "byte", "text"]),
    "before": ("context-before: %s:%d: %s", ["path", "line", "text"]),
    "after": ("context-after: %s:%d: %s", ["path", "line", "text"]),
    "count": ("count: %s: %d", ["path", "n"]),
    "path": ("path-match: %s", ["path"]),
    "no-path": ("path-no-match: %s", ["path"]),
    "preview": ("preview: %s %s:%d:%d %s => %s", ["record_id", "path", "line", "byte", "old_text", "new_text"]),
    "write": ("write: %s %s: replacements=%d bytes=%d->%d", ["record_id", "path", "n", "old_size", "new_size"]),
    "skip": ("skip: %s %s: %s", ["label", "path", "text"]),
    "warning": ("warning: %s %s: %s", ["label", "path", "text"]),
    "error": ("error: %s %s: %s", ["label", "path", "text"]),
    "truncated": ("truncated: output-limit shown=%d remaining=%d", ["shown", "remaining"]),
    "resume": ("resume: --skip %d --limit %d", ["skip", "limit"]),
    "summary": ("summary: files=%d matched=%d changed=%d replacements=%d skipped=%d warnings=%d errors=%d truncated=%s", ["files", "matched", "changed", "replacements", "skipped", "warnings", "errors", "truncated"]),
}


def rendered(rows: DataFrame, kind: str | None = None) -> Column:
    """The line of each record of ``rows`` by its column ``kind``, or of the one given; forms whose columns are not there give null."""
    out = F.lit(None).cast("string")
    for name, (form, columns) in FORMS.items():
        if all(c in rows.columns for c in columns) and kind in (None, name):
            line = F.format_string(form, *(F.col(c) for c in columns))
            out = line if kind else F.when(F.col("kind") == name, line).otherwise(out)
    return out


def page_records(records: DataFrame, order: list[str], skip: int, limit: int) -> DataFrame:
    """place, text: ``limit`` records (column text) after ``skip``, then, if more follow, how many and how to go on.

    A skip beyond the end starts at the end.
    """
    total = records.agg(F.count(F.lit(1)).alias("total"))
    shown = records.orderBy(*order).offset(skip).limit(limit)
    place = F.row_number().over(Window.orderBy(*order)).cast("long")  # at most ``limit`` rows
    shown = shown.select(place.alias("place"), "text")
    left = total.withColumn("start", F.least(F.lit(skip), F.col("total"))).withColumn("remaining", F.col("total") - F.col("start") - limit).where("remaining > 0")
    left = left.withColumn("shown", F.lit(limit)).withColumn("skip", F.col("start") + limit).withColumn("limit", F.lit(limit))
    ends = F.explode(F.array(*(F.struct(F.lit(limit + 1 + k).cast("long").alias("place"), rendered(left, kind).alias("text")) for k, kind in enumerate(("truncated", "resume")))))
    return shown.unionByName(left.select(ends.alias("x")).select("x.place", "x.text"))


def sed_apply(files: DataFrame, pattern: str, replacement: str, first_only: bool = False, line_range: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """path, text, changed: rewritten texts, line by line, with terminators as they were."""
    low, high = line_range

    def rewrite(x: Column, i: Column) -> Column:
        if first_only:
            shifted = re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 1}", replacement)
            new = F.regexp_replace(x, f"^(.*?)(?:{pattern})", f"$1{shifted}")
        else:
            new = F.regexp_replace(x, pattern, replacement)
        inside = F.lit(True) if low is None else i + 1 >= low
        inside = inside if high is None else inside & (i + 1 <= high)
        return F.when(inside, new).otherwise(x)

    def kept(x: Column, i: Column) -> Column:  # a carriage return is part of the terminator
        return F.when(x.endswith("\r"), F.concat(rewrite(F.left(x, F.length(x) - 1), i), F.lit("\r"))).otherwise(rewrite(x, i))

    new = F.array_join(F.transform(F.split("text", "\n", -1), kept), "\n")
    return files.select("path", new.alias("new"), "text").select("path", F.col("new").alias("text"), (F.col("new") != F.col("text")).alias("changed"))


def parse_range(value: str) -> tuple[int | None, int | None]:
    """``N``, ``A:B``, ``A:``, ``:B`` or ``A,B``, from 1, both ends included; ``$`` at the end is the last line. ValueError otherwise."""
    raw = value.strip()
    parts = re.split("[:,]", raw, maxsplit=1)
    if not raw or not re.fullmatch(r"\+?\d+" if len(parts) == 1 else r"(\+?\d+)?", parts[0]) or not re.fullmatch(r"(\+?\d+|\$)?", parts[-1]):
        raise ValueError(f"bad line range {value!r}")
    low = int(parts[0]) if parts[0] else 1
    high = low if len(parts) == 1 else None if parts[1] in ("", "$") else int(parts[1])
    if low < 1 or high is not None and high < max(1, low):
        raise ValueError(f"bad line range {value!r}")
    return low, high


def read_lines(files: DataFrame, value: str) -> DataFrame:
    """path, line, text of the lines of a range (:func:`parse_range`)."""
    low, high = parse_range(value)
    out = lines(files)
    out = out if low is None else out.where(F.col("line") >= low)
    return out if high is None else out.where(F.col("line") <= high)


def page(rows: DataFrame, order: list[str], skip: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(limit)


def escape_replacement(value: str, groups: int) -> str:
    """A replacement whose ``$n`` all exist; ``$$`` is a dollar sign. ValueError for an unknown group."""
    out, at = [], 0
    for m in re.finditer(r"\$\$|\$(\d+)|\$\{(\w+)\}", value):
        out.append(value[at : m.start()])
        at = m.end()
        if m[0] == "$$":
            out.append("\\$")
        elif (m[1] or m[2]).isdigit() and int(m[1] or m[2]) > groups:
            raise ValueError(f"group {m[1] or m[2]} does not exist")
        else:
            out.append(m[0])
    return "".join([*out, value[at:]])
