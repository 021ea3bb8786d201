"""Structured documents: front-matter bundles, usage files, API descriptions, spec manifests; bundle export."""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillmesh.functions import markdown
from quillmesh.runtime import ship

METHODS = ("get", "post", "put", "patch", "delete", "options", "head", "trace")


@dataclass(frozen=True)
class Limits:
    files: int = 10_000
    file_bytes: int = 4 << 20
    front_bytes: int = 256 << 10


CONCEPT = "kind string, title string, description string, tags array<string>, status string, stale_after string, body string, raw_frontmatter string, diagnostics array<struct<level string, code string>>, error string"


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None if value is None or isinstance(value, (dict, list)) else str(value)


def split_front_matter(text: str) -> tuple[str, str] | None:
    """(front matter, body) between lines of ``---``, or None."""
    m = re.match(r"---\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|\Z)", text, re.S | re.M)
    return (m[1], text[m.end() :]) if m else None


#: Where libyaml and the library's own parser read differently, or may: tags, explicit keys, directives, tabs, byte order marks, odd line ends, long keys.
_UNLIKE = re.compile("(?:\\A|\n)%|[!?\t\r\x80-\x9f\u2028\u2029\ufeff]|[^\n]{1000}")


@lru_cache
def _loader():
    """(module, loader, fast loader or None, errors) of YAML in which dates stay as they are written; the library is needed only here.

    The fast loader takes events from libyaml, where it is there, but composes and constructs as the other does, since
    libyaml's own composer has no bound on nesting.
    """
    import yaml

    resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    class Strings(yaml.SafeLoader):
        yaml_implicit_resolvers = resolvers

    fast = None
    if yaml.__with_libyaml__:
        from yaml.composer import Composer
        from yaml.constructor import SafeConstructor
        from yaml.cyaml import CParser
        from yaml.resolver import Resolver

        class Events(Composer, CParser, SafeConstructor, Resolver):
            yaml_implicit_resolvers = resolvers

            def __init__(self, stream):
                CParser.__init__(self, stream)
                Composer.__init__(self)
                SafeConstructor.__init__(self)
                Resolver.__init__(self)

        fast = Events

    return yaml, Strings, fast, (yaml.YAMLError, RecursionError)


def load_yaml(text: str) -> object:
    """The first document of ``text``; ValueError if it can't be parsed."""
    yaml, loader, fast, errors = _loader()
    if fast and not _UNLIKE.search(text):
        with contextlib.suppress(*errors):  # whether it is an error, the other decides
            return yaml.load(text, fast)
    try:
        return yaml.load(text, loader)
    except errors as e:
        raise ValueError("invalid YAML") from e


def parse_concept(path: str, text: str | None, limits: Limits = Limits(), front: bool = False) -> dict:
    """One document as a row of CONCEPT; ``error`` says why it can't be one, and all else is then null. ``front``: with ``front_json``, its front matter as JSON."""
    row: dict = dict.fromkeys(("kind", "title", "description", "tags", "status", "stale_after", "body", "raw_frontmatter", "diagnostics", "error") + ("front_json",) * front)
    text = text or ""
    if path.startswith("/") or "\0" in path or ".." in path.split("/"):
        return row | {"error": "path escapes the bundle"}
    if len(text.encode()) > limits.file_bytes:
        return row | {"error": "document exceeds the byte limit"}
    cut = split_front_matter(text)
    if cut is None:
        return row | {"error": "no front matter"}
    raw, body = cut
    if len(raw.encode()) > limits.front_bytes:
        return row | {"error": "front matter exceeds the byte limit"}
    try:
        meta = load_yaml(raw)
    except ValueError:
        return row | {"error": "invalid front matter"}
    if not isinstance(meta, dict):
        return row | {"error": "front matter is not a mapping"}
    if not _text(meta.get("type")):
        return row | {"error": "type is missing"}
    headings = [h["text"] for h in markdown._outline(body) or [] if h["level"] == 1]
    tags = meta.get("tags")
    notes = [{"level": "info", "code": "okf-0.1-timestamp"}] * ("timestamp" in meta)
    notes += [{"level": "info", "code": "okf-0.1-citations"}] * any(x.strip() == "# Citations" for x in body.split("\n"))
    return row | {
        "kind": _text(meta["type"]), "title": _text(meta.get("title")) or next(iter(headings), path), "description": _text(meta.get("description")),
        "tags": [t for t in map(_text, tags if isinstance(tags, list) else []) if t is not None], "status": _text(meta.get("status")) or "stable",
        "stale_after": _text(meta.get("stale_after")), "body": body, "raw_frontmatter": raw, "diagnostics": notes,
    } | ({"front_json": _json(meta)} if front else {})


def _json(value: object) -> str | None:
    try:
        return json.dumps(value, default=str, ensure_ascii=False)
    except (ValueError, TypeError):  # keys that are no scalars
        return None


def concepts(docs: DataFrame, limits: Limits = Limits(), front: bool = False) -> DataFrame:
    """path and the columns of CONCEPT for each (path, text); documents that break a rule keep a row, with ``error``.

    ``front``: with ``front_json``, so that :func:`with_front` need not read front matter again.
    """
    ship(docs.sparkSession)
    schema = CONCEPT + ", front_json string" * front

    @F.pandas_udf(schema)
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in re.split(r", (?![^<]*>)", schema)]
        for paths, texts in batches:
            yield pd.DataFrame([parse_concept(p, t, limits, front) for p, t in zip(paths, texts, strict=True)], columns=names)

    return docs.select("path", parse("path", "text").alias("c")).select("path", "c.*")


def with_front(parsed: DataFrame) -> DataFrame:
    """``parsed`` with ``front``, its front matter as a VARIANT; null where there is none or it can't be read."""
    if "front_json" in parsed.columns:
        return parsed.withColumn("front", F.try_parse_json("front_json")).drop("front_json")
    ship(parsed.sparkSession)

    @F.pandas_udf("string")
    def as_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(raw: str | None) -> str | None:
            try:
                return None if raw is None else _json(load_yaml(raw))
            except ValueError:
                return None

        for batch in batches:
            yield batch.map(one)

    return parsed.withColumn("front", F.try_parse_json(as_json("raw_frontmatter")))


def _scalar(value: Column) -> Column:
    """A variant's text if it is a string, number or truth value."""
    nested = F.schema_of_variant(value).rlike("^(OBJECT|ARRAY|VOID)")
    return F.when(~nested, F.try_variant_get(value, "$", "string"))


def _field(value: Column, name: str) -> Column:
    return _scalar(F.try_variant_get(value, f"$.{name}", "variant"))


def front_sources(fronts: DataFrame) -> DataFrame:
    """path, ordinal, id, resource, title: the sources that front matter (:func:`with_front`) lists, those without a resource left out,
    then, of documents with a heading ``# Citations``, the external references of the lists under it."""
    # sections start at a heading, or at a line that is the mark alone; what follows the mark counts
    mark = "[\\s&&[^\n]]*# Citations[\\s&&[^\n]]*(?:\n|\\z)"
    sections = F.filter(F.split("body", f"(?U)(?:\\A|\n)(?=# |{mark})", -1), lambda x: x.rlike(f"(?U)\\A{mark}"))
    lines = F.transform(F.flatten(F.transform(sections, lambda x: F.split(x, "\r?\n", -1))), lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", ""))
    items = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("- "))), lambda x: F.substr(x, F.lit(3)))
    cited = F.when(F.exists("diagnostics", lambda d: d["code"] == "okf-0.1-citations"), items)
    listed = F.try_variant_get("front", "$.sources", "array<variant>")
    # both lists in one array, so that a document is read once
    both = F.concat(
        F.coalesce(F.transform(listed, lambda s, k: F.struct(k.alias("ordinal"), s.alias("s"), F.lit(None).cast("string").alias("cited"))), F.array()),
        F.coalesce(F.transform(cited, lambda x, k: F.struct((k + (1 << 20)).alias("ordinal"), F.lit(None).cast("variant").alias("s"), x.alias("cited"))), F.array()),
    )
    rows = fronts.select("path", F.inline(both))
    own = [F.when(F.col("cited").isNull(), _field(F.col("s"), c)).alias(c) for c in ("id", "resource", "title")]
    rows = rows.select("path", "ordinal", "cited", *own).where(F.when(F.col("cited").isNull(), F.col("resource").isNotNull()).otherwise(markdown.is_external(F.col("cited"))))
    return rows.select("path", "ordinal", "id", F.coalesce("cited", "resource").alias("resource"), "title")


def front_verified(fronts: DataFrame) -> DataFrame:
    """path, kind, actor, at: who verified a document, by kind; ``at`` is shared by all. An actor that is no text is shown as JSON."""
    marks = F.try_variant_get("front", "$.verified", "map<string, variant>")
    rows = fronts.select("path", _field(F.try_variant_get("front", "$.verified", "variant"), "at").alias("at"), F.explode(marks).alias("kind", "value")).where("kind <> 'at'")
    return rows.select("path", "kind", F.coalesce(_scalar(F.col("value")), F.to_json("value"), F.lit("null")).alias("actor"), "at")


def front_generated(fronts: DataFrame) -> DataFrame:
    """path, by, at: what generated a document and when; ``timestamp`` is what older documents have for ``at``."""
    made = F.try_variant_get("front", "$.generated", "variant")
    return fronts.select("path", _field(made, "by").alias("by"), F.coalesce(_field(made, "at"), _field(F.col("front"), "timestamp")).alias("at"))


def bundle(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The concepts of a bundle; ValueError for too many files. Ids are paths without ``.md``."""
    found = docs.where(F.col("path").endswith(".md"))
    if found.limit(limits.files + 1).count() > limits.files:
        raise ValueError(f"a bundle has at most {limits.files} files")
    return concepts(found, limits).withColumn("id", F.regexp_replace("path", "\\.md$", ""))


def concept_links(parsed: DataFrame) -> DataFrame:
    """path, line, label, target, external, resolved (the path of a document of the bundle, else null) of all links in bodies."""
    found = markdown.inline_links(parsed.where("error IS NULL").select("path", F.col("body").alias("text")))
    bare = F.regexp_replace("target", "[#?].*$", "")
    parent = F.regexp_replace("path", "[^/]*$", "")
    joined = F.when(bare.startswith("/"), F.substring(bare, 2, 1 << 20)).otherwise(F.concat(parent, bare))
    keyed = found.withColumn("key", F.when(~F.col("external"), normal_path(joined)))
    names = parsed.where("error IS NULL").select(F.col("path").alias("resolved"))
    return keyed.join(names, keyed.key == names.resolved, "left").select("path", "line", "n", "label", "target", "external", "resolved")


def normal_path(c: Column) -> Column:
    """Without ``.`` and empty parts, each ``..`` taking off a part; null where that leads above the root."""
    parts = F.filter(F.split(c, "/"), lambda x: ~x.isin("", "."))
    start = F.array().cast("array<string>")
    step = lambda a, x: F.when(a.isNull() | ((x == "..") & (F.size(a) == 0)), F.lit(None)).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    return F.array_join(F.aggregate(parts, start, step), "/")


def document(front: Column, body: Column) -> Column:
    """A document of front matter and body."""
    return F.concat(F.lit("---\n"), F.regexp_replace(front, "\n$", ""), F.lit("\n---\n"), body)


def bundle_index(parsed: DataFrame) -> DataFrame:
    """kind, entries: (id, title) of each kind's concepts, by id."""
    return parsed.where("error IS NULL").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("entries"))


def export_bundle(parsed: DataFrame, target: str) -> None:
    """Write (path, document) rows as Parquet; ValueError for a path outside the bundle."""
    out = parsed.where("error IS NULL").select("path", document(F.col("raw_frontmatter"), F.col("body")).alias("document"))
    if out.where(normal_path(F.col("path")).isNull() | F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")).limit(1).count():
        raise ValueError("a path leads outside the bundle")
    out.write.mode("overwrite").parquet(target)


def parse_usage(text: str) -> dict[str, list[str]]:
    """Paths by id, both in order: ``id``, ``id: a, b``, or ``id:`` and indented ``- path`` lines. ValueError names the line."""
    found: dict[str, dict[str, None]] = {}
    owner: str | None = None

    def token(value: str, number: int) -> str:
        if not value or re.search(r"\s", value):
            raise ValueError(f"line {number}: {value!r} is no id or path")
        return value

    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if line.startswith("#"):
            raise ValueError(f"line {number}: comments are not supported")
        if not line:
            owner = None
        elif raw[0] in " \t":
            if owner is None or not line.startswith("- "):
                raise ValueError(f"line {number}: a path needs an id above it and a dash before it")
            found[owner][token(line[2:].strip(), number)] = None
        else:
            name, _, rest = line.partition(":")
            paths = found.setdefault(token(name.strip(), number), {})
            paths.update(dict.fromkeys(p for p in map(str.strip, rest.split(",")) if p))
            owner = name.strip() if line.endswith(":") else None
    return {k: list(v) for k, v in found.items()}


def render_usage(usage: dict[str, list[str]]) -> str:
    return "".join(f"{k}:\n" + "".join(f"  - {p}\n" for p in v) if v else f"{k}\n" for k, v in usage.items())


def pattern_usages(files: DataFrame) -> DataFrame:
    """path, n, id, paths, error: the entries of usage files (path, text); a file with a mistake gives one row with ``error``."""
    ship(files.sparkSession)

    @F.pandas_udf("array<struct<id string, paths array<string>, error string>>")
    def parse(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            try:
                return [{"id": k, "paths": v, "error": None} for k, v in parse_usage(text or "").items()]
            except ValueError as e:
                return [{"id": None, "paths": None, "error": str(e)}]

        return pd.Series([one(t) for t in texts])

    return files.select("path", F.posexplode(parse("text")).alias("n", "u")).select("path", "n", "u.*")


def as_json(files: DataFrame) -> DataFrame:
    """path, value: the JSON of JSON and YAML files (path, text), by extension; null where a file can't be parsed."""
    ship(files.sparkSession)

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(load_yaml(text), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    is_yaml = F.col("path").rlike("(?i)\\.ya?ml$")
    plain = files.where(~is_yaml).select("path", F.when(F.try_parse_json("text").isNotNull(), F.col("text")).alias("value"))
    return plain.unionByName(files.where(is_yaml).select("path", convert("text").alias("value")))


def endpoints(files: DataFrame) -> DataFrame:
    """path (of the file), method, route, operation_id, summary, description of API descriptions given as ``value`` (JSON)."""
    routes = files.select("path", F.explode(F.from_json(F.get_json_object("value", "$.paths"), "map<string,map<string,string>>")).alias("route", "methods"))
    ops = routes.select("path", "route", F.explode("methods").alias("method", "op")).where(F.col("method").isin(*METHODS))
    get = lambda k: F.get_json_object("op", f"$.{k}")
    return ops.select("path", F.upper("method").alias("method"), "route", F.coalesce(get("operationId"), get("operation_id")).alias("operation_id"), get("summary").alias("summary"), get("description").alias("description"))


def spec_bodies(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path (of the manifest), file, body: the files that items and the tasks of phases name, each once; body null where there is no such file."""
    entry = "array<struct<spec_file:string,file_path:string>>"
    items = F.from_json(F.get_json_object("value", "$.items"), entry)
    tasks = F.flatten(F.transform(F.from_json(F.get_json_object("value", "$.phases"), f"array<struct<tasks:{entry}>>"), lambda p: F.coalesce(p["tasks"], F.array().cast(entry.replace(":", ": ")))))
    none = F.array().cast(entry)
    all_ = F.concat(F.coalesce(items, none), F.coalesce(tasks, none))
    named = manifest.select("path", F.explode(F.array_distinct(F.transform(all_, lambda x: F.coalesce(x["spec_file"], x["file_path"])))).alias("file")).where("file IS NOT NULL")
    key = normal_path(F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("file")))
    bodies = files.select(F.col("path").alias("__p"), F.col("text").alias("body"))
    return named.withColumn("__k", key).join(bodies, F.col("__k") == F.col("__p"), "left").select("path", "file", "body")
