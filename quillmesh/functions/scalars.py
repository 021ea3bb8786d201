"""Scalar text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sanitize_name(c: Column) -> Column:
    """Lower case; other characters than a-z, 0-9, ``_`` and ``-`` become one dash; at most 100, without dashes at the ends."""
    return F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_-]+", "-"), "^-+|-+$", ""), F.lit(100)), "-+$", "")


def normalize_ident(c: Column) -> Column:
    """Host and path of a remote: no scheme, user, ``.git`` or final slash; ``host:path`` has a slash."""
    bare = F.regexp_replace(F.regexp_replace(c, "^[a-z+]+://", ""), "^[^@/]+@", "")
    return F.regexp_replace(F.regexp_replace(bare, "^([^/:]+):([^0-9/])", "$1/$2"), "(\\.git)?/*$", "")


def short_ident(c: Column) -> Column:
    return sanitize_name(F.regexp_replace(F.element_at(F.split(c, "/"), -1), "\\.git$", ""))


def format_size(c: Column) -> Column:
    k = 1024.0
    return (
        F.when(c < k, F.concat(c.cast("string"), F.lit("B")))
        .when(c < k**2, F.format_string("%.1fK", F.bround(c / k, 1)))
        .when(c < k**3, F.format_string("%.1fM", F.bround(c / k**2, 1)))
        .otherwise(F.format_string("%.1fG", F.bround(c / k**3, 1)))
    )


def compact(c: Column, n: int) -> Column:
    """One space for each run of white space; longer than ``n`` characters: n - 1 and an ellipsis."""
    one = F.trim(F.regexp_replace(c, "\\s+", " "))
    return F.when(F.length(one) <= n, one).otherwise(F.concat(F.left(one, F.lit(n - 1)), F.lit("…")))


def age(c: Column, now: Column) -> Column:
    """Age of epoch seconds in the largest whole unit."""
    s = F.greatest(F.lit(0), now - c)
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return F.when(s < 60, unit(1, "s ago")).when(s < 3600, unit(60, "m ago")).when(s < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def prompt_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda x: F.octet_length(x) >= 2)


def links(c: Column) -> Column:
    """(label, target) of inline links, in order."""
    return F.transform(
        F.regexp_extract_all(c, F.lit("\\[[^\\]]*\\]\\([^)\\s]+\\)"), F.lit(0)),
        lambda m: F.struct(F.regexp_extract(m, "^\\[([^\\]]*)\\]", 1).alias("label"), F.regexp_extract(m, "\\(([^)\\s]+)\\)$", 1).alias("target")),
    )


def is_external(target: Column) -> Column:
    return target.rlike("^(https?|mailto|file):|://")


def rfc3339(c: Column) -> Column:
    """Epoch milliseconds as ``2024-01-31T08:05:00Z``."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_millis(F.floor(c / 1000) * 1000), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def event_millis(c: Column) -> Column:
    """Epoch milliseconds of a number or of an RFC 3339 time; null for another text."""
    whole = F.try_to_number(c, F.lit("999999999999999999")).cast("long")
    form = c.rlike("^\\d{4}-\\d\\d-\\d\\d[Tt ]\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?([Zz]|[+-]\\d\\d:\\d\\d)$")
    return F.coalesce(F.when(c.rlike("^\\d+$"), whole), F.when(form, F.unix_millis(F.try_to_timestamp(F.upper(c)))))


def csv_values(c: Column) -> Column:
    """The parts of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def first_of(json: Column, keys: list[str]) -> Column:
    """The value of the first of ``keys`` that a JSON object has as text."""
    return F.coalesce(*(F.get_json_object(json, f"$.{k}") for k in keys))


# fixed values: words that hint at an API
API_WORDS = ["api", "apis", "endpoint", "endpoints", "route", "routes", "openapi", "swagger", "graphql", "rest"]


def is_api_query(c: Column) -> Column:
    """Is one of the ASCII words of a query about APIs?"""
    folded = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.arrays_overlap(F.split(folded, "[^a-z0-9]"), F.array(*map(F.lit, API_WORDS)))


def appended(a: Column, b: Column) -> Column:
    """The values of ``a``, then those of ``b`` that are not there, each once, in order."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def front_matter(c: Column) -> Column:
    """A map of text as front matter: a line for each key, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def envelope(kind: Column, **fields: Column) -> Column:
    """An event as JSON: its kind and the fields that are not null."""
    return F.to_json(F.struct(kind.alias("event"), *(c.alias(k) for k, c in fields.items())))
