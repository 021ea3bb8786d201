"""Documents by a name that is a file's path or, where no file has it, a stored resource's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillmesh.functions.text import parse_range
from quillmesh.operators.catalog import find_resources

#: Resources that a name may match before it is given up as ambiguous.
MATCHES = 20


def stored_document(raw: Column, body: Column) -> Column:
    """A stored version as it was read: its front matter between dashes, without trailing line feeds, then its body."""
    front = F.concat(F.lit("---\n"), F.regexp_replace(raw, "\n+$", ""), F.lit("\n---\n"), F.coalesce(body, F.lit("")))
    return F.when(raw.isNotNull(), front).otherwise(F.coalesce(body, F.lit("")))


def read_document(target: str, files: DataFrame, resources: DataFrame, versions: DataFrame) -> DataFrame:
    """target, found, text, candidates: one row. ``found`` is file, resource, ambiguous or none; only the first two have a text.

    ``files`` (path, text) come first. Else ``resources`` (id, uri, title, external_id) that the name fits: one alone, or of
    several that whose uri it is; else ``candidates`` lists them. ``versions`` has id, raw and body of current versions. A
    name of white space is none.
    """
    spark = files.sparkSession
    asked = spark.createDataFrame([(target,)], "target string")
    if not target.strip():
        return asked.select("target", F.lit("none").alias("found"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("candidates"))
    # a path is one file's, and a lookup gives MATCHES rows at most: both sides of the joins below are a row
    real = files.where(F.col("path") == target).agg(F.max(F.struct(F.lit(True).alias("there"), "text")).alias("real"))
    fits = find_resources(resources, target, limit=MATCHES)
    own = F.sum((F.col("uri") == target).cast("int"))
    few = fits.agg(F.count(F.lit(1)).alias("n"), own.alias("exact"), F.min_by("id", F.struct(F.col("uri") != target, "uri")).alias("id"), F.array_sort(F.collect_list("uri")).alias("uris"))
    chosen = few.withColumn("id", F.when((F.col("n") == 1) | (F.col("exact") > 0), F.col("id")))
    text = versions.select(F.col("id").alias("v"), stored_document(F.col("raw"), F.col("body")).alias("stored"))
    row = asked.join(F.broadcast(real)).join(F.broadcast(chosen)).join(text, F.col("id") == F.col("v"), "left")
    there = F.col("real.there").isNotNull()
    found = F.when(there, "file").when(F.col("v").isNotNull(), "resource").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return row.select(
        "target", found.alias("found"), F.when(there, F.coalesce("real.text", F.lit(""))).otherwise(F.col("stored")).alias("text"), F.when(~there & F.col("v").isNull() & (F.col("n") > 1), F.col("uris")).alias("candidates")
    )


def read_virtual(target: str, value: str | None, files: DataFrame, resources: DataFrame, versions: DataFrame) -> DataFrame:
    """target, line, text: the lines of a range (all for None) of the document of that name, with their terminators."""
    low, high = parse_range(value) if value else (None, None)
    doc = read_document(target, files, resources, versions).where("text IS NOT NULL")
    # a line keeps its line feed; what follows the last one is a line only if there is something
    cut = doc.select("target", F.posexplode(F.regexp_extract_all("text", F.lit("[^\\n]*\\n|[^\\n]+$"), F.lit(0))).alias("i", "text"))
    out = cut.select("target", (F.col("i") + 1).cast("long").alias("line"), "text")
    out = out if low is None else out.where(F.col("line") >= low)
    return out if high is None else out.where(F.col("line") <= high)
