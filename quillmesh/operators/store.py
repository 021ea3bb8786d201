"""Mutations as functions from old and new rows to the table's next state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; ``keep_old`` columns keep a value that was there."""
    marked_new = new.withColumn("__n", F.lit(True))
    joined = old.alias("o").join(marked_new.alias("n"), keys, "full_outer")
    columns = []
    for c in old.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c in keep_old:
            columns.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            columns.append(F.when(F.col("n.__n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*columns)


def merge_metadata(old: DataFrame, new: DataFrame, key: str, optional: list[str]) -> DataFrame:
    """As :func:`upsert`, but a null in an ``optional`` column of ``new`` leaves the old value."""
    marked = new.withColumn("__n", F.lit(True))
    joined = old.alias("o").join(marked.alias("n"), key, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in optional else F.when(F.col("n.__n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*(F.col(c) if c == key else pick(c).alias(c) for c in old.columns))


def scan_diff(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """path, action: insert, update, skip (same size and mtime) or delete."""
    s, n = stored.select("path", F.col("size").alias("s_size"), F.col("mtime").alias("s_mtime")), scanned.select("path", F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime"))
    both = s.join(n, "path", "full_outer")
    action = F.when(F.col("s_size").isNull(), "insert").when(F.col("n_size").isNull(), "delete").when((F.col("s_size") == F.col("n_size")) & (F.col("s_mtime") == F.col("n_mtime")), "skip").otherwise("update")
    return both.select("path", action.alias("action"))


def put_version(versions: DataFrame, new: DataFrame) -> DataFrame:
    """``versions`` (resource, hash, version) with each (resource, hash) of ``new`` that isn't there as the resource's next version."""
    fresh = new.select("resource", "hash").distinct().join(versions, ["resource", "hash"], "left_anti")
    last = versions.groupBy("resource").agg(F.max("version").alias("__last"))
    place = F.row_number().over(Window.partitionBy("resource").orderBy("hash"))
    fresh = fresh.join(last, "resource", "left").withColumn("version", (F.coalesce("__last", F.lit(0)) + place).cast(versions.schema["version"].dataType))
    return versions.unionByName(fresh.select(*versions.columns))


def replace_owned(rows: DataFrame, new: DataFrame, owner: list[str]) -> DataFrame:
    """All rows of the owners that ``new`` has are replaced by those of ``new``."""
    return rows.join(new.select(*owner).distinct(), owner, "left_anti").select(*rows.columns).unionByName(new)


def prune_to_retained(rows: DataFrame, retained: DataFrame, scope: dict[str, str], key: str) -> DataFrame:
    """Drop rows of the scope whose key is not retained; others stay."""
    inside = F.lit(True)
    for c, v in scope.items():
        inside = inside & (F.col(c) == v)
    kept = rows.where(inside).join(retained, key, "left_semi")
    return rows.where(~F.coalesce(inside, F.lit(False))).unionByName(kept)


def prune_to_recent(rows: DataFrame, origin: list[str], keep: int, at: str, key: str) -> DataFrame:
    order = Window.partitionBy(*origin).orderBy(F.desc(at), F.desc(key))
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= keep).drop("__r")


def insert_or_ignore(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return rows.unionByName(new.dropDuplicates(keys).join(rows, keys, "left_anti").select(*rows.columns))


def access_counts(events: DataFrame) -> DataFrame:
    """resource, tool, access_count, first_access, last_access."""
    return events.groupBy("resource", "tool").agg(F.count(F.lit(1)).alias("access_count"), F.min("seen").alias("first_access"), F.max("seen").alias("last_access"))


def publish_plan(projections: DataFrame, existing: DataFrame) -> DataFrame:
    """source_ref, action: create, reuse (same version) or update."""
    e = existing.select("source_ref", F.col("version").alias("e_version"))
    action = F.when(F.col("e_version").isNull(), "create").when(F.col("e_version") == F.col("version"), "reuse").otherwise("update")
    return projections.join(e, "source_ref", "left").select("source_ref", action.alias("action"))


def sync_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """name, action: push what is missing or differs remotely, pull what is only there."""
    l, r = local.select("name", F.col("checksum").alias("l")), remote.select("name", F.col("checksum").alias("r"))
    action = F.when(F.col("l").isNull(), "pull").when(F.col("r").isNull(), "push").when(F.col("l") != F.col("r"), "push").otherwise("none")
    return l.join(r, "name", "full_outer").select("name", action.alias("action"))


def sync_names(plan: DataFrame, skills: DataFrame) -> DataFrame:
    """A sync plan of commands or agents (name, action) without names that a skill (name) has."""
    return plan.join(skills.select("name"), "name", "left_anti")


def current_versions(versions: DataFrame) -> DataFrame:
    """The row of the greatest version of each resource."""
    best = versions.groupBy("resource").agg(F.max("version").alias("version"))
    return versions.join(best, ["resource", "version"], "left_semi")


def merge_access(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Stored counters (resource, tool, access_count, first_access, last_access) with a batch of events added; the first access stays."""
    both = stored.unionByName(access_counts(events).select(*stored.columns))
    return both.groupBy("resource", "tool").agg(F.sum("access_count").alias("access_count"), F.min("first_access").alias("first_access"), F.max("last_access").alias("last_access"))


def put_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """aliases (alias, uri, reason, at): the last writer of an alias wins."""
    both = aliases.unionByName(new.select(*aliases.columns))
    return both.groupBy("alias").agg(F.max_by(F.struct(*[c for c in aliases.columns if c != "alias"]), F.struct("at", "uri")).alias("x")).select("alias", "x.*").select(*aliases.columns)


def mark_producers(states: DataFrame, done: DataFrame) -> DataFrame:
    """Checkpoints (path, producer, hash) with those of ``done`` put in."""
    return upsert(states, done.dropDuplicates(["path", "producer"]), ["path", "producer"])


def producer_current(inputs: DataFrame, states: DataFrame, producer: str) -> DataFrame:
    """path, current: is the hash that ``producer`` last saw of a file (path, hash) the one it has now?"""
    seen = states.where(F.col("producer") == producer).select("path", F.col("hash").alias("__seen"))
    return inputs.join(seen, "path", "left").select("path", F.coalesce(F.col("hash") == F.col("__seen"), F.lit(False)).alias("current"))


def mark_seen(files: DataFrame, seen: DataFrame, scan: int) -> tuple[DataFrame, DataFrame]:
    """(files with scan set where ``seen`` (path) has them, paths that aren't known)."""
    marks = seen.select("path").distinct().withColumn("__s", F.lit(scan))
    marked = files.join(marks, "path", "left").withColumn("scan", F.coalesce("__s", "scan")).drop("__s")
    return marked.select(*files.columns), seen.select("path").distinct().join(files, "path", "left_anti")


def complete_scan(files: DataFrame, scan: int) -> DataFrame:
    """The files that a scan has seen."""
    return files.where(F.col("scan").eqNullSafe(F.lit(scan)))


def replace_snapshot(tables: dict[str, DataFrame], new: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Each table without its rows of ``paths`` (path), and with the new ones: all a file gave is replaced at once."""
    gone = paths.select("path").distinct()
    return {k: t.join(gone, "path", "left_anti").select(*t.columns).unionByName(new[k].select(*t.columns)) for k, t in tables.items()}


# fixed values: what resources and edges may have
AUTHORITIES = ("repository", "gateway", "derived", "user")
STATUSES = ("draft", "stable", "deprecated")
CONFIDENCES = ("extracted", "resolved", "ambiguous", "inferred")


def invalid_resources(resources: DataFrame) -> DataFrame:
    """uri, problem: the first rule that a resource breaks; no row for valid ones."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    problem = F.when(blank("uri"), "uri is empty").when(blank("kind"), "kind is empty").when(blank("namespace"), "namespace is empty")
    problem = problem.when(~F.coalesce(F.col("authority").isin(*AUTHORITIES), F.lit(False)), "unknown authority").when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown status")
    return resources.withColumn("problem", problem).where("problem IS NOT NULL").select("uri", "problem")


def invalid_edges(edges: DataFrame) -> DataFrame:
    """edge, problem: edges without a relation, with an unknown confidence, or with neither a target nor a reference."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    problem = F.when(blank("relation"), "relation is empty").when(~F.col("confidence").isin(*CONFIDENCES), "unknown confidence").when(F.col("dst").isNull() & blank("dst_ref"), "no target")
    return edges.withColumn("problem", problem).where("problem IS NOT NULL").select("edge", "problem")


def origin_ids(resources: DataFrame, namespace: str, origin: str) -> DataFrame:
    """external_id of the resources of one origin, in order."""
    return resources.where((F.col("namespace") == namespace) & (F.col("origin") == origin)).select("external_id").orderBy("external_id")


def origin_documents(resources: DataFrame, versions: DataFrame, namespace: str, origin: str) -> DataFrame:
    """external_id, document of one origin: the current version's front matter and body, one text."""
    kept = resources.where((F.col("namespace") == namespace) & (F.col("origin") == origin)).select("external_id", F.col("id").alias("resource"))
    text = F.concat(F.lit("---\n"), "front", F.lit("\n---\n"), "body")
    return current_versions(versions).join(kept, "resource").select("external_id", text.alias("document")).orderBy("external_id")


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, fingerprint: a hash of nodes (id, hash) and edges (src, dst, relation) that does not depend on their order.

    Each row's hash goes into sums of its parts, so nothing is gathered: sums of 60-bit pieces and the number of rows are hashed.
    """
    lines = nodes.select(F.to_json(F.struct(F.lit("n").alias("t"), "id", "hash")).alias("x")).unionByName(edges.select(F.to_json(F.struct(F.lit("e").alias("t"), "src", "dst", "relation")).alias("x")))
    digest = F.sha2("x", 256)
    pieces = [F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return lines.distinct().agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *(F.coalesce(p, F.lit(0)).cast("string") for p in pieces)), 256).alias("fingerprint"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolution_stats(edges: DataFrame) -> DataFrame:
    """resolved, unresolved, ambiguous numbers of resolved edges (confidence)."""
    n = lambda c: F.coalesce(F.sum((F.col("confidence") == c).cast("long")), F.lit(0))
    return edges.agg(n("resolved").alias("resolved"), n("extracted").alias("unresolved"), n("ambiguous").alias("ambiguous"))


def kv_set(cache: DataFrame, new: DataFrame, now: int, ttl: int | None) -> DataFrame:
    """cache (key, value, expires_at) with ``new`` (key, value) put in, to expire after ``ttl`` seconds, or never."""
    expires = F.lit(None if ttl is None else now + ttl).cast(cache.schema["expires_at"].dataType)
    return upsert(cache, new.dropDuplicates(["key"]).withColumn("expires_at", expires).select(*cache.columns), ["key"])


def kv_live(cache: DataFrame, now: int) -> DataFrame:
    """The entries that have not expired; a cache that is cleaned holds these alone."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def kv_get(cache: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    return kv_live(cache, now).join(keys.select("key").distinct(), "key", "left_semi").select("key", "value")


def kv_remove(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key").distinct(), "key", "left_anti").select(*cache.columns)


def import_legacy(files: DataFrame, symbols: DataFrame, old_files: DataFrame, old_symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, symbols) with the rows of older databases whose paths are not there yet; symbols without a file's row make one."""
    known = old_files.select("path", "size").unionByName(old_symbols.select("path", F.lit(None).cast(old_files.schema["size"].dataType).alias("size")))
    known = known.groupBy("path").agg(F.max("size").alias("size")).join(files, "path", "left_anti")
    fresh = old_symbols.join(files, "path", "left_anti").select(*symbols.columns)
    return files.unionByName(known.select(*files.columns)), symbols.unionByName(fresh)


def outcomes(names: DataFrame, candidates: DataFrame, narrow: bool = True, exact_wins: bool = False) -> DataFrame:
    """name, outcome (found, ambiguous, not-found), uri, n: how each of ``names`` is resolved by ``candidates`` (name, uri, authority).

    ``narrow`` keeps the candidates of the best authority alone; ``exact_wins`` takes a uri equal to the name whatever else there is.
    """
    rank = F.when(F.col("authority") == "repository", 0).when(F.col("authority") == "gateway", 1).otherwise(2) if narrow else F.lit(0)
    by_rank = candidates.withColumn("r", rank).groupBy("name", "r").agg(F.count(F.lit(1)).alias("n"), F.min("uri").alias("uri"), F.max((F.col("uri") == F.col("name")).cast("int")).alias("same"))
    best = by_rank.groupBy("name").agg(F.min_by(F.struct("n", "uri"), "r").alias("b"), F.max("same").alias("same"))
    joined = names.select("name").distinct().join(best, "name", "left")
    exact = (F.col("same") == 1) if exact_wins else F.lit(False)
    outcome = F.when(F.col("b").isNull(), "not-found").when(exact | (F.col("b.n") == 1), "found").otherwise("ambiguous")
    uri = F.when(exact, F.col("name")).when(F.col("b.n") == 1, F.col("b.uri"))
    return joined.select("name", outcome.alias("outcome"), uri.alias("uri"), F.coalesce("b.n", F.lit(0)).alias("n"))
