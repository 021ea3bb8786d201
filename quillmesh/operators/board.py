"""Boards and registries as tables: tasks, messages, patterns, docs and federated results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: order of task states on a board
STATUS_ORDER = ["todo", "in_progress", "done"]


def status_place() -> Column:
    place = F.lit(len(STATUS_ORDER))
    for k, s in reversed(list(enumerate(STATUS_ORDER))):
        place = F.when(F.col("status") == s, k).otherwise(place)
    return place


#: Milliseconds after which a task that is done is no longer listed.
STALE_MS = 7 * 24 * 3600 * 1000


def list_tasks(tasks: DataFrame, statuses: list[str] = ("todo", "in_progress"), now: int | None = None, include_stale: bool = False, label: str | None = None) -> DataFrame:
    """Tasks of these states; those done for over seven days before ``now`` (milliseconds, of updated_at) only with ``include_stale``."""
    out = tasks.where(F.col("status").isin(list(statuses)))
    if now is not None and not include_stale:
        out = out.where((F.col("status") != "done") | (F.col("updated_at") >= now - STALE_MS))
    return out if label is None else out.where(F.array_contains("labels", label))


def first_gateway(rows: DataFrame, order: list[str], key: str = "id", gateway: str | None = None) -> DataFrame:
    """Of rows that gateways share by ``key``, that of the first gateway in ``order``, or of the one that is named."""
    if gateway is not None:
        return rows.where(F.col("gateway") == gateway)
    place = F.array_position(F.array(*map(F.lit, order)), F.col("gateway"))
    fields = [c for c in rows.columns if c != key]
    return rows.where(place > 0).groupBy(key).agg(F.min_by(F.struct(*fields), place).alias("x")).select(key, "x.*")


def with_comments(tasks: DataFrame, comments: DataFrame) -> DataFrame:
    """Tasks with their comments (task, at, body) as one text, oldest first."""
    said = comments.groupBy(F.col("task").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n").alias("comments"))
    return tasks.join(said, "id", "left").withColumn("comments", F.coalesce("comments", F.lit("")))


#: Events that a task takes in each state, and the state after them.
MOVES = {("todo", "claim"): "in_progress", ("in_progress", "release"): "todo", ("in_progress", "done"): "done", ("todo", "done"): "done", ("todo", "delegate"): "todo", ("in_progress", "delegate"): "in_progress"}


def fold_tasks(events: DataFrame) -> DataFrame:
    """id, status, owner, n_refused: each task's state after its events (id, at, event, agent), in order; those that its state does not
    take are refused. A task starts as todo; who claims it owns it, a delegate gets it, a release frees it. A task's events fit a row."""
    order = F.array_sort(F.collect_list(F.struct("at", "event", "agent")))
    allowed = F.create_map(*[F.lit(x) for (state, event), after in MOVES.items() for x in (f"{state} {event}", after)])
    start = F.struct(F.lit("todo").alias("status"), F.lit(None).cast("string").alias("owner"), F.lit(0).cast("long").alias("n_refused"))

    def step(s: Column, e: Column) -> Column:
        after = F.element_at(allowed, F.concat_ws(" ", s["status"], e["event"]))
        owner = F.when(e["event"].isin("claim", "delegate"), e["agent"]).when(e["event"] == "release", F.lit(None)).otherwise(s["owner"])
        taken = after.isNotNull()
        return F.struct(F.coalesce(after, s["status"]).alias("status"), F.when(taken, owner).otherwise(s["owner"]).alias("owner"), (s["n_refused"] + F.when(taken, 0).otherwise(1)).alias("n_refused"))

    return events.groupBy("id").agg(order.alias("log")).select("id", F.aggregate("log", start, step).alias("x")).select("id", "x.*")


def list_docs(docs: DataFrame, q: str | None = None, app: str | None = None, label: str | None = None, kind: str | None = None, scope: str = "all") -> DataFrame:
    """Documents (title, summary, app, labels, kind, scope) that meet the filters given; ``scope`` is local, global or all."""
    if scope not in ("local", "global", "all"):
        raise ValueError("scope must be local, global or all")
    out = docs
    if q:
        out = out.where(F.lower("title").contains(q.lower()) | F.lower(F.coalesce("summary", F.lit(""))).contains(q.lower()))
    out = out if app is None else out.where(F.col("app") == app)
    out = out if kind is None else out.where(F.col("kind") == kind)
    out = out if label is None else out.where(F.array_contains("labels", label))
    return out if scope == "all" else out.where(F.col("scope") == scope)


def publish_docs(docs: DataFrame, new: DataFrame, deleted: DataFrame) -> DataFrame:
    """Documents (slug, ...) with ``new`` put in by slug, and those of ``deleted`` (slug) left out."""
    kept = docs.join(new.select("slug"), "slug", "left_anti").select(*docs.columns)
    return kept.unionByName(new.select(*docs.columns)).join(deleted.select("slug"), "slug", "left_anti").select(*docs.columns)


def doc_problems(docs: DataFrame, required: list[str] = ("slug", "title", "kind", "body")) -> DataFrame:
    """slug, missing: the required fields that a document lacks, in order; no row for whole documents."""
    blank = F.filter(F.array(*(F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(c)) for c in required)), lambda x: x.isNotNull())
    return docs.withColumn("__m", blank).where(F.size("__m") > 0).select("slug", F.array_join("__m", ",").alias("missing"))


def export_manifest(docs: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """slug, version, path, sha256: what an export writes. The accepted version goes before the current one, if there is one; a path
    that is there (existing: path) gets a proposal beside it, unless ``overwrite``."""
    path = F.concat(F.lit("docs/"), "slug", F.lit(".yaml"))
    rows = docs.withColumn("path", path).withColumn("version", F.coalesce("accepted_version", "current_version"))
    there = existing.select("path").distinct().withColumn("__there", F.lit(True))
    beside = F.concat(F.lit("docs/"), "slug", F.lit(".proposed.yaml"))
    shown = F.col("path") if overwrite else F.when(F.col("__there"), beside).otherwise(F.col("path"))
    return rows.join(there, "path", "left").select("slug", "version", shown.alias("path"), F.sha2("body", 256).alias("sha256"))


def categories(patterns: DataFrame) -> Column:
    """Categories of a pattern: its own and those that labels name as ``category:x``, each once."""
    marked = F.transform(F.filter("labels", lambda x: x.startswith("category:")), lambda x: F.trim(F.substring(x, 10, 1 << 20)))
    return F.array_distinct(F.concat("categories", marked))


def message_tags(messages: DataFrame) -> DataFrame:
    """conv, id, tags: AGENT or USER, REPLY to a parent, ACTION where a message asks for one."""
    tags = F.array_compact(F.array(F.when(F.col("sender") == "user", "USER").otherwise("AGENT"), F.when(F.col("parent").isNotNull(), F.concat(F.lit("REPLY:"), F.col("parent").cast("string"))), F.when(F.col("action"), "ACTION")))
    return messages.select("conv", "id", F.array_join(tags, " ").alias("tags"))


def federation_report(batches: DataFrame, primary: str) -> DataFrame:
    """gateway, state of each gateway that failed or left results out (gateway, authorized, error): fatal for the primary one, a warning
    for others, unauthorized where results were not for the caller; by gateway."""
    by = batches.groupBy("gateway").agg(F.max("error").alias("error"), F.sum((~F.coalesce("authorized", F.lit(True))).cast("long")).alias("hidden"))
    state = F.when(F.col("error").isNotNull(), F.when(F.col("gateway") == primary, "fatal").otherwise("warning")).when(F.col("hidden") > 0, "unauthorized")
    return by.withColumn("state", state).where("state IS NOT NULL").select("gateway", "state", F.col("hidden").alias("n_hidden")).orderBy("gateway")


def capable(gateways: DataFrame, capability: str) -> DataFrame:
    """Gateways (gateway, read: a list of capabilities) that can be asked for one."""
    return gateways.where(F.array_contains("read", capability))


def of_kind(skills: DataFrame, kind: str) -> DataFrame:
    """Commands, agents, or skills, which are neither of them, by their paths."""
    command, agent = F.col("path").startswith("commands/"), F.col("path").startswith("agents/")
    tests = {"command": command, "agent": agent, "skill": ~command & ~agent}
    return skills.where(tests[kind])


def prompt_context(tasks: DataFrame, patterns: DataFrame, knowledge: DataFrame, prompt_words: list[str], budget: int = 3000) -> DataFrame:
    """place, line: what a prompt's hook shows: the patterns and tasks that share most words with it, then knowledge, while the budget lasts.

    Parts are small (three patterns, three tasks, the rows of ``knowledge``: id, title, text), so one task sums their lengths.
    """
    three = lambda rows, hay: token_overlap(rows, prompt_words, hay, 3)
    part = lambda rows, k, line: rows.select(F.lit(k).alias("part"), F.col("place"), line.alias("line"))
    a = three(patterns, "body").withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    b = three(tasks, "title").withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    c = knowledge.withColumn("place", F.row_number().over(Window.orderBy("id")))
    rows = part(a, 0, F.concat(F.lit("pattern "), "slug")).unionByName(part(b, 1, F.concat(F.lit("task "), "title"))).unionByName(part(c, 2, F.concat("title", F.lit(": "), "text")))
    kept = within_budget(rows, ["part", "place"], F.length("line"), budget)
    return kept.select(F.row_number().over(Window.orderBy("part", "place")).cast("long").alias("place"), "line")


def gateway_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of all gateways, each with the name of its own."""
    tagged = [rows.withColumn("gateway", F.lit(k)) for k, rows in parts.items()]
    out = tagged[0]
    for rows in tagged[1:]:
        out = out.unionByName(rows)
    return out


def task_board(tasks: DataFrame, comments: DataFrame) -> DataFrame:
    """Tasks with comment_count, status_count and place (from 1) in their status by rank and id."""
    n = comments.groupBy("id").agg(F.count(F.lit(1)).alias("comment_count"))
    counts = tasks.groupBy("status").agg(F.count(F.lit(1)).alias("status_count"))
    out = tasks.join(n, "id", "left").join(F.broadcast(counts), "status")  # a row per state
    return out.withColumn("comment_count", F.coalesce("comment_count", F.lit(0))).withColumn("status_place", status_place())


def unread(messages: DataFrame, confirmed: DataFrame, agent: str) -> DataFrame:
    """Messages not sent by ``agent`` and not confirmed by it (conv, id)."""
    return messages.where(F.col("sender") != agent).join(confirmed, ["conv", "id"], "left_anti")


def threads(messages: DataFrame) -> DataFrame:
    """Each reply with its parent's sender."""
    p = messages.select("conv", F.col("id").alias("parent"), F.col("sender").alias("parent_sender"))
    return messages.join(p, ["conv", "parent"])


def superseded_by(state: Column) -> Column:
    return F.when(state.startswith("superseded-by:"), F.trim(F.substring(state, 15, 1 << 20))).when(state == "superseded", "(replacement not named)")


def pattern_tasks(patterns: DataFrame, open_tasks: DataFrame) -> DataFrame:
    """slug, replacement, task_title, action: a review task for each superseded pattern, created unless one with that title (task_title) is open."""
    old = patterns.withColumn("replacement", superseded_by(F.col("state"))).where("replacement IS NOT NULL").withColumn("task_title", F.concat(F.lit("review "), F.col("slug")))
    known = open_tasks.select("task_title").distinct().withColumn("open", F.lit(True))
    return old.join(known, "task_title", "left").select("slug", "replacement", "task_title", F.when(F.col("open"), "keep").otherwise("create").alias("action"))


def search_patterns(patterns: DataFrame, query: str | None = None, version: str | None = None, state: str | None = None, label: str | None = None) -> DataFrame:
    """Patterns with ``query`` in their title, slug, summary, body, labels, version or state, of which those that are there count."""
    out = patterns
    if query:
        q, hit = query.lower(), F.lit(False)
        for c in ("title", "slug", "summary", "body", "version", "state"):
            hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q) if c in patterns.columns else hit
        if "labels" in patterns.columns:
            hit = hit | F.exists(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.lower(x).contains(q))
        out = out.where(hit)
    if label is not None:
        out = out.where(F.array_contains("labels", label))
    if version is not None:
        out = out.where(F.col("version") == version)
    return out if state is None else out.where(F.col("state") == state)


def federate(batches: DataFrame) -> DataFrame:
    """uri, title, hash, origins of authorised results (gateway, authority, uri, title, hash, authorized, position).

    The first result of a uri, by position and gateway, gives title and hash; origins are distinct and sorted.
    """
    kept = batches.where("authorized")
    first = F.min_by(F.struct("title", "hash"), F.struct("position", "gateway"))
    out = kept.groupBy("uri").agg(first.alias("f"), F.array_sort(F.collect_set(F.struct("gateway", "authority"))).alias("o"))
    return out.select("uri", F.col("f.title").alias("title"), F.col("f.hash").alias("hash"), F.array_join(F.transform("o", lambda x: F.concat_ws("/", x["gateway"], x["authority"])), ",").alias("origins"))


def docs_hierarchy(docs: DataFrame) -> DataFrame:
    """space, n, first_id, first_title: documents by space, ``default`` where it is missing."""
    space = F.when(F.coalesce(F.col("space"), F.lit("")) == "", "default").otherwise(F.col("space"))
    return docs.withColumn("space", space).groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.min_by("title", "id").alias("first_title"))


def recent_accesses(counts: DataFrame, since: int, limit: int) -> DataFrame:
    """resource, uses of counters touched since then; most used first."""
    return counts.where(F.col("last_access") >= since).groupBy("resource").agg(F.sum("access_count").alias("uses")).orderBy(F.desc("uses"), "resource").limit(limit)


def usage_rerank(found: DataFrame, uses: DataFrame, k: int) -> DataFrame:
    """Over-fetched search results by authority, status, uses, then their place; ``found`` is at most 4 k rows."""
    from quillmesh.operators.fts import authority_rank, status_rank

    out = found.join(uses, found.id == uses.resource, "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return out.orderBy(authority_rank(), status_rank(), F.desc("uses"), "place").limit(k)


def token_overlap(rows: DataFrame, prompt_words: list[str], hay: str, limit: int = 3) -> DataFrame:
    """Rows whose text has most of the words as parts; rows with none are left out."""
    score = sum((F.when(F.lower(hay).contains(w), 1).otherwise(0) for w in dict.fromkeys(prompt_words)), F.lit(0))
    return rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def within_budget(rows: DataFrame, order: list[str], length: Column, budget: int, group: list[str] = ()) -> DataFrame:
    """The leading rows whose running length stays within the budget; the first overflow ends the list."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(length).over(w)).where(F.col("running") <= budget)
