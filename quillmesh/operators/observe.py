"""Observations: what was read in the hours before a piece of work was done, as links from the work to what it touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Seconds before the end of a piece of work that count, links of one, and observations that are kept.
WINDOW, LINKS, KEPT = 12 * 3600, 8, 200

def spans(accesses: DataFrame, window: int = WINDOW) -> DataFrame:
    """resource, start, end, uses: the stretches of seconds in which a piece of work that ends then has so many uses of a resource.

    ``accesses`` has resource, tool and seen (epoch seconds); rows without resource or time are left out. A tool counts with
    all its accesses so far, from one of them until ``window`` seconds after it. Stretches of a resource don't meet, are
    ``window`` + 1 seconds long at most, and are no more than twice its accesses.
    """
    seconds = accesses.where("resource IS NOT NULL AND seen IS NOT NULL").groupBy("resource", "tool", "seen").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("resource", "tool").orderBy("seen")
    told = seconds.select("resource", "seen", "n", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.lag("seen").over(by).alias("last"), F.lead("seen").over(by).alias("next"))
    more = F.when(F.col("seen") - F.col("last") <= window, F.col("n")).otherwise(F.col("upto"))
    ends = F.when(F.coalesce(F.col("next") - F.col("seen") > window, F.lit(True)), F.col("seen") + window + 1)
    steps = told.select("resource", F.explode(F.array(F.struct(F.col("seen").alias("start"), more.alias("more")), F.struct(ends.alias("start"), (-F.col("upto")).alias("more")))).alias("s"))
    steps = steps.select("resource", "s.*").where("start IS NOT NULL")
    order = Window.partitionBy("resource").orderBy("start")
    # steps of one second share a sum, and all but the last of them end before they start
    out = steps.select("resource", "start", (F.lead("start").over(order) - 1).alias("end"), F.sum("more").over(order.rangeBetween(Window.unboundedPreceding, 0)).alias("uses"))
    return out.where("uses > 0 AND end >= start")


def _blocks(start: Column, end: Column, levels: int) -> Column:
    """The least blocks of 1, 2, 4, ... seconds, each from a multiple of its length, that make up a stretch: two of each length at most."""
    found = []
    for k in range(levels):
        low, high = F.shiftright(start + ((1 << k) - 1), k), F.shiftright(end + 1, k)
        odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
        found += [F.when((low < high) & odd(low), _block(low, k)), F.when((low < high) & odd(high), _block(high - 1, k))]
    return F.array_compact(F.array(*found))


def _block(number: Column, level: int) -> Column:
    return F.shiftleft(number, 6).bitwiseOR(F.lit(level).cast("long"))


def observation_links(work: DataFrame, accesses: DataFrame, window: int = WINDOW, limit: int = LINKS) -> DataFrame:
    """work, rank, resource, uses: for each piece of ``work`` (work, at) the resources most used by then, of those touched in the ``window`` before.

    A resource counts by tool: the tools that touched it in the window count with all their accesses until ``at``, as
    counters do that are read when the work ends. Most used first, then by resource. No piece of work meets all that its
    window holds: stretches of equal uses (:func:`spans`) are cut into blocks of seconds, of each block that holds the end of
    some work the first ``limit`` resources stay, and a piece of work meets the blocks around its end, one of each length.
    Work that touched nothing has no row; rows without id or time are left out.
    """
    levels = (window + 1).bit_length()
    done = work.select("work", F.col("at").cast("long").alias("at")).where("work IS NOT NULL AND at IS NOT NULL").distinct()
    around = done.select("at").distinct().select("at", F.explode(F.array(*(_block(F.shiftright("at", k), k) for k in range(levels)))).alias("block"))
    held = spans(accesses, window).select("resource", "uses", F.explode(_blocks(F.col("start"), F.col("end"), levels)).alias("block"))
    held = held.join(around.select("block").distinct(), "block", "left_semi")
    most = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("uses"), "resource"))
    first = held.withColumn("rank", most("block")).where(F.col("rank") <= limit).drop("rank")
    found = around.join(first, "block").withColumn("rank", most("at")).where(F.col("rank") <= limit)
    return done.join(found, "at").select("work", "rank", "resource", "uses")


def concept_link(namespace: Column, uri: Column, origin: Column, title: Column, project: Column) -> Column:
    """The link from an observation to what describes a resource: concepts by their path in their origin, files by the concept of the file."""
    mark = F.concat(F.lit("/"), origin, F.lit("/"))
    tail = F.element_at(F.split(uri, F.concat(F.lit("\\Q"), mark, F.lit("\\E")), -1), -1)
    own = F.concat(F.lit("/"), F.when(F.contains(uri, mark), tail).otherwise(title))
    head = F.concat(F.lit("repo://"), project, F.lit("/"))
    file = F.when(F.startswith(uri, head), F.concat(F.lit("/code/"), F.substring(uri, F.length(head) + 1, F.length(uri)), F.lit(".md")))
    return F.when(namespace == "okf", own).when(namespace == "file", file)


def observations(work: DataFrame, links: DataFrame, resources: DataFrame, kept: int = KEPT) -> DataFrame:
    """work, title, status, tags, body: a draft of each of the ``kept`` latest pieces of work (work, at, title, outcome) with links.

    ``resources`` has resource, title, uri and link (:func:`concept_link`); what has a link is linked, else named by its uri.
    """
    named = links.join(resources.select("resource", F.col("title").alias("__title"), "uri", "link"), "resource")
    times = F.concat(F.lit(" — read "), F.col("uses").cast("string"), F.when(F.col("uses") == 1, " time\n").otherwise(" times\n"))
    line = F.concat(F.lit("- "), F.when(F.col("link").isNotNull(), F.concat(F.lit("["), "__title", F.lit("]("), "link", F.lit(")"))).otherwise(F.concat(F.lit("`"), "uri", F.lit("`"))), times)
    lists = named.groupBy("work").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "").alias("list"))  # LINKS lines at most
    body = F.concat(F.lit("# "), "title", F.lit("\n\n"), "outcome", F.lit("\n\n## Resources touched\n\n"), "list")
    made = work.join(lists, "work").select("work", "at", "title", F.lit("draft").alias("status"), F.array(F.lit("observation")).alias("tags"), body.alias("body"))
    return made.orderBy(F.desc("at"), F.desc("work")).limit(kept)
