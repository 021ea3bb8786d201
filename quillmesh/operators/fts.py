"""Full-text search over segments: an index of postings, a query language, BM25 and the best segment of each resource.

The index is a table of postings dealt to buckets by their term, and one row of statistics. A query reads the buckets of
its own terms, gathers their postings by segment, and tests and scores each segment there.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmesh.runtime import shared_dir, tidy_shuffles

K1, B = 1.2, 0.75
#: Folders of the postings table.
BUCKETS = 64
#: A token's place is its column's number, shifted by this, and its place there.
_SHIFT = 40


def _folds() -> tuple[str, str]:
    """Letters with marks and the letters without, then combining marks, which go."""
    pairs = {}
    for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(k)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(k):
            pairs[chr(k)] = plain
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(pairs) + marks, "".join(pairs.values())


_MARKED, _PLAIN = _folds()


_TABLE = str.maketrans(_MARKED, _PLAIN + "\0" * (len(_MARKED) - len(_PLAIN)))
#: A token with the combining marks that folding takes out of it.
_TOKEN = "[\\p{L}\\p{N}\u0300-\u036f]*[\\p{L}\\p{N}][\\p{L}\\p{N}\u0300-\u036f]*"


def fold(c: Column | str) -> Column:
    """Lower case, Latin letters without their marks, no combining marks U+0300 to U+036F. Letters of other scripts stay whole."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(F.lower(c), _MARKED, _PLAIN))


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(fold(c), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def n_tokens(c: Column | str) -> Column:
    """The number of :func:`tokens`, without making them."""
    return F.regexp_count(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(_TOKEN))


def words(text: str) -> list[str]:
    """The tokens of a query's word or phrase, folded by the table of :func:`fold` and cut by the rule of :func:`tokens`."""
    folded = text.lower().translate(_TABLE).replace("\0", "")
    return [w for w in "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded).split(" ") if w]


@dataclass(frozen=True)
class Index:
    """``postings`` (bucket, term, id, ordinal, size, places), ``stats`` (N, avgdl; one row) and the names of the columns."""

    postings: DataFrame
    stats: DataFrame
    columns: tuple[str, ...]


def postings(segments: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """term, id, ordinal, size, tf, places of every term of every segment. A segment (id, ordinal) is one row, whose tokens are
    sorted and cut into terms where the row is, so nothing is shuffled."""
    def placed(k: int):
        return lambda x, i: F.struct(x.alias("term"), (F.lit(k << _SHIFT) + i).alias("place"))

    def term(t: Column, starts: Column):
        upto = lambda k: F.coalesce(F.get(starts, k + 1), F.size(t))
        return lambda a, k: F.struct(F.get(t, a)["term"].alias("term"), F.transform(F.slice(t, a + 1, upto(k) - a), lambda x: x["place"]).alias("places"))

    bound = lambda c, body: F.flatten(F.transform(F.array(c), body))  # noqa: E731  # once a row, not again in each lambda
    first = lambda t: F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["term"] != F.get(t, i - 1)["term"]))
    starts = lambda t: F.when(F.size(t) > 0, first(t)).otherwise(F.array().cast("array<int>"))
    cut = [F.transform(tokens(F.coalesce(F.col(c), F.lit(""))), placed(k)) for k, c in enumerate(columns)]
    terms = bound(F.sort_array(F.concat(*cut)), lambda t: bound(starts(t), lambda a: F.transform(a, term(t, a))))
    rows = segments.select("id", "ordinal", terms.alias("t"))
    rows = rows.withColumn("size", F.aggregate("t", F.lit(0), lambda n, x: n + F.size(x["places"]))).select("id", "ordinal", "size", F.explode("t").alias("x"))
    return rows.select("x.term", "id", "ordinal", "size", F.size("x.places").cast("long").alias("tf"), "x.places")


def write_buckets(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``rows`` in folders by bucket, from the tasks that make them: each keeps its BUCKETS files open, so no row is shuffled or sorted."""
    conf, name = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, None)
    conf.set(name, str(BUCKETS))
    try:
        with tidy_shuffles(rows.sparkSession):
            rows.write.mode(mode).option("compression", "zstd").partitionBy("bucket").parquet(path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def build_index(segments: DataFrame, columns: tuple[str, ...] = ("text",), path: str | None = None) -> Index:
    """Write postings and statistics of ``segments`` (id, ordinal and the columns) under ``path`` or in the shared folder."""
    spark = segments.sparkSession
    path = path or f"{shared_dir(spark)}/quillmesh-index-{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    # a term's bucket has a file of each task that meets it, so a frequent term is not one task's
    write_buckets(postings(segments, columns).drop("tf").withColumn("bucket", bucket), f"{path}/postings")
    size = sum((n_tokens(c) for c in columns), F.lit(0))
    segments.agg(F.count(F.lit(1)).alias("N"), F.avg(size).alias("avgdl")).write.parquet(f"{path}/stats")
    return open_index(spark, path, columns)


def open_index(spark, path: str, columns: tuple[str, ...] = ("text",)) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"), tuple(columns))


_LEXEMES = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\x1a\x80-\U0010ffff]+)|([(){}:,+*^-]))')


def _lexemes(query: str) -> list[str]:
    found, at = [], 0
    while query[at:].strip():
        m = _LEXEMES.match(query, at)
        if not m:
            raise ValueError(f"can't read {query[at:].strip()[:20]!r}")
        found.append(m[0].strip())
        at = m.end()
    return found


def _string(x: str) -> bool:
    return x[0] == '"' or x not in ("AND", "OR", "NOT") and x[0] not in "(){}:,+*^-"


def _narrowed(column, more):
    """A column filter inside another: both hold."""
    return column if more is None else more if column is None else ("both", column, more)


def parse(query: str) -> list:
    """Postfix form of a query: ("phrase" or "first", words, prefix, columns), ("near", phrases, distance), "AND", "OR", "NOT".

    Words, "phrases" (with "" for a quote), one + two as one phrase, prefix*, ^first word of a column, NEAR(a b, 5), AND, OR, NOT
    and parentheses. Terms that stand side by side belong together by AND, more tightly than by any operator. ``a : x``,
    ``{a b} : x``, ``- a : x`` and ``- {a b} : x`` name the columns that x may or may not be in, or must not be in; in another
    filter both hold. Columns are None (any), a name, ("in", names), ("out", names) or ("both", columns, columns). A word is cut
    by the rule of texts, so ``foo_bar`` is a phrase of two. ValueError for a form that can't be read.
    """
    found = _lexemes(query)
    out: list = []
    at = 0

    def peek(k: int = 0) -> str:
        return found[at + k] if at + k < len(found) else ""

    def take(x: str) -> None:
        nonlocal at
        if peek() != x:
            raise ValueError(f"{x} is missing" if not peek() else f"unexpected {peek()!r}")
        at += 1

    def string() -> str:
        nonlocal at
        if not peek() or not _string(peek()):
            raise ValueError("a term is missing" if not peek() else f"unexpected {peek()!r}")
        at += 1
        x = found[at - 1]
        return x[1:-1].replace('""', '"') if x[0] == '"' else x

    def filtered() -> bool:
        return peek() in ("-", "{") or bool(peek()) and _string(peek()) and peek(1) == ":"

    def columns():
        nonlocal at
        out_ = peek() == "-"
        at += out_
        if peek() == "{":
            at += 1
            names = []
            while peek() != "}":
                names.append(string().lower())
            at += 1
        else:
            names = [string().lower()]
        take(":")
        if not names:
            raise ValueError("a column is missing")
        return ("out" if out_ else "in", tuple(names)) if out_ or len(names) > 1 else names[0]

    def phrase(column) -> tuple:
        nonlocal at
        own, prefix = words(string()), False
        while True:
            if peek() == "*":
                at += 1
                prefix = True
            if peek() != "+" or prefix:
                break
            at += 1
            own += words(string())
        if not own:
            raise ValueError("a phrase has no word")
        return "phrase", own, prefix, column

    def near_set(column) -> None:
        nonlocal at
        if peek() == "NEAR" and peek(1) == "(":
            at += 2
            phrases, distance = [phrase(column)], "10"
            while peek() not in (")", ","):
                phrases.append(phrase(column))
            if peek() == ",":
                at += 1
                distance = string()
            take(")")
            if not distance.isdigit():
                raise ValueError("NEAR takes a number of words")
            out.append(("near", phrases, int(distance)))
        elif peek() == "^":
            at += 1
            out.append(("first", *phrase(column)[1:]))
        else:
            out.append(phrase(column))

    def item(column) -> None:
        nonlocal at
        while filtered():
            column = _narrowed(column, columns())
        if peek() == "(":
            at += 1
            either(column)
            take(")")
        else:
            near_set(column)

    def terms(column) -> None:
        item(column)
        while peek() and (_string(peek()) or peek() in ("(", "^", "-", "{")):
            item(column)
            out.append("AND")

    def chain(below, word: str):
        def run(column) -> None:
            nonlocal at
            below(column)
            while peek() == word:
                at += 1
                below(column)
                out.append(word)

        return run

    either = chain(chain(chain(terms, "NOT"), "AND"), "OR")
    either(None)
    if at < len(found):
        raise ValueError(f"unexpected {found[at]!r}")
    return out


def _phrases(parsed: list) -> list[tuple]:
    return [p for x in parsed if isinstance(x, tuple) for p in (x[1] if x[0] == "near" else [x])]


def _allowed(column, columns: tuple[str, ...]) -> set[int]:
    """Numbers of the columns that a filter leaves."""
    if column is None:
        return set(range(len(columns)))
    if column[0] == "both" and isinstance(column, tuple):
        return _allowed(column[1], columns) & _allowed(column[2], columns)
    kind, names = column if isinstance(column, tuple) else ("in", (column,))
    lower = [c.lower() for c in columns]
    for name in names:
        if name not in lower:
            raise ValueError(f"no column {name}")
    return {k for k, c in enumerate(lower) if (c in names) == (kind == "in")}


def _places(hits: Column, word: str, prefix: bool) -> Column:
    """Places of a word, or of all words with a prefix, among a segment's postings (term, places)."""
    test = (lambda h: h["term"].startswith(word)) if prefix else (lambda h: h["term"] == word)
    return F.flatten(F.transform(F.filter(hits, test), lambda h: h["places"]))


def _starts(hits: Column, phrase: tuple, columns: tuple[str, ...]) -> Column:
    """Places where a phrase starts, in its column if it names one."""
    kind, own, prefix, column = phrase
    places = [_places(hits, w, prefix and k == len(own) - 1) for k, w in enumerate(own)]
    kept = _allowed(column, columns)
    if kind == "first":
        inside = lambda p: p.isin([k << _SHIFT for k in sorted(kept)])
    else:
        inside = lambda p: F.lit(True) if len(kept) == len(columns) else F.shiftright(p, _SHIFT).isin(sorted(kept))
    follows = lambda p: reduce(lambda a, b: a & b, [F.array_contains(x, p + k) for k, x in enumerate(places[1:], 1)], inside(p))
    return F.filter(places[0], follows)


def _near(starts: list[Column], sizes: list[int], distance: int) -> list[Column]:
    """Of each phrase's places those in a window: all phrases stand there, ``distance`` words at most from the end of the
    first to the start of the last."""

    if len(starts) == 2:  # each place needs one of the other phrase before or after it
        (a, b), (m, n) = starts, sizes
        close = lambda p, size, q, other: ((q >= p) & (q <= p + size + distance)) | ((p >= q) & (p <= q + other + distance))
        return [F.filter(a, lambda p: F.exists(b, lambda q: close(p, m, q, n))), F.filter(b, lambda p: F.exists(a, lambda q: close(p, n, q, m)))]

    def window(a: Column, size: int) -> Column:
        return reduce(lambda x, y: x & y, [F.exists(other, lambda q: (q >= a) & (q <= a + size + distance)) for other in starts])

    def windows(places: Column, size: int) -> Column:
        return F.transform(F.filter(places, lambda a: window(a, size)), lambda a: F.struct(a.alias("a"), (a + size + distance).alias("z")))

    anchors = F.concat(*(windows(s, n) for s, n in zip(starts, sizes, strict=True)))
    return [F.filter(s, lambda p: F.exists(anchors, lambda w: (p >= w["a"]) & (p <= w["z"]))) for s in starts]


def bm25(index: Index, query: str) -> DataFrame:
    """id, ordinal, rank of matching segments: negative, lower is better.

    Only postings of the query's terms are read, from their buckets (a prefix reads all buckets). The number of segments of
    each phrase and the index's statistics are one row, whose size does not depend on the data; it is broadcast.
    """
    parsed = parse(query)
    known = _phrases(parsed)
    exact = sorted({w for _, own, prefix, _ in known for w in (own[:-1] if prefix else own)})
    starts = sorted({own[-1] for _, own, prefix, _ in known if prefix})
    rows = index.postings
    test = F.col("term").isin(exact) if exact else F.lit(False)
    for w in starts:
        test = test | F.col("term").startswith(w)
    if not starts:
        buckets = rows.sparkSession.range(1).select(*(F.pmod(F.xxhash64(F.lit(w)), F.lit(BUCKETS)).cast("int") for w in exact)).first()
        rows = rows.where(F.col("bucket").isin(sorted(set(buckets))))
    hits = rows.where(test).groupBy("id", "ordinal", "size").agg(F.collect_list(F.struct("term", "places")).alias("hits"))
    # places are columns of their own, so that tests of windows don't make them again for each place
    hits = hits.select("id", "ordinal", "size", *(_starts(F.col("hits"), p, index.columns).alias(f"s{k}") for k, p in enumerate(known)))
    stack: list[Column] = []
    freqs: list[Column] = []
    for x in parsed:
        if isinstance(x, str):
            b, a = stack.pop(), stack.pop()
            stack.append(a & b if x == "AND" else a | b if x == "OR" else a & ~b)
            continue
        found = [F.col(f"s{len(freqs) + k}") for k in range(len(x[1]) if x[0] == "near" else 1)]
        if x[0] == "near":
            found = _near(found, [len(p[1]) for p in x[1]], x[2]) if len(found) > 1 else found
        freqs += [F.size(f) for f in found]
        stack.append(reduce(lambda a, b: a & b, [F.size(f) > 0 for f in found]))
    n = range(len(freqs))
    scored = hits.select("id", "ordinal", "size", stack[0].alias("hit"), *(f.cast("double").alias(f"f{k}") for k, f in enumerate(freqs)))
    counts = scored.agg(*(F.sum((F.col(f"f{k}") > 0).cast("long")).alias(f"n{k}") for k in n))

    def part(k: int) -> Column:
        raw = F.log((F.col("N") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        f = F.col(f"f{k}")
        return F.when(raw <= 0, 1e-6).otherwise(raw) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("avgdl")))

    one = counts.crossJoin(index.stats)
    score = -reduce(lambda a, b: a + b, [part(k) for k in n])
    return scored.where("hit").crossJoin(F.broadcast(one)).select("id", "ordinal", score.alias("rank"))


def authority_rank() -> Column:
    return F.when(F.col("authority") == "repository", 0).when(F.col("authority") == "gateway", 1).otherwise(2)


def status_rank() -> Column:
    return F.when(F.col("status") == "stable", 0).when(F.col("status") == "draft", 1).otherwise(2)


def search_segments(index: Index, query: str, limit: int) -> DataFrame:
    return bm25(index, query).orderBy("rank", "id", "ordinal").limit(limit)


#: Filters of :func:`search` that are equalities on columns of resources.
FILTERS = ("namespace", "kind", "authority", "status", "origin")


def search(
    index: Index, resources: DataFrame, query: str, limit: int = 20, path: str | None = None, files: DataFrame | None = None, relation: str | None = None, edges: DataFrame | None = None, **filters: str | None
) -> DataFrame:
    """Best segment of each resource, by authority, status, rank and uri; a filter that is None does not filter.

    ``path`` keeps resources that ``files`` (id, path) places there; ``relation`` those that an edge (src, dst, relation; ids)
    of that kind leaves or enters.
    """
    kept = resources
    for name, value in filters.items():
        if name not in FILTERS:
            raise TypeError(f"no filter {name}")
        kept = kept if value is None else kept.where(F.col(name) == value)
    if path is not None:
        kept = kept.join(files.where(F.col("path") == path).select("id"), "id", "left_semi")
    if relation is not None:
        of = edges.where(F.col("relation") == relation)
        kept = kept.join(of.select(F.col("src").alias("id")).unionByName(of.select(F.col("dst").alias("id"))), "id", "left_semi")
    # a segment's rank depends on all segments, its place only on those of resources that are kept
    ranked = bm25(index, query).join(kept.select("id"), "id", "left_semi")
    best = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("rank", "ordinal"))).where("rn = 1").drop("rn").join(kept, "id")
    return best.orderBy(authority_rank(), status_rank(), "rank", "uri").limit(limit)


def search_docs(index: Index, resources: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """id, title, uri, rank of documents, each once, 100 at most."""
    return search(index, resources, query, limit=min(limit, 100)).select("id", "title", "uri", "rank")


def prompt_query(prompt: str, limit: int = 8) -> str:
    """Quoted words of a prompt, joined by OR."""
    words = [w for w in re.split(r"[\W_]+", prompt.lower()) if len(w.encode()) >= 2]
    return " OR ".join(f'"{w}"' for w in words[:limit])
