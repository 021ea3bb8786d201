"""Operator 1, quality rules: repetition coverage by rolling hashes of several n-gram lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from quillmesh.llm.common import add_columns, doc_columns, read_table

#: Highest share, in percent, of a text's word characters inside n-grams of this many words that occur twice or more.
NGRAM_LIMITS = {5: 40, 6: 36, 8: 32, 10: 28}
#: Highest share, in percent, of word characters inside lines that repeat an earlier line.
LINE_LIMIT = 30
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = b"#*$%&|<>"

_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C17)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Texts of one call hold about this many bytes; powers are kept up to that.
SLICE = 1 << 19
KEPT_POWERS = SLICE + (1 << 16)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

COLUMNS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("dup_line_chars", T.LongType()),
    *(T.StructField(f"dup_{n}gram_chars", T.LongType()) for n in NGRAM_LIMITS),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse. They are kept for a slice's length; a longer text makes its own for once."""
    up, down = _powers["up"], _powers["down"]
    if len(up) < n:
        up, down = (np.full(max(n, KEPT_POWERS), base, np.uint64) for base in (_BASE, _INVERSE))
        for x in (up, down):
            x[0] = 1
            np.cumprod(x, dtype=np.uint64, out=x)
        if n <= KEPT_POWERS:
            _powers["up"], _powers["down"] = up, down
    return up[:n], down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more; which are not the first of their group in sort order."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    later[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def repetition(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Counts per text; whole texts are hashed together, and keys of n-grams and lines carry their text's number."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(x) + 1 for x in raw], np.int64)
    ends = np.cumsum(lengths)
    n_docs = len(raw)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    up, down = _power(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.take(_BYTE, data, out=prefix[1:])
    prefix[1:] *= up[:-1]
    np.cumsum(prefix, dtype=np.uint64, out=prefix)
    heads = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    np.cumsum(((data & 0xC0) != 0x80) & ~blank, out=heads[1:], dtype=heads.dtype)
    edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    w_start, w_end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    w_doc = np.searchsorted(ends, w_start, side="right")

    def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64))

    def per_doc(docs: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        if weights is None:
            return np.bincount(docs, minlength=n_docs).astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(weights, dtype=np.int64)))
        edges = np.searchsorted(docs, np.arange(n_docs + 1))
        return sums[edges[1:]] - sums[edges[:-1]]

    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.searchsorted(ends, np.flatnonzero(symbol[data]), side="right")
    salt = _mix(np.arange(1, n_docs + 1, dtype=np.uint64) * _STEP)
    words, chars = hashed(w_start, w_end), heads[w_end] - heads[w_start]
    out = {
        "n_words": per_doc(w_doc),
        "word_chars": per_doc(w_doc, chars),
        "n_symbols": per_doc(symbols),
    }

    l_end = np.flatnonzero(data == 0x0A)
    l_start = np.concatenate(([0], l_end[:-1] + 1)).astype(np.int64)
    l_doc = np.searchsorted(ends, l_start, side="right")
    l_chars = heads[l_end] - heads[l_start]
    some = l_chars > 0
    l_start, l_end, l_doc, l_chars = l_start[some], l_end[some], l_doc[some], l_chars[some]
    _, later = _repeated(hashed(l_start, l_end) ^ salt[l_doc])
    out["n_dup_lines"] = per_doc(l_doc, later.astype(np.int64))
    out["dup_line_chars"] = per_doc(l_doc, np.where(later, l_chars, 0))

    rolling, n = words, 1
    for size in sorted({3, *NGRAM_LIMITS}):
        while n < size:
            rolling = rolling[:-1] * _STEP + words[n:] if len(rolling) > 1 else rolling[:0]
            n += 1
        covered = np.zeros(len(words), bool)
        if len(rolling):
            whole = np.flatnonzero(w_doc[: len(rolling)] == w_doc[size - 1 :])
            twice, _ = _repeated(_mix(rolling[whole]) ^ salt[w_doc[whole]])
            hits = whole[twice]
            for k in range(size):
                covered[hits + k] = True
        if size == 3:
            out["n_repeat_words"] = per_doc(w_doc, covered.astype(np.int64))
        if size in NGRAM_LIMITS:
            out[f"dup_{size}gram_chars"] = per_doc(w_doc, np.where(covered, chars, 0))

    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT * out["n_words"])
    kept = ~out["base_failed"] & (100 * out["dup_line_chars"] <= LINE_LIMIT * out["word_chars"])
    for size, limit in NGRAM_LIMITS.items():
        kept &= 100 * out[f"dup_{size}gram_chars"] <= limit * out["word_chars"]
    out["kept"] = kept
    return out


def _work(column: str):
    def work(part: pa.RecordBatch) -> list:
        found = repetition(part.column(column).to_pylist())
        return [pa.array(found[f.name]) for f in COLUMNS]

    return work


def quality_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id with the counts and verdicts of :data:`COLUMNS`, a row per input row (repeated ids too).

    A null or blank text has no words, so base_failed is true. Other columns are not read.
    """
    return add_columns(doc_columns(docs, key, text), "text", COLUMNS, _work("text"), drop_input=True, limit=SLICE)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes the rules; a null text does not."""
    return add_columns(docs, text, COLUMNS, _work(text), keep="kept", limit=SLICE)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; null texts fail, repeated ids keep a row each."""
    return quality_columns(read_table(spark, sf_dir, "documents"))


_N = sorted({3, *NGRAM_LIMITS})
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w0 AS (SELECT rid, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w,
              generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
w AS (SELECT rid, i, length(w) AS c,
             {", ".join(f"CASE WHEN lead(i, {n - 1}) OVER p IS NOT NULL THEN concat_ws(' ', {', '.join(f'lead(w, {k}) OVER p' if k else 'w' for k in range(n))}) END AS g{n}" for n in _N)}
      FROM w0 WINDOW p AS (PARTITION BY rid ORDER BY i)),
k AS (SELECT *, {", ".join(f"CASE WHEN g{n} IS NOT NULL AND count(*) OVER (PARTITION BY rid, g{n}) > 1 THEN 1 ELSE 0 END AS r{n}" for n in _N)} FROM w),
v AS (SELECT rid, c, {", ".join(f"max(r{n}) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS v{n}" for n in _N)} FROM k),
s AS (SELECT rid, count(*) AS n_words, sum(c) AS word_chars, sum(v3) AS n_repeat_words,
             {", ".join(f"sum(c * v{n}) AS dup_{n}gram_chars" for n in NGRAM_LIMITS)} FROM v GROUP BY rid),
l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT rid, line, count(*) - 1 AS again, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS c
       FROM l0 WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid, line),
l AS (SELECT rid, sum(again) AS n_dup_lines, sum(again * c) AS dup_line_chars FROM l1 GROUP BY rid),
a AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
             {", ".join(f"coalesce(dup_{n}gram_chars, 0)::BIGINT AS dup_{n}gram_chars" for n in NGRAM_LIMITS)}
      FROM d LEFT JOIN s USING (rid) LEFT JOIN l USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words)
       AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars
       AND {" AND ".join(f"100 * dup_{n}gram_chars <= {p} * word_chars" for n, p in NGRAM_LIMITS.items())} AS kept
FROM a
"""
