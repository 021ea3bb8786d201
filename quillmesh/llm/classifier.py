"""Operator 12, a quality classifier: random-indexing word vectors pooled per document, then a small network.

Every word has a sparse random index vector that its hash gives. A word's context vector is the sum of the index vectors
around all its occurrences in the corpus. A document is the mean of its words' context vectors and index vectors, those of
whole words and those of their endings and shapes. A two-layer network over these means is fit on a bounded sample of
labelled texts, and its probabilities are calibrated by one temperature on a part of the sample that it has not learnt.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from quillmesh.llm.common import add_columns, prepare, read_table, slices, stage_table, tidy

#: Words share BUCKETS context vectors by hash, so the table of vectors is bounded whatever the vocabulary: 4 MB.
BUCKETS, DIM, NONZERO, REACH = 1 << 14, 64, 4, 2
#: Documented bounds of the fit: distinct texts of each label; every fifth calibrates.
SAMPLE_PER_LABEL, HIDDEN, EPOCHS, BATCH, RATE, DECAY = 4000, 32, 60, 128, 3e-3, 1e-3
#: Bytes of text that are split into words at a time; a longer text is cut at white space, a longer word into pieces.
PIECE = 1 << 19
PARTS = 64
#: Chunks that the sum of all tasks' context counts is made in.
CHUNKS = 64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
_UPPER = np.array([65 <= c <= 90 for c in range(256)], np.int64)
_DIGIT = np.array([48 <= c <= 57 for c in range(256)], np.int64)
_SIGN = np.array([33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in range(256)], np.int64)
_ONE = np.ones(1, np.uint64)
_POWERS = np.cumprod(np.concatenate([_ONE, np.full(PIECE, _BASE, np.uint64)]), dtype=np.uint64)
_INVERSES = np.cumprod(np.concatenate([_ONE, np.full(PIECE, pow(_BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _pieces(raw: bytes) -> Iterator[bytes]:
    start = 0
    while len(raw) - start > PIECE:
        part = np.frombuffer(raw, np.uint8, PIECE, start)
        blanks = np.flatnonzero(_SPACE[part[PIECE // 2 :]])
        stop = start + (PIECE // 2 + int(blanks[-1]) if len(blanks) else PIECE)
        yield raw[start:stop]
        start = stop
    yield raw[start:]


@dataclass
class Words:
    """Words of some texts in a row: number of the text, hash of the whole word (A to Z lower-cased), hash of ending and shape."""

    text: np.ndarray
    word: np.ndarray
    kind: np.ndarray


def split_words(texts: list[str | None]) -> Iterator[Words]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of whole texts, in parts of about PIECE bytes; null texts have none."""
    held: list[bytes] = []
    owners: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for piece in _pieces((t or "").encode("utf-8", "surrogatepass")):
            if held and size + len(piece) + 1 > PIECE:
                yield _split(held, owners)
                held, owners, size = [], [], 0
            held.append(piece)
            owners.append(i)
            size += len(piece) + 1
    if held:
        yield _split(held, owners)


def _split(pieces: list[bytes], owners: list[int]) -> Words:
    raw = np.frombuffer(b" ".join(pieces), np.uint8)
    blank = np.concatenate([[True], _SPACE[raw], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.cumsum([0] + [len(p) + 1 for p in pieces])
    text = np.array(owners, np.int64)[np.searchsorted(offsets, starts, side="right") - 1]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[raw] + np.uint64(1)) * _POWERS[: len(raw)], dtype=np.uint64)])
    count = lambda table: (c := np.concatenate([[0], np.cumsum(table[raw])]))[ends] - c[starts]
    lengths = ends - starts
    tails = np.maximum(starts, ends - 3)
    upper, digits, signs = count(_UPPER), count(_DIGIT), count(_SIGN)
    shape = np.minimum(lengths // 3, 7) + 8 * np.minimum(upper, 2) + 24 * np.minimum(digits, 2) + 72 * np.minimum(signs, 3)
    ending = (sums[ends] - sums[tails]) * _INVERSES[tails]
    return Words(text, _mixed((sums[ends] - sums[starts]) * _INVERSES[starts]), _mixed(ending + shape.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (NONZERO a word) of the sparse random index vectors."""
    fields = _mixed(hashes + np.uint64(0xA0761D6478BD642F))[:, None] >> (np.uint64(8) * np.arange(NONZERO, dtype=np.uint64))
    return (fields & np.uint64(DIM - 1)).astype(np.int64), 1.0 - 2.0 * ((fields >> np.uint64(7)) & np.uint64(1)).astype(np.float64)


def _buckets(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def add_contexts(total: np.ndarray, words: Words) -> None:
    """Add to ``total`` (BUCKETS * DIM) the index vectors of the words up to REACH places before and after each word of the same text."""
    bucket, (places, signs) = _buckets(words.word) * DIM, _index(words.word)
    cells, weights = [], []
    for d in range(1, REACH + 1):
        same = np.flatnonzero(words.text[d:] == words.text[:-d])
        for own, other in ((same, same + d), (same + d, same)):
            cells.append((bucket[own][:, None] + places[other]).ravel())
            weights.append(signs[other].ravel())
    total += np.bincount(np.concatenate(cells), np.concatenate(weights), BUCKETS * DIM).astype(np.int64)


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS unit rows (or zero rows) of DIM numbers: context vectors over all rows of ``docs``. Sums of integers, so any order gives the same.

    Each task sums its rows; the sums meet in CHUNKS chunks; BUCKETS * DIM numbers come to the driver, whatever the data.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIM, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for words in split_words(part.column("text").to_pylist()):
                    add_contexts(total, words)
        packed = [(k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(total.reshape(CHUNKS, -1)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], ["chunk", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(x), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["chunk", "sums"])

    prepare(docs.sparkSession)
    kind = "chunk int, sums binary"
    parts = docs.select(docs[text].cast("string").alias("text")).mapInArrow(tidy(count), kind)
    # tasks' sums are added in two steps, so that a chunk's last task reads a row of each group of tasks
    halves = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16))).repartition("chunk", "part").select("chunk", "sums").mapInArrow(tidy(add), kind)
    out = np.zeros((CHUNKS, BUCKETS * DIM // CHUNKS), np.float64)
    for r in halves.repartition("chunk").mapInArrow(tidy(add), kind).collect():
        out[r["chunk"]] = np.frombuffer(zlib.decompress(r["sums"]), np.int64)
    rows = out.reshape(BUCKETS, DIM)
    norms = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return (rows / np.where(norms > 0, norms, 1)).astype(np.float32)


FEATURES = 3 * DIM + 3


def pooled(vectors: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """A row a text: means of context, word and kind vectors, logs of words and of different buckets a word, and the
    share of words that repeat the one before (neighbours whose index vectors agree). Zeros without words."""
    n = len(texts)
    out, counts, different, again = np.zeros((n, FEATURES)), np.zeros(n), np.zeros(n), np.zeros(n)
    for words in split_words(texts):
        if not len(words.text):
            continue
        at = words.text * DIM
        for k, hashes in enumerate((words.word, words.kind)):
            places, signs = _index(hashes)
            out[:, (k + 1) * DIM : (k + 2) * DIM] += np.bincount((at[:, None] + places).ravel(), signs.ravel(), n * DIM).reshape(n, DIM)
        bucket = _buckets(words.word)
        # words of a text that share a bucket are one row of the product
        pairs, times = np.unique(words.text * BUCKETS + bucket, return_counts=True)
        owner, rows = pairs // BUCKETS, pairs % BUCKETS
        for start in range(0, len(pairs), 1 << 14):
            some = slice(start, start + (1 << 14))
            weighted = vectors[rows[some]] * times[some, None].astype(np.float32)
            first = np.flatnonzero(np.concatenate([[True], owner[some][1:] != owner[some][:-1]]))
            np.add.at(out, (owner[some][first], slice(0, DIM)), np.add.reduceat(weighted, first, axis=0))
        counts += np.bincount(words.text, minlength=n)
        different += np.bincount(owner, minlength=n)
        same = (words.word[1:] == words.word[:-1]) & (words.text[1:] == words.text[:-1])
        again += np.bincount(words.text[1:][same], minlength=n)
    some = counts > 0
    out[some, : 3 * DIM] /= counts[some, None]
    out[some, 3 * DIM] = np.log(counts[some])
    out[some, 3 * DIM + 1] = np.log(different[some] / counts[some])
    out[some, 3 * DIM + 2] = again[some] / counts[some]
    return out


@dataclass
class Network:
    """Scales of the features, two layers and the temperature of the logits; without layers ``bias`` alone is the logit."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.bias)
        w, b, v, c = self.layers
        return np.tanh((x - self.mean) / self.scale @ w + b) @ v + c

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> Network:
    """Fit on rows ``x`` with targets ``y`` (0 to 1) and weights: Adam on cross entropy, rows in a fixed random order."""
    total = weights.sum()
    prior = (weights @ y + 0.5) / (total + 1) if total else 0.5
    plain = Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), [], float(np.log(prior / (1 - prior))))
    kept = np.arange(len(y)) % 5 != 4
    if min(y[kept].sum(), (1 - y[kept]).sum()) < 2:  # one label alone, or hardly another
        return plain
    rng = np.random.default_rng(12)
    mean, scale = x[kept].mean(axis=0), x[kept].std(axis=0) + 1e-6
    z, t, w_ = (x[kept] - mean) / scale, y[kept], weights[kept] / weights[kept].mean()
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.full((), plain.bias)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(t))
        for at in range(0, len(t), BATCH):
            rows = order[at : at + BATCH]
            w, b, v, c = layers
            hidden = np.tanh(z[rows] @ w + b)
            error = (1 / (1 + np.exp(-np.clip(hidden @ v + c, -30, 30))) - t[rows]) * w_[rows] / len(rows)
            back = error[:, None] * v * (1 - hidden**2)
            grads = [z[rows].T @ back + DECAY * w, back.sum(axis=0), hidden.T @ error + DECAY * v, error.sum()]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] = layers[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    out = Network(mean, scale, layers, plain.bias)
    out.temperature = calibrated(out.logits(x[~kept]), y[~kept], weights[~kept])
    return out


def calibrated(logits: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The temperature of least cross entropy, by golden section over its logarithm; 1 without rows."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        return float(weights @ (np.logaddexp(0, z) - y * z))

    low, high, ratio = np.log(0.25), np.log(16.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(key: str = "doc_id"):
    """crc32 of the id's decimal text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(h, target): a row for each distinct text with labels that are not held out; target is their mean.

    Null ids, texts and labels teach nothing; an id with several texts labels each of them.
    """
    known = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("double").alias("y")).where("k IS NOT NULL AND y IS NOT NULL").where(~held_out("k"))
    known = known.groupBy("k").agg(F.avg("y").alias("y"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text")).where("k IS NOT NULL AND text IS NOT NULL").where(~held_out("k"))
    return rows.select("k", F.xxhash64("text").alias("h")).distinct().join(known, "k").groupBy("h").agg(F.avg("y").alias("target"))


@dataclass
class Model:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[str | None]) -> list[float]:
        return self.network.scores(pooled(self.vectors, texts)).tolist()


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Word vectors of all rows of ``docs``; a network of at most ``per_label`` distinct labelled texts of each label, chosen by a hash.

    Rows of a label weigh as much together as the label's distinct texts are of all, so scores keep the corpus's balance.
    """
    prepare(docs.sparkSession)
    vectors = context_vectors(docs, text)
    known = stage_table(labelled_texts(docs, labels, key, text, label).withColumn("good", F.col("target") >= 0.5), "quality-labels")
    sizes = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    part = known.withColumn("o", F.xxhash64("h", F.lit(12))).withColumn("part", F.pmod(F.col("o"), F.lit(PARTS)))
    # each part keeps a bounded number before they meet
    order = Window.partitionBy("good", "part").orderBy("o", "h")
    part = part.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_label)
    order = Window.partitionBy("good").orderBy("o", "h")
    picked = stage_table(part.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_label).select("h", "good", "target", "r"), "quality-sample")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS * DIM numbers

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # at most as many as are picked
        for batch in batches:
            for cut in slices(batch, "text"):
                fresh = []
                for i, h in enumerate(cut.column("h").to_pylist()):
                    if h not in done:
                        done.add(h)
                        fresh.append(i)
                kept = cut.take(pa.array(fresh, pa.int64()))
                rows = pooled(shared.value, kept.column("text").to_pylist()).astype(np.float32)
                yield pa.RecordBatch.from_arrays([kept.column("h"), pa.array([r.tobytes() for r in rows], pa.binary())], ["h", "x"])

    texts = docs.select(F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    chosen = texts.join(F.broadcast(picked.select("h")), "h", "left_semi").select("h", "text").mapInArrow(tidy(features), "h long, x binary").dropDuplicates(["h"])
    found = sorted(chosen.join(F.broadcast(picked), "h").collect(), key=lambda r: (r["r"], r["good"]))  # at most 2 * per_label rows
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found], np.float64).reshape(-1, FEATURES)
    own = {g: sum(r["good"] == g for r in found) for g in sizes}
    weights = np.array([sizes[r["good"]] / own[r["good"]] for r in found], np.float64)
    return Model(vectors, fit(x, np.array([r["target"] for r in found], np.float64), weights / (weights.mean() if len(weights) else 1)))


def score_columns(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: a row per input row. Null and empty texts and those of white space get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> list:
        scores = shared.value.scores(part.column("text").to_pylist())
        return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]

    named = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    return add_columns(named, "text", [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], work, drop_input=True)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, by a model of the labelled ones that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    return score_columns(docs, train(docs, read_table(spark, sf_dir, "labels")))
