"""Operator 7, language ID: blended-spectrum string kernels, Nystrom landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from quillmesh.llm.common import add_columns, prepare, read_table, slices, tidy

#: Documented bounds of the fit: distinct texts of each language and languages that are learnt from.
SAMPLE_PER_LANGUAGE, MAX_LANGUAGES = 300, 200
LANDMARKS_PER_LANGUAGE = 24
PARTS = 64
ORDERS, BINS, RIDGE = (1, 2, 3), 1 << 14, 1e-2
UNKNOWN = "und"
_LETTER = np.zeros(0x110000, bool)
_LETTER[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True


def presence(text: str) -> np.ndarray:
    """Bins of the distinct n-grams (code points, lower case, white space and signs as one blank) of a whole text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_LETTER[codes], codes, 32)
    if not len(codes):
        return np.zeros(0, np.int64)
    blank = codes == 32
    codes = np.concatenate(([32], codes[~(blank & np.concatenate(([True], blank[:-1])))], [32])).astype(np.uint64)
    seen = np.zeros(BINS, bool)
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        key = key[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in ORDERS and len(key):
            mixed = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            seen[(mixed >> np.uint64(50)).astype(np.int64)] = True
    return np.flatnonzero(seen)


def presence_rows(texts: list[str]) -> np.ndarray:
    """A row of presences for each text, scaled so that the product of two rows is the normalised kernel."""
    return _scaled((presence(text) for text in texts), len(texts))


def _scaled(bins: Iterable[np.ndarray], n: int) -> np.ndarray:
    out = np.zeros((n, BINS), np.float32)
    for row, found in zip(out, bins, strict=True):
        row[found] = 1 / np.sqrt(max(1, len(found)))
    return out


def presence_bits(text: str) -> bytes:
    """The bins of a whole text as BINS / 8 bytes."""
    seen = np.zeros(BINS, bool)
    seen[presence(text)] = True
    return np.packbits(seen).tobytes()


@dataclass
class Model:
    """Landmark rows and, for each language, a weight of each landmark."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Regression values by text and language: two matrix products for a batch."""
        return (presence_rows(texts) @ self.landmarks.T) @ self.weights


def fit(bits: list[bytes], labels: list[str], ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on presence bits, in the Nystrom space of evenly chosen landmarks; targets are +1 and -1."""
    languages = sorted(set(labels))
    labels_ = np.array(labels, dtype=object)
    unpacked = lambda some: _scaled((np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))) for x in some), len(some))
    chosen = [int(i) for x in languages for i in np.flatnonzero(labels_ == x)[:LANDMARKS_PER_LANGUAGE]]
    landmarks = unpacked([bits[i] for i in chosen])
    kernel = (landmarks @ landmarks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel) if len(chosen) else (np.zeros(0), np.zeros((0, 0)))
    used = values > 1e-6
    root = vectors[:, used] / np.sqrt(values[used])  # kernel ** -1/2
    # normal equations, a block of rows at a time: only landmarks are held as dense rows
    width = root.shape[1] + 1
    left, right = ridge * np.eye(width) / max(1, len(bits)), np.zeros((width, len(languages)))
    balance = {x: 1 / (labels_ == x).sum() for x in languages}
    for at in range(0, len(bits), 512):
        rows, own = unpacked(bits[at : at + 512]), labels[at : at + 512]
        features = np.concatenate([(rows @ landmarks.T).astype(np.float64) @ root, np.ones((len(rows), 1))], axis=1)
        weighted = features * np.array([balance[x] for x in own])[:, None]
        left += weighted.T @ features
        right += weighted.T @ np.array([[1.0 if x == y else -1.0 for y in languages] for x in own])
    solved = np.linalg.solve(left, right)
    # a constant landmark carries the intercept
    return Model(languages, landmarks, np.concatenate([root @ solved[:-1], solved[-1:]]).astype(np.float32))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Best language and score of each text; the score is the softmax of the regression values at slope 4."""
    labels, out = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    for at in range(0, len(known) if model.languages else 0, 32):
        part = known[at : at + 32]
        products = presence_rows([texts[i] for i in part]) @ model.landmarks.T
        values = products @ model.weights[:-1] + model.weights[-1]
        shares = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
        shares /= shares.sum(axis=1, keepdims=True)
        for i, row in zip(part, shares, strict=True):
            labels[i], out[i] = model.languages[int(row.argmax())], float(row.max())
    return labels, out


def held_out(key: str = "doc_id"):
    """crc32 of the id's decimal text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on at most SAMPLE_PER_LANGUAGE distinct texts of each language, chosen by a hash; held-out rows are never used."""
    rows = docs.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("k"))
    rows = rows.select("lang", F.xxhash64("text").alias("h"), "text")
    # copies count once; each of PARTS parts of a language keeps a bounded number of hashes before they meet
    part = rows.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.pmod(F.col("h"), F.lit(PARTS)))
    order = Window.partitionBy("lang", "part").orderBy("h")
    part = part.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_PER_LANGUAGE)
    order = Window.partitionBy("lang").orderBy("h")
    picked = part.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_PER_LANGUAGE)
    picked = picked.orderBy("r", "lang").limit(SAMPLE_PER_LANGUAGE * MAX_LANGUAGES).select("lang", "h", "r")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[str, int]] = set()  # at most as many as are picked
        for batch in batches:
            for cut in slices(batch, "text"):
                at = []
                for i, x in enumerate(zip(cut.column("lang").to_pylist(), cut.column("r").to_pylist(), strict=True)):
                    if x not in done:
                        done.add(x)
                        at.append(i)
                kept = cut.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept.column("lang"), kept.column("r"), pa.array([presence_bits(t) for t in kept.column("text").to_pylist()], pa.binary())], ["lang", "r", "bits"])

    prepare(docs.sparkSession)
    chosen = rows.join(F.broadcast(picked), ["lang", "h"]).select("lang", "r", "text")
    chosen = chosen.mapInArrow(tidy(bits), "lang string, r int, bits binary").dropDuplicates(["lang", "r"])
    found = sorted(chosen.collect(), key=lambda r: (r["r"], r["lang"]))
    return fit([bytes(r["bits"]) for r in found], [r["lang"] for r in found])


def language_columns(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per input row; ``und`` and 0 for a null text or one without letters."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks: bounded by LANDMARKS_PER_LANGUAGE * MAX_LANGUAGES rows

    def work(part: pa.RecordBatch) -> list:
        labels, scores = predict(shared.value, part.column("text").to_pylist())
        return [pa.array(labels, pa.string()), pa.array(scores, pa.float64())]

    named = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    return add_columns(named, "text", fields, work, drop_input=True)


def keep_known(docs: DataFrame, model: Model, text: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, that have a language with at least ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> list:
        labels, scores = predict(shared.value, part.column(text).to_pylist())
        return [pa.array([a != UNKNOWN and s >= min_score for a, s in zip(labels, scores, strict=True)])]

    return add_columns(docs, text, [T.StructField("known", T.BooleanType())], work, keep="known")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model of the labelled ones that are not held out; null texts are ``und``."""
    docs = read_table(spark, sf_dir, "documents")
    return language_columns(docs, train(docs))
