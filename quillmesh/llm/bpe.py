"""Operator 9, byte-level BPE by length-bucketed padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, types as T

from quillmesh.llm.common import TOKEN_SLICE_BYTES, add_columns, doc_columns, read_table, worker_state
from quillmesh.llm.wordcache import CACHE_WORDS, WordCache, split_ids

RANKS = "byte_bpe_50k.tiktoken"
#: Pieces of more bytes are merged one by one through a heap of pairs: rounds over a matrix would cost their square.
MATRIX_BYTES = 256
_NONE = np.int64(1 << 40)


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.vocab = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocab[rank] = token
        self.pieces: dict[bytes, bytes] = {}  # matches of texts before; bounded
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # every way to cut a token into two tokens, in an open-addressing table of (left, right) -> rank
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(rank)
        self.bits = max(4, (8 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        key, value = np.array(keys, np.int64), np.array(values, np.int64)
        slot = self._slot(key)
        self.probes = 1
        while len(key):
            free = self.keys[slot] == -1
            first = np.zeros(len(key), bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            key, value, slot = key[~put], value[~put], (slot[~put] + 1) & (size - 1)
            self.probes += bool(len(key))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's token; _NONE where there is none or an end is padding (-1)."""
        key = left << 20 | right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        found = np.full(key.shape, _NONE, np.int64)
        open_ = np.flatnonzero(key.ravel() >= 0)
        key, slot, flat = key.ravel(), slot.ravel(), found.ravel()
        size = len(self.keys)
        while len(open_):
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            flat[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
            slot[open_] = (slot[open_] + 1) & (size - 1)
        return flat.reshape(found.shape)

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        ids = np.full((len(pieces), width + 1), -1, np.int64)
        inside = np.arange(width + 1) < lengths[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        rows, count = np.arange(len(pieces)), lengths.copy()
        while len(rows):
            best = ranks.argmin(axis=1)  # the leftmost of the least
            line = np.arange(len(rows))
            least = ranks[line, best]
            done = least == _NONE
            for r in np.flatnonzero(done):
                out[rows[r]] = ids[r, : count[r]].copy()
            if done.any():
                keep = ~done
                rows, ids, ranks, count, best, least = rows[keep], ids[keep], ranks[keep], count[keep], best[keep], least[keep]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            # compaction: what stands right of the merged pair moves one place left
            column = np.arange(ids.shape[1] - 1)
            ids = np.where(column <= best[:, None], ids[:, :-1], ids[:, 1:])
            ids = np.concatenate([ids, np.full((len(rows), 1), -1, np.int64)], axis=1)
            ids[line, best] = least
            count = count - 1
            column = np.arange(ranks.shape[1] - 1)
            ranks = np.concatenate([np.where(column <= best[:, None], ranks[:, :-1], ranks[:, 1:]), np.full((len(rows), 1), _NONE)], axis=1)
            ranks[line, best] = self.pair_ranks(ids[line, best], ids[line, best + 1])
            left = np.maximum(best - 1, 0)
            before = self.pair_ranks(ids[line, left], ids[line, left + 1])
            ranks[line, left] = np.where(best > 0, before, ranks[line, left])
            width = int(count.max())
            ids, ranks = ids[:, : width + 1], ranks[:, :width]
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, vocab, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.vocab, self.ranks.get

        def rank(i: int) -> int | None:
            j = after[i]
            return get(vocab[ids[i]] + vocab[ids[j]]) if j < n else None

        heap = [(r, i) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (new := rank(k)) is not None:
                    heapq.heappush(heap, (new, k))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; pieces of similar length share a matrix."""
        out = [np.zeros(0, np.int64)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = np.array([whole])
            elif len(piece) > MATRIX_BYTES:
                out[i] = self._long(piece)
            elif piece:
                buckets.setdefault((len(piece) - 1).bit_length() * 4 + (len(piece) > 3 * (1 << (len(piece) - 1).bit_length()) // 4), []).append(i)
        for members in buckets.values():
            for at in range(0, len(members), 8192):
                part = members[at : at + 8192]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit: its pattern matches are encoded apart, each distinct match once."""
        cut = [[p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(t)] for t in texts]
        ids = self.pieces
        if len(ids) > CACHE_WORDS:
            ids.clear()
        distinct = list({p for c in cut for p in c if p not in ids})
        ids.update(zip(distinct, [x.astype("<u4").tobytes() for x in self.encode_pieces(distinct)], strict=True))
        return [b"".join([ids[p] for p in c]) for c in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        vocab = self.vocab
        return b"".join([vocab[i] for i in ids.tolist()])


def loaded(path: str, pattern: str) -> tuple[Bpe, WordCache]:
    def make() -> tuple[Bpe, WordCache]:
        bpe = Bpe(path, pattern)
        return bpe, WordCache(bpe.encode_many, spaced=True)

    return worker_state((path, pattern), make)


COLUMNS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("decoded", T.BinaryType()),
]


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded bytes: a row per input row; a null text is empty."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def work(part: pa.RecordBatch) -> list:
        bpe, cache = loaded(path, pattern)
        ids = split_ids(*cache.encode(part.column("text")))
        back = [bpe.decode(np.frombuffer(x, "<u4")) for x in ids]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())]

    return add_columns(doc_columns(docs), "text", COLUMNS, work, drop_input=True, limit=TOKEN_SLICE_BYTES, state=(path, pattern))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As :func:`encode_documents`, with SHA-256 of ids and decoded bytes in place of the bytes."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def work(part: pa.RecordBatch) -> list:
        bpe, cache = loaded(path, pattern)
        ids = split_ids(*cache.encode(part.column("text")))
        back = [hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in ids]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(back)]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return add_columns(doc_columns(docs), "text", fields, work, drop_input=True, limit=TOKEN_SLICE_BYTES, state=(path, pattern))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
