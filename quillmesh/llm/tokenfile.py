"""Operator 2, token ids in a binary file: an adaptive context-mixing range coder over independent blocks.

A file row is a run of whole documents: their ids and lengths, a prior, and blocks of at most BLOCK ids. The prior holds
the run's order-0 counts and its frequent order-1 pairs; it is the state to which every block resets. A block
carries the CRC-32 of its ids and needs the prior alone to be decoded. Since blocks don't depend on each other, all blocks of
a run are coded in step, one id of each at a time, in numpy: coder registers and adaptive state are arrays over blocks.

Each id is one step of the range coder. Its distribution is a mix of three: order 0, order 1 (a row for the id before), and
order 2 (what followed the two ids before the last time in this block, by a hashed table). The weights belong to a block
and a confidence of order 2; after each id they move to the shares that the three orders had in its probability. All
three are cumulative tables over the same order of ids, so the mix of tables is the table of the mix, and the decoder finds
an id by binary search in it. Weights are float32 under IEEE operations alone, so every machine computes the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillmesh.llm.common import TOKEN_SLICE_BYTES, doc_columns, partition_offsets, read_table, slices, stage_table, tidy
from quillmesh.llm.wordcache import tokenizer_cache

TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Ids of a block (2**16 at most), and of one file row unless one document has more. Ids are below 2**16.
BLOCK, RUN_IDS = 2048, 8 << 20
MAGIC = b"QMX2"
#: Cells of the order-1 table, which has a row for each of the most frequent ids; the others share order 0's.
CELLS = 8 << 20
#: Order-1 pairs that occur less often in a run are not worth their bytes in the prior.
LEAST_PAIR = 3
#: Later ids of an order-1 row, the commonest ones; each takes a share of the row's total, the others are left to order 0.
MOST_AFTER = 8192
#: Slots of a block's order-2 table.
SLOTS = 1024
_U = np.uint64
#: Totals of order 0 (and of the mix, before weights), of order 1, and of the weights, in bits.
_T0, _T1, _TW = 17, 15, 12
_TOTAL = _T0 + _TW
_RATE, _ROOM = np.float32(0.02), np.float32(0.98)
_START = (np.float32(0.78), np.float32(0.08))  # weights of order 1 and order 2


def _share(counts: np.ndarray, total: int, least: int) -> np.ndarray:
    """Integers in proportion to ``counts`` that sum to ``total``; ``least`` at least where a count is positive."""
    out = np.where(counts > 0, least + counts * (total - least * int((counts > 0).sum())) // max(1, int(counts.sum())), 0)
    out[int(counts.argmax())] += total - int(out.sum())
    return out


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts in half octaves, as bytes of the prior."""
    return np.searchsorted(_LEVELS, counts, side="right").astype(np.uint8) - 1


_LEVELS = np.array(sorted({1 << k for k in range(40)} | {3 << k for k in range(39)}), np.int64)


class Prior:
    """Tables of a run over its distinct ids ``vocab``: cumulative order-0 frequencies and order-1 rows."""

    def __init__(self, vocab: np.ndarray, counts: np.ndarray, sizes: np.ndarray, after: np.ndarray, level: np.ndarray):
        self.vocab, n = vocab, len(vocab)
        base = _share(counts.astype(np.int64), 1 << _T0, 1)
        self.zero = np.concatenate(([0], np.cumsum(base))).astype(np.int32)
        rows = np.zeros((len(sizes) + 1, n + 1), np.uint16)
        ends = np.cumsum(sizes)
        for k, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
            line = np.zeros(n, np.int64)
            if size:
                line[after[end - size : end]] = _share(_LEVELS[level[end - size : end]], 1 << _T1, 1)
            else:
                line = base >> (_T0 - _T1)
            np.cumsum(line, out=rows[k, 1:], dtype=np.uint16)
        np.cumsum(base >> (_T0 - _T1), out=rows[-1, 1:], dtype=np.uint16)
        self.one = rows.ravel()
        # the rows of contexts: those of the most frequent ids, in the order of their counts
        self.row = np.full(n, len(sizes), np.int64)
        self.row[np.argsort(-counts, kind="stable")[: len(sizes)]] = np.arange(len(sizes))
        self.row *= n + 1
        self.none = len(sizes) * (n + 1)

    @staticmethod
    def parts(ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids that occur, their counts, pairs of each context row, and the pairs' later ids and levels."""
        counts = np.bincount(ids, minlength=1)
        vocab = np.flatnonzero(counts)
        place = np.zeros(len(counts), np.int32)
        place[vocab] = np.arange(len(vocab))
        counts, n = counts[vocab], len(vocab)
        rows = min(n, max(1, CELLS // (n + 1)))
        rank = np.full(n, rows, np.int64)
        rank[np.argsort(-counts, kind="stable")[:rows]] = np.arange(rows)
        at = place[ids]
        pairs = np.bincount((rank * n)[at[:-1]] + at[1:], minlength=rows * n)[: rows * n] if len(ids) > 1 else np.zeros(rows * n, np.int64)
        kept = np.flatnonzero(pairs >= LEAST_PAIR)
        sizes = np.bincount(kept // n, minlength=rows)
        if (sizes > MOST_AFTER).any():
            order = np.lexsort((-pairs[kept], kept // n))
            within = np.arange(len(kept)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = np.sort(kept[order[within < MOST_AFTER]])
            sizes = np.minimum(sizes, MOST_AFTER)
        return vocab, counts, sizes, kept % n, _level(pairs[kept])

    @staticmethod
    def pack(vocab: np.ndarray, counts: np.ndarray, sizes: np.ndarray, after: np.ndarray, level: np.ndarray) -> bytes:
        """The prior as bytes; ids of a row ascend, so their differences are stored."""
        steps = np.diff(after, prepend=0)
        steps[np.cumsum(sizes)[:-1][sizes[1:] > 0]] = after[np.cumsum(sizes)[:-1][sizes[1:] > 0]] if len(after) else 0
        head = np.array([len(vocab), len(sizes), len(after)], "<u4").tobytes()
        body = [np.diff(vocab, prepend=0).astype("<u2"), counts.astype("<u4"), sizes.astype("<u2"), steps.astype("<u2"), level]
        # bytes of one weight stand together: they are alike
        planes = [x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"" for x in body]
        return zlib.compress(head + b"".join(planes), 9)

    @classmethod
    def unpack(cls, raw: bytes) -> Prior:
        data = zlib.decompress(raw)
        n, rows, pairs = np.frombuffer(data[:12], "<u4").tolist()
        out, at = [], 12
        for size, kind in ((n, "<u2"), (n, "<u4"), (rows, "<u2"), (pairs, "<u2"), (pairs, "u1")):
            width = np.dtype(kind).itemsize
            plane = np.frombuffer(data[at : at + size * width], np.uint8).reshape(width, size).T
            out.append(np.ascontiguousarray(plane).view(kind).reshape(size))
            at += size * width
        vocab, counts, sizes, steps, level = out
        sizes = sizes.astype(np.int64)
        run = np.cumsum(steps.astype(np.int64))
        starts = np.cumsum(sizes) - sizes
        before = np.concatenate(([0], run))[starts]  # of the row's start
        return cls(np.cumsum(vocab.astype(np.int64)), counts.astype(np.int64), sizes, run - np.repeat(before, sizes), level)


class _Encoder:
    """64-bit low and range of many blocks; 32-bit words come out, carries are added to them at the end."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
        self.carry = np.zeros(lanes, bool)  # to be added to the word that came out last
        self.events: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def code(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        """Narrow the ranges of the first ``n`` blocks to [start, start + size) of 2**_TOTAL."""
        low, wide = self.low[:n], self.range[:n]
        wide >>= _U(_TOTAL)
        more = low + wide * start.astype(_U)
        self.carry[:n] |= more < low
        low[:] = more
        wide *= size.astype(_U)
        out = np.flatnonzero(wide < _U(1 << 32))
        if len(out):
            self._put(out)
            wide[out] <<= _U(32)

    def _put(self, i: np.ndarray) -> None:
        self.events.append((i.astype(np.int32), (self.low[i] >> _U(32)).astype(np.uint32), self.carry[i]))
        self.low[i] <<= _U(32)
        self.carry[i] = False

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        self._put(every)
        self._put(every)
        lanes, words, carries = (np.concatenate(x) for x in zip(*self.events, strict=True))
        order = np.argsort(lanes, kind="stable")
        value = words[order].astype(_U)
        value[:-1] += carries[order][1:]  # a block's first word never gets one from the next block
        while (over := value >> _U(32)).any():
            value &= _U((1 << 32) - 1)
            value[:-1] += over[1:]
        raw, ends = value.astype("<u4"), np.cumsum(np.bincount(lanes, minlength=len(every)))
        return [x.tobytes() for x in np.split(raw, ends[:-1])]


class _Decoder:
    def __init__(self, coded: list[bytes]):
        words = [np.frombuffer(x, "<u4") for x in coded]
        sizes = np.array([len(w) for w in words])
        # two words more, for the reads that no id follows
        self.words = np.concatenate([*words, np.zeros(2, "<u4")]).astype(_U)
        self.at = np.cumsum(sizes) - sizes
        self.value = self.words[self.at] << _U(32) | self.words[self.at + 1]
        self.at = self.at + 2
        self.range = np.full(len(coded), (1 << 64) - 1, _U)

    def peek(self, n: int) -> np.ndarray:
        self.range[:n] >>= _U(_TOTAL)
        return np.minimum(self.value[:n] // self.range[:n], _U((1 << _TOTAL) - 1)).view(np.int64)

    def code(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        value, wide = self.value[:n], self.range[:n]
        value -= wide * start.astype(_U)
        wide *= size.astype(_U)
        out = np.flatnonzero(wide < _U(1 << 32))
        if len(out):
            at = np.minimum(self.at[out], len(self.words) - 1)
            value[out] = value[out] << _U(32) | self.words[at]
            wide[out] <<= _U(32)
            self.at[out] += 1


#: What a guess is trusted after it missed and after it hit, by its trust before.
_TRUST = np.array([1, 1, 1, 2, 1, 2, 3, 3], np.int32)


class _Mix:
    """Adaptive state of ``lanes`` blocks, reset to the prior. Frequencies are below 2**_TOTAL and so fit in 32 bits."""

    def __init__(self, prior: Prior, lanes: int):
        self.prior, self.lanes = prior, np.arange(lanes)
        self.weight = [np.full(4 * lanes, w, np.float32) for w in _START]  # by confidence and block
        self.held = np.zeros(lanes * SLOTS, np.int32)  # four times the guess, plus its trust
        self.first = self.lanes * SLOTS
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.row = np.full(lanes, prior.none, np.int64)
        self.mid, self.step = np.empty(lanes, np.int64), np.empty(lanes, np.int64)
        self.c0, self.c1, self.part = np.empty(lanes, np.int32), np.empty(lanes, np.int32), np.empty(lanes, np.uint16)
        self.less = np.empty(lanes, bool)

    def look(self, n: int) -> None:
        """Weights and guesses for the next id of the first ``n`` blocks."""
        mark = self.last[:n] * np.uint32(0x9E3B)
        mark += self.before[:n] * np.uint32(0x1F35B)
        mark >>= np.uint32(3)
        mark &= np.uint32(SLOTS - 1)
        self.slot = self.first[:n] + mark
        held = self.held.take(self.slot)
        self.two, self.sure = (held >> np.int32(2)).astype(np.int64), held & np.int32(3)
        self.cell = self.sure * np.int64(len(self.lanes))
        self.cell += self.lanes[:n]
        self.w = [w.take(self.cell) for w in self.weight]
        self.w1 = (self.w[0] * np.float32(1 << _TW)).astype(np.int32)
        w2 = (self.w[1] * np.float32(1 << _TW)).astype(np.int32)
        w2 *= self.sure > 0
        self.w0 = np.int32(1 << _TW) - self.w1
        self.w0 -= w2
        self.w1 <<= np.int32(_T0 - _T1)
        w2 <<= np.int32(_T0)
        self.bump = w2

    def _edge(self, n: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cumulative frequency below ``ids`` in orders 0 and 1 mixed, and the weighted frequencies of the two."""
        zero, one, after, at = self.prior.zero, self.prior.one, ids + 1, self.row[:n] + ids
        p0, p1, c0, c1 = zero.take(after), one.take(at + 1).astype(np.int32), zero.take(ids), one.take(at).astype(np.int32)
        p0 -= c0
        p0 *= self.w0
        p1 -= c1
        p1 *= self.w1
        c0 *= self.w0
        c1 *= self.w1
        c0 += c1
        return c0, p0, p1

    def find(self, n: int, value: np.ndarray) -> np.ndarray:
        """The ids in whose intervals ``value`` lies."""
        low, p0, p1 = self._edge(n, self.two)
        high = low + p0 + p1
        value = value.astype(np.int32)
        value = np.where(value < low, value, np.where(value < high + self.bump, low, value - self.bump))
        zero, one, row, w0, w1 = self.prior.zero, self.prior.one, self.row[:n], self.w0, self.w1
        mid, step, c0, c1, part, less = (x[:n] for x in (self.mid, self.step, self.c0, self.c1, self.part, self.less))
        at, left = np.zeros(n, np.int64), len(self.prior.vocab)
        while left > 1:
            half = left >> 1
            np.add(at, half, out=mid)
            zero.take(mid, out=c0, mode="clip")  # places are in range; other modes would copy
            c0 *= w0
            mid += row
            one.take(mid, out=part, mode="clip")
            np.multiply(part, w1, out=c1)
            c0 += c1
            np.less_equal(c0, value, out=less)
            np.multiply(less, half, out=step)
            at += step
            left -= half
        return at

    def interval(self, n: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, self.p0, self.p1 = self._edge(n, ids)
        self.hit = self.two == ids
        start += self.bump * (ids > self.two)
        self.p2 = self.bump * self.hit
        return start, self.p0 + self.p1 + self.p2

    def learn(self, n: int, ids: np.ndarray, size: np.ndarray) -> None:
        scale = _ROOM / size.astype(np.float32)
        for k, part in enumerate((self.p1, self.p2)):
            w, move = self.w[k], part.astype(np.float32)
            move *= scale
            move -= w
            move *= _RATE
            w += move
            self.weight[k][self.cell] = w
        sure, ids = self.sure, ids.astype(np.int64, copy=False)
        held = np.where(sure > 1, self.two, ids).astype(np.int32)
        held <<= np.int32(2)
        held |= _TRUST.take(self.hit * np.int32(4) + sure)
        self.held[self.slot] = held
        self.before[:n], self.last[:n] = self.last[:n], ids
        self.row[:n] = self.prior.row.take(ids)


def _steps(coder: _Encoder | _Decoder, prior: Prior, lengths: np.ndarray, ids: np.ndarray) -> None:
    """Code all blocks in step, the longest first; ``ids`` (places in the vocabulary, by step and block) are read or made."""
    mix, decoding = _Mix(prior, len(lengths)), isinstance(coder, _Decoder)
    for t in range(int(lengths[0])):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        mix.look(n)
        now = mix.find(n, coder.peek(n)) if decoding else ids[t, :n].astype(np.int64)
        start, size = mix.interval(n, now)
        coder.code(n, start, size)
        mix.learn(n, now, size)
        if decoding:
            ids[t, :n] = now


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[bytes]]:
    """(prior, blocks) of ``ids`` (below 2**16); a block is: magic, number of ids, their CRC-32, coded words."""
    n = -(-len(ids) // block)
    if not n:
        return b"", []
    parts = Prior.parts(ids)
    raw = Prior.pack(*parts)
    place = np.zeros(1 << 16, np.uint16)
    place[parts[0]] = np.arange(len(parts[0]))
    grid = np.zeros((n, block), np.uint16)
    grid.ravel()[: len(ids)] = place[ids]
    lengths = np.full(n, block)
    lengths[-1] = len(ids) - (n - 1) * block
    coder = _Encoder(n)
    _steps(coder, Prior.unpack(raw), lengths, np.ascontiguousarray(grid.T))
    sums = [zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()) for k in range(n)]
    return raw, [MAGIC + np.array([k, c], "<u4").tobytes() + coded for k, c, coded in zip(lengths.tolist(), sums, coder.finish(), strict=True)]


def decode_blocks(prior: bytes, blocks: list[bytes]) -> np.ndarray:
    """The ids of blocks in a row; a block whose ids don't fit its checksum raises ValueError."""
    if not blocks:
        return np.zeros(0, np.uint16)
    heads = [np.frombuffer(b[4:12], "<u4").tolist() for b in blocks]
    lengths = np.array([h[0] for h in heads])
    if any(b[:4] != MAGIC for b in blocks) or not len(lengths) or lengths.min() < 1 or lengths.max() > 1 << 16:
        raise ValueError("a token block is damaged")
    order = np.argsort(-lengths, kind="stable")
    known = Prior.unpack(prior)
    out = np.zeros((int(lengths.max()), len(blocks)), np.uint16)
    _steps(_Decoder([blocks[k][12:] for k in order]), known, lengths[order], out)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    lines = np.ascontiguousarray(out.T)
    rows = [known.vocab[lines[back[k], : lengths[k]]].astype(np.uint16) for k in range(len(blocks))]
    for h, row in zip(heads, rows, strict=True):
        if zlib.crc32(row.astype("<u4").tobytes()) != h[1]:
            raise ValueError("a token block is damaged")
    return np.concatenate(rows)


RUN = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("prior", T.BinaryType()),
        T.StructField("blocks", T.ArrayType(T.BinaryType())),
    ]
)


def _rows(part: int, at: int, docs: list, counts: list[int], ids: list[bytes]) -> pa.RecordBatch:
    flat = np.frombuffer(b"".join(ids), "<u2")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
    values = [part, at, len(flat), docs, counts, *encode_blocks(flat)]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], RUN.fieldNames())


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode documents in ascending doc_id order (null ids first) and write the file rows; the table that is read back.

    Range partitions keep the order; ``part`` is a partition's place and ``part_start`` the ids before a row in it.
    A null or empty text has its end id alone. Rows that share one id, or none, share a task. The ids of ``tokenizer``
    must be below 2**16.
    """
    import public_tokenizers

    path = tokenizer or public_tokenizers.path(TOKENIZER)
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, at = tokenizer_cache(path, spaced=False, width="<u2"), TaskContext.get().partitionId(), 0
        docs_, counts, ids, held = [], [], [], 0
        for batch in batches:
            for piece in slices(batch, "text", TOKEN_SLICE_BYTES):
                flat, ends = cache.encode(piece.column("text"))
                starts, raw = [0, *ends[:-1].tolist()], flat.tobytes()
                for doc, a, b in zip(piece.column("doc_id").to_pylist(), starts, ends.tolist(), strict=True):
                    docs_.append(doc)
                    counts.append(b - a + 1)
                    ids.append(raw[2 * a : 2 * b] + end)
                    held += b - a + 1
                    if held >= RUN_IDS:
                        yield _rows(part, at, docs_, counts, ids)
                        at, docs_, counts, ids, held = at + held, [], [], [], 0
        if docs_:
            yield _rows(part, at, docs_, counts, ids)

    ordered = doc_columns(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return stage_table(ordered.mapInArrow(tidy(run, (path, False, "<u2")), RUN), "token-file", "uncompressed")


def read_tokens(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of each document, decoded from file rows."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "part", "start", "n_tokens")] + [T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = decode_blocks(row["prior"], row["blocks"]).astype("<u4").tobytes()
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                starts = row["part_start"] + ends - counts
                for a in range(0, len(counts), 4096):
                    b = min(a + 4096, len(counts))
                    cut = [raw[4 * (e - c) : 4 * e] for e, c in zip(ends[a:b].tolist(), counts[a:b].tolist(), strict=True)]
                    part = np.full(b - a, row["part"], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][a:b], pa.int64()), pa.array(part), pa.array(starts[a:b]), pa.array(counts[a:b]), pa.array(cut, pa.binary())], schema.fieldNames())

    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("total"))
    offsets = partition_offsets(totals, "part", "total")
    docs = rows.mapInArrow(tidy(run), schema).join(F.broadcast(offsets), "part")  # a row for each task that wrote
    return docs.select("doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids that the written file gives back, a row per document; null texts have the end id alone."""
    back = read_tokens(write_tokens(read_table(spark, sf_dir, "documents")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
