"""Operator 6, media columns: GIF files, written and decoded by their own LZW code streams."""

from __future__ import annotations

import functools
import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillmesh.llm.common import add_columns, doc_columns, read_table, stage_table

#: A payload is a column of rows this wide; a frame has at most this many rows, further rows go to further frames.
WIDTH, ROWS, DELAY_CS = 64, 4096, 10
_CLEAR, _END = 256, 257


@dataclass
class Frame:
    """One composed picture: its time in centiseconds, RGB pixels, those of its own rectangle, and that one's palette indices."""

    start_cs: int
    delay_cs: int
    rgb: np.ndarray
    drawn: np.ndarray
    indices: np.ndarray
    transparent: int | None


def _widths(n: int, bits: int) -> np.ndarray:
    """Bits of the codes after a clear code: the decoder's table has grown by one entry per code but the first."""
    entries = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, bits + 1, 12)


@functools.cache
def _cut(n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the first ``n`` codes after a clear code, and where they end, in bits."""
    width = _widths(n, bits).astype(np.int32)
    return width, np.cumsum(width, dtype=np.int32)


def lzw_encode(data: bytes) -> bytes:
    """Code stream of 8-bit samples: greedy matches, a clear code whenever the table is full."""
    codes = [_CLEAR]
    put, table, free, current = codes.append, {}, _END + 1, data[0]
    get = table.get
    for b in data[1:]:
        key = current << 8 | b
        code = get(key)
        if code is not None:
            current = code
            continue
        put(current)
        if free < 4096:
            table[key] = free
            free += 1
        else:
            put(_CLEAR)
            table.clear()
            free = _END + 1
        current = b
    codes += [current, _END]
    values = np.array(codes, np.int64)
    clears = np.flatnonzero(values == _CLEAR)
    sizes = np.diff(np.concatenate((clears, [len(values)])))
    longest = _widths(int(sizes.max()) + 1, 8)
    # a clear code itself is read at the width that its predecessors reached
    place = np.arange(len(values)) - np.repeat(clears, sizes)
    width = longest[np.maximum(place - 1, 0)]
    inner = clears[1:]
    width[inner] = longest[sizes[:-1] - 1]
    width[0] = 9
    ends = np.cumsum(width)
    total = int(ends[-1])
    bits = np.zeros(-(-total // 8) * 8, np.uint8)
    starts = ends - width
    for k in range(12):
        on = width > k
        bits[starts[on] + k] = values[on] >> k & 1
    return np.packbits(bits, bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, count: int) -> bytes:
    """At most ``count`` samples of a code stream with ``bits``-bit samples; ValueError for an impossible code.

    Codes between two clear codes have known widths, so they are cut out of the bits at once. The string of the
    m-th table entry is what the m-th code of its section gave and one sample more, which stand together in the output.
    So each code is a copy of an earlier place of the output; lengths and samples follow by doubling of those pointers.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    if not 1 <= bits <= 8:
        raise ValueError("samples of impossible size")
    raw = np.frombuffer(stream + bytes(4), np.uint8)
    size = 8 * len(stream)
    parts, firsts = [], []
    at = codes_in = 0
    while at + bits < size and codes_in < count:  # a code gives one sample or more
        n = 4096
        while True:
            width, ends = _cut(n, bits)
            fit = min(n, int(np.searchsorted(ends, size - at, side="right")))
            begin = at + ends[:fit] - width[:fit]
            byte = begin >> 3
            codes = (raw[byte] | raw[byte + 1].astype(np.int32) << 8 | raw[byte + 2].astype(np.int32) << 16) >> (begin & 7)
            codes &= (1 << width[:fit]) - 1
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop) or fit < n:
                break
            n *= 2
        last = int(stop[0]) if len(stop) else len(codes)
        if last:
            parts.append(codes[:last])
            firsts.append(np.full(last, codes_in, np.int32))
            codes_in += last
        if not len(stop) or codes[last] == end:
            break
        at += int(ends[last])
    if not parts:
        return b""
    codes, first = np.concatenate(parts), np.concatenate(firsts)
    every = np.arange(len(codes), dtype=np.int32)
    copied = codes > end
    source = np.where(copied, first + codes - end - 1, every)  # the code whose output is copied
    if (copied & (source >= every)).any() or (codes[first] >= clear).any():
        raise ValueError("LZW code out of range")
    length, jump = copied.astype(np.int32), source
    while True:  # 1 + the number of hops to a code that is a sample
        more = length[jump]
        if not more.any():
            break
        length += more
        jump = jump[jump]
    length += 1
    ends = np.cumsum(length, dtype=np.int64)
    # codes behind the last sample that is asked for make none: what a stream could make does not count
    used = int(np.searchsorted(ends, count)) + 1
    length, ends, source, copied, codes = (x[:used] for x in (length, ends, source, copied, codes))
    place = ends - length
    total = int(ends[-1])
    pointer = np.arange(total, dtype=np.int32) - np.repeat((place - place[source]).astype(np.int32), length)
    for _ in range((2 * int(length.max())).bit_length()):  # within a string, then at the start of the next one
        pointer = pointer[pointer]
    samples = np.zeros(total, np.uint8)
    samples[place[~copied]] = codes[~copied]
    return samples[pointer].tobytes()[:count]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def _u16(*values: int) -> bytes:
    return b"".join(v.to_bytes(2, "little") for v in values)


def gif_encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY_CS) -> bytes:
    """A GIF89a whose grey palette index is the sample; ``payload`` is a positive multiple of ``width`` bytes."""
    height = min(len(payload) // width, rows)
    out = [b"GIF89a", _u16(width, height), b"\xf7\0\0", bytes(v for i in range(256) for v in (i, i, i))]
    for at in range(0, len(payload), width * rows):
        part = payload[at : at + width * rows]
        out += [b"\x21\xf9\x04\x04", _u16(delay), b"\0\0"]
        out += [b"\x2c", _u16(0, 0, width, len(part) // width), b"\0\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


#: Pixels of a frame or a canvas at most; of a canvas that any first frame may have, else SPARE times the first frame's.
MAX_PIXELS, LEAST_CANVAS, SPARE = 1 << 24, 1 << 20, 16


def gif_decode(data: bytes) -> list[Frame]:
    """Frames as shown: local or global palette, interlace, transparency, and disposal of the frame before.

    A file that is cut (it has no trailer), or has impossible blocks, codes or too few samples, raises ValueError. So does a
    frame or a canvas of more than MAX_PIXELS, or a canvas far larger than what its frames hold: memory is bounded before
    it is taken.
    """
    try:
        return _gif_decode(data)
    except IndexError as cut:
        raise ValueError("the file is cut") from cut


def _gif_decode(data: bytes) -> list[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")

    def u16(i: int) -> int:
        return int.from_bytes(data[i : i + 2], "little")

    def palette(i: int, flags: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, i
        n = 2 << (flags & 7)
        if len(data) < i + 3 * n:
            raise ValueError("the file is cut")
        return np.frombuffer(data[i : i + 3 * n], np.uint8).reshape(n, 3), i + 3 * n

    def sub_blocks(i: int) -> tuple[bytes, int]:
        parts = []
        while data[i]:
            parts.append(data[i + 1 : i + 1 + data[i]])
            i += 1 + data[i]
        return b"".join(parts), i + 1

    width, height = u16(6), u16(8)
    shared, at = palette(13, data[10])
    canvas = np.zeros((0, 0, 3), np.uint8)  # taken when the first frame has its samples
    frames: list[Frame] = []
    time, delay, disposal, transparent = 0, 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                flags = data[at + 3]
                disposal, delay = flags >> 2 & 7, u16(at + 4)
                transparent = data[at + 6] if flags & 1 else None
            _, at = sub_blocks(at + 2)
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown GIF block")
        x, y, w, h, flags = u16(at + 1), u16(at + 3), u16(at + 5), u16(at + 7), data[at + 9]
        if w * h > MAX_PIXELS:
            raise ValueError("a frame is too large")
        own, at = palette(at + 10, flags)
        bits = data[at]
        stream, at = sub_blocks(at + 1)
        samples = lzw_decode(stream, bits, w * h)
        if len(samples) < w * h:
            raise ValueError("a frame's code stream is short")
        if not frames:
            if width * height > min(MAX_PIXELS, max(LEAST_CANVAS, SPARE * w * h)):
                raise ValueError("the canvas is too large for its first frame")
            canvas = np.zeros((height, width, 3), np.uint8)
        indices = np.frombuffer(samples, np.uint8).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(first, h, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
            woven = np.empty_like(indices)
            woven[order] = indices
            indices = woven
        colours = own if own is not None else shared
        if colours is None:
            raise ValueError("a frame has no palette")
        before = canvas.copy() if disposal == 3 else None
        h2, w2 = max(0, min(h, height - y)), max(0, min(w, width - x))
        view, seen = canvas[y : y + h2, x : x + w2], indices[:h2, :w2]
        if len(colours) < 256 and seen.size and int(seen.max()) >= len(colours):
            raise ValueError("a sample is not in the palette")
        picture = colours.take(seen, axis=0)
        if transparent is None:
            view[:] = picture
        else:
            np.copyto(view, picture, where=(seen != transparent)[:, :, None])
        shown_canvas = canvas.copy()
        frames.append(Frame(time, delay, shown_canvas, shown_canvas[y : y + h2, x : x + w2], indices, transparent))
        time += delay
        if disposal == 2:
            view[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, transparent = 0, 0, None
    if at >= len(data):
        raise ValueError("the file is cut")
    return frames


def histogram(frame: Frame, bins: int = 4) -> np.ndarray:
    """Pixels that the frame itself draws, by their colour on the canvas, each channel in ``bins`` equal steps: red slowest."""
    q = frame.drawn.reshape(-1, 3).astype(np.int64) * bins >> 8
    return np.bincount((q[:, 0] * bins + q[:, 1]) * bins + q[:, 2], minlength=bins**3)


def payload_of(text: str | None, unit: int = WIDTH) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a GIF of the text's bytes): a row per input row; a null text is one row of zeros."""

    def work(part: pa.RecordBatch) -> list:
        made = [payload_of(t) for t in part.column("text").to_pylist()]
        return [pa.array([n for n, _ in made], pa.int64()), pa.array([gif_encode(p) for _, p in made], pa.binary())]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    return add_columns(doc_columns(docs), "text", fields, work, drop_input=True, limit=1 << 20)


FRAME = T.ArrayType(
    T.StructType(
        [
            T.StructField("start_cs", T.LongType()),
            T.StructField("delay_cs", T.LongType()),
            T.StructField("width", T.LongType()),
            T.StructField("height", T.LongType()),
            T.StructField("histogram", T.ArrayType(T.LongType())),
            T.StructField("rgb", T.BinaryType()),
        ]
    )
)
_ARROW_FRAMES = pa.list_(pa.struct([("start_cs", pa.int64()), ("delay_cs", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("histogram", pa.list_(pa.int64())), ("rgb", pa.binary())]))


def _frame_row(f: Frame, pixels: bool) -> dict:
    height, width = f.rgb.shape[:2]
    return {"start_cs": f.start_cs, "delay_cs": f.delay_cs, "width": width, "height": height, "histogram": histogram(f).tolist(), "rgb": f.rgb.tobytes() if pixels else None}


def _decoded(data: bytes | None) -> tuple[list[Frame] | None, str | None]:
    """Frames, or None and why there are none."""
    if data is None:
        return None, None
    try:
        return gif_decode(data), None
    except ValueError as e:
        return None, str(e)


def frame_columns(media: DataFrame, column: str = "media", pixels: bool = True) -> DataFrame:
    """``media`` with ``frames``, timed frames with colour histograms and, with ``pixels``, composed RGB, and ``error``.

    Null media has null frames and no error; malformed media has null frames and says why in ``error``.
    """

    def work(part: pa.RecordBatch) -> list:
        found = [_decoded(data) for data in part.column(column).to_pylist()]
        rows = [None if frames is None else [_frame_row(f, pixels) for f in frames] for frames, _ in found]
        return [pa.array(rows, _ARROW_FRAMES), pa.array([e for _, e in found], pa.string())]

    return add_columns(media, column, [T.StructField("frames", FRAME), T.StructField("error", T.StringType())], work, limit=1 << 20)


DIGESTS = [
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("frames", FRAME),
    T.StructField("error", T.StringType()),
]


def frame_table(media: DataFrame) -> DataFrame:
    """Digests of the stored bytes and of the samples that decoding gives back, and the timed frames with their histograms.

    The pixels stay in the GIF, which is their lossless form. Null or malformed media has null digests of samples and
    null frames; ``error`` tells why.
    """

    def work(part: pa.RecordBatch) -> list:
        rows = []
        for data in part.column("media").to_pylist():
            frames, error = _decoded(data)
            stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
            if frames is None:
                rows.append((None, None, None, *stored, None, error))
                continue
            payload = b"".join(f.indices.tobytes() for f in frames)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, [_frame_row(f, False) for f in frames], None))
        columns = zip(*rows, strict=True)
        return [pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), _ARROW_FRAMES, pa.string()], strict=True)]

    return add_columns(media, "media", DIGESTS, work, drop_input=True, limit=1 << 20)


def with_feature(frames: DataFrame) -> DataFrame:
    """``frames`` replaced by n_frames, duration_cs and ``feature``: 64 shares of drawn pixels by colour, in per mille, rounded down."""
    zero = F.array_repeat(F.lit(0).cast("long"), 64)
    total = F.aggregate("frames", zero, lambda s, f: F.zip_with(s, f["histogram"], lambda a, b: a + b))
    summed = F.aggregate("__total", F.lit(0).cast("long"), lambda s, x: s + x)
    share = F.array_join(F.transform("__total", lambda x: F.floor(x * 1000 / F.col("__sum")).cast("string")), ",")
    out = frames.withColumn("__total", total).withColumn("__sum", summed)
    out = out.withColumn("n_frames", F.when(F.col("frames").isNotNull(), F.size("frames")).cast("long"))
    out = out.withColumn("duration_cs", F.aggregate("frames", F.lit(0).cast("long"), lambda s, f: s + f["delay_cs"]))
    return out.withColumn("feature", share).drop("frames", "__total", "__sum")


def media_digests(media: DataFrame) -> DataFrame:
    """The columns of :func:`frame_table` with the feature of its frames, which are stored and read back."""
    return with_feature(stage_table(frame_table(media), "gif-frames"))


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of every text as a GIF, both written and read back; a null text is a payload of zeros."""
    return media_digests(stage_table(media_table(read_table(spark, sf_dir, "documents")), "gif", "uncompressed"))
