"""Tokens of whole texts from the tokens of their words, with a bounded cache of words in each Python worker.

A tokenizer whose pre-tokens never cross the place between a word and a following single space or line feed gives
the same ids word by word. Words are cut with ``str.split``; only words that the cache lacks reach the tokenizer.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillmesh.llm.common import worker_state

#: Words of one generation of a worker's cache. A full generation becomes the old one, and words still in use move
#: to the next, so two generations bound the memory; the limit changes speed alone.
CACHE_WORDS = 300_000


#: ASCII signs that are cut from a word's end: with a letter before them, both kinds of tokenizers see them as one piece apart.
#: Not the apostrophe, which can begin a piece of signs and letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below this are one code point in any normal form, but for one that is two in lower case.
SIMPLE = "\u0180"
_LETTERS = "".join(c for c in map(chr, range(ord(SIMPLE))) if c.isalpha() and c.lower().isalpha())
#: Words of simple letters, one piece to both kinds of tokenizers.
_PLAIN, _PLAIN_CHARS = f"\\A[{_LETTERS}]+\\z", 100
_ODD = bytes(bytearray(8))  # stands for words that can't be encoded alone; known by identity


def _listed(values: pa.Array) -> list:
    """``to_pylist`` without an Arrow scalar for each value."""
    return values.to_numpy(zero_copy_only=False).tolist()


class WordCache:
    """``encode_many`` maps texts to their ids as bytes. ``spaced``: a word's ids depend on the space before it (byte-level BPE).

    Texts with a string of ``special`` in them, in any case, go whole to ``encode_whole``. ``encode_plain`` maps words of simple
    letters, with the space before them, to their ids; with it, signs at a word's end and a line feed before it are encoded
    apart. ``lower``: the tokenizer has one id for both cases of letters.
    """

    def __init__(
        self,
        encode_many: Callable[[list[str]], list[bytes]],
        spaced: bool,
        width: str = "<u4",
        limit: int = CACHE_WORDS,
        special: tuple[str, ...] = (),
        encode_whole: Callable[[list[str]], list[bytes]] | None = None,
        encode_plain: Callable[[list[str]], list[bytes]] | None = None,
        lower: bool = False,
    ):
        self.encode_plain, self.lower, self.marks = encode_plain, lower, {}
        self.encode_many, self.spaced, self.width, self.limit = encode_many, spaced, np.dtype(width), limit
        self.special, self.encode_whole = special, encode_whole or encode_many
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    @staticmethod
    def _odd(word: str) -> bool:
        """Words that can't be encoded alone: white space beyond a leading line feed touches their neighbours."""
        body = word[1:] if word[:1] == "\n" else word
        return not body or not body.isprintable()  # spaces are not in a word, other white space isn't printable

    def _known(self, distinct: list[str]) -> list[bytes]:
        """Ids of each word, _ODD for odd ones."""
        if len(self.words) > self.limit:
            self.words, self.old, self.cores = {}, self.words, {}
        words = self.words
        out = list(map(words.get, distinct))
        gaps = [i for i, x in enumerate(out) if x is None]
        if gaps:
            new = [distinct[i] for i in gaps]
            found = list(map(self.old.get, new))
            lack = [i for i, x in enumerate(found) if x is None]
            for i, x in zip(lack, self._fresh([new[i] for i in lack], self.spaced), strict=True):
                found[i] = x
            words.update(zip(new, found, strict=True))
            for i, x in zip(gaps, found, strict=True):
                out[i] = x
        return out

    def _fresh(self, words: list[str], space: bool) -> list[bytes]:
        """Ids of each word, with a ``space`` before it unless a line feed leads it; _ODD for odd ones where spaces count."""
        out: list = [None] * len(words)
        if self.encode_plain and words:
            column = pa.array(words, pa.string())
            cores = pc.utf8_rtrim(column, characters=MARKS)
            fed = pc.starts_with(cores, "\n")
            bare = pc.utf8_ltrim(cores, characters="\n") if self.spaced else cores
            plain = pc.and_(pc.match_substring_regex(bare, _PLAIN), pc.less(pc.utf8_length(bare), _PLAIN_CHARS))
            at = np.flatnonzero(plain.to_numpy(zero_copy_only=False)).tolist()
            fed, bare = fed.filter(plain), bare.filter(plain)
            bare = pc.utf8_lower(bare) if self.lower else bare
            coded = (pc.if_else(fed, bare, pc.binary_join_element_wise(" ", bare, "")) if space else bare).dictionary_encode()
            made = self._cores(_listed(coded.dictionary))
            signs = _listed(pc.subtract(pc.binary_length(column), pc.binary_length(cores)).filter(plain))
            for i, k, n, f in zip(at, _listed(coded.indices), signs, _listed(fed), strict=True):
                x = made[k] + self._apart(words[i][-n:]) if n else made[k]
                out[i] = self._apart("\n") + x if f else x
        rest = [i for i, x in enumerate(out) if x is None]
        if self.spaced and space:
            for i in rest:
                out[i] = _ODD if self._odd(words[i]) else None
            rest = [i for i in rest if out[i] is None]
        left = [words[i] for i in rest]
        for i, x in zip(rest, self.encode_many([w if w[:1] == "\n" else " " + w for w in left] if space else left), strict=True):
            out[i] = x
        return out

    def _cores(self, cores: list[str]) -> list[bytes]:
        out = list(map(self.cores.get, cores))
        gaps = [i for i, x in enumerate(out) if x is None]
        new = [cores[i] for i in gaps]
        for i, w, x in zip(gaps, new, self.encode_plain(new) if new else [], strict=True):
            out[i] = self.cores[w] = x
        return out

    def _apart(self, signs: str) -> bytes:
        """Ids of signs that are a piece of their own."""
        if signs not in self.marks:
            if len(self.marks) > 1000:
                self.marks.clear()
            self.marks[signs] = self.encode_whole([signs])[0]
        return self.marks[signs]

    def encode(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ends): ends[i] ids belong to the texts up to i. A null text is empty."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        held = [pc.match_substring(column, x, ignore_case=True).to_numpy(zero_copy_only=False) for x in self.special]
        whole = np.flatnonzero(np.logical_or.reduce(held)) if held else np.zeros(0, np.int64)
        if not len(whole):
            return self._encode(column)
        ids, ends = self._encode(pc.if_else(pa.array(np.logical_or.reduce(held)), "", column))
        own = [np.frombuffer(x, self.width) for x in self.encode_whole(_listed(column.take(pa.array(whole))))]
        between = np.split(ids, ends[whole])
        joined = [x for pair in zip(between, own, strict=False) for x in pair] + [between[-1]]
        more = np.zeros(len(ends), np.int64)
        more[whole] = [len(x) for x in own]
        return np.concatenate(joined), ends + np.cumsum(more)

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(column)
        # "X\nY" is cut before the line feed, which then leads its word
        cut = pc.split_pattern(pc.replace_substring(column, "\n", " \n" if self.spaced else " "), " ")
        coded = cut.flatten().dictionary_encode()
        known = self._known(_listed(coded.dictionary))
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        item = self.width.itemsize
        pool = known
        own = len(pool)
        if self.spaced:
            odd = np.fromiter((x is _ODD for x in known), bool, own)
            whole = np.zeros(n, bool)
            if odd.any():
                bad = np.concatenate(([0], np.cumsum(odd[codes])))
                whole = bad[bounds[1:]] > bad[bounds[:-1]]
            first = _listed(coded.dictionary.take(pa.array(codes[bounds[:-1]])))
            whole |= np.array([w[:1] == "\n" for w in first], bool) if n else False
            # a first word has no space before it; a text with odd words is encoded as one
            heads = [i for i in range(n) if not whole[i]]
            alone = [i for i in range(n) if whole[i]]
            pool += self._fresh([first[i] for i in heads], False) + self.encode_many(_listed(column.take(pa.array(alone, pa.int64()))))
            codes[bounds[:-1][heads]] = np.arange(own, own + len(heads))
            codes[bounds[:-1][alone]] = np.arange(own + len(heads), own + n)
            if alone:
                rest = np.zeros(len(codes) + 1, np.int64)
                np.add.at(rest, bounds[:-1][alone] + 1, 1)
                np.add.at(rest, bounds[1:][alone], -1)
                skip = np.cumsum(rest[:-1]) > 0
                pool.append(b"")
                codes[skip] = len(pool) - 1
        joined = pa.array(pool, pa.large_binary()).take(pa.array(codes))
        sizes, raw = joined.buffers()[1:]
        ends = np.frombuffer(sizes, np.int64)[: len(codes) + 1] // item
        return np.frombuffer(raw, self.width)[: ends[-1]], ends[bounds[1:]]


def split_ids(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The ids of each text, as bytes."""
    raw, item, out, at = ids.tobytes(), ids.dtype.itemsize, [], 0
    for end in ends.tolist():
        out.append(raw[at * item : end * item])
        at = end
    return out


def byte_signs() -> list[str]:
    """The sign of byte-level tokenizers for each byte: printable bytes stand for themselves, others are moved up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + moved.index(b)) for b in range(256)]


def tokenizer_cache(path: str, spaced: bool, width: str = "<u4") -> WordCache:
    """The worker's cache over a tokenizers file, used as the library does by default: special tokens in a text are special.

    Words of plain letters that are new go straight to the file's model, all of a slice at once; others through the whole tokenizer.
    """
    return worker_state((path, spaced, width), lambda: _tokenizer_cache(path, spaced, width))


def _tokenizer_cache(path: str, spaced: bool, width: str) -> WordCache:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = tuple(x.content for x in tokenizer.get_added_tokens_decoder().values())
    if tokenizer.get_vocab_size() > 1 << 8 * np.dtype(width).itemsize:
        raise ValueError(f"ids of {path} do not fit in {width}")

    def encode_whole(texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, width).tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    # a word of simple letters is one pre-token, so the model of the file alone gives its ids; it reads bytes as signs
    signs = np.array([ord(c) for c in byte_signs()], "<u2")
    signs[ord("\n")] = ord("\n")
    model, kind = tokenizer.model, "H" if np.dtype(width).itemsize == 2 else "I"

    def encode_plain(words: list[str]) -> list[bytes]:
        text = signs[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le")
        return [array(kind, [x.id for x in model.tokenize(w)]).tobytes() for w in text.split("\n")]

    return WordCache(encode_whole, spaced, width, special=special, encode_whole=encode_whole, encode_plain=encode_plain, lower=not spaced)
