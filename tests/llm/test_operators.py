"""Operators of the llm subpackage against brute force, round trips and held-out accuracy, on small fixtures."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash

from quillmesh.llm import bpe, gif, language, lines, neardup, packing, pages, quality, sharding, tokenfile
from quillmesh.llm.components import components

DATA = "/root/testdata/sf0.001"


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_quality_matches_sql(odd_docs, docs):
    con = duckdb.connect()
    for df in (odd_docs, docs):
        con.register("documents", df.select("doc_id", "text").toPandas())
        want = con.sql(quality.ORACLE).df()
        got = quality.quality_columns(df).toPandas()
        rows = lambda x: sorted(tuple("~" if v is None or v != v else str(int(v)) for v in r) for r in x[sorted(got.columns)].astype(object).itertuples(index=False))
        assert rows(got) == rows(want)


def test_quality_filter_keeps_columns(odd_docs, no_docs):
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == []
    assert quality.quality_columns(no_docs).count() == 0


def test_token_file_round_trip(odd_docs, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = tokenfile.read_tokens(tokenfile.write_tokens(odd_docs)).collect()
    want = Counter((d, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for d, x in texts(odd_docs))
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    ids = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)
    assert tokenfile.read_tokens(tokenfile.write_tokens(no_docs)).count() == 0


def test_coder_blocks():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0), np.zeros(5000), rng.integers(0, 65536, 3001), rng.zipf(1.3, 5000) % 49408, np.array([65535]), np.arange(65536)):
        ids = ids.astype(np.uint16)
        assert np.array_equal(tokenfile.decode_blocks(*tokenfile.encode_blocks(ids)), ids)
    # blocks are independent, and damage is found
    prior, blocks = tokenfile.encode_blocks((np.arange(7000) % 900).astype(np.uint16))
    assert np.array_equal(tokenfile.decode_blocks(prior, blocks[1:2]), np.arange(tokenfile.BLOCK, 2 * tokenfile.BLOCK) % 900)
    assert np.array_equal(tokenfile.decode_blocks(prior, [blocks[3], blocks[0]])[: len(range(3 * tokenfile.BLOCK, 7000))], np.arange(3 * tokenfile.BLOCK, 7000) % 900)
    prior, blocks = tokenfile.encode_blocks(rng.integers(0, 900, 7000).astype(np.uint16))
    for at in (0, 5, 9, 14, 40):
        bad = bytearray(blocks[0])
        bad[at] ^= 255
        with pytest.raises(ValueError):
            tokenfile.decode_blocks(prior, [bytes(bad)])


def test_coder_mixes_in_32_bits():
    """Frequencies of the mix fit in 32 bits, a guess and its trust in one cell; the blocks are those that 64 bits made."""
    ids = (np.arange(7000) % 900).astype(np.uint16)
    prior, blocks = tokenfile.encode_blocks(ids)
    assert zlib.crc32(b"".join(blocks)) == 3342527876 and np.array_equal(tokenfile.decode_blocks(prior, blocks), ids)
    mix = tokenfile._Mix(tokenfile.Prior.unpack(prior), 3)
    mix.look(3)
    start, size = mix.interval(3, np.array([0, 5, 899]))
    assert start.dtype == size.dtype == mix.held.dtype == np.int32 and (size > 0).all() and (start + size <= 1 << tokenfile._TOTAL).all()


def test_coder_carries():
    """Intervals at the upper end of the range make long runs of carries."""
    rng = np.random.default_rng(9)
    total = 1 << tokenfile._TOTAL
    size = np.where(rng.random((3000, 5)) < 0.5, 1, total // 3).astype(np.int64)
    start = np.where(rng.random((3000, 5)) < 0.9, total - size, (rng.random((3000, 5)) * (total - size)).astype(np.int64))
    coder = tokenfile._Encoder(5)
    for a, b in zip(start, size, strict=True):
        coder.code(5, a, b)
    back = tokenfile._Decoder(coder.finish())
    for a, b in zip(start, size, strict=True):
        value = back.peek(5)
        assert ((a <= value) & (value < a + b)).all()
        back.code(5, a, b)


def test_coder_beats_order_0_entropy():
    from quillmesh.llm.wordcache import tokenizer_cache

    cache = tokenizer_cache(P.path("word_bpe_49k.json"), spaced=False, width="<u2")
    ids, _ = cache.encode([t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()])
    prior, blocks = tokenfile.encode_blocks(ids)
    counts = np.bincount(ids)
    shares = counts[counts > 0] / len(ids)
    stored = 8 * (len(prior) + sum(map(len, blocks))) / len(ids)
    assert np.array_equal(tokenfile.decode_blocks(prior, blocks), ids)
    assert stored < 0.85 * -(shares * np.log2(shares)).sum()


@pytest.mark.parametrize(("name", "spaced", "width"), [("word_bpe_49k.json", False, "<u2"), ("byte_bpe_50k.json", True, "<u4")])
def test_word_cache_matches_the_untouched_tokenizer(name, spaced, width):
    from tokenizers import Tokenizer

    from quillmesh.llm.wordcache import split_ids, tokenizer_cache

    rng = random.Random(12)
    parts = [*"aBéÉIİjKß中😀Σ", "J\u030c", "\u030c", "\u0307", "\u01f0", *".,!?:;&'", "'s", " ", "  ", "\n", "\t", "\r\n", "\xa0", "1", "word", "The", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|"]
    whole, cache = Tokenizer.from_file(P.path(name)), tokenizer_cache(P.path(name), spaced, width)
    for _ in range(20):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(150)]
        got = [np.frombuffer(x, width).tolist() for x in split_ids(*cache.encode(texts))]
        assert got == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("name", "spaced", "width"), [("word_bpe_49k.json", False, "<u2"), ("byte_bpe_50k.json", True, "<u4")])
def test_word_cache_takes_words_with_signs_by_their_letters(name, spaced, width):
    """Words of letters reach the file's model at once; signs after them and line feeds before them cost nothing more."""
    from tokenizers import Tokenizer

    from quillmesh.llm.wordcache import _tokenizer_cache, split_ids

    cache, sent = _tokenizer_cache(P.path(name), spaced, width), []
    slow, plain = cache.encode_many, cache.encode_plain
    cache.encode_many = lambda texts: sent.extend(texts) or slow(texts)
    made = []
    cache.encode_plain = lambda words: made.extend(words) or plain(words)
    stems = ["onatan", "thstinnt", "ééellere", "ciónadoraez", "beßst"]
    texts = [" ".join(["the", *(w + x for w in stems for x in ("", "$$$", ",###", ".", "&&&", "%%%", "***"))]) + "\n" + "\n".join(stems) for _ in range(3)]
    whole = Tokenizer.from_file(P.path(name))
    got = [np.frombuffer(x, width).tolist() for x in split_ids(*cache.encode(texts))]
    assert got == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert sent == [] and len(made) <= 3 + 2 * len(stems)


def test_packing_is_gapless(odd_docs, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack(odd_docs).collect()
    by_sequence: dict = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or k == len(by_sequence) - 1
    joined = b"".join(r.ids for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)))
    want = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, x in texts(odd_docs)]
    assert len(joined) == sum(map(len, want))
    whole = Counter((r.doc_id, r.ids) for r in rows if r.length == r.doc_tokens)
    assert all((d, w) in whole for (d, _), w in zip(texts(odd_docs), want, strict=True) if d in (3, 4, 8))
    assert packing.pack(no_docs).count() == 0


def _simhash(text):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    n = max(1, len(words) - 2)
    grams = [b" ".join(words[i : i + 3]) for i in range(n)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(odd_docs, docs, no_docs):
    for frame in (odd_docs, docs):
        rows = [(d, _simhash(x)) for d, x in texts(frame)]
        parent = list(range(len(rows)))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                    parent[root(i)] = root(j)
        least: dict = {}
        for i, (d, _) in enumerate(rows):
            if d is not None:
                least[root(i)] = min(d, least.get(root(i), d))
        want = Counter((d, f"{f:016x}", least.get(root(i))) for i, (d, f) in enumerate(rows))
        assert Counter(map(tuple, neardup.near_duplicates(frame).select("doc_id", "fingerprint", "component_id").collect())) == want
        kept = neardup.keep_one(frame)
        assert kept.columns == frame.columns and kept.count() == len({root(i) for i in range(len(rows))})
    assert neardup.near_duplicates(no_docs).count() == 0


def test_keep_one_of_repeated_ids_with_other_texts(spark):
    one, two = ("a b c d e f g h i j " * 4).strip(), ("k l m n o p q r s t " * 4).strip()
    rows = [(1, one, 0), (1, two, 1), (2, two, 2), (2, one, 3), (3, one, 4), (None, "only a nameless text", 5), (None, one, 6)]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, k int")).collect()
    assert sorted((r.text, r.doc_id, r.k) for r in kept) == sorted([(one, 1, 0), (two, 1, 1), ("only a nameless text", None, 5)], key=lambda r: r[0])


def _shingles(text):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dedup_stage_is_exact_jaccard(spark, odd_docs, no_docs):
    import corpus_pipeline

    rng = random.Random(6)
    planted = []
    for g in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(4, 160))]
        planted.append((10 * g, " ".join(base)))
        for k in range(1, 5):  # up to five words changed: similarities on both sides of 0.8
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            planted.append((10 * g + k, " ".join(copy)))
    for frame in (spark.createDataFrame(planted, "doc_id long, text string").repartition(3), odd_docs):
        rows = texts(frame)
        sets = [_shingles(x) for _, x in rows]
        close = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j])]
        group = list(range(len(rows)))
        for i, j in close:
            group = [group[j] if x == group[i] else x for x in group]
        want = Counter(min((d is None, d) for (d, _), x in zip(rows, group, strict=True) if x == k)[1] for k in set(group))
        got = corpus_pipeline.near_dedup(spark, frame, DATA)
        assert got.columns == frame.columns and Counter(r.doc_id for r in got.collect()) == want
        if frame is not odd_docs:  # near copies that two differing bits don't reach
            far = [(i, j) for i, j in close if (_simhash(rows[i][1]) ^ _simhash(rows[j][1])).bit_count() > 2]
            assert len(far) > 10 and len(want) < neardup.keep_one(frame).count()
    assert corpus_pipeline.near_dedup(spark, no_docs, DATA).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (5, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_gif(odd_docs, no_docs):
    rng = random.Random(5)
    for n in (64, 640, 64 * 700):
        data = bytes(rng.choice(b"abcd \n") for _ in range(n))
        assert gif.lzw_decode(gif.lzw_encode(data), 8, n) == data
    noise = np.random.default_rng(1).integers(0, 256, 64 * 5000, np.uint8).tobytes()
    frames = gif.gif_decode(gif.gif_encode(noise))
    assert len(frames) == 2 and b"".join(f.indices.tobytes() for f in frames) == noise and frames[1].start_cs == gif.DELAY_CS
    rows = {r.doc_id: r for r in gif.media_digests(gif.media_table(odd_docs)).collect()}
    for d, x in texts(odd_docs):
        n, payload = gif.payload_of(x)
        stored = gif.gif_encode(payload)
        counts = Counter(b >> 6 for b in payload)  # grey levels, so red, green and blue step alike
        feature = ",".join(str(counts[k // 21] * 1000 // len(payload)) if k % 21 == 0 else "0" for k in range(64))
        r = rows[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature, r.n_frames, r.error) == (len(stored), hashlib.sha256(stored).hexdigest(), feature, -(-len(payload) // (64 * 4096)), None)
    framed = gif.frame_columns(gif.media_table(odd_docs)).collect()
    assert len(framed) == odd_docs.count() and all(len(f.rgb) == 3 * f.width * f.height and sum(f.histogram) > 0 for r in framed for f in r.frames)
    assert gif.media_digests(gif.media_table(no_docs)).count() == 0


def test_gif_of_several_frames(spark):
    text = "The letters of it. " * 16_000  # more than one frame, the last one short
    r = gif.media_digests(gif.media_table(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    payload = gif.payload_of(text)[1]
    counts = Counter(b >> 6 for b in payload)
    assert r.n_frames == 2 and r.duration_cs == 2 * gif.DELAY_CS and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
    assert [int(x) for x in r.feature.split(",")] == [counts[k // 21] * 1000 // len(payload) if k % 21 == 0 else 0 for k in range(64)]


def test_malformed_gifs_have_errors(spark):
    whole = gif.gif_encode(bytes(range(64)) * 40)
    at = whole.index(b"\x2c") + 11
    short = whole[:at] + gif._blocks(gif.lzw_encode(bytes(64))) + b";"
    bad_code = whole[:at] + gif._blocks(gif.lzw_encode(bytes(64))[:1] + b"\xff" * 40) + b";"
    cases = [None, b"", b"no GIF", whole[:20], whole[: len(whole) // 2], short, bad_code, whole[:13] + b"\x99" + whole[14:], whole[:781] + b"\x00" + whole[782:], whole]
    media = spark.createDataFrame([(k, None if x is None else len(x), x) for k, x in enumerate(cases)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in gif.frame_columns(media).collect()}
    digests = {r.doc_id: r for r in gif.media_digests(media).collect()}
    assert got[0].frames is None and got[0].error is None and digests[0].media_bytes is None
    for k in (1, 2, 3, 4, 5, 6, 8):
        assert got[k].frames is None and got[k].error and digests[k].payload_sha256 is None and digests[k].feature is None and digests[k].error, k
    assert got[9].error is None and digests[9].payload_bytes == 2560


def test_gif_disposal_and_transparency():
    def frame(disposal, flags, samples, transparent=0):
        return bytes([0x21, 0xF9, 4, disposal << 2 | flags, 5, 0, transparent, 0, 0x2C, 0, 0, 0, 0, 2, 0, 1, 0, 0, 8]) + gif._blocks(gif.lzw_encode(bytes(samples)))

    head = b"GIF89a" + bytes([2, 0, 1, 0, 0xF7, 0, 0]) + bytes(v for i in range(256) for v in (i, i, i))
    shown = [f.rgb[0, :, 0].tolist() for f in gif.gif_decode(head + frame(1, 0, [10, 20]) + frame(3, 1, [0, 30]) + frame(2, 1, [40, 0]) + frame(0, 1, [0, 50]) + b";")]
    assert shown == [[10, 20], [10, 30], [40, 20], [0, 50]]


def test_language(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    got = language.language_columns(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98 and got.score.between(0, 1).all()
    assert set(got.doc_id % 1000) and all((zlib.crc32(str(d).encode()) % 4 == 2) for d in got.doc_id)
    odd = language.language_columns(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and {r.lang_pred for r in odd if r.doc_id in (3, 4, 8)} == {"und"}
    assert language.keep_known(odd_docs, model).columns == odd_docs.columns
    assert language.train(no_docs).languages == [] and language.language_columns(no_docs, model).count() == 0


def test_language_sample_has_distinct_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    few = docs.where("doc_id < 400")
    copies = few.selectExpr("doc_id", "text", "lang", "explode(sequence(1, 400)) AS k").drop("k")
    got, want = language.train(copies), language.train(few)
    assert got.languages == want.languages and np.array_equal(got.landmarks, want.landmarks) and np.array_equal(got.weights, want.weights)
    assert len(np.unique(got.landmarks, axis=0)) == len(got.landmarks) == 4 * language.LANDMARKS_PER_LANGUAGE


def test_language_kernel_and_ridge_match_brute_force():
    rng = random.Random(3)
    words = {"en": "the of and house was in".split(), "fr": "le la des maison dans et".split(), "de": "der und das haus im war".split()}
    texts_ = [(x, " ".join(rng.choice(w) for _ in range(9))) for x, w in words.items() for _ in range(12)]

    def grams(text):
        padded = " " + " ".join(text.lower().split()) + " "
        return {(n, padded[i : i + n]) for n in language.ORDERS for i in range(len(padded) - n + 1)}

    sets = [grams(t) for _, t in texts_]
    exact = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    rows = language.presence_rows([t for _, t in texts_])
    assert np.allclose(rows @ rows.T, exact, atol=0.02)  # but for bins that meet
    model = language.fit([language.presence_bits(t) for _, t in texts_], [x for x, _ in texts_])
    # all rows are landmarks here: ridge regression in the kernel's own space, in closed form
    kernel = (rows @ rows.T).astype(float)
    targets = np.array([[1.0 if x == y else -1.0 for y in model.languages] for x, _ in texts_])
    values, vectors = np.linalg.eigh(kernel)
    space = np.concatenate([vectors[:, values > 1e-6] * np.sqrt(values[values > 1e-6]), np.ones((len(rows), 1))], axis=1)
    stacked = np.concatenate([space / 12**0.5, (language.RIDGE / len(rows)) ** 0.5 * np.eye(space.shape[1])])
    best = np.linalg.lstsq(stacked, np.concatenate([targets / 12**0.5, np.zeros((space.shape[1], 3))]), rcond=None)[0]
    got = (rows @ model.landmarks.T) @ model.weights[:-1] + model.weights[-1]
    assert np.allclose(got, space @ best, atol=1e-2)


def test_language_learns_whole_texts(spark):
    head = "q z " * 1500  # 6000 characters that all languages share
    rows = [(i, head + tail * 3, lang) for i in range(40) for lang, tail in [("en", f"the house and the dog {i} "), ("fr", f"le chat est sur la table {i} ")]]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert language.predict(model, [head + "the dog and the house", head + "la table est sur le chat"])[0] == ["en", "fr"]
    want = {language.presence_rows([r[1]])[0].tobytes() for r in rows}
    assert {x.tobytes() for x in model.landmarks} <= want


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("tau", [1, 2])
def test_edit_links(spark, tau):
    rng = random.Random(4)
    words = set()
    for _ in range(25):
        base = "".join(rng.choice("abé") for _ in range(rng.randint(6, 14)))
        words.add(base)
        for _ in range(3):
            c = list(base)
            for _ in range(rng.randint(1, 4)):
                k = rng.randrange(len(c))
                c[k : k + rng.choice([0, 1, 1])] = [rng.choice("abc")] * rng.choice([0, 1, 1])
                c = c or ["a"]
            words.add("".join(c))
    words |= {x + "7" for x in words} | {x + "8" for x in words}
    s = sorted(words)
    told = [[c for c in x if c.isdigit()] for x in s]
    df = spark.createDataFrame(list(enumerate(s)), "lid long, line string")
    got = Counter(tuple(sorted((r.a, r.b))) for r in lines.edit_links(df, tau, tau + 3).collect())
    assert got == Counter((j, i) for i in range(len(s)) for j in range(i) if min(len(s[i]), len(s[j])) >= tau + 3 and told[i] == told[j] and _edits(s[i], s[j]) <= tau)


def test_letter_counts_come_from_what_the_letters_before_have_left(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("eantroisdhulcmwgE é,19 ") for _ in range(rng.randint(0, 150)))) for i in range(200)]
    out = lines.with_counts(spark.createDataFrame(rows, "lid long, line string"))
    assert "replace(__rest" in out._jdf.queryExecution().optimizedPlan().toString() and out.columns == ["lid", "line", "n", "c", "digits"]
    digits: dict = {}
    for r in out.collect():
        assert r.n == len(r.line)
        if r.n < lines.MIN_CHARS:
            assert r.c is None and r.digits is None
            continue
        assert [r.c >> 4 * k & 15 for k in range(16)] == [r.line.count(x) & 15 for x in reversed(lines.LETTERS)]
        digits.setdefault("".join(x for x in r.line if x in "0123456789"), set()).add(r.digits)
    assert all(len(x) == 1 for x in digits.values()) and len(set.union(*digits.values())) == len(digits)


def test_letters_are_counted_in_lines_that_share_a_segment(spark):
    """One key serves all lengths of a step, and lines that share no segment are gone before letters are counted and pairs are made."""
    rng = random.Random(6)
    rows = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in range(40, 75) for _ in range(3)]
    far = len(rows)
    for x in rows[:far:3]:
        for _ in range(2):
            y = list(x)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(y))
                y[k : k + rng.choice([0, 1])] = [rng.choice("abcé")] * rng.choice([0, 1, 2])
            rows.append("".join(y))
    df = spark.createDataFrame(list(enumerate(rows)), "lid long, line string")
    sizes = Counter(r.lid for r in lines.key_rows(df, 2, 40).collect())
    assert len(sizes) == sum(len(x) >= 40 for x in rows) and max(sizes.values()) <= 9 and sum(sizes.values()) < 6.1 * len(sizes)
    met = {r.lid for r in lines.shared_keys(df, 2, 40).collect()}
    assert not met & {i for i in range(far) if i % 3}
    got = Counter(tuple(sorted((r.a, r.b))) for r in lines.edit_links(df).collect())
    want = Counter((j, i) for i in range(len(rows)) for j in range(i) if min(len(rows[i]), len(rows[j])) >= 40 and abs(len(rows[i]) - len(rows[j])) <= 2 and _edits(rows[i], rows[j]) <= 2)
    assert got == want and len(want) > 30


def test_line_dedup(spark, odd_docs, no_docs):
    out = lines.dedup_lines(odd_docs)
    assert out.count() == odd_docs.count() and out.columns[: len(odd_docs.columns)] == odd_docs.columns
    got = {r.doc_id: r for r in out.collect()}
    # lines that differ in a digit are other lines
    body = {r.doc_id: r.text for r in odd_docs.collect()}
    assert got[1].text == body[1] and got[1]["__n_near"] == 0 and got[1]["__n_lines"] == 8
    assert got[2].text == "" and got[2]["__n_exact"] == 8
    assert got[9].text == "" and got[9]["__n_near"] == 8
    assert got[3].text is None and got[4].text == "" and got[5].text == "mot " * 30_000
    assert got[8].text == " \n\t "
    assert lines.dedup_lines(no_docs).count() == 0


def test_line_dedup_keeps_blank_lines_and_digits(spark):
    table = "\n".join(f"row {i:03d} of the table of all the houses in the town" for i in range(30))
    crlf = "one two\r\n\r\nthree\r\n\t\r\n\xa0\n\u3000\n\xa0\nfour"
    told = "it was the story of the town and all of its houses, told by nobody"
    rows = [(1, table), (2, crlf), (3, crlf.replace("two", "2")), (4, told), (5, told.replace("nobody", "nobodys") + "\n" + told[:-1])]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == table and got[2] == crlf
    assert got[3] == "one 2\r\n\r\n\t\r\n\xa0\n\u3000\n\xa0"
    assert got[4] == told and got[5] == ""


def test_line_dedup_matches_plain_python(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choice("alpha beta gamma delta eta 12 13 the of".split()) for _ in range(12)) for _ in range(25)]
    rows = []
    for d in range(40):
        out = []
        for _ in range(rng.randint(0, 6)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                x[rng.randrange(len(x))] = rng.choice("xyz12")
            out.append("".join(x) if rng.random() < 0.8 else rng.choice(["", " ", "\r", "short", "\t"]))
        rows.append((rng.choice([d, d, None]), "\n".join(out), "en"))
    want, near = _plain_lines(rows)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).select("doc_id", "text").collect()
    assert near > 10 and Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for d, t, _ in want)


def test_bpe_matches_tiktoken(odd_docs, no_docs):
    import tiktoken

    coder, cache = bpe.loaded(P.path(bpe.RANKS), P.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(2)
    mixed = ["".join(rng.choice("ab  \n\té😀 1.,'s't") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for text in [*mixed, "a" * 3000, "the" * 500, " lead", "trail \n"]:
        ids, _ = cache.encode([text])
        assert ids.tolist() == reference.encode_ordinary(text), text
    rows = {r.doc_id: r for r in bpe.digests(odd_docs).collect()}
    for d, x in texts(odd_docs):
        ids = np.array(reference.encode_ordinary(x or ""), "<u4").tobytes()
        assert (rows[d].n_tokens, rows[d].ids_sha256, rows[d].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
    assert bpe.encode_documents(no_docs).count() == 0


def test_pages(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/x>Menu</a></li></ul></nav>
    <div class="ad">Buy the best of it now.</div><article><h1>Title &amp; more</h1><p><b>First of the paragraphs<br>goes  on.</b><p>Short one.</p>
    <div id="comments"><p>I am the first to comment on it.</p></div></article><aside>Side of the page.</aside><footer>&copy; x.example</footer></body></html>"""
    assert pages.main_text(page) == "Title & more First of the paragraphs goes on. Short one."
    bare = "<div><a href=a>Home</a> <a href=b>News</a></div>" + "<p>" + "the story of a man and his dog that was in the house. " * 6 + "</p><p>It was so.</p><p>" + "and then it is the end of all that we had to say of it. " * 6 + "</p><div><a href=c>Next</a></div>"
    assert pages.main_text(bare).count("It was so.") == 1 and "Home" not in pages.main_text(bare)
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", page), (3, "u", "<p")], "page_id long, url string, html string")
    assert [r.n_chars for r in pages.page_texts(rows).orderBy("page_id", "n_chars").collect()][:2] == [0, 0]


def test_pages_weigh_article_elements(spark):
    story = "the story of a man and his dog that was in the house. " * 6
    told = f"<div><p>{story}</p><p>It was so.</p><p>{story}</p></div>"
    cards = "".join(f"<article><h3>Card {i}</h3><p>Read it in here.</p></article>" for i in range(4))
    want = f"{story.strip()} It was so. {story.strip()}"
    assert pages.main_text(f"{told}{cards}<footer>f</footer>") == want
    # beside an article, the density rules still decide: an unmarked link list and a line after it go
    assert pages.main_text(f"<article><p>{story}</p><p>It was so.</p><p>{story}</p></article><div>Shown to you</div><div><a href=a>More of this</a></div>") == want
    assert pages.main_text(f"<main><p>{story}</p><p>It was so.</p><p>{story}</p><div><a href=a>Home</a> <a href=b>News</a></div><p>Buy now</p><div><a href=c>Next</a></div></main>") == want
    # short lines of an article that outweighs what is around it
    poem = "".join(f"<p>line {i} of it</p>" for i in range(200))
    assert pages.main_text(f"<article>{poem}</article><div>{story}</div>").count("line ") == 200


def test_pages_malformed_markup():
    import time

    began = time.time()
    for part in ("<a ", "<div>a", "</x>a", "<textarea>", "<!--", "<!-", "<svg>a", '<a x="', "<a x='y\" ", "<a = ", "<![CDATA[", "<b class=ad>x", "<p title=", "&lt;"):
        pages.main_text(part * (1_000_000 // len(part)))
    assert time.time() - began < 14  # a second each
    kept = "Tom's link stays and it's fine to have the story of it all in the house that was there for him."
    assert pages.main_text("<p>Tom's <a href=x title=don't>link</a> stays and it's fine to have the story of it all in the house that was there for him.</p>") == kept
    story = "the story of a man and his dog that was in the house. " * 6
    for frame in ("layout with-sidebar", "sidebar layout", "page has-ads"):
        for inner in (f"<article><p>{story}</p><p>It was so.</p></article>", f"<p>{story}</p><p>It was so.</p>"):
            text = pages.main_text(f"<nav><a href=a>Home</a></nav><div class='{frame}'>{inner}</div>")
            assert text == f"{story.strip()} It was so.", frame
    assert pages.main_text(f"<p>{story}</p><div class=comments><p>{story}</p><p>{story}</p></div>") == story.strip()
    assert pages.main_text(f"<p>{story}<b>bold</p></i></div><p>{story}") == f"{story}bold {story.strip()}"
    deep = "<div>" * 5000 + f"<p>{story}</p>" + "</div>" * 5000
    assert pages.main_text(deep) == story.strip()


def test_pages_nearest_labels_match_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        blocks = [pages.Block("x", 0, False, False, rng.choice([0, 0, 1])) for _ in range(rng.randint(0, 14))]
        labels = [rng.choice(["good", "bad", "near", "short"]) for _ in blocks]
        for own in (False, True):
            for order, step in ((range(len(blocks)), -1), (range(len(blocks) - 1, -1, -1), 1)):
                got = pages._nearest(blocks, labels, order, own)
                for i, label in enumerate(labels):
                    want = ("", len(blocks))
                    if label in ("near", "short"):
                        k = i + step
                        while 0 <= k < len(blocks):
                            counts = labels[k] in ("good", "bad") or labels[k] == "near" and label == "short"
                            if counts and (not own or blocks[k].scope == blocks[i].scope):
                                want = ("bad" if labels[k] == "bad" else "good", abs(i - k))
                                break
                            k += step
                    assert got[i] == want


def test_pages_take_null_empty_and_clashing_columns(spark):
    story = "the story of a man and his dog that was in the house. " * 6
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", f"<p>{story}</p>", "own", "x"), (1, "u", f"<p>{story}</p>", "own", "x"), (None, None, None, None, None), (2, "", "", "", "")]
    got = pages.page_texts(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(r.n_chars for r in got.collect()) == [0, 0, 323, 323]
    assert pages.page_texts(spark.createDataFrame([], schema)).count() == 0
    long = pages.main_text(f"<p>{story}</p>" * 20_000)
    assert len(long) == 20_000 * 324 - 1


def test_pages_reach_and_copyright_signs(spark):
    story = "the story of a man and his dog that was in the house. " * 6
    lines = "".join(f"<p>line {i} it was</p>" for i in range(3000))
    assert pages.main_text(f"<p>{story}</p>{lines}<p>{story}</p>").count("line ") == 3000
    assert pages.main_text(f"<p>{story}</p>{lines}").count("line ") == 3000
    for page in (f"<article><p>{story}&copy; 1999 {story}</p><p>Photo &copy; A. B.</p><p>{story}</p></article>", f"<div><p>{story}&copy; 1999 {story}</p></div>"):
        assert pages.main_text(page).count("\xa9") == page.count("&copy;")
    assert "\xa9" not in pages.main_text(f"<p>{story}</p><p>&copy; x.example</p><p>{story}</p>")


def test_sharding(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard(docs, 8).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == docs.count() and len(sizes) == 8 and sizes.max() / sizes.mean() < 1.1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    forty = sharding.shard(docs).toPandas()
    sizes = forty.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and sizes.max() < 1.05 * sizes.mean() and sizes.min() > 0.95 * sizes.mean()
    assert (forty.groupby("text_crc32")["shard"].nunique() == 1).all()
    many = docs.selectExpr("doc_id", "text", "lang", "source").unionByName(docs.sparkSession.range(2000).selectExpr("cast(null as long) as doc_id", "repeat('copy ', 300) as text", "'en' as lang", "'s' as source"))
    hot = sharding.shard(many, 10).toPandas()  # copies of more than a shard take as few shards as hold them
    sizes = hot.groupby("shard")["size"].sum()
    assert sizes.max() < 1.1 * sizes.mean() and hot[hot.doc_id.isna()].shard.nunique() == -(-hot[hot.doc_id.isna()]["size"].sum() // int(sizes.mean()))
    for _, part in hot.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    few = sharding.shard(docs.limit(3)).toPandas()  # most boxes are empty
    assert len(few) == 3 and few.shard.nunique() == 3
    odd = sharding.shard(odd_docs, 4).toPandas()
    want = Counter((d, len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for d, x in texts(odd_docs))
    assert Counter((None if d != d else d, s, c) for d, s, c in zip(odd.doc_id, odd["size"], odd.text_crc32, strict=True)) == want
    assert sharding.shard(no_docs).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 150")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
        assert docs.count() > 50
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).selectExpr("sum(length)").first()[0] > 10_000


def test_pipeline_stages_take_odd_rows(spark, odd_docs, no_docs):
    import corpus_pipeline

    # columns that stages might use themselves, repeated ids and rows, nulls, empty and very long texts
    clashing = odd_docs.selectExpr("*", "1 AS fp", "'c' AS class", "'l' AS line", "2 AS n_words", "'k' AS known", "3 AS h", "4 AS node", "5 AS n", "6 AS start", "'p' AS part", "7 AS rank")
    for docs in (clashing, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns, name
            got = out.collect()
            assert len(got) <= docs.count() and (docs is no_docs or name == "quality_rules" or got), name
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
        assert len({r.doc_id for r in pieces}) == len({r.doc_id for r in docs.collect()})


def _hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _groups(n, links):
    group = list(range(n))
    for i, j in links:
        group = [group[j] if x == group[i] else x for x in group]
    return group


def _plain_language(rows):
    import corpus_pipeline

    known = {(lang, t) for d, t, lang in rows if lang is not None and t is not None and not (d is not None and zlib.crc32(str(d).encode()) % 4 == 2)}
    ranked = sorted((k, lang, t) for x in {lang for lang, _ in known} for k, (_, lang, t) in enumerate(sorted((_hash(t), lang, t) for lang, t in known if lang == x)[:300]))
    model = language.fit([language.presence_bits(t) for _, _, t in ranked], [lang for _, lang, _ in ranked])
    best = [language.predict(model, [t]) for _, t, _ in rows]
    return [r for r, (label, score) in zip(rows, best, strict=True) if label[0] != "und" and score[0] >= corpus_pipeline.MIN_LANGUAGE_SCORE]


def _plain_quality(text):
    size = lambda w: len("".join(w.split()))
    words = [w.decode() for w in text.encode().split()]
    chars = sum(map(len, words))
    covered = {}
    for n in (3, 5, 6, 8, 10):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        seen = Counter(grams)
        covered[n] = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(n)}
    again = sum((c - 1) * size(x) for x, c in Counter(text.split("\n")).items())
    shares = all(100 * sum(len(words[i]) for i in covered[n]) <= limit * chars for n, limit in ((5, 40), (6, 36), (8, 32), (10, 28)))
    return len(words) >= 50 and 100 * len(covered[3]) <= 50 * len(words) and 100 * again <= 30 * chars and shares


def _plain_lines(rows):
    places: dict = {}  # of each line, in order
    for d, t, _ in rows:
        for no, line in enumerate(t.split("\n")):
            if line.strip(lines.BLANK):
                places.setdefault(line, set()).add((d is not None, d or 0, _hash(t), no))
    lines_ = list(places)
    counts = [Counter(x) for x in lines_]
    digits = [[c for c in x if c in "0123456789"] for x in lines_]
    may = ((i, j) for i in range(len(lines_)) for j in range(i) if digits[i] == digits[j] and abs(len(lines_[i]) - len(lines_[j])) <= 2 and min(len(lines_[i]), len(lines_[j])) >= 40)
    links = [(i, j) for i, j in may if (counts[i] - counts[j]).total() <= 2 and (counts[j] - counts[i]).total() <= 2 and _edits(lines_[i], lines_[j]) <= 2]
    first: dict = {}
    group = _groups(len(lines_), links)
    for x, g in zip(lines_, group, strict=True):
        first[g] = min(first.get(g, min(places[x])), min(places[x]))
    keep = {x: first[g] for x, g in zip(lines_, group, strict=True)}
    stays = lambda d, t, no, line: not line.strip(lines.BLANK) or keep[line] == (d is not None, d or 0, _hash(t), no)
    return [(d, "\n".join(x for no, x in enumerate(t.split("\n")) if stays(d, t, no, x)), lang) for d, t, lang in rows], len(links)


def _plain_near(rows):
    sets = [_shingles(t) for _, t, _ in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    group = _groups(len(rows), close)
    return [min((r for r, x in zip(rows, group, strict=True) if x == k), key=lambda r: (r[0] is None, r[0], _hash(r[1]))) for k in sorted(set(group))]


def test_pipeline_matches_plain_python(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(8)
    raw = [(r.doc_id, r.text, r.lang) for r in docs.where("doc_id < 70 and length(text) < 8000").orderBy("doc_id").collect()]
    good = [r for r in raw if r[1] and len(r[1].split()) > 120 and _plain_quality(r[1])]
    assert len(good) >= 12
    for k, (_, t, lang) in enumerate(good[:6]):  # near copies: a few words changed, all on lines that differ by more than two edits
        words = t.replace("\n", " ").split(" ")
        for i in rng.sample(range(len(words)), max(1, len(words) // 70)):
            words[i] = f"changed{i}"
        raw.append((1000 + k, " ".join(words), lang))
    for k, (_, t, lang) in enumerate(good[6:9]):  # a near copy of a line, at the end of another text
        line = max(t.split("\n"), key=len)
        raw.append((1100 + k, " ".join(f"own{k}x{i} the" for i in range(80)) + "\n" + line[:20] + "x" + line[20:], lang))
    raw += [good[9], (good[9][0], " ".join(f"the other{i} and" for i in range(60)), "en"), (None, " ".join(f"of nameless{i} in" for i in range(60)), "en")]
    raw += [(1200, None, "en"), (1201, "", "fr"), (1202, "12 34 " * 60, "de"), (1203, "the same of it " * 60, "en")]
    frame = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in raw], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    known = _plain_language(raw)
    passed = [r for r in known if _plain_quality(r[1])]
    cut, near_lines = _plain_lines(passed)
    want = _plain_near(cut)
    assert len(raw) > len(known) > len(passed) and near_lines and cut != passed and len(want) <= len(cut) - 3
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    left = [(d, np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")) for d, x, _ in want]
    at = total = 0
    pieces: list = []
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 2048 + r.offset == total and r.start == at
        total, at, pieces = total + r.length, at + r.length, [*pieces, r]
        if at == r.doc_tokens:
            fits = [k for k, (d, ids) in enumerate(left) if d == r.doc_id and len(ids) == at and all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)]
            assert fits, r
            del left[fits[0]]
            at, pieces = 0, []
    assert not left and not pieces


def test_parity_masks_bound_the_difference_of_sets():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 90, 700):
        for cut in (0, 1, 5, 60):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[min(cut, len(x)) :], rng.integers(0, 1 << 63, cut).astype(np.uint64)]))
            bits = sum(int(v).bit_count() for v in (neardup.parity(x) ^ neardup.parity(y)).view(np.uint64))
            assert bits <= len(np.setxor1d(x, y))
    assert not neardup.parity(np.array([3, 3 + (1 << 40)], np.uint64)).any()  # even on every bit


def test_near_dedup_of_a_dense_group_equals_brute_force_and_makes_few_pairs(spark, monkeypatch):
    """Variants of one template link in chains: far fewer pairs than the square, and the classes of all pairs."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(400):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(1, 6)), replace=False):
            words[at] = f"x{k}_{at}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{k}_{j}" for j in range(40)) for k in range(50)] + texts[:20]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    tested = []
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda t, i, pairs: (tested.append(pairs.count()), verified(t, i, pairs))[1])
    got = {r.doc_id for r in neardup.keep_one_similar(docs).collect()}
    sets = [set(neardup.shingle_set(t).tolist()) for t in texts]
    head = list(range(len(texts)))

    def root(k):
        while head[k] != k:
            k = head[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 18 * both >= 8 * (len(sets[a]) + len(sets[b])):
                x, y = root(a), root(b)
                head[max(x, y)] = min(x, y)
    assert got == {k for k in range(len(texts)) if root(k) == k}
    assert sum(tested) < 400 * 399 // 8


def test_near_dedup_stage_starts_from_simhash_balls(spark, monkeypatch):
    """The first candidates are what ball hashing finds: all sets within two bits are joined by them, no others, and hubs don't repeat them."""
    rng = random.Random(12)
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(900)}" for _ in range(250)]
        for k in range(8):
            copy = list(base)
            for _ in range(k // 2):
                copy[rng.randrange(250)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate([*texts, "", *texts[:5]])), "doc_id long, text string")
    calls = []
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda t, i, pairs: (calls.append({tuple(r) for r in pairs.select("a", "b").collect()}), verified(t, i, pairs))[1])
    neardup.keep_one_similar(docs).count()
    prints = {}
    for t in [*texts, ""]:
        found = neardup.shingle_set(t)
        prints[neardup._signed(neardup._set_key(found))] = neardup.majority(found)
    keys = sorted(prints)
    group = {k: k for k in keys}
    for a in keys:
        for b in keys:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
                group = {k: group[a] if x == group[b] else x for k, x in group.items()}
    reached = {k: k for k in keys}
    for a, b in calls[0]:
        assert a < b and (prints[a] ^ prints[b]).bit_count() <= 2
        if reached[a] != reached[b]:
            reached = {k: reached[a] if x == reached[b] else x for k, x in reached.items()}
    same = lambda of: {frozenset(k for k in keys if of[k] == x) for x in of.values()}
    assert same(group) == same(reached) and len(calls[0]) > 5
    assert not any(calls[0] & later for later in calls[1:])
