"""Operators 11 to 13 against brute force, their SQL and held-out labels."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import classifier, names, trie

DATA = "/root/testdata/sf0.001"


def alignment(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            d[i, j] = i + j if not i or not j else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def some_names(n, seed, letters="abé", most=8):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(most + 1))) for _ in range(n)]


def test_banded_distance_is_optimal_string_alignment():
    a, b = some_names(1500, 1) + ["ca", "", "", "x" * 5000], some_names(1500, 2) + ["abc", "", "abc", "x" * 2500 + "y" + "x" * 2500]
    for limit in (1, 2, 3):
        want = [min(limit + 1, alignment(x, y)) if len(x) < 100 else 1 for x, y in zip(a, b, strict=True)]
        assert names.banded_distances(a, b, limit).tolist() == want


@pytest.mark.parametrize("prefix", [3, 5, 32])
def test_close_names_share_a_variant(prefix):
    for a, b in zip(some_names(800, 3), some_names(800, 4), strict=True):
        if alignment(a, b) <= 2:
            (_, x), (_, y) = names.variant_keys([a], 2, prefix), names.variant_keys([b], 2, prefix)
            assert set(x.tolist()) & set(y.tolist()), (a, b)


def test_variants_are_each_name_once():
    rows, keys = names.variant_keys(["aab", "", "b"], 2)
    left = lambda s: {"".join(c for i, c in enumerate(s) if i not in d) for d in [(), *((i,) for i in range(len(s))), *((i, j) for i in range(len(s)) for j in range(i))]}
    assert [int((rows == k).sum()) for k in range(3)] == [len(left(s)) for s in ("aab", "", "b")]
    assert len(set(zip(rows.tolist(), keys.tolist(), strict=True))) == len(keys)


def swapped(key, name):
    h = zlib.crc32(str(key).encode())
    if name is None or h % 2 or len(name) < 2:
        return name
    at = h % (len(name) - 1)
    return name[:at] + name[at + 1] + name[at] + name[at + 2 :]


def test_misspelt_exchanges_code_points(spark):
    rows = [(i, x) for i, x in enumerate([*some_names(60, 5, "aé\U0001f600"), None, "", "x", "ab"])]
    df = spark.createDataFrame(rows, "vendor_id long, name string")
    got = {r[0]: r[1] for r in df.select("vendor_id", names.misspelt(F.col("vendor_id"), F.col("name"))).collect()}
    assert got == {k: swapped(k, x) for k, x in rows}


def folded(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def joined(clients, vendors, limit=2):
    out = defaultdict(lambda: [0, None, 0])
    for v, b in {(v, folded(b)) for v, b in vendors if b}:
        for c, a in clients:
            if a and (d := alignment(folded(a), b)) <= limit:
                row = out[v, d]
                row[0] += 1
                if c is not None:
                    row[1] = c if row[1] is None else min(row[1], c)
                    row[2] += zlib.crc32(str(c).encode())
    return {(v, d, *x) for (v, d), x in out.items()}


def test_edit_join_matches_brute_force(spark):
    clients = [*enumerate(some_names(250, 6, "abAé")), (5, None), (None, "ab"), (7, ""), (7, "ab"), (7, "ab"), (9, "q" * 300), (10, "q" * 301 + "z"), (11, "É")]
    vendors = [*enumerate(some_names(40, 7, "abBé")), (3, None), (None, "ba"), (4, "ab"), (4, "AB"), (50, "q" * 301), (51, ""), (52, "é")]
    # extra columns with clashing names; one name for a third of the rows
    clients += [(1000 + i, "abab") for i in range(130)]
    c = spark.createDataFrame([(*x, 1, "n") for x in clients], "client_id long, name string, nid long, key string").repartition(3)
    v = spark.createDataFrame([(*x, 1, "n") for x in vendors], "vendor_id long, name string, r long, distance string").repartition(2)
    got = {tuple(r) for r in names.edit_join(c, v).select("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc").collect()}
    assert got == joined(clients, vendors)
    assert {tuple(r) for r in names.edit_join(c, v, prefix=4).select("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc").collect()} == got
    assert names.edit_join(c.limit(0), v).count() == 0 and names.edit_join(c, v.limit(0)).count() == 0


def same(got, want):
    key = sorted(got.columns)
    one = lambda x: "~" if pd.isna(x) else x if isinstance(x, str) else str(int(x))
    rows = lambda df: sorted(tuple(map(one, r)) for r in df[key].astype(object).itertuples(index=False))
    assert sorted(want.columns) == key and rows(got) == rows(want) and len(got)


def test_name_join_matches_sql(spark):
    con = duckdb.connect()
    for t in ("clients", "vendors"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    same(names.op11_edit_name_join(spark, "/root/testdata/sf0.01").toPandas(), con.sql(names.ORACLE).df())


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            told = f"{len(role.encode())}:{role}{text}".encode()
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(told).digest()[:16], role, text))
    own = {c: [(x[3], x[4]) for x in sorted(t)] for c, t in convs.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    out = set()
    for p, m in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[:-1] == q for x in nodes)
        ends = ",".join(str(c) for c in m if len(paths[c]) == len(p))
        out.add(
            (m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), sum(map(leaf, below)),
             sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


TRIE = "conv_id long, turn long, role string, text string"


def trie_rows(df):
    return {tuple(r) for r in trie.prefix_trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_brute_force(spark, seed):
    r = random.Random(seed)
    ids = [*range(12), 100, *range(103, 108), 250, 251, -7, -150, -100, 9_000_000_005]
    rows = []
    for c in ids:
        turns = [(c, t, r.choice(["user", "bot", None]), r.choice(["hé", "yo", "a\U0001f600b", None, ""])) for t in range(r.randrange(1, 9))]
        rows += turns
    rows += [(3, None, "user", "null turn"), (3, None, "user", "null turn"), (4, 2, "bot", "tie"), (4, 2, "bot", "other tie"), (None, 0, "user", "no id")]
    # one conversation for a third of the conversations, in one family and in others
    rows += [(c, t, "user", f"hot {t}") for c in (*range(20, 27), *range(300, 303)) for t in range(4)]
    df = spark.createDataFrame([(*x, b"x", 1) for x in rows], f"{TRIE}, node binary, depth int").repartition(3)
    assert trie_rows(df) == brute_trie(rows)


def test_trie_of_odd_tables(spark):
    assert trie_rows(spark.createDataFrame([], TRIE)) == set()
    assert trie_rows(spark.createDataFrame([(None, 1, "a", "b")], TRIE)) == set()
    # turnless: the base is absent and all own turns are among the first h
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(alone, 0, "user", "x")]
    assert trie_rows(spark.createDataFrame(rows, TRIE)) == brute_trie(rows) and len(brute_trie(rows)) == 1
    rows = [(1, t, "user", "long " * 2000 + str(t)) for t in range(60)]
    assert trie_rows(spark.createDataFrame(rows, TRIE)) == brute_trie(rows)


def test_trie_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    same(trie.op13_conversation_trie(spark, DATA).toPandas(), con.sql(trie.ORACLE).df())


def test_words_are_split_as_defined():
    import re

    texts = ["a b\tc\n\nd  e", None, "", " \r\v\f ", "é\x1cx \x85y z", "w" * (2 * classifier.PIECE + 5), "ab " * classifier.PIECE]
    count = np.zeros(len(texts), int)
    for w in classifier.split_words(texts):
        count += np.bincount(w.text, minlength=len(texts))
    want = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]
    assert count.tolist()[:5] == want[:5] and count[5] == 3 and count[6] == want[6]
    one = [np.concatenate([w.word for w in classifier.split_words([t])]) for t in ("Same word, same hash", "x same WORD, hash")]
    assert one[0][0] == one[0][2] == one[1][1] and one[0][1] == one[1][2] and one[0][3] == one[1][3] and len(set(one[0].tolist())) == 3


def test_context_vectors_match_plain_sums(spark):
    texts = ["the cat sat on the mat", "a cat", None, "", "x", "the cat sat on the mat"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = np.zeros((classifier.BUCKETS, classifier.DIM))
    for t in texts:
        for w in classifier.split_words([t]):
            place, sign = classifier._index(w.word)
            for i, b in enumerate(classifier._buckets(w.word)):
                for j in range(max(0, i - classifier.REACH), min(len(w.word), i + classifier.REACH + 1)):
                    if i != j:
                        np.add.at(want[b], place[j], sign[j])
    want /= np.maximum(np.sqrt((want**2).sum(axis=1, keepdims=True)), 1e-12)
    assert np.allclose(classifier.context_vectors(df), want, atol=1e-6)


def test_pooled_rows_do_not_depend_on_neighbours():
    v = np.random.default_rng(1).normal(size=(classifier.BUCKETS, classifier.DIM)).astype(np.float32)
    texts = ["one two two", "", "three " * 50_000, None, "ONE!! two $$$"]
    rows = classifier.pooled(v, texts)
    assert np.allclose(rows, np.concatenate([classifier.pooled(v, [t]) for t in texts]), atol=1e-6)
    assert not rows[1].any() and not rows[3].any() and rows[2][-1] > 0.99


def test_temperature_is_the_best_one():
    r = np.random.default_rng(3)
    z = r.normal(0, 2, 4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(classifier.calibrated(3 * z, y, np.ones(4000)) - 3) < 0.3


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = classifier.op12_quality_classifier(spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_classifier_of_odd_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = classifier.train(odd_docs, none)
    assert {r.score for r in classifier.score_columns(odd_docs, model).collect()} == {0.5}
    assert classifier.score_columns(no_docs, classifier.train(no_docs, none)).count() == 0
    labels = spark.createDataFrame([(d, q, 0, "x") for d, q in [(1, 1), (1, 1), (2, 0), (5, 1), (7, None), (None, 1), (8, 0), (9, 1), (99, 1)]], "doc_id long, quality int, h int, text string")
    rows = classifier.score_columns(odd_docs, classifier.train(odd_docs, labels)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 8)}) == 1  # null, empty and blank texts


def test_labels_of_held_out_rows_teach_nothing(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcdefgh") * 3 for _ in range(20)) + (" !!!" if i % 2 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    score = lambda f: [x.score for x in classifier.score_columns(docs, classifier.train(docs, spark.createDataFrame([(i, f(i)) for i in range(300)], "doc_id long, quality int"))).orderBy("doc_id").collect()]
    one = score(lambda i: i % 2)
    assert one == score(lambda i: 1 - i % 2 if i in held else i % 2)
    assert all((s >= 0.5) == (i % 2 == 1) for i, s in enumerate(one))
