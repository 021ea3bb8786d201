"""The incremental search index against rebuilt ones; the forms of the query language; folding."""

import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import fts, ftsdelta

SEGMENT = "id long, ordinal long, text string, title string"
COLUMNS = ("text", "title")


def ranks(index, query):
    return {(r.id, r.ordinal): round(r.rank, 9) for r in fts.bm25(index, query).collect()}


def files_of(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_changes_equal_a_rebuild(spark, tmp_path):
    r = random.Random(4)
    words = "alpha beta gamma delta Café ночь" .split()
    text = lambda: " ".join(r.choice(words) for _ in range(r.randrange(0, 7)))
    live, want = ftsdelta.create(spark, COLUMNS, str(tmp_path)), {}
    for step in range(3):
        put = {(r.randrange(12), r.randrange(3)): (text(), text()) for _ in range(8 if step else 30)}
        gone_keys = [(r.randrange(12), r.randrange(3)) for _ in range(3)]
        gone_ids = [r.randrange(12)]
        taken = [(i,) for i in gone_ids] if step % 2 else gone_keys
        schema = "id long" if step % 2 else "id long, ordinal long"
        before = files_of(tmp_path)
        live = ftsdelta.apply(live, spark.createDataFrame([(*k, *x) for k, x in put.items()], SEGMENT), spark.createDataFrame(taken, schema))
        assert before <= files_of(tmp_path)
        want = {k: x for k, x in want.items() if (k[0] not in gone_ids if step % 2 else k not in gone_keys)} | put
        if step == 1:
            live = ftsdelta.merge(live, 2)
        rebuilt = fts.build_index(spark.createDataFrame([(*k, *x) for k, x in want.items()], SEGMENT), COLUMNS)
        for q in ("beta OR cafe", 'title:gamma NOT text:delta OR "alpha beta" OR ноч*'):
            assert ranks(ftsdelta.index(live), q) == ranks(rebuilt, q), (step, q)
        assert (live.n, live.size) == tuple(ftsdelta.segments(live).agg(F.count(F.lit(1)), F.sum("size")).first())
    again = ftsdelta.open_live(spark, str(tmp_path), COLUMNS)
    assert again == live
    merged = ftsdelta.merge(live, 2)
    found = ranks(ftsdelta.index(live), "alpha OR beta")
    assert ranks(ftsdelta.index(merged), "alpha OR beta") == found and max(f[3] for f in merged.files) > 0
    assert ftsdelta.vacuum(merged) and ranks(ftsdelta.index(ftsdelta.open_live(spark, str(tmp_path), COLUMNS)), "alpha OR beta") == found


def test_a_merge_leaves_other_buckets_alone(spark, tmp_path):
    live = ftsdelta.create(spark, ("text",), str(tmp_path))
    for k in range(4):
        live = ftsdelta.apply(live, spark.createDataFrame([(k, 0, "same", None), (100 + k, 0, f"only{k}", None)], SEGMENT))
    bucket = lambda w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(fts.BUCKETS)).cast("int")).first()[0]
    merged = ftsdelta.merge(live)
    own = lambda x: {f for f in x.files if f[0] == 0 and f[1] != bucket("same")}
    assert own(merged) == own(live) and {f[3] for f in merged.files if f[:2] == (0, bucket("same"))} == {1}
    assert len(ranks(ftsdelta.index(merged), "same")) == 4 and len(ranks(ftsdelta.index(merged), "only*")) == 4


def test_a_change_that_did_not_end_is_not_seen(spark, tmp_path):
    live = ftsdelta.apply(ftsdelta.create(spark, ("text",), str(tmp_path)), spark.createDataFrame([(1, 0, "one", None)], SEGMENT))
    later = ftsdelta.apply(live, spark.createDataFrame([(1, 0, "two", None)], SEGMENT))
    os.remove(tmp_path / f"manifest/v={later.version}/_SUCCESS")
    seen = ftsdelta.open_live(spark, str(tmp_path))
    assert seen.version == live.version and list(ranks(ftsdelta.index(seen), "one")) == [(1, 0)]
    redone = ftsdelta.apply(seen, taken=spark.createDataFrame([(1,), (None,), (7,)], "id long"))
    assert redone.n == 0 and ftsdelta.open_live(spark, str(tmp_path)) == redone
    with pytest.raises(RuntimeError):
        ftsdelta.apply(seen, spark.createDataFrame([(2, 0, "late", None)], SEGMENT))


def test_odd_changes(spark, tmp_path):
    live = ftsdelta.create(spark, COLUMNS, str(tmp_path))
    none = spark.createDataFrame([], SEGMENT)
    assert ranks(ftsdelta.index(live), "x") == {} and ftsdelta.apply(live) == live
    live = ftsdelta.apply(live, none, spark.createDataFrame([(1,)], "id long"))
    rows = [(1, 0, "b", None), (1, 0, "a", None), (1, 0, "a", None), (None, 0, "a", None), (2, None, "a", None), (3, 0, None, None), (4, 0, "", ""), (5, 0, "long " * 50_000, "t")]
    live = ftsdelta.apply(live, spark.createDataFrame([(*x, 7, "y") for x in rows], f"{SEGMENT}, bucket int, gen string"))
    assert live.n == 4 and list(ranks(ftsdelta.index(live), "a OR b")) == [(1, 0)] and list(ranks(ftsdelta.index(live), "long")) == [(5, 0)]


def test_both_sides_fold_alike(spark):
    letters = [chr(k) for k in range(0x21, 0x30000) if unicodedata.category(chr(k))[0] in "LNM" and unicodedata.category(chr(k)) != "Cn"]
    df = spark.createDataFrame([(i, f"x{c}y {c}", c) for i, c in enumerate(letters)], "i int, t string, c string").where(F.col("c").rlike("^[\\p{L}\\p{N}\\p{M}]$"))  # those that the JVM's Unicode knows
    differ = [letters[r.i] for r in df.select("i", fts.tokens("t").alias("t"), fts.n_tokens("t").alias("n")).collect() if (w := fts.words(f"x{letters[r.i]}y {letters[r.i]}")) != r.t or len(w) != r.n]
    # letters that one side's Unicode knows and the other's does not, or lower-cases otherwise
    assert len(differ) < 0.001 * len(letters), differ[:20]
    assert not [c for c in differ if ord(c) < 0x530 or 0x1E00 <= ord(c) < 0x2000 or 0x3040 <= ord(c) < 0xA000]
    index = fts.build_index(spark.createDataFrame([(1, 0, "чай"), (2, 0, "が"), (3, 0, "ΚΑΦΈΣ"), (4, 0, "Café"), (5, 0, "été")], "id long, ordinal long, text string"))
    assert [sorted(k[0] for k in ranks(index, q)) for q in ("чай", "ЧАЙ", "が", "καφές", "cafe", "été")] == [[1], [1], [2], [3], [4], [5]]


def test_column_filters_and_first_words(spark):
    rows = [(1, "the cat", "a menu"), (2, "a cat the", "the end"), (3, "the end of the day", "x"), (4, 'say "hi', "cat")]
    index = fts.build_index(spark.createDataFrame([(i, 0, t, h) for i, t, h in rows], SEGMENT), COLUMNS)
    found = lambda q: sorted(k[0] for k in ranks(index, q))
    assert found("^the") == [1, 2, 3] and found("text:^the") == [1, 3] and found("title : ^ the") == [2] and found("^cat") == [4]
    assert found("-title:cat") == [1, 2] and found("{text title}:end") == [2, 3] and found("-{text}:end") == [2] and found("- {text title} : end") == []
    assert found("the + end") == [2, 3] and found("end + of + th*") == [3] and found('"the end" + of') == [3]
    assert found("title:(cat OR {text}:the)") == [4] and found("TEXT:cat") == [1, 2]
    assert found("cat NOT the a") == [4]  # NOT takes all terms side by side
    assert found("cat a NOT end") == [1] and found("(cat OR end) NOT (the a)") == [3, 4] and found("NEAR(the)") == [1, 2, 3]
    assert fts.parse('"say ""hi"""') == [("phrase", ["say", "hi"], False, None)]
    for bad in ("{a}", "{} : x", "- x", "a + ", "^", "a ^ OR", "NEAR(", "NEAR(a, b)", "x) y", "a : : b", "+a", "a, b", "{a : b"):
        with pytest.raises(ValueError):
            fts.parse(bad)
    with pytest.raises(ValueError):
        found("-nope:x")


def test_postings_are_made_and_written_where_segments_are(spark):
    """No row of postings is shuffled or sorted on its way to its bucket."""
    rows = [(1, 0, "b a b", "a"), (1, 1, None, "c"), (2, 0, "", ""), (3, 5, "Été ete x", None)]
    made = fts.postings(spark.createDataFrame(rows, SEGMENT), COLUMNS)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    at = (1 << 40).__add__
    want = {("a", 1, 0, 4, 2, (1, at(0))), ("b", 1, 0, 4, 2, (0, 2)), ("c", 1, 1, 1, 1, (at(0),)), ("ete", 3, 5, 3, 2, (0, 1)), ("x", 3, 5, 3, 1, (2,))}
    assert {(r.term, r.id, r.ordinal, r.size, r.tf, tuple(r.places)) for r in made.collect()} == want


def test_texts_and_lasting_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Keys that stand once bring their texts in where they are; a merge gathers only postings of ids that a tombstone may name."""
    plans, real = [], ftsdelta._write
    monkeypatch.setattr(ftsdelta, "_write", lambda live, kind, gen, rows, sort: (plans.append((kind, rows)), real(live, kind, gen, rows, sort))[1])
    monkeypatch.setattr(ftsdelta, "_MERGED", 5)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    live = ftsdelta.create(spark, ("text",), str(tmp_path))
    for k in range(3):
        live = ftsdelta.apply(live, spark.createDataFrame([(i, 0, f"same w{i} g{k}", None) for i in range(20 * k, 20 * k + 30)], SEGMENT))
    assert [k for k, _ in plans].count(0) == 3 and not any("Exchange" in plan(rows) for k, rows in plans if k == 0)
    twice = ftsdelta.apply(live, spark.createDataFrame([(7, 0, "same a", None), (7, 0, "same b", None), (8, 0, "same", None)], SEGMENT))
    found = ranks(ftsdelta.index(twice), "same OR b OR w9")
    assert len(found) == 70 and list(ranks(ftsdelta.index(twice), "b")) == [(7, 0)] and not ranks(ftsdelta.index(twice), "w8")
    plans.clear()
    merged = ftsdelta.merge(twice, 2, tidy=True)
    postings = [rows for k, rows in plans if k == 0]
    assert len(postings) > 1 and all("Union" in plan(rows) and "BroadcastHashJoin" in plan(rows) for rows in postings)
    assert ranks(ftsdelta.index(merged), "same OR b OR w9") == found and ftsdelta.vacuum(merged) == []
    held = ftsdelta._read(merged, 0, [f for f in merged.files if f[0] == 0 and f[3] > 0], ftsdelta._POSTING)
    assert held.where("term = 'same'").count() == 70 and held.where("term = 'w8'").count() == 0


@pytest.mark.parametrize("bits", [6, 24])
def test_marks_lose_and_keep_nothing(spark, monkeypatch, bits):
    """Rows that meet marks by chance stay: only the tombstone of a row's own key and of a later generation ends it."""
    monkeypatch.setattr(ftsdelta, "_MARK_BITS", bits)
    r = random.Random(bits)
    rows = spark.createDataFrame([(k, r.randrange(-50, 200), r.randrange(3), r.randrange(1, 6)) for k in range(500)], "n long, id long, ordinal long, gen int")
    ended = spark.createDataFrame([(i, o, r.randrange(1, 6)) for i in range(-20, 60, 3) for o in range(2)], "id long, ordinal long, ended int")
    some = ftsdelta._alive_here(rows, ended)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, ftsdelta._alive(rows, ended).collect())) and some.columns == rows.columns and some.count() < 500
    assert ftsdelta._alive_here(rows, ended.limit(0)).count() == 500


def test_a_put_of_one_part_is_dealt(spark):
    rows = spark.createDataFrame([(k, 0, "same", None) for k in range(40)], SEGMENT)
    assert ftsdelta._spread(rows.repartition(8)).rdd.getNumPartitions() == 8
    dealt = ftsdelta._spread(rows.coalesce(1))
    assert "hashpartitioning(id" in dealt._jdf.queryExecution().executedPlan().toString() and dealt.count() == 40
