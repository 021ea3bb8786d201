"""Streams equal the batch operators over the same rows, whatever their order, repeats and restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quillmesh.operators import board, store
from quillmesh.streaming import counters

START = dt.datetime(2024, 3, 1)
EVENT = "event_id long, resource string, tool string, seen timestamp"
MESSAGE = "conv string, id long, sender string, at timestamp"
CONFIRMED = "conv string, id long, at timestamp"


def _put(spark, folder, rows, schema, parts):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_access_counters_count_each_event_once_over_restarts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, f"r{rng.randrange(5)}", rng.choice(["grep", "sed", None]), START + dt.timedelta(seconds=rng.randrange(200))) for k in range(300)]
    source, out, write = tmp_path / "events", str(tmp_path / "counters"), counters.counter_writer(str(tmp_path / "counters"))

    def run():
        events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = counters.unique_events(events).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    _put(spark, source, rows[:200], EVENT, 2)
    run()
    _put(spark, source, rows[150:], EVENT, 1)  # some events come again, to a query that was restarted
    run()
    want = store.access_counts(spark.createDataFrame(rows, EVENT)).select("resource", "tool", "access_count", "first_access", "last_access")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(counters.stored_counters(spark, out)) == key(want)
    batch = spark.createDataFrame(rows[:7], EVENT)
    for _ in range(2):  # a batch that runs twice counts once
        counters.counter_writer(out + "-twice")(batch, 4)
    assert counters.stored_counters(spark, out + "-twice").agg(F.sum("access_count")).first()[0] == 7


def test_unread_queue_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    at = lambda: START + dt.timedelta(seconds=rng.randrange(1200))
    messages = [(f"c{k % 4}", k, rng.choice(["me", "ann", "bob"]), at()) for k in range(60)] + [(None, 70, "ann", at()), ("c1", None, "bob", None)]
    done = [(c, i, at()) for c, i, _, _ in rng.sample(messages[:60], 25)] + [("c9", 900, at()), (None, 70, at()), ("c1", None, at())]
    sent, read = messages + messages[:20], done + done[:9]
    rng.shuffle(sent)
    rng.shuffle(read)
    _put(spark, tmp_path / "messages", sent, MESSAGE, 3)
    _put(spark, tmp_path / "confirmed", read, CONFIRMED, 2)
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    changes = counters.unread_changes(stream("messages", MESSAGE), stream("confirmed", CONFIRMED), "me")
    query = changes.writeStream.format("memory").queryName("unread_changes").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = spark.table("unread_changes")
    assert seen.groupBy("conv", "id", "change").count().where("count > 1").count() == 0
    got = seen.groupBy("conv", "id").agg(F.max_by("state", "change").alias("state"), F.max_by("sender", "change").alias("sender")).where("state = 'unread'")
    want = board.unread(spark.createDataFrame(messages, MESSAGE), spark.createDataFrame(done, CONFIRMED).select("conv", "id"), "me")
    rows = lambda df: sorted((tuple(r) for r in df.select("conv", "id", "sender").collect()), key=str)
    assert rows(got) == rows(want) and len(rows(want)) > 10
