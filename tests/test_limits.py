"""Bounds that keep a task's or a worker's memory apart from the size of tables."""

from quillmesh import runtime
from quillmesh.plans.registry import QUERIES


def test_batches_are_bounded_where_the_package_is_shipped(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        for held, want in (("2147483647", runtime.BATCH_BYTES), ("4096", 4096)):
            spark.conf.set(key, held)
            runtime.ship(spark)
            assert int(spark.conf.get(key).rstrip("bB")) == want
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_task_states_deals_events_by_task_alone(spark):
    plan = QUERIES["task_states"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning(id" in plan
