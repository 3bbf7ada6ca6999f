"""Setup states as a stream against the batch form, over micro-batches, a restart and timers alone."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators import decisions as D
from tidemark.streaming import setups as S

START = datetime(2024, 1, 1)
STATUSES = ["watching", "armed", "detected", "entry_ready", "invalidated"]


def hours(n: float) -> datetime:
    return START + timedelta(hours=n)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def feed(spark, folder, rows):
    spark.createDataFrame(rows, S.EVENT).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def run(spark, folder, **limits):
    """All that has arrived, through the same checkpoint: each call is a restart."""
    events = spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    out = S.setup_stream(events, "1 hour", **limits)
    out.writeStream.trigger(availableNow=True).option("checkpointLocation", str(folder / "state")).format("parquet").start(str(folder / "out")).awaitTermination()
    return spark.read.schema(S.OUT).parquet(str(folder / "out"))


def states(df):
    return {r.setup_id: (r.status, r.reason, r.evaluated, r.entry_score) for r in S.latest(df).collect()}


def detected(i, at, status="watching"):
    return (i, at, -1, status, None, None, None, None, None, None)


def told(i, at, tie=0, rr=4.0, score=0.5, passed=False, broken=None, blocked=False, own=None):
    return (i, at, tie, None, rr, score, passed, broken, blocked, own)


def test_equal_to_the_batch_form_over_micro_batches(spark, folder):
    rng = random.Random(3)
    setups = [detected(i, hours(rng.randrange(0, 200)), rng.choice(STATUSES)) for i in range(40)]
    evaluations = []
    for i, at, *_ in setups:
        for k in range(rng.randrange(0, 6)):
            evaluations.append(told(i, at + timedelta(hours=rng.randrange(0, 150)), k, rng.choice([4.0, 4.0, 4.0, 1.0, None]), rng.random(), rng.random() < 0.3, rng.random() < 0.05, rng.random() < 0.05, rng.choice([None] * 9 + ["own reason"])))
    # In order of time but for an hour, which the watermark allows, in five files; the last moves the clock.
    events = sorted(setups + evaluations, key=lambda e: e[1] + timedelta(minutes=rng.randrange(0, 59)))
    for k in range(5):
        feed(spark, folder, events[len(events) * k // 5 : len(events) * (k + 1) // 5])
        if k in (1, 3):
            run(spark, folder)
    feed(spark, folder, [detected(999, hours(400.5))])
    found = states(run(spark, folder))
    now = F.lit(hours(399.5)).cast("timestamp")
    df = spark.createDataFrame([(i, at, s) for i, at, _, s, *_ in setups], "setup_id long, detected_at timestamp, status string")
    want = D.setup_states(df, spark.createDataFrame(evaluations, S.EVENT).drop("status"), ["at", "tie"], now=now)
    assert found == {r.setup_id: (r.status, r.reason, r.evaluated, r.entry_score) for r in want.collect()}
    assert {s for s, *_ in found.values()} >= {"expired", "invalidated"} and any(why == "own reason" for _, why, *_ in found.values())


def test_expiry_without_an_event_and_forgetting(spark, folder):
    feed(spark, folder, [detected(1, hours(0)), told(1, hours(10), passed=True), detected(2, hours(100))])
    assert states(run(spark, folder, forget_days=10)) == {1: ("entry_ready", "entry_gate_passed", 1, 0.5)}
    # Another setup's event moves the clock past the first one's deadline; an evaluation after that doesn't count.
    feed(spark, folder, [told(2, hours(122)), told(1, hours(121.5), score=0.9)])
    out = run(spark, folder, forget_days=10)
    assert states(out)[1] == ("expired", "max_age_days_exceeded", 1, 0.5)
    assert out.filter("setup_id = 1 and status = 'expired'").first()["at"] == hours(120)
    # After ten days it is forgotten: the same id may be detected anew.
    feed(spark, folder, [detected(3, hours(24 * 20))])
    run(spark, folder, forget_days=10)
    feed(spark, folder, [detected(1, hours(24 * 20 + 2), "armed"), detected(3, hours(24 * 20 + 5))])
    assert states(run(spark, folder, forget_days=10))[1] == ("armed", None, 0, None)


def test_own_invalidation_reason_in_batch(spark):
    setups = spark.createDataFrame([(1, hours(0), "watching"), (2, hours(0), "watching"), (3, hours(0), "watching")], "setup_id long, detected_at timestamp, status string")
    rows = [told(1, hours(1), own="liquidity_gone"), told(2, hours(1), broken=True), told(3, hours(1), own="")]
    out = D.setup_states(setups, spark.createDataFrame(rows, S.EVENT).drop("status"), ["at", "tie"])
    assert {r.setup_id: r.reason for r in out.collect()} == {1: "liquidity_gone", 2: "setup_context_broken", 3: None}


def test_a_bucket_of_setups_costs_the_state_store_one_read_and_write(spark, folder):
    class Store:
        calls, value = 0, None

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                if name == "update":
                    self.value = args[0]
                return self if name in ("getValueState", "getListState") else self.value if name == "get" else self.value is not None if name == "exists" else None

            return call

    store, processor = Store(), S.SetupProcessor(5, 3.0, 30)
    processor.init(store)
    row = spark.createDataFrame([detected(1, hours(0))], S.EVENT).first().asDict()
    assert list(processor.handleInputRows((7,), (Row(**row | {"setup_id": i}) for i in range(1000)), None)) == []
    assert store.calls < 10
    assert S.setup_stream(spark.readStream.schema(S.EVENT).parquet(str(folder / "in")), "1 hour").columns == ["setup_id", "at", "status", "reason", "evaluated", "entry_score"]
