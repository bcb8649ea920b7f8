"""The queue's life cycle: publishing, delivery over restarts, steps, batches."""

import pytest
from pyspark.sql import functions as F

from cadence.operators import messages, ranges
from cadence.sources import mailbox
from cadence.streaming import events


@pytest.fixture(scope="module")
def send(spark):
    spark.dataSource.register(mailbox.Mailbox)
    return lambda rows, path: spark.createDataFrame(rows, "name string, text string").repartition(3).write.format("mailbox").option("path", str(path)).mode("append").save()


def _files(path):
    return {p.name: p.read_text() for p in path.iterdir() if p.is_file() and not p.name.startswith(".")}


def test_publishing_again_changes_nothing(send, tmp_path):
    rows = [("m1", "one"), ("m2", "two"), ("m3", None)]
    send(rows, tmp_path)
    send([*rows, ("m4", "four")], tmp_path)
    assert _files(tmp_path) == {"m1": "one", "m2": "two", "m3": "", "m4": "four"}


def test_a_taken_name_fails_the_whole_job(send, tmp_path):
    send([("m1", "one")], tmp_path)
    with pytest.raises(Exception, match="taken by another"):
        send([("m0", "zero"), ("m1", "another")], tmp_path)
    with pytest.raises(Exception, match="two messages of one name"):
        send([("m5", "a"), ("m5", "b")], tmp_path)
    with pytest.raises(Exception, match="no name of a message"):
        send([("m6", "a"), ("../m7", "b")], tmp_path)
    assert _files(tmp_path) == {"m1": "one"} and not list((tmp_path / "_tmp").iterdir())


def test_delivery_goes_on_after_a_restart(spark, tmp_path):
    roles = spark.createDataFrame([("a",), ("b",)], "role string")
    schema = "id long, to string, at timestamp"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [[(1, "a,b", "2024-01-01 00:00:00"), (2, "a,x", "2024-01-01 00:00:00")], [(1, "b,a", "2024-01-01 01:00:00"), (3, "b", "2024-01-01 01:00:00"), (3, "b", "2024-01-01 01:00:00")]]
    for rows in batches:
        spark.createDataFrame(rows, "id long, to string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        events.deliver(spark.readStream.schema(schema).parquet(source), roles, out, state, "at", "1 day")
    events.deliver(spark.readStream.schema(schema).parquet(source), roles, out, state, "at", "1 day")
    got = sorted((r.id, r.recipient) for r in spark.read.parquet(out).collect())
    assert got == [(1, "a"), (1, "b"), (3, "b")]


def test_steps_of_the_queue(spark):
    schema = "id long, role string, priority int, created long, dequeued_at long, completed_at long"
    rows = [(1, "a", 5, 1, 10, None), (2, "a", 1, 9, None, None), (3, "a", 1, 2, None, None), (4, "a", 7, 0, None, None), (5, "b", 1, 1, 10, None), (6, "b", 0, 1, None, None), (7, "c", 3, 1, None, None), (8, "c", 3, 2, None, None), (9, "d", 1, 1, 4, 6)]
    queue = spark.createDataFrame(rows, schema).repartition(3)
    done = spark.createDataFrame([(1, 20), (1, 25), (2, 30), (99, 1)], "id long, ended long")
    step = messages.advance(queue, done, F.lit(50).cast("long"), ["priority", "created"])
    got = {r.id: (r.dequeued_at, r.completed_at) for r in step.collect()}
    assert got == {1: (10, 25), 2: (None, None), 3: (50, None), 4: (None, None), 5: (10, None), 6: (None, None), 7: (50, None), 8: (None, None), 9: (4, 6)}
    again = {r.id: (r.dequeued_at, r.completed_at) for r in messages.advance(step, done, F.lit(60).cast("long"), ["priority", "created"]).collect()}
    assert again == got
    batch = {r.id: r.dequeued_at for r in messages.advance(queue, done, F.lit(50).cast("long"), ["priority", "created"], batch="priority").collect()}
    assert [k for k, v in batch.items() if v == 50] and {k for k, v in batch.items() if v == 50} == {2, 3, 7, 8}
    assert messages.advance(queue.limit(0), done, F.lit(1).cast("long"), ["priority", "created"]).count() == 0


def test_batches_are_numbered_from_one(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, "z")], "role string, n int, text string")
    assert {r.role: r.text for r in messages.batch_text(df, "role", ["n"]).collect()} == {"a": "[1/2]\nx\n\n[2/2]\ny", "b": "[1/1]\nz"}
    with pytest.raises(ValueError, match="empty batch"):
        messages.batch_text(df.limit(0), "role", ["n"])


def test_medians_by_places(spark):
    import statistics

    rows = [(k, float(v)) for k, vs in {"a": [3, 1, 2], "b": [4, 1, 1, 9], None: [7], "c": [5] * 40}.items() for v in vs] + [("a", None), ("d", None)]
    got = {r.k: r.median for r in ranges.medians(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v").collect()}
    assert got == {"a": 2.0, "b": statistics.median([4, 1, 1, 9]), None: 7.0, "c": 5.0}
