"""Streams with state against the batch operators; sources that go while a stream runs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import jobs, progress

EVENT = "job_id long, ts timestamp, event_id long, status string, step string"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def written(spark, rows, folder):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)


class Rows:
    """What a stream has put out, by batch."""

    def __init__(self):
        self.rows = []

    def __call__(self, batch, number):
        self.rows += [(number, r.asDict()) for r in batch.collect()]

    def newest(self):
        return {r["job_id"]: {k: v for k, v in r.items() if k != "final"} for _, r in self.rows}


@pytest.fixture
def stream(spark, tmp_path):
    def run(sink):
        events = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
        made = progress.progress_stream(events, "job_id", "ts", "status", "step", "event_id", "30 minutes", 600)
        query = made.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    return run


def test_progress_in_any_order_equals_the_batch(spark, tmp_path, stream):
    rng = random.Random(4)
    steps = list(progress.STEPS)
    events = [(job, at(rng.randrange(25)), k, rng.choice(["queued", "running", "failed", "completed", None]), rng.choice([*steps, "odd", None])) for k, job in enumerate(rng.choices(range(9), k=120))]
    events += [(20, at(1), 900, "failed", "parsing"), (20, at(2), 901, "running", "embedding"), (21, at(3), 902, "running", "saving"), (21, at(3), 903, "completed", "saving")]
    rng.shuffle(events)
    sink = Rows()
    for k in range(0, len(events), 40):  # each run is a batch
        written(spark, events[k : k + 40], str(tmp_path / "in"))
        stream(sink)
    batch = {r["job_id"]: r.asDict() for r in progress.progress(spark.createDataFrame(events, EVENT), "job_id", "ts", "status", "step", "event_id").collect()}
    assert sink.newest() == batch
    assert batch[20]["retrying"] and batch[20]["percent"] == 50 and not batch[21]["retrying"] and batch[21]["percent"] == 100


def test_late_events_are_left_out_and_state_goes(spark, tmp_path, stream):
    sink, folder = Rows(), str(tmp_path / "in")
    written(spark, [(1, at(0), 1, "running", "fetching"), (2, at(5), 2, "failed", "parsing")], folder)
    stream(sink)
    written(spark, [(1, at(20), 3, "completed", "completed"), (2, at(21), 4, "running", "chunking")], folder)
    stream(sink)
    assert sink.newest()[2]["retrying"] and sink.newest()[1]["percent"] == 100
    written(spark, [(9, at(300), 5, "queued", "queued")], folder)  # the watermark passes both jobs
    stream(sink)
    written(spark, [(1, at(1), 6, "failed", "saving"), (9, at(301), 7, "running", "starting")], folder)  # far too late for job 1
    query = stream(sink)
    final = [r["job_id"] for _, r in sink.rows if r["final"]]
    assert sorted(final) == [1, 2] and sink.newest()[1]["status"] == "completed" and sink.newest()[1]["events"] == 2
    held = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert held[-1] == 1  # only the job that the watermark hasn't passed


def test_work_on_deleted_sources_leaves_nothing(spark, tmp_path):
    source, store, check, alive = (str(tmp_path / x) for x in ("in", "store", "check", "alive"))
    kind = "doc_id long, text string"

    def run(rows, live):
        spark.createDataFrame([(i,) for i in live], "id long").coalesce(1).write.mode("overwrite").parquet(alive)
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        jobs.incremental_chunks(spark.readStream.schema(kind).parquet(source), store, check, live=lambda s: s.read.parquet(alive)).awaitTermination()
        return sorted((r["id"], r["content"]) for r in jobs.current_chunks(spark.read.parquet(store)).collect())

    assert run([(1, "One."), (2, "Two."), (3, "Three.")], [1, 2]) == [(1, "One."), (2, "Two.")]
    assert run([(4, "Four."), (2, "Two.")], [2, 4]) == [(2, "Two."), (4, "Four.")]  # 1 was deleted meanwhile
    assert run([(1, "One."), (2, "Two more.")], [1, 2, 4]) == [(1, "One."), (2, "Two more."), (4, "Four.")]  # and is back
    before = sorted(map(str, spark.read.parquet(store).collect()))
    assert run([(1, "One."), (4, "Four.")], [1, 2, 4]) == [(1, "One."), (2, "Two more."), (4, "Four.")]
    assert sorted(map(str, spark.read.parquet(store).collect())) == before  # nothing new, nothing written


def test_percent(spark):
    rows = spark.createDataFrame([("running", "embedding"), ("completed", "x"), ("queued", None), (None, "saving")], "a string, b string")
    assert [r[0] for r in rows.select(progress.percent(F.col("a"), F.col("b"))).collect()] == [50, 100, 0, 85]
