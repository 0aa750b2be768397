import pytest

from grovekit.operators import events as E
from grovekit.streaming import jobs as ST

EVENTS = "run_id long, type string, name string, started boolean, ts_nanos long, path string, completed long, ts timestamp, message_id long"


@pytest.fixture
def stream(spark, tmp_path):
    def start(rows, schema, job, mode="append"):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
        out = job(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = out.writeStream.format("memory").queryName("streamed").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table("streamed").collect()

    return start


def event(i, kind, seconds, name=None, started=None, completed=0):
    import datetime

    return i, kind, name, started, seconds * 10**9, "p", completed, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds), seconds


def test_phase_latency(stream):
    rows = [event(1, "phase", 5, "scan", True), event(1, "phase", 8, "scan", False), event(2, "phase", 1, "plan", False), event(1, "phase", 9, "other", True)]
    assert list(map(tuple, stream(rows, EVENTS, ST.phase_latency_stream))) == [(1, "scan", 3.0)]


def test_checkpoint_state(stream):
    schema = "path string, size long, fingerprint string, offset long, length long"
    rows = [("f", 9, "x", 0, 5), ("f", 9, "x", 3, 4), ("f", 9, "x", 7, 2), ("g", 9, "x", 0, 5), ("g", 9, "y", 6, 1)]
    assert sorted(map(tuple, stream(rows, schema, ST.checkpoint_state, "update"))) == [("f", "x", 0, 7), ("f", "x", 7, 2), ("g", "y", 6, 1)]


def test_totals_as_in_batch(spark, stream):
    rows = [event(i % 3, kind, i) for i, kind in enumerate(["progress", "failed", "transferred", "transferred", "other"] * 4)]
    got = stream(rows, EVENTS, ST.run_totals_stream, "complete")
    assert sorted(got) == sorted(E.run_totals(spark.createDataFrame(rows, EVENTS)).collect())


def test_windows_close_behind_the_watermark(stream):
    rows = [event(1, "transferred", s, completed=10) for s in (0, 60, 3700, 20_000)]
    got = stream(rows, EVENTS, lambda e: ST.progress_throughput(e, "1 hour", "10 minutes"))
    assert sorted((r["files"], r["bytes"]) for r in got) == [(1, 10), (2, 20)]


def test_duplicates_within_the_watermark(stream):
    rows = [event(1, "progress", s) for s in (1, 1, 2)]
    assert len(stream(rows, EVENTS, lambda e: ST.dedup_messages(e, "10 minutes"))) == 2


def test_incremental_diff(spark, tmp_path):
    schema = "path string, kind string, size long, mtime_ns long, mode int"
    spark.createDataFrame([("a", "file", 1, 0, 420), ("b", "file", 2, 0, 420)], schema).write.parquet(str(tmp_path / "in"))
    held = spark.createDataFrame([("a", "file", 1, 0, 420), ("b", "file", 1, 0, 420), ("c", "file", 1, 0, 420)], schema)
    seen = []
    job = ST.incremental_diff(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda: held, lambda plan, n: seen.extend(plan.select("path", "classification").collect()))
    assert job.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, seen)) == [("a", "unchanged"), ("b", "changed")]
