"""Tables of progress events and failures: events(run_id, type, ts_nanos, name, started, path, completed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# The phases of a run.
PHASES = ("scan", "plan", "transfer", "metadata")


def phase_durations(events: DataFrame) -> DataFrame:
    """run_id, name, seconds from the last start to the last end of each phase; none if incomplete or negative."""
    phases = events.filter((F.col("type") == "phase") & F.col("name").isin(*PHASES))
    last = phases.groupBy("run_id", "name").agg(F.max(F.when(F.col("started"), F.col("ts_nanos"))).alias("_a"), F.max(F.when(~F.col("started"), F.col("ts_nanos"))).alias("_b"))
    return last.filter("_b >= _a").select("run_id", "name", ((F.col("_b") - F.col("_a")) / 1e9).alias("seconds"))


def phase_latencies(events: DataFrame) -> DataFrame:
    """run_id, name, seconds from each end of a phase back to the start just before it: the batch form of the stream."""
    order = W.partitionBy("run_id", "name").orderBy("ts_nanos", "started")
    phases = events.filter((F.col("type") == "phase") & F.col("name").isin(*PHASES))
    seen = phases.withColumn("_at", F.lag("ts_nanos").over(order)).withColumn("_begun", F.lag("started").over(order))
    return seen.filter("not started and _begun").select("run_id", "name", ((F.col("ts_nanos") - F.col("_at")) / 1e9).alias("seconds"))


def done_event(events: DataFrame) -> DataFrame:
    """The first `done` or `finished` record of each run."""
    found = events.filter(F.col("type").isin("done", "finished"))
    return found.groupBy("run_id").agg(F.min_by(F.struct("type", "path", "completed"), F.struct("ts_nanos", "path")).alias("x"), F.min("ts_nanos").alias("ts_nanos")).select("run_id", "ts_nanos", "x.*")


def progress_deltas(events: DataFrame) -> DataFrame:
    """run_id, path, ts_nanos, delta: what was added since the record before, 0 if less."""
    order = W.partitionBy("run_id", "path").orderBy("ts_nanos", "completed")
    before = F.coalesce(F.lag("completed").over(order), F.lit(0).cast("long"))
    return events.filter("type = 'progress'").select("run_id", "path", "ts_nanos", F.greatest(F.col("completed") - before, F.lit(0).cast("long")).alias("delta"))


def progress_rates(events: DataFrame) -> DataFrame:
    """run_id, bytes, elapsed seconds, rate."""
    out = progress_deltas(events).groupBy("run_id").agg(F.sum("delta").alias("bytes"), ((F.max("ts_nanos") - F.min("ts_nanos")) / 1e9).alias("elapsed"))
    return out.withColumn("rate", F.when(F.col("elapsed") > 0, F.col("bytes") / F.col("elapsed")))


def run_totals(events: DataFrame) -> DataFrame:
    t = F.col("type")
    return events.groupBy("run_id").agg(
        F.count_if(t == "transferred").alias("transferred"), F.count_if(t == "failed").alias("failed"), F.count_if(t == "progress").alias("progress"), F.count("*").alias("events")
    )


def totals_until_done(events: DataFrame) -> DataFrame:
    """run_id, transferred, failed, progress, events, outcome: the totals of each run up to its first `done` or `finished`
    event in order of time (then of type), that one included, or of all of it (`open`). The batch form of the stream."""
    at = F.struct("ts_nanos", "type")
    end = events.filter(F.col("type").isin("done", "finished")).groupBy("run_id").agg(F.min(at).alias("_end"))
    held = events.join(end, "run_id", "left").filter(F.col("_end").isNull() | (at <= F.col("_end")))
    # rows that share the time and the type of the last one count once
    last = held.filter(at == F.col("_end")).groupBy("run_id").agg((F.count("*") - 1).alias("_more"))
    totals = run_totals(held).join(end, "run_id", "left").join(last, "run_id", "left")
    return totals.select("run_id", "transferred", "failed", "progress", (F.col("events") - F.coalesce("_more", F.lit(0))).alias("events"), F.when(F.col("_end").isNull(), "open").otherwise("done").alias("outcome"))


def failure_rollup(failures: DataFrame) -> DataFrame:
    return failures.groupBy("type", "kind", "origin").agg(F.count("*").alias("n"))


def throughput_windows(events: DataFrame, width: str) -> DataFrame:
    """Files and bytes per tumbling window of the event time `ts`; the same on a stream, with a watermark before it."""
    done = events.filter("type = 'transferred'")
    out = done.groupBy(F.window("ts", width)).agg(F.count("*").alias("files"), F.sum("completed").alias("bytes"))
    return out.select(F.col("window.start").alias("window_start"), "files", "bytes")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """run_id, session_start, events of spells of activity no further apart than the gap."""
    out = events.groupBy("run_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))
    return out.select("run_id", F.col("session_window.start").alias("session_start"), "events")
