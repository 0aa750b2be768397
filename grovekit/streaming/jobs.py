"""Streaming forms of the event operators. Late rows: those behind the watermark are dropped by Spark and counted in
the query's progress (numRowsDroppedByWatermark)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from grovekit.operators import events as E
from grovekit.operators.planning import manifest_diff
from grovekit.operators.ranges import add_span


def progress_throughput(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return E.throughput_windows(events.withWatermark("ts", late), width)


def session_activity(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return E.sessions(events.withWatermark("ts", late), gap)


def dedup_messages(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "message_id"])


def run_totals_stream(events: DataFrame) -> DataFrame:
    """Running totals, for update or complete mode. Nothing ends a run here, so its state stays; see final_totals_stream."""
    return E.run_totals(events)


def failure_router(failures: DataFrame, sinks: dict[str, Callable[[DataFrame], object]]) -> dict[str, object]:
    """Starts a query for each severity; sinks take the filtered stream and start it."""
    return {severity: start(failures.filter(F.col("type") == severity)) for severity, start in sinks.items()}


class _Expiring(StatefulProcessor):
    """State of a key that isn't touched for `expire_ms` is dropped; None keeps it. Expiry goes by processing time, and a
    query with it has a next batch always: it doesn't end by itself under the trigger availableNow."""

    def __init__(self, expire_ms: int | None = None):
        self.expire_ms = expire_ms

    @property
    def time_mode(self) -> str:
        return "None" if self.expire_ms is None else "ProcessingTime"

    def close(self) -> None:
        pass


class PhaseLatency(_Expiring):
    """Pairs the start and the end of a phase: rows (run_id, name, seconds) when both have come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.begun = handle.getValueState("begun", "ts_nanos long", self.expire_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for part in rows:
            for r in part.sort_values("ts_nanos").itertuples():
                if r.started:
                    self.begun.update((int(r.ts_nanos),))
                elif self.begun.exists():
                    seconds = (r.ts_nanos - self.begun.get()[0]) / 1e9
                    self.begun.clear()
                    if seconds >= 0:
                        out.append((key[0], key[1], seconds))
        if out:
            yield pd.DataFrame(out, columns=["run_id", "name", "seconds"])


def phase_latency_stream(events: DataFrame, expire_ms: int | None = None) -> DataFrame:
    job = PhaseLatency(expire_ms)
    phases = events.filter((F.col("type") == "phase") & F.col("name").isin(*E.PHASES)).select("run_id", "name", "started", "ts_nanos")
    return phases.groupBy("run_id", "name").transformWithStateInPandas(job, "run_id long, name string, seconds double", "Append", job.time_mode)


class FinalTotals(StatefulProcessor):
    """Counters of a run until its `done` (or `finished`) event, or until no event has come for `idle_ms` of event time:
    then one row (run_id, transferred, failed, progress, events, outcome), and the state goes. After `done` a mark stays
    for `keep_ms`, so that events which come late don't begin the run anew."""

    COUNTERS = ("transferred", "failed", "progress")

    def __init__(self, idle_ms: int, keep_ms: int):
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "transferred long, failed long, progress long, events long, closed boolean, timer long")

    def close(self) -> None:
        pass

    def _row(self, key, counts, outcome: str) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *counts, outcome)], columns=["run_id", *self.COUNTERS, "events", "outcome"])

    def _wait(self, counts, closed: bool, timer: int | None, at_ms: int) -> None:
        """One timer a run: the one before goes."""
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at_ms)
        self.held.update((*counts, closed, at_ms))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *counts, closed, timer = self.held.get() if self.held.exists() else (0, 0, 0, 0, False, None)
        if closed:
            return
        latest = timerValues.getCurrentWatermarkInMs()
        # the rows of a trigger come in several frames, in no order
        part = pd.concat(list(rows)).sort_values(["ts_nanos", "type"], kind="stable")
        for kind, ns in zip(part["type"], part["ts_nanos"]):
            latest = max(latest, int(ns) // 1_000_000)
            counts[3] += 1
            if kind in self.COUNTERS:
                counts[self.COUNTERS.index(kind)] += 1
            if kind in ("done", "finished"):
                self._wait(counts, True, timer, latest + self.keep_ms)
                yield self._row(key, counts, "done")
                return
        self._wait(counts, False, timer, latest + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        *counts, closed, _ = self.held.get()
        self.held.clear()
        if not closed:
            yield self._row(key, counts, "idle")


def final_totals_stream(events: DataFrame, late: str = "10 minutes", idle_ms: int = 86_400_000, keep_ms: int = 3_600_000) -> DataFrame:
    """Totals of each run when it ends, for append mode; E.totals_until_done is the batch form."""
    job = FinalTotals(idle_ms, keep_ms)
    schema = "run_id long, transferred long, failed long, progress long, events long, outcome string"
    rows = events.withWatermark("ts", late).select("run_id", "type", "ts_nanos", "ts")
    return rows.groupBy("run_id").transformWithStateInPandas(job, schema, "Append", "EventTime")


def union_of(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted (offset, end): overlapping ones become one, touching ones stay apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(r for r in ranges if r[0] < r[1]):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


#: Bytes of a file whose covered spans stand in one entry of the state.
SLOT_BYTES = 64 << 20


class RangeTracker(_Expiring):
    """Accepts a range of a path unless it overlaps one that was accepted or passes the end: rows (path, offset, length,
    accepted, complete). A new fingerprint begins anew.

    What is covered stands in a map by slot of SLOT_BYTES: a range reads and writes the entries of its own slots alone, in
    which spans that touch are one. A slot that is covered whole is one span, and when all of the file is, the map goes
    and a mark stays. So the state follows the gaps that are left, not the ranges that came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.file = handle.getValueState("file", "fingerprint string, covered long, complete boolean", self.expire_ms)
        self.slots = handle.getMapState("slots", "slot long", "spans array<struct<a: long, b: long>>", self.expire_ms)

    def _spans(self, slot: int) -> list[tuple[int, int]]:
        return [(x[0], x[1]) for x in self.slots.getValue((slot,))[0]] if self.slots.containsKey((slot,)) else []

    def _accept(self, a: int, b: int) -> bool:
        """Adds [a, b) to what is covered, unless any of it is already."""
        changed = []
        for slot in range(a // SLOT_BYTES, -(-b // SLOT_BYTES)):
            spans = self._spans(slot)
            if not add_span(spans, max(a, slot * SLOT_BYTES), min(b, (slot + 1) * SLOT_BYTES)):
                return False
            changed.append((slot, spans))
        for slot, spans in changed:
            self.slots.updateValue((slot,), (spans,))
        return True

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fingerprint, covered, complete = self.file.get() if self.file.exists() else (None, 0, False)
        out = []
        for part in rows:
            for r in part.itertuples():
                if r.fingerprint != fingerprint:
                    fingerprint, covered, complete = r.fingerprint, 0, False
                    if self.slots.exists():
                        self.slots.clear()
                a, b = int(r.offset), int(r.offset + r.length)
                # an empty range overlaps nothing
                ok = b <= r.size and (a == b or not complete and self._accept(a, b))
                if ok:
                    covered += b - a
                if not complete and covered >= r.size:
                    complete = True
                    if self.slots.exists():
                        self.slots.clear()
                out.append((key[0], a, b - a, ok, complete))
        self.file.update((fingerprint, covered, complete))
        yield pd.DataFrame(out, columns=["path", "offset", "length", "accepted", "complete"])


def range_tracker(ranges: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """ranges(path, size, fingerprint, offset, length)."""
    job = RangeTracker(expire_ms)
    schema = "path string, offset long, length long, accepted boolean, complete boolean"
    return ranges.groupBy("path").transformWithStateInPandas(job, schema, "Append", job.time_mode)


class CheckpointState(_Expiring):
    """The union of all verified ranges of a path under its fingerprint: rows (path, fingerprint, offset, length) of the
    whole union after each batch that changes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "fingerprint string, ranges array<struct<a: long, b: long>>", self.expire_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fingerprint, ranges = self.held.get() if self.held.exists() else (None, [])
        before = (fingerprint, ranges := [tuple(r) for r in ranges])
        for part in rows:
            for r in part.itertuples():
                if r.fingerprint != fingerprint:
                    fingerprint, ranges = r.fingerprint, []
                ranges = [*ranges, (int(r.offset), int(r.offset + r.length))]
        ranges = union_of(ranges)
        self.held.update((fingerprint, ranges))
        if (fingerprint, ranges) == before:
            return
        yield pd.DataFrame([(key[0], fingerprint, a, b - a) for a, b in ranges], columns=["path", "fingerprint", "offset", "length"])


def checkpoint_state(ranges: DataFrame, expire_ms: int | None = None) -> DataFrame:
    job = CheckpointState(expire_ms)
    schema = "path string, fingerprint string, offset long, length long"
    return ranges.groupBy("path").transformWithStateInPandas(job, schema, "Update", job.time_mode)


def incremental_diff(changed: DataFrame, destination: Callable[[], DataFrame], emit: Callable[[DataFrame, int], None]):
    """A writer that diffs each batch of changed source rows with the destination's rows of the same paths alone. Of
    rows of one path the latest counts, and of equally late ones any single one. Where `changed` has a column `deleted`,
    a path whose latest row says so is gone from the source, and its destination row is extraneous."""

    def each(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "path"]), "mtime_ns").alias("x")).select("path", "x.*")
        touched = destination().join(latest.select("path"), "path", "left_semi")
        there = latest.filter("not coalesce(deleted, false)").drop("deleted") if "deleted" in latest.columns else latest
        emit(manifest_diff(there, touched), number)

    return changed.writeStream.foreachBatch(each)
