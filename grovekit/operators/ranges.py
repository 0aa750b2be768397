"""Byte ranges and units of work."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grovekit.staging import staged

CHUNK = 16 << 20
BATCH_BYTES, BATCH_FILES = 32 << 20, 8192


#: Ranges of one path beyond which they are dealt by offset, over many tasks.
HOT_RANGES = 1 << 20


def _hot(ranges: DataFrame, keys: tuple[str, ...], hot_ranges: int) -> DataFrame | None:
    """The keys of more ranges than that, a row for each; none where there is no such key, as in most tables."""
    if ranges.count() <= hot_ranges:
        return None
    found = staged(ranges.groupBy(*keys).count().filter(F.col("count") > hot_ranges).select(*keys), "hot-ranges")
    return found if found.limit(1).count() else None


def _split(ranges: DataFrame, keys: tuple[str, ...], hot: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(ranges of other keys, ranges of hot keys). One hot key stands for HOT_RANGES rows at least."""
    if hot is None:
        return ranges, None
    return ranges.join(F.broadcast(hot), [*keys], "left_anti"), ranges.join(F.broadcast(hot), [*keys], "left_semi")


def _ordered(ranges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """ranges dealt by range of (keys, offset, length) and written, with `_part`: a path of very many ranges lies in as many
    parts as it fills, one after another."""
    columns = [*keys, "offset", "length"]
    return staged(ranges.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id()), "ordered-ranges")


def _carried(ordered: DataFrame, value: Column, keys: tuple[str, ...]) -> DataFrame:
    """ordered with `_seen`, the greatest value of the rows before it under its keys: inside its part by a window, and
    from the parts before it by what each part's rows under those keys came to. Of these only keys that lie in several
    parts matter, two a part at most."""
    inside = W.partitionBy("_part", *keys).orderBy("offset", "length").rowsBetween(W.unboundedPreceding, -1)
    parts = ordered.groupBy("_part", *keys).agg(F.max(value).alias("_most"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = parts.withColumn("_before", F.max("_most").over(earlier)).filter("_before is not null").drop("_most")
    return ordered.withColumn("_inside", F.max(value).over(inside)).join(F.broadcast(before), ["_part", *keys], "left").withColumn("_seen", F.greatest("_inside", "_before")).drop("_inside", "_before")


def _seen(ranges: DataFrame, value: Column, keys: tuple[str, ...], hot: DataFrame | None) -> DataFrame:
    """ranges(keys, offset, length) with `_seen`, the greatest value of the ranges before it under its keys."""
    cold, many = _split(ranges, keys, hot)
    seen = cold.withColumn("_seen", F.max(value).over(W.partitionBy(*keys).orderBy("offset", "length").rowsBetween(W.unboundedPreceding, -1)))
    return seen if many is None else seen.unionByName(_carried(_ordered(many, keys), value, keys).drop("_part"))


def merge_ranges(ranges: DataFrame, keys: tuple[str, ...] = ("path",), hot_ranges: int = HOT_RANGES) -> DataFrame:
    """path, offset, length: overlapping ranges become one, touching ones stay apart, empty ones go.

    A path's ranges are one window, unless they are more than hot_ranges. Those of such paths are dealt by (path, offset),
    and the greatest end so far and the begin of the open range are carried over the parts' edges, so that one path of very
    many ranges is the work of many tasks."""
    full = ranges.filter("length > 0").select(*keys, "offset", "length")
    return _merged(full, keys, _hot(full, keys, hot_ranges))


def _merged(full: DataFrame, keys: tuple[str, ...], hot: DataFrame | None) -> DataFrame:
    end = F.col("offset") + F.col("length")
    new = F.col("_seen").isNull() | (F.col("offset") >= F.col("_seen"))
    cold, many = _split(full, keys, hot)
    order = W.partitionBy(*keys).orderBy("offset", "length").rowsBetween(W.unboundedPreceding, 0)
    begun = _seen(cold, end, keys, None).withColumn("_begin", F.max(F.when(new, F.col("offset"))).over(order)).drop("_seen")
    out = begun.groupBy(*keys, "_begin").agg(F.max(end).alias("_end"))
    if many is not None:
        marked = _carried(_ordered(many, keys), end, keys).withColumn("_begin", F.when(new, F.col("offset"))).drop("_seen")
        # the last begin at or before a row is the greatest so far
        held = _carried(marked, F.col("_begin"), keys).withColumn("_begin", F.coalesce("_begin", "_seen"))
        out = out.unionByName(held.groupBy(*keys, "_begin").agg(F.max(end).alias("_end")))
    return out.select(*keys, F.col("_begin").alias("offset"), (F.col("_end") - F.col("_begin")).alias("length"))


def missing_chunks(files: DataFrame, ranges: DataFrame, chunk: int = CHUNK, hot_ranges: int = HOT_RANGES) -> DataFrame:
    """path, offset, length: what files(path, size) lack of the ranges, in steps of `chunk` from where each gap begins."""
    end = F.col("offset") + F.col("length")
    keys = ("path",)
    full = ranges.filter("length > 0").select("path", "offset", "length")
    hot = _hot(full, keys, hot_ranges)
    merged = _merged(full, keys, hot)
    # merged ranges are apart, so the greatest end before one is that of its neighbour
    inner = _seen(merged, end, keys, hot).select("path", F.coalesce("_seen", F.lit(0).cast("long")).alias("begin"), F.col("offset").alias("end"))
    last = merged.groupBy("path").agg(F.max(end).alias("begin"))
    tail = files.join(last, "path", "left").select("path", F.coalesce("begin", F.lit(0).cast("long")).alias("begin"), F.col("size").alias("end"))
    gaps = inner.join(files.select("path", "size"), "path").select("path", "begin", F.least("end", "size").alias("end")).unionByName(tail).filter("begin < end")
    cut = gaps.withColumn("offset", F.explode(F.sequence(F.col("begin"), F.col("end") - 1, F.lit(chunk).cast("long"))))
    return cut.select("path", "offset", F.least(F.lit(chunk).cast("long"), F.col("end") - F.col("offset")).alias("length"))


def range_overlaps(files: DataFrame, ranges: DataFrame, hot_ranges: int = HOT_RANGES) -> DataFrame:
    """Ranges that are at fault: path, offset, length, fault (overlap with an earlier one, or beyond_end)."""
    end = F.col("offset") + F.col("length")
    own = ranges.select("path", "offset", "length")
    seen = _seen(own, end, ("path",), _hot(own, ("path",), hot_ranges)).join(files.select("path", "size"), "path", "left")
    fault = F.when(end > F.col("size"), "beyond_end").when(F.col("offset") < F.col("_seen"), "overlap")
    return seen.withColumn("fault", fault).filter("fault is not null").select("path", "offset", "length", "fault")


def range_coverage(files: DataFrame, ranges: DataFrame, hot_ranges: int = HOT_RANGES) -> DataFrame:
    """path, size, covered, sent, retransmitted, complete (a file of size 0 is)."""
    covered = merge_ranges(ranges, hot_ranges=hot_ranges).groupBy("path").agg(F.sum("length").alias("covered"))
    sent = ranges.groupBy("path").agg(F.sum("length").alias("sent"))
    zero = F.lit(0).cast("long")
    return (
        files.join(covered, "path", "left").join(sent, "path", "left")
        .select("path", "size", F.coalesce("covered", zero).alias("covered"), F.coalesce("sent", zero).alias("sent"))
        .withColumn("retransmitted", F.col("sent") - F.col("covered")).withColumn("complete", F.col("covered") >= F.col("size"))
    )


def add_span(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Adds [a, b), not empty, to spans that stand in order and apart; those that it touches become one with it. False, and
    nothing is changed, if it overlaps one."""
    at = bisect_left(spans, (a, b))
    if at and spans[at - 1][1] > a or at < len(spans) and spans[at][0] < b:
        return False
    end = spans.pop(at)[1] if at < len(spans) and spans[at][0] == b else b
    if at and spans[at - 1][1] == a:
        a, at = spans[at - 1][0], at - 1
        spans.pop(at)
    spans.insert(at, (a, end))
    return True


def track_ranges(ranges: DataFrame) -> DataFrame:
    """path, seq, offset, length, accepted, complete of ranges(path, size, seq, offset, length), by the order of seq: a range
    is accepted unless it passes the end or overlaps one that was accepted before it (an empty one overlaps nothing);
    complete once all is covered. The
    batch form of the stream's tracker: each range depends on those accepted before it, so a path is gone through in order,
    sorted by Spark, with what is covered held as spans."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, spans, covered = None, [], 0
        for part in parts:
            accepted, complete = [], []
            for own, size, a, n in zip(part["path"], part["size"], part["offset"].tolist(), part["length"].tolist()):
                if own != path:
                    path, spans, covered = own, [], 0
                ok = a + n <= size and (not n or add_span(spans, a, a + n))
                covered += n if ok else 0
                accepted.append(ok)
                complete.append(covered >= size)
            yield part[["path", "seq", "offset", "length"]].assign(accepted=accepted, complete=complete)

    ordered = ranges.select("path", "size", "seq", "offset", "length").repartition("path").sortWithinPartitions("path", "seq", "offset", "length")
    return ordered.mapInPandas(run, "path string, seq long, offset long, length long, accepted boolean, complete boolean")


FINGERPRINT = ("size", "mtime_ns", "ctime_ns", "device", "inode", "kind")


def fingerprint_matches(ours: str, theirs: str) -> Column:
    """Whether the columns of FINGERPRINT under two prefixes say the same; a change time that wasn't taken counts as 0."""
    zero = lambda k, c: F.coalesce(c, F.lit(0).cast("long")) if k == "ctime_ns" else c
    same = F.lit(True)
    for k in FINGERPRINT:
        same = same & zero(k, F.col(f"{ours}{k}")).eqNullSafe(zero(k, F.col(f"{theirs}{k}")))
    return same


def resume_lookup(files: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """files with the ranges of their checkpoint where its fingerprint is the file's; else none."""
    there = checkpoints.select("path", *[F.col(k).alias(f"_{k}") for k in FINGERPRINT], "ranges")
    joined = files.join(there, "path", "left").withColumn("usable", F.col("ranges").isNotNull() & fingerprint_matches("", "_"))
    return joined.withColumn("ranges", F.when(F.col("usable"), F.col("ranges"))).drop(*[f"_{k}" for k in FINGERPRINT])


def checkpoint_upsert(checkpoints: DataFrame, new: DataFrame, hot_ranges: int = HOT_RANGES) -> DataFrame:
    """path, fingerprint, offset, length: under one fingerprint the union of both; a new fingerprint drops the old."""
    current = new.select("path", F.col("fingerprint").alias("_now")).distinct()
    old = checkpoints.join(current, "path", "left").filter(F.col("_now").isNull() | (F.col("_now") == F.col("fingerprint"))).drop("_now")
    return merge_ranges(old.unionByName(new), ("path", "fingerprint"), hot_ranges)


def chunk_files(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    cut = files.filter("size > 0").withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(chunk).cast("long"))))
    return cut.select("path", "offset", F.least(F.lit(chunk).cast("long"), F.col("size") - F.col("offset")).alias("length"))


def stripe_chunks(chunks: DataFrame, streams: int, chunk: int = CHUNK) -> DataFrame:
    return chunks.withColumn("stream_id", F.floor(F.col("offset") / chunk) % streams)


def stripe_missing(missing: DataFrame, streams: int) -> DataFrame:
    """path, offset, length, stream_id of missing(path, offset, length): round robin in the order of first ranges of all
    files, then second ones, and so on, so that a file with many doesn't keep the others waiting."""
    from grovekit.operators.planning import numbered

    turn = F.row_number().over(W.partitionBy("path").orderBy("offset"))
    placed = numbered(missing.withColumn("turn", turn), F.col("turn"), F.col("path").cast("binary"))
    return placed.select("path", "offset", "length", ((F.col("place") - 1) % streams).alias("stream_id"))


def _batch_ends(sizes: np.ndarray, target: int, most: int, flush_full: bool) -> np.ndarray:
    """For each file the place after the last one of the batch that would begin with it."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    begin = np.arange(len(sizes))
    limit = upto[:-1] + target
    ends = np.searchsorted(upto, limit, "right") - 1
    if flush_full:  # a batch that is exactly full takes no empty files any more
        full = np.searchsorted(upto, limit, "left")
        ends = np.where(upto[np.minimum(full, len(sizes))] == limit, full, ends)
    return np.minimum(np.maximum(ends, begin + 1), begin + most)


def _by_shard(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of one shard after another; only one is held."""
    held: list[pd.DataFrame] = []
    for part in parts:
        for shard, rows in part.groupby("shard", sort=True):
            if held and held[0]["shard"].iloc[0] != shard:
                whole = pd.concat(held)
                yield int(whole["shard"].iloc[0]), whole
                held = []
            held.append(rows)
    if held:
        whole = pd.concat(held)
        yield int(whole["shard"].iloc[0]), whole


def pack_small_files(files: DataFrame, target: int = BATCH_BYTES, most: int = BATCH_FILES, flush_full: bool = True, shard_files: int = 1 << 20) -> DataFrame:
    """path, size, batch_id: next fit in path order. A batch ends when the next file would exceed the target, when it has
    `most` files and, with flush_full, when it is exactly full; a larger file has its own. Batches are numbered from 0.

    The batches are those of one scan over all files, for every shard_files. Files are numbered in path order and cut into
    shards. Where a batch ends follows from where it begins, within `most` files, so a shard sees as many of the next one.
    All that a shard takes from those before it is which of its first `most` files begins a batch: for each of these a task
    works out, by jumping from batch to batch, which file of the next shard begins one and how many batches lie between.
    Running through these tables, of `most` entries a shard, gives each shard its first batch, and a second pass the rest."""
    from grovekit.operators.planning import numbered

    shard_files = max(shard_files, most)
    placed = numbered(files.select("path", F.coalesce("size", F.lit(0).cast("long")).alias("size")), F.col("path").cast("binary"))
    at = (F.col("place") - 1) % shard_files
    placed = staged(placed.withColumn("shard", F.floor((F.col("place") - 1) / shard_files)).withColumn("at", at), "placed-files")
    ahead = placed.filter((F.col("at") < most) & (F.col("shard") > 0)).select("path", "size", "place", (F.col("shard") - 1).alias("shard"), (F.col("at") + shard_files).alias("at"))
    rows = placed.unionByName(ahead).repartition("shard").sortWithinPartitions("shard", "place")

    def ends_of(rows: pd.DataFrame) -> tuple[np.ndarray, int]:
        own = int((rows["at"] < shard_files).sum())
        return _batch_ends(rows["size"].to_numpy(np.int64), target, most, flush_full)[:own], own

    def tables(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, rows in _by_shard(parts):
            ends, own = ends_of(rows)
            # places beyond the shard stay where they are; jumps double until all have left it
            jump, count = np.concatenate([ends, np.arange(own, own + most + 1)]), np.concatenate([np.ones(own, np.int64), np.zeros(most + 1, np.int64)])
            while (jump[:own] < own).any():
                count, jump = count + count[jump], jump[jump]
            n = min(most, own)
            yield pd.DataFrame({"shard": [shard], "exits": [jump[:n] - own], "counts": [count[:n]]})

    def entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entry, batch = 0, 0
        for part in parts:
            out = []
            for shard, exits, counts in zip(part["shard"], part["exits"], part["counts"]):
                out.append((shard, entry, batch))
                if entry < len(exits):
                    entry, batch = int(exits[entry]), batch + int(counts[entry])
                else:
                    entry -= len(exits)
            yield pd.DataFrame(out, columns=["shard", "entry", "batch"])

    jumps = staged(rows.mapInPandas(tables, "shard long, exits array<long>, counts array<long>"), "batch-tables")
    # one row a shard, in order
    begins = staged(jumps.repartitionByRange(1, "shard").sortWithinPartitions("shard").mapInPandas(entries, "shard long, entry long, batch long"), "batch-entries")

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _by_shard(parts):
            ends, own = ends_of(rows)
            place, starts = int(rows["entry"].iloc[0]), []
            while place < own:
                starts.append(place)
                place = int(ends[place])
            begun = np.zeros(own, np.int64)
            begun[starts] = 1
            ids = int(rows["batch"].iloc[0]) - 1 + np.cumsum(begun)
            yield rows[["path", "size"]].iloc[:own].assign(batch_id=ids)

    # one row a shard of a million files
    dealt = placed.unionByName(ahead).join(F.broadcast(begins), "shard").repartition("shard").sortWithinPartitions("shard", "place")
    return dealt.mapInPandas(pack, "path string, size long, batch_id long")


def work_stats(work: DataFrame) -> DataFrame:
    kind = F.col("item_kind")
    return work.agg(
        F.countDistinct(F.when(kind == "batch", F.col("batch_id"))).alias("batches"),
        F.count_if(kind == "batch").alias("batched_files"),
        F.count_if(kind == "whole").alias("whole_files"),
        F.count_if(kind == "chunk").alias("chunks"),
    )


def id_ranges(ids: DataFrame) -> DataFrame:
    """group_id, first, last of runs of consecutive ids; duplicates count once."""
    order = W.partitionBy("group_id").orderBy("id")
    islands = ids.select("group_id", "id").distinct().withColumn("_i", F.col("id") - F.row_number().over(order))
    return islands.groupBy("group_id", "_i").agg(F.min("id").alias("first"), F.max("id").alias("last")).drop("_i")


def duplicate_ids(ids: DataFrame) -> DataFrame:
    return ids.groupBy("group_id", "id").agg(F.count("*").alias("n")).filter("n > 1")


def list_page(entries: DataFrame, token: int, size: int) -> DataFrame:
    """The entries of each directory from place `token` on (in byte order of names): directory, path, final_page,
    next_token (0 at the end). Places come from one numbering by range, so a large directory is no task of its own."""
    if not 1 <= size <= 65536:
        raise ValueError("a page has 1 to 65536 entries")
    from grovekit.functions import paths as P
    from grovekit.operators.planning import numbered

    at = entries.select(P.path_parent(F.col("path")).alias("directory"), "path")
    placed = staged(numbered(at, F.col("directory").cast("binary"), F.col("path").cast("binary")), "listed")
    bounds = placed.groupBy("directory").agg(F.min("place").alias("_first"), F.count("*").alias("_n"))
    found = placed.join(bounds, "directory").withColumn("_at", F.col("place") - F.col("_first"))
    final = F.col("_n") <= token + size
    return found.filter((F.col("_at") >= token) & (F.col("_at") < token + size)).select(
        "directory", "path", final.alias("final_page"), F.when(final, 0).otherwise(token + size).cast("long").alias("next_token")
    )
