"""Digests of manifests and checks of an outcome against them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.functions import scalars as S
from grovekit.staging import batch_bytes, staged

#: Bytes of chunks that a task is given at once.
CHUNK_BATCH_BYTES = 32 << 20


def content_digest(df: DataFrame, content: str = "content") -> DataFrame:
    """df with the digest of a content that fits a cell, which is 2 GiB at most; chunk_digests() is for larger ones."""
    return df.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256))


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of path and offset -> a row a path. Between batches only the running hash is kept."""
    path, end, fault, h = None, 0, None, None

    def row() -> pa.RecordBatch:
        digest = h.hexdigest() if fault is None else None
        return pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([end]), pa.array([digest], pa.string()), pa.array([fault], pa.string())], ["path", "size", "digest", "fault"])

    for batch in batches:
        columns = [batch.column(c) for c in ("path", "offset", "content")]
        for at, offset, content in zip(*columns):
            at, offset = at.as_py(), offset.as_py()
            body = content.as_buffer()
            if h is None or at != path:
                if h is not None:
                    yield row()
                path, end, fault, h = at, 0, None, hashlib.sha256()
            if offset != end and fault is None:
                fault = "gap" if offset > end else "overlap"
            if body is not None:
                h.update(body)
                end = max(end, offset + body.size)
    if h is not None:
        yield row()


def chunk_digests(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """path (binary), size, digest, fault of contents that stand in rows (path, offset, content), of any size together.

    A path's chunks go to one task, sorted outside memory by their offset, and are hashed as they come, a batch of
    CHUNK_BATCH_BYTES at a time. Chunks must follow one another: a gap or an overlap is a fault, and then there is no
    digest. With files(path, size), a path of another size, or of no chunks, is at fault too (`size`, `missing`). Written
    to the shared folder, as the batches are small only while this job runs."""
    spark = chunks.sparkSession
    ordered = chunks.select(F.col("path").cast("binary").alias("path"), F.col("offset").cast("long").alias("offset"), F.col("content").cast("binary").alias("content"))
    ordered = ordered.filter("path is not null and offset is not null and content is not null").repartition("path").sortWithinPartitions("path", "offset")
    with batch_bytes(spark, CHUNK_BATCH_BYTES):
        found = staged(ordered.mapInArrow(_hash_chunks, "path binary, size long, digest string, fault string"), "chunk-digests")
    if files is None:
        return found
    want = files.select(F.col("path").cast("binary").alias("path"), F.col("size").alias("_want"))
    joined = want.join(found, "path", "left")
    fault = F.when(F.col("size").isNull(), "missing").when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("size") != F.col("_want"), "size")
    return joined.select("path", "size", F.when(fault.isNull(), F.col("digest")).alias("digest"), fault.alias("fault"))


def row_digest() -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("path", "kind", "size", "mtime_ns", "mode", "digest")]
    return F.sha2(F.concat_ws("|", *parts), 256)


def digest_buckets(rows: int) -> int:
    """Buckets of a manifest's digest: 256, and more of them for more than 2^24 rows, so that one has about 2^16 at most."""
    return max(256, 1 << (-(-rows // (1 << 16)) - 1).bit_length()) if rows else 256


def manifest_digest(entries: DataFrame, buckets: int | None = None) -> DataFrame:
    """item_count, logical_bytes, allocated_bytes (of files; null where they weren't taken), manifest_digest. Row digests
    are put together by bucket of the path's hash, in path order, and then the buckets' digests, so that no task gathers
    more than its share of 64 characters a row. The number of buckets follows from the number of rows (digest_buckets)."""
    buckets = buckets or digest_buckets(entries.count())
    bucket = F.conv(F.substring(F.sha2("path", 256), 1, 8), 16, 10).cast("long") % buckets
    held = F.col("allocated_bytes") if "allocated_bytes" in entries.columns else F.lit(None).cast("long")
    file = F.col("kind") == "file"
    rows = entries.select(bucket.alias("b"), F.struct(F.col("path"), row_digest().alias("h")).alias("x"), F.when(file, F.col("size")).otherwise(0).alias("bytes"), F.when(file, held).alias("held"))
    parts = rows.groupBy("b").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("held").alias("held"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), ""), 256).alias("h")
    )
    return parts.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("item_count"),
        F.coalesce(F.sum("bytes"), F.lit(0).cast("long")).alias("logical_bytes"),
        F.sum("held").alias("allocated_bytes"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("manifest_digest"),
    )


def manifest_verify(expected: DataFrame, actual: DataFrame, sampled: Column | None = None) -> DataFrame:
    """path, reason of every mismatch: missing, unexpected, or the fields that differ; times to the nanosecond. With
    `sampled` (of the path), only sampled files compare their contents."""
    fields = ["kind", "size", "digest", "mode", "mtime_ns"] + (["symlink_target"] if "symlink_target" in expected.columns else [])
    there = actual.select("path", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_there"))
    joined = expected.select("path", *fields, F.lit(True).alias("_here")).join(there, "path", "full_outer")
    names = {"size": "length", "digest": "content", "mtime_ns": "mtime", "symlink_target": "symlink target"}

    def differs(f: str) -> Column:
        unlike = ~F.col(f).eqNullSafe(F.col(f"_{f}"))
        return unlike & sampled if f == "digest" and sampled is not None else unlike

    listed = F.array_join(F.array_compact(F.array(*[F.when(differs(f), F.lit(names.get(f, f))) for f in fields])), ", ")
    reason = F.when(F.col("_there").isNull(), "missing").when(F.col("_here").isNull(), "unexpected").when(listed != "", listed)
    return joined.select("path", reason.alias("reason")).filter("reason is not null")


def manifest_verify_sampled(expected: DataFrame, actual: DataFrame, fraction: float, seed: str) -> DataFrame:
    return manifest_verify(expected, actual, S.sample_select(F.col("path"), seed, fraction))


def refuse_unless_digest(entries: DataFrame, recorded: str) -> DataFrame:
    """entries, if their digest is the one recorded; an error otherwise."""
    found = manifest_digest(entries).first()["manifest_digest"]
    if found != recorded:
        raise ValueError(f"the manifest's digest is {found}, not the recorded {recorded}")
    return entries


def first_mismatches(mismatches: DataFrame, most: int = 100) -> DataFrame:
    """The first by path, with the number of all."""
    total = mismatches.agg(F.count("*").alias("mismatch_count"))
    return mismatches.orderBy(F.col("path").cast("binary")).limit(most).join(F.broadcast(total))  # total is one row


def digest_cache_lookup(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """entries(.., fingerprint) with the cached digest and hit."""
    known = cache.groupBy("fingerprint").agg(F.max("digest").alias("cached_digest"))
    return entries.join(known, "fingerprint", "left").withColumn("hit", F.col("cached_digest").isNotNull())


def digest_cache_append(cache: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (fingerprint, digest) to append: each fingerprint once, those in the cache not again."""
    return found.groupBy("fingerprint").agg(F.max("digest").alias("digest")).join(cache.select("fingerprint"), "fingerprint", "left_anti")


def readback_verify(published: DataFrame, expected: DataFrame) -> DataFrame:
    """Paths of expected whose published digest is missing or another."""
    there = published.select("path", F.col("digest").alias("published_digest"))
    return expected.select("path", "digest").join(there, "path", "left").filter(~F.col("digest").eqNullSafe(F.col("published_digest")))


def corpus_drift(pinned: DataFrame, observed: DataFrame) -> DataFrame:
    """name, status (matches, drifted, missing) of corpora by file count and digest."""
    seen = observed.select("name", F.col("files").alias("_files"), F.col("digest").alias("_digest"))
    status = F.when(F.col("_files").isNull(), "missing").when((F.col("files") == F.col("_files")) & (F.col("digest") == F.col("_digest")), "matches").otherwise("drifted")
    return pinned.join(seen, "name", "left").select("name", status.alias("status"))
