"""Deterministic corpora and states of a destination, made on the executors from a range of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions.paths import staging_name
from grovekit.functions.scalars import mix64
from grovekit.operators.planning import numbered
from grovekit.operators.selection import least_by

CLASSES = ("flat-small", "deep-small", "zero-byte-storm", "mixed", "compressible", "incompressible", "one-large-file")
WORKLOADS = ("initial-copy", "no-op", "content-churn", "metadata-churn", "type-replacement", "delete", "interrupted-resume")


def corpus(spark: SparkSession, kind: str, entry_count: int, seed: int = 42, large_bytes: int = 1 << 30) -> DataFrame:
    """path, kind, size, mtime_ns, mode, word (64 bits that stand for the content)."""
    if kind not in CLASSES:
        raise ValueError(f"no such class: {kind}")
    n = F.col("id")
    rows = spark.range(1 if kind == "one-large-file" else entry_count).withColumn("word", mix64(n + F.lit(seed)))
    spread = (F.col("word") % 8192).cast("long")
    entry: Column = F.lit("file")
    size: Column = F.lit(257).cast("long") + spread
    path: Column = F.format_string("f%08d", n)
    if kind == "deep-small":
        path = F.concat_ws("/", *[F.format_string(f"d{i}-%02d", F.floor(n / 16**i) % 16) for i in range(8, 0, -1)], path)
    elif kind == "zero-byte-storm":
        size = F.lit(0).cast("long")
    elif kind == "mixed":
        entry = F.when(n % 20 == 0, "directory").when(n % 20 == 1, "symlink").otherwise("file")
        size = F.when(entry != "file", 0).when(n % 11 == 0, 0).otherwise(size).cast("long")
    elif kind in ("compressible", "incompressible"):
        size = F.lit(1 << 20).cast("long")
    elif kind == "one-large-file":
        size = F.lit(large_bytes).cast("long")
    word = F.lit(0).cast("decimal(20,0)") if kind == "compressible" else F.col("word")
    return rows.select(path.alias("path"), entry.alias("kind"), size.alias("size"), (n * 60_000_000_000).alias("mtime_ns"), F.lit(420).alias("mode"), word.alias("word"))


def with_content(entries: DataFrame) -> DataFrame:
    """entries of corpus() with `content`: as many bytes as the size says, drawn from the word in pieces of a digest;
    the same byte for those whose word is 0. Made row by row on the executors; null for what isn't a file."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / 32).cast("int") - 1, F.lit(0))), lambda i: F.sha2(F.concat_ws(":", F.col("word").cast("string"), i.cast("string")), 256))
    drawn = F.substring(F.unhex(F.array_join(pieces, "")), F.lit(1), F.col("size").cast("int"))
    same = F.repeat(F.lit("a"), F.col("size").cast("int")).cast("binary")
    return entries.withColumn("content", F.when(F.col("kind") == "file", F.when(F.col("word") == 0, same).otherwise(drawn)))


def churned(content: Column) -> Column:
    """A content with its first byte changed."""
    first = F.conv(F.hex(F.substring(content, 1, 1)), 16, 10).cast("int").bitwiseXOR(F.lit(0xA5))
    return F.when(F.octet_length(content) > 0, F.concat(F.unhex(F.lpad(F.hex(first), 2, "0")), F.substring(content, F.lit(2), F.octet_length(content)))).otherwise(content)


def select_spaced(files: DataFrame, seed: int) -> DataFrame:
    """One of a hundred, spaced evenly over the sorted paths from a place that the seed gives (one at least)."""
    placed = numbered(files, F.col("path").cast("binary"), name="place").withColumn("place", F.col("place") - 1)
    n = placed.count()
    if not n:
        return placed.drop("place")
    target = max(n // 100, 1)
    spark = files.sparkSession
    wanted = spark.range(target).select(((F.lit(seed % n) + F.floor(F.col("id") * n / target)) % n).alias("place"))
    return placed.join(wanted.distinct(), "place", "left_semi").drop("place")


def select_hashed(files: DataFrame, seed: str) -> DataFrame:
    """The hundredth part (rounded up) with the least keyed hashes. The last hash that counts is found by rounds of
    histograms, so that no task sorts what is taken."""
    k = -(-files.count() // 100)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), "path"), 256)
    return least_by(files, F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long"), k, hashed, F.col("path").cast("binary"))


def workload(source: DataFrame, kind: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(source, destination) in one of the states of WORKLOADS."""
    if kind not in WORKLOADS:
        raise ValueError(f"no such workload: {kind}")
    if kind == "initial-copy":
        return source, source.limit(0)
    if kind == "no-op":
        return source, source
    if kind in ("content-churn", "metadata-churn", "type-replacement"):
        some = select_spaced(source.filter("kind = 'file'"), seed).select("path", F.lit(True).alias("_hit"))
        marked = source.join(some, "path", "left")
        hit = F.coalesce("_hit", F.lit(False))
        if kind == "content-churn":
            changed = marked.withColumns({"word": F.when(hit, F.col("word") + 1).otherwise(F.col("word")), "mtime_ns": F.when(hit, F.col("mtime_ns") + 1_000_000_000).otherwise(F.col("mtime_ns"))})
            if "content" in source.columns:
                changed = changed.withColumn("content", F.when(hit, churned(F.col("content"))).otherwise(F.col("content")))
        elif kind == "metadata-churn":
            changed = marked.withColumns({"mtime_ns": F.when(hit, F.col("mtime_ns") + 60_000_000_000).otherwise(F.col("mtime_ns")), "mode": F.when(hit, F.lit(384)).otherwise(F.col("mode"))})
        else:
            changed = marked.withColumns({"kind": F.when(hit, "directory").otherwise(F.col("kind")), "size": F.when(hit, 0).otherwise(F.col("size")).cast("long")})
        return changed.select(*source.columns), source
    half = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "path"), 256), 1, 1) < "8"
    if kind == "delete":
        return source.filter(half), source
    # the first file that is missing was under way: half of it stands under its staging name
    begun = source.filter(~half & (F.col("kind") == "file")).orderBy(F.col("path").cast("binary")).limit(1)
    part = {"path": staging_name(F.col("path")), "size": F.floor(F.col("size") / 2).cast("long")}
    if "content" in source.columns:
        part["content"] = F.substring("content", F.lit(1), F.floor(F.col("size") / 2).cast("int"))
    return source, source.filter(half).unionByName(begun.select(*[part.get(c, F.col(c)).alias(c) for c in source.columns]))
