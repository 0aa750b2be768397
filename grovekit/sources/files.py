"""Readers and writers of manifests, reports, event logs, failure logs and rule files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit import schemas
from grovekit.functions import paths as P
from grovekit.functions import scalars as S
from grovekit.functions.globs import rule_parse
from grovekit.operators.verifying import manifest_digest

MANIFEST_VERSION = "manifest.v1"


def manifest_from_table(df: DataFrame, path, content, mtime_ns, mode) -> DataFrame:
    """A manifest of a table's rows, each a file: the table form of a scan."""
    return df.select(
        path.alias("path"),
        F.lit("file").alias("kind"),
        F.octet_length(content).cast("long").alias("size"),
        mtime_ns.cast("long").alias("mtime_ns"),
        mode.cast("int").alias("mode"),
        F.sha2(content.cast("binary"), 256).alias("digest"),
    )


def read_manifest_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows of nested manifest documents, one a file, or with `lines` one a line, as write_manifest_json() puts them; the
    recorded digest and counts stand in each row."""
    docs = spark.read.schema(schemas.MANIFEST).option("multiLine", not lines).json(path)
    rows = docs.select("manifest_digest", "item_count", "digest_algorithm", F.explode("entries").alias("e"))
    return rows.select(
        P.from_hex_components(F.col("e.path.components_hex")).alias("path"),
        F.col("e.kind").alias("kind"),
        F.col("e.length").alias("size"),
        S.from_seconds(F.col("e.mtime.seconds"), F.col("e.mtime.nanoseconds")).alias("mtime_ns"),
        F.col("e.mode").alias("mode"),
        F.col("e.content_digest").alias("digest"),
        F.unhex("e.symlink_target_hex").alias("symlink_target"),
        F.col("e.allocated_bytes").alias("allocated_bytes"),
        "manifest_digest",
        "item_count",
    )


def write_manifest_json(entries: DataFrame, path: str) -> None:
    """One JSON line per entry under the manifest's own field names: a document as large as a table can't be one row,
    so an `entries` array holds one entry a line (read it with lines=True). Each line carries the whole manifest's
    counts and digest, so a reader can check what it has read (refuse_unless_digest)."""
    whole = manifest_digest(entries).first()
    held = F.col("allocated_bytes") if "allocated_bytes" in entries.columns else F.lit(None).cast("long")
    target = F.lower(F.hex("symlink_target")) if "symlink_target" in entries.columns else F.lit(None).cast("string")
    entry = F.struct(
        F.struct(P.hex_components(F.col("path")).alias("components_hex")).alias("path"),
        F.col("kind"),
        F.col("size").alias("length"),
        held.alias("allocated_bytes"),
        F.col("digest").alias("content_digest"),
        F.col("mode"),
        F.struct(S.whole_seconds(F.col("mtime_ns")).alias("seconds"), S.nanoseconds_part(F.col("mtime_ns")).alias("nanoseconds")).alias("mtime"),
        target.alias("symlink_target_hex"),
    )
    counts = [F.lit(whole[c]).cast("long").alias(c) for c in ("item_count", "logical_bytes", "allocated_bytes")]
    head = [F.lit(MANIFEST_VERSION).alias("schema"), F.lit("hex").alias("path_encoding"), F.lit("sha256").alias("digest_algorithm"), *counts, F.lit(whole["manifest_digest"]).alias("manifest_digest")]
    entries.select(*head, F.array(entry).alias("entries")).write.json(path)


def read_bench_input(spark: SparkSession, path: str) -> DataFrame:
    """samples of nested report documents, in the columns that the measuring operators read."""
    docs = spark.read.schema(schemas.BENCH_INPUT).option("multiLine", True).json(path)
    results = docs.select("schema", "environment", "session", F.posexplode("results").alias("result_number", "r"))
    rows = results.select("schema", "environment", "session", "result_number", F.col("r.name").alias("result"), F.col("r.baseline").alias("baseline"), F.explode("r.samples").alias("s"))
    return rows.select("schema", "environment", "session", "result_number", "result", "baseline", "s.*").withColumnRenamed("phases_seconds", "phases").withColumn("allocated_bytes", F.col("destination_allocated_bytes"))


def _lines(reader, schema: str, path: str) -> DataFrame:
    full = reader.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return full.filter("_corrupt_record is null").drop("_corrupt_record").filter("type is not null")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; what isn't one, or has no type, is left out; unknown fields are ignored."""
    return _lines(spark.read, schemas.EVENTS, path)


def stream_event_log(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark.readStream, schemas.EVENTS, path)


def read_failure_log(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark.read, schemas.FAILURES, path)


def write_event_log(events: DataFrame, path: str) -> None:
    """A JSON line for each event; null fields are left out."""
    events.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")).write.mode("append").text(path)


def append_failure_log(failures: DataFrame, path: str) -> None:
    """Null fields are left out of the line."""
    failures.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")).write.mode("append").text(path)


def parse_rules(files: DataFrame, default_action: str = "exclude") -> DataFrame:
    """origin, line_number (from 1), action, pattern of files(origin, content)."""
    lines = files.select("origin", F.posexplode(F.split("content", "\n")).alias("_at", "line"))
    parsed = lines.withColumn("rule", rule_parse(F.regexp_replace("line", "\r$", ""), default_action)).filter("rule is not null")
    return parsed.select("origin", (F.col("_at") + 1).cast("long").alias("line_number"), "rule.action", "rule.pattern")


def read_rules(spark: SparkSession, path: str, default_action: str = "exclude") -> DataFrame:
    """Rules of text files, read whole so that lines keep their numbers."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("origin"), F.col("value").alias("content"))
    return parse_rules(files, default_action)


def discover_ignore_files(entries: DataFrame, name: str) -> DataFrame:
    """scope, ord, action, pattern, origin of the rule files called `name` among entries(path, content)."""
    files = entries.filter(P.path_basename(F.col("path")) == name).select(F.col("path").alias("origin"), F.col("content").cast("string").alias("content"))
    rules = parse_rules(files)
    return rules.select(P.path_parent(F.col("origin")).alias("scope"), F.col("line_number").alias("ord"), "action", "pattern", "origin")


def recover(spark: SparkSession, target: str) -> bool:
    """Puts a table back that a lost publish() left beside its place; whether there was one."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    goal = fs_path(target.rstrip("/"))
    fs = goal.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(goal) or not fs.exists(goal.getParent()):
        return False
    left = [x.getPath() for x in fs.listStatus(goal.getParent()) if x.getPath().getName().startswith(f"{goal.getName()}.old-")]
    return bool(left) and fs.rename(left[0], goal)


def publish(df: DataFrame, target: str, key: str = "path", retries: int = 1) -> None:
    """Writes a table beside the target, reads it back, compares the count and the digest of its rows, and only then
    puts it in the target's place; one more try if they differ. Between the two renames that do so the former table
    stands beside the target; if the driver is lost just then, the next publish() or recover() puts it back."""
    spark = df.sparkSession

    def measure(x: DataFrame):
        row = F.xxhash64(*[F.col(c) for c in sorted(x.columns)])
        return x.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h")).first()

    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    goal = fs_path(target)
    fs = goal.getFileSystem(spark._jsc.hadoopConfiguration())
    recover(spark, target)
    want = measure(df)
    for _ in range(retries + 1):
        beside = fs_path(f"{target.rstrip('/')}.stage-{uuid.uuid4().hex}")
        df.write.parquet(beside.toString())
        if measure(spark.read.parquet(beside.toString())) == want:
            old = fs_path(f"{target.rstrip('/')}.old-{uuid.uuid4().hex}")
            if fs.exists(goal):
                fs.rename(goal, old)
            if not fs.rename(beside, goal):
                fs.rename(old, goal)
                raise OSError(f"{target} could not be put in place")
            fs.delete(old, True)
            return
        fs.delete(beside, True)
    raise OSError(f"what was written to {target} is not what was to be written")
