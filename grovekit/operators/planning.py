"""Plans: what differs between two manifests, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grovekit.functions import paths as P
from grovekit.functions import scalars as S
from grovekit.staging import staged

# The limits of the deletion audit.
SUSPICIOUS_COUNT, SUSPICIOUS_SHARE = 100, 0.5
CLASSES = ("new", "changed", "metadata_only", "unchanged", "extraneous")


def duplicate_paths(entries: DataFrame) -> DataFrame:
    """Paths that occur more than once, with their counts."""
    return entries.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")


def _joined(src: DataFrame, dst: DataFrame) -> DataFrame:
    columns = [c for c in src.columns if c != "path"]
    there = dst.select("path", *[F.col(c).alias(f"dst_{c}") for c in columns if c in dst.columns], F.lit(True).alias("_dst"))
    return src.withColumn("_src", F.lit(True)).join(there, "path", "full_outer")


def manifest_diff(src: DataFrame, dst: DataFrame, compare_modes: bool = True, precision: str = "s", equality: Column | None = None) -> DataFrame:
    """The plan of making dst like src: a row per path of either, with `classification`.

    A row is the source's, or for extraneous paths the destination's; the destination's values stand in dst_*. Times are
    compared by whole seconds, or to the nanosecond for precision "ns". One full outer join on the path; paths must be
    unique on each side (see duplicate_paths)."""
    time = (lambda c: F.col(c)) if precision == "ns" else (lambda c: S.whole_seconds(F.col(c)))
    same = (F.col("size").eqNullSafe(F.col("dst_size"))) & time("mtime_ns").eqNullSafe(time("dst_mtime_ns"))
    same = F.col("kind").eqNullSafe(F.col("dst_kind")) & (same if equality is None else equality)
    drift = S.mode_drift(F.col("kind"), F.col("mode"), F.col("dst_mode")) if compare_modes else F.lit(False)
    classification = (
        F.when(F.col("_dst").isNull(), "new").when(F.col("_src").isNull(), "extraneous").when(~same, "changed").when(drift, "metadata_only").otherwise("unchanged")
    )
    found = _joined(src, dst).withColumn("classification", classification)
    kept = [F.when(F.col("_src").isNull(), F.col(f"dst_{c}")).otherwise(F.col(c)).alias(c) if f"dst_{c}" in found.columns else F.col(c) for c in src.columns if c != "path"]
    return found.select("path", *kept, "classification", *[c for c in found.columns if c.startswith("dst_")])


def manifest_diff_checksum(src: DataFrame, dst: DataFrame, compare_modes: bool = True) -> DataFrame:
    """As manifest_diff, but files are equal by size and digest, whatever their times."""
    file = F.col("kind") == "file"
    by_digest = F.coalesce((F.col("size") == F.col("dst_size")) & (F.col("digest") == F.col("dst_digest")), F.lit(False))
    by_time = F.col("size").eqNullSafe(F.col("dst_size")) & S.whole_seconds(F.col("mtime_ns")).eqNullSafe(S.whole_seconds(F.col("dst_mtime_ns")))
    return manifest_diff(src, dst, compare_modes, equality=F.when(file, by_digest).otherwise(by_time))


def quick_check_exact(src: DataFrame, dst: DataFrame) -> DataFrame:
    return manifest_diff(src, dst, compare_modes=False, precision="ns")


def checksum_reclassify(plan: DataFrame, src_digests: DataFrame, dst_digests: DataFrame) -> DataFrame:
    """Decides files that are changed or unchanged anew by their digests (a missing one means changed); the digests are
    asked for those paths alone. Tables of (path, digest)."""
    at = F.col("classification").isin("changed", "unchanged") & (F.col("kind") == "file")
    asked = plan.filter(at).select("path")
    digests = (
        asked.join(src_digests.select("path", F.col("digest").alias("_s")), "path", "left").join(dst_digests.select("path", F.col("digest").alias("_d")), "path", "left")
    )
    same = F.coalesce(F.col("_s") == F.col("_d"), F.lit(False))
    decided = F.when(at, F.when(same, "unchanged").otherwise("changed")).otherwise(F.col("classification"))
    return plan.join(digests, "path", "left").withColumn("classification", decided).drop("_s", "_d")


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("kind", "classification").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


def transferable(plan: DataFrame) -> DataFrame:
    return plan.filter(F.col("classification").isin("new", "changed") & F.col("kind").isin("file", "symlink"))


def transfer_totals(plan: DataFrame) -> DataFrame:
    files = plan.filter(F.col("classification").isin("new", "changed") & (F.col("kind") == "file"))
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("bytes"))


def unsupported_kind(plan: DataFrame) -> DataFrame:
    return plan.filter(F.col("classification").isin("new", "changed") & (F.col("kind") == "other"))


def deletion_audit(plan: DataFrame, max_delete: int | None = None) -> DataFrame:
    """to_delete, destination_entries, share, verdict (allowed, over_limit, suspicious). A given limit alone decides."""
    c = F.col("classification")
    counts = plan.agg(F.count_if(c == "extraneous").alias("to_delete"), F.count_if(c.isNotNull() & (c != "new")).alias("destination_entries"))
    part = S.share(F.col("to_delete"), F.col("destination_entries"))
    if max_delete is None:
        verdict = F.when((F.col("to_delete") >= SUSPICIOUS_COUNT) & (part >= SUSPICIOUS_SHARE), "suspicious").otherwise("allowed")
    else:
        verdict = F.when(F.col("to_delete") > max_delete, "over_limit").otherwise("allowed")
    return counts.withColumn("share", part).withColumn("verdict", verdict)


def sync_report(plan: DataFrame, failures: DataFrame, partial_work: bool = False) -> DataFrame:
    """A row of counters. failures(path, severity): entries that could not be done; they count as failed, not as done.
    Those of the severity `warning` were done and count as warnings beside it. Physical bytes are what was moved: of a
    plan with physical_bytes (null: the size) those, else the sizes."""
    severity = F.col("severity") if "severity" in failures.columns else F.lit("error")
    seen = failures.groupBy("path").agg(F.bool_or(severity != "warning").alias("_bad"), F.count_if(severity == "warning").alias("_warnings"))
    c, ok = F.col("classification"), ~F.coalesce("_bad", F.lit(False))
    physical = F.coalesce("physical_bytes", "size") if "physical_bytes" in plan.columns else F.col("size")
    moved = c.isin("new", "changed") & ok
    zero = F.lit(0).cast("long")
    return (
        plan.join(seen, "path", "left")
        .agg(
            F.count_if(moved & (F.col("kind") == "file")).alias("transferred"),
            F.coalesce(F.sum(F.when(moved & (F.col("kind") == "file"), F.col("size"))), zero).alias("bytes"),
            F.coalesce(F.sum(F.when(moved & (F.col("kind") == "file"), physical)), zero).alias("physical_bytes"),
            F.count_if((c == "unchanged") & ok).alias("skipped"),
            F.count_if((c == "metadata_only") & ok).alias("repaired"),
            F.count_if((c == "extraneous") & ok).alias("deleted"),
            F.count_if(~ok).alias("failed"),
            F.coalesce(F.sum("_warnings"), zero).alias("warnings"),
        )
        .withColumn("partial_failure", (F.col("failed") != 0) | F.lit(partial_work))
    )


def delete_gate(report: DataFrame) -> DataFrame:
    """Deletions run only if nothing failed and nothing was left undone."""
    return report.select("failed", "partial_failure", (~F.col("partial_failure")).alias("may_delete"))


def action_rank(plan_kind: Column, classification: Column) -> Column:
    kind = F.when(plan_kind == "directory", 0).when(plan_kind == "symlink", 1).when(plan_kind == "file", 2).otherwise(3)
    cls = F.when(classification == "new", 0).when(classification == "changed", 1).otherwise(2)
    return F.struct((classification == "extraneous").cast("int"), kind, cls)


def dry_run_actions(plan: DataFrame) -> DataFrame:
    """path, action, place: creates and updates by kind, deletions after them; the rest does nothing. The place is the
    order of the report, so this one result is sorted as a whole, by a range exchange; it isn't numbered by one task."""
    action = F.when(F.col("classification") == "new", "create").when(F.col("classification") == "changed", "update").when(F.col("classification") == "extraneous", "delete")
    found = plan.withColumn("action", action).filter("action is not null")
    return found.orderBy(action_rank(F.col("kind"), F.col("classification")), F.col("path").cast("binary")).select("path", "kind", "action")


def placeholder_policy(entries: DataFrame, policy: str) -> DataFrame:
    """Entries with `retained`. `download` keeps placeholders, `skip` leaves them out, `error` raises on the first."""
    flag = F.coalesce("is_placeholder", F.lit(False))
    if policy == "error":
        kept = F.when(flag, F.raise_error(F.concat(F.lit("placeholder: "), F.col("path"))).cast("boolean")).otherwise(True)
    else:
        kept = {"download": F.lit(True), "skip": ~flag}[policy]
    return entries.withColumn("retained", kept)


def placeholder_counts(entries: DataFrame) -> DataFrame:
    flag = F.coalesce("is_placeholder", F.lit(False))
    return entries.agg(F.count_if(flag).alias("placeholders"), F.coalesce(F.sum(F.when(flag, F.col("size"))), F.lit(0).cast("long")).alias("placeholder_bytes"))


def protect_skipped(plan: DataFrame, skipped: DataFrame) -> DataFrame:
    """Paths that were skipped at the source are no reason to delete them at the destination."""
    gone = plan.filter("classification = 'extraneous'").join(skipped.select("path").distinct(), "path", "left_semi").select("path")
    return plan.join(gone, "path", "left_anti")


def canonical_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("path").cast("binary"))


def create_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.octet_length("path"), F.col("path").cast("binary"))


def delete_order(df: DataFrame) -> DataFrame:
    return df.orderBy(P.path_depth(F.col("path")).desc(), F.col("path").cast("binary"))


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with its place (from 1) in a total order, without one task seeing all rows: rows are dealt by range and written,
    so that a partition keeps its number, then counted by partition and numbered inside it. The order should have no ties."""
    ranged = staged(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_p").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_in", inside).join(sizes.select("_p", before.alias("_before")), "_p").withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_p", "_in", "_before")
