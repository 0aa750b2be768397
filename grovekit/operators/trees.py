"""Joins along the tree: an entry meets its ancestors through an exploded array, so that every join is by equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grovekit.functions import paths as P
from grovekit.staging import staged


def with_directories(entries: DataFrame, mode: int = 493) -> DataFrame:
    """entries and a row for each distinct directory above them."""
    above = entries.select(F.explode(P.path_ancestors(F.col("path"))).alias("path")).distinct().join(entries.select("path"), "path", "left_anti")
    values = {"kind": F.lit("directory"), "size": F.lit(0).cast("long"), "mtime_ns": F.lit(0).cast("long"), "mode": F.lit(mode)}
    rows = above.select("path", *[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in entries.dtypes if c != "path"])
    return entries.unionByName(rows.select(*entries.columns))


def exploded(df: DataFrame, including_self: bool = True) -> DataFrame:
    """(path, ancestor, distance), nearest first; the columns are cut to the path before the rows multiply."""
    array = P.path_and_ancestors(F.col("path")) if including_self else P.path_ancestors(F.col("path"))
    return df.select("path", F.posexplode(array).alias("distance", "ancestor"))


def drop_collisions(entries: DataFrame, groups: DataFrame, below: bool = True) -> DataFrame:
    """Without every entry at or below a colliding path; groups(paths array). Where paths are keys of a flat table and not
    of a tree, `below` is false and the colliding paths alone go."""
    bad = groups.select(F.explode("paths").alias("ancestor")).distinct()
    if not below:
        return entries.join(bad.withColumnRenamed("ancestor", "path"), "path", "left_anti")
    gone = exploded(entries).join(bad, "ancestor", "left_semi").select("path").distinct()
    return entries.join(gone, "path", "left_anti")


def collision_failures(groups: DataFrame) -> DataFrame:
    """A failure for each member of groups(collision_key, paths): path, collision_key, kind, message, which names the others."""
    each = groups.select("collision_key", "paths", F.explode("paths").alias("path"))
    others = F.array_join(F.array_remove("paths", F.col("path")), ", ")
    return each.select("path", "collision_key", F.lit("collision").alias("kind"), F.concat(F.lit("the destination can't tell it from "), others).alias("message"))


def path_collisions(entries: DataFrame, case_insensitive: bool = True, normalization_insensitive: bool = True) -> DataFrame:
    """collision_key, paths: names that a destination takes for one. The key is worked out in an Arrow batch; groups
    are found on it alone, and only those of more than one path are gathered."""
    keyed = entries.select("path").distinct().withColumn("collision_key", P.collision_key(F.col("path"), case_insensitive, normalization_insensitive))
    many = keyed.groupBy("collision_key").agg(F.count("*").alias("n")).filter("n > 1").select("collision_key")
    return keyed.join(many, "collision_key", "left_semi").groupBy("collision_key").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def maximal_new_subtrees(plan: DataFrame) -> DataFrame:
    """New directories with no new directory above them."""
    new = plan.filter("classification = 'new' and kind = 'directory'").select("path")
    below = exploded(new, False).join(new.withColumnRenamed("path", "ancestor"), "ancestor", "left_semi").select("path").distinct()
    return new.join(below, "path", "left_anti")


def subtree_members(plan: DataFrame, roots: DataFrame) -> DataFrame:
    """root, path, relative, kind, size of every entry at or below a root; roots(path)."""
    found = exploded(plan).join(roots.select(F.col("path").alias("ancestor")), "ancestor").select("path", F.col("ancestor").alias("root"))
    return plan.select("path", "kind", "size").join(found, "path").withColumn("relative", P.strip_prefix(F.col("path"), F.col("root")))


def subtree_totals(members: DataFrame) -> DataFrame:
    file = F.col("kind") == "file"
    return members.groupBy("root").agg(F.count_if(file).alias("files"), F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0).cast("long")).alias("bytes"))


def subtree_remainder(plan: DataFrame, roots: DataFrame) -> DataFrame:
    inside = exploded(plan).join(roots.select(F.col("path").alias("ancestor")), "ancestor", "left_semi").select("path").distinct()
    return plan.join(inside, "path", "left_anti")


def symlink_escape(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests (req_id, path) that go through a symlink; the last component may be one."""
    links = entries.filter("kind = 'symlink'").select(F.col("path").alias("ancestor"))
    above = requests.select("req_id", F.explode(P.path_ancestors(F.col("path"))).alias("ancestor"))
    bad = above.join(links, "ancestor", "left_semi").select("req_id").distinct()
    return requests.join(bad.withColumn("_bad", F.lit(True)), "req_id", "left").withColumn("rejected", F.coalesce("_bad", F.lit(False))).drop("_bad")


def mutated_parents(plan: DataFrame) -> DataFrame:
    c = F.col("classification")
    return plan.filter(c.isin("new", "changed", "extraneous")).select(P.path_parent(F.col("path")).alias("path")).filter("path <> ''").distinct()


def restore_directory_set(plan: DataFrame, delete: bool = True) -> DataFrame:
    """Directories whose times must be set at the end: those written, and unchanged ones in which something was."""
    dirs = plan.filter("kind = 'directory'")
    written = dirs.filter(F.col("classification").isin("new", "changed")).select("path")
    touched = mutated_parents(plan if delete else plan.filter("classification <> 'extraneous'"))
    kept = dirs.filter("classification = 'unchanged'").select("path").join(touched, "path", "left_semi")
    return written.union(kept).distinct()


def tree_digest(entries: DataFrame, bucket_rows: int = 65_536) -> DataFrame:
    """path, tree_digest of every directory, from the digests of its children in the order of their names.

    The entries are read once and written with their depths; from the deepest up, each level reads its own rows, joins
    the digests of the level below, and is written, so that a plan holds one level however deep the tree is. A directory
    of more children than bucket_rows is digested in buckets of names first (as many as the next power of two of the
    quotient, by the names' hashes) and then over the buckets in their order, so that no task gathers more."""
    name, parent = P.path_basename(F.col("path")), P.path_parent(F.col("path"))
    columns = entries.select("path", "kind", F.coalesce("digest", F.lit("")).alias("digest"), name.alias("name"), parent.alias("parent"), P.path_depth(F.col("path")).alias("depth"))
    at = staged(columns, "tree-entries")
    deepest = at.agg(F.max("depth")).first()[0] or 0
    done, below = [], None
    for depth in range(deepest, 0, -1):
        here, content = at.filter(F.col("depth") == depth), F.col("digest")
        if below is not None:
            here = here.join(below, "path", "left")
            content = F.coalesce("children", "digest")
        kind = F.when(F.lit(below is not None) & F.col("children").isNotNull(), "directory").otherwise(F.col("kind")) if below is not None else F.col("kind")
        level = staged(here.select("path", "kind", "name", "parent", F.sha2(F.concat_ws("|", kind, "name", content), 256).alias("own")), "tree-level")
        done.append(level.filter("kind = 'directory'").select("path", F.col("own").alias("tree_digest")))
        counts = level.groupBy("parent").agg(F.count("*").alias("n")).withColumn("buckets", F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / bucket_rows, F.lit(1.0))))).cast("long"))
        bucket = F.conv(F.substring(F.sha2("name", 256), 1, 8), 16, 10).cast("long") % F.col("buckets")
        parts = level.join(counts.select("parent", "buckets"), "parent").groupBy("parent", "buckets", bucket.alias("bucket")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "own"))), lambda x: x["own"]), ""), 256).alias("h")
        )
        joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), ""), 256)
        below = parts.groupBy(F.col("parent").alias("path")).agg(F.when(F.count("*") == 1, F.first("h")).otherwise(joined).alias("children"))
    out = at.select("path", F.lit("").alias("tree_digest")).limit(0)
    for df in done:
        out = out.unionByName(df)
    return out


def tree_profile(entries: DataFrame) -> DataFrame:
    """One row: counts, mean, median, 90th percentile, largest, and a histogram of sizes. Both quantiles are exact, by rounds
    of histograms (exact_quantiles)."""
    from grovekit.operators.selection import exact_quantiles

    file, size = F.col("kind") == "file", F.when(F.col("kind") == "file", F.col("size"))
    edges = [("under_1k", 0, 1 << 10), ("to_8k", 1 << 10, 8 << 10), ("to_64k", 8 << 10, 64 << 10), ("to_1m", 64 << 10, 1 << 20), ("to_8m", 1 << 20, 8 << 20), ("above_8m", 8 << 20, 1 << 62)]
    median, p90 = (F.lit(x).cast("double") for x in exact_quantiles(entries, size, (0.5, 0.9)))
    return entries.agg(
        F.count_if(file).alias("files"),
        F.count_if(F.col("kind") == "directory").alias("directories"),
        F.avg(size).alias("mean_size"),
        median.alias("median_size"),
        p90.alias("p90_size"),
        F.max(size).alias("max_size"),
        *[F.count_if((size >= a) & (size < b)).alias(name) for name, a, b in edges],
    ).withColumn("files_per_directory", F.when(F.col("directories") > 0, F.col("files") / F.col("directories")))


def hardlink_extra(inodes: DataFrame) -> DataFrame:
    """Second and later names of an inode."""
    order = F.row_number().over(W.partitionBy("device", "inode").orderBy("path"))
    return inodes.withColumn("name_number", order.cast("long")).filter("name_number > 1")


def dropped_metadata(entries: DataFrame, owner: int) -> DataFrame:
    """What a copy would lose: hard links, foreign owners, extended attributes; what wasn't looked at is listed."""
    extra = hardlink_extra(entries.filter("kind = 'file' and nlink > 1")).agg(F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("extra_bytes"))
    unchecked = F.array_compact(F.array(*[F.when(F.count(c) < F.count("*"), F.lit(c)) for c in ("uid", "has_xattrs", "nlink")]))
    seen = entries.agg(
        F.count_if((F.col("kind") == "file") & (F.col("nlink") > 1)).alias("hardlinked"),
        F.count_if(F.col("uid") != owner).alias("foreign_owner"),
        F.count_if("has_xattrs").alias("with_xattrs"),
        F.array_join(unchecked, ",").alias("unchecked"),
    )
    return seen.join(F.broadcast(extra))  # a row and a row


def sparse_report(entries: DataFrame) -> DataFrame:
    from grovekit.functions import scalars as S

    sparse = S.sparse_candidate(F.col("kind"), F.col("size"), F.col("allocated_bytes"))
    return entries.filter("kind = 'file' and allocated_bytes is not null").agg(
        F.sum("size").alias("apparent"),
        F.sum("allocated_bytes").alias("allocated"),
        F.count_if(sparse).alias("sparse_files"),
        F.coalesce(F.sum(F.when(sparse, S.wasted_bytes(F.col("size"), F.col("allocated_bytes")))), F.lit(0).cast("long")).alias("wasted"),
    )


def sparse_top(entries: DataFrame, k: int) -> DataFrame:
    from grovekit.functions import scalars as S

    found = entries.filter(S.sparse_candidate(F.col("kind"), F.col("size"), F.col("allocated_bytes")))
    return found.orderBy(F.desc("size"), "path").limit(k).select("path", "size", "allocated_bytes", S.amplification(F.col("size"), F.col("allocated_bytes")).alias("amplification"))
