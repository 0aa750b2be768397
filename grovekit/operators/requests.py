"""Batches of requests on a manifest table, and the new versions of the table that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.functions import paths as P
from grovekit.operators.trees import exploded
from grovekit.staging import staged


def stat_lookup(requests: DataFrame, entries: DataFrame, include_digest: bool = False) -> DataFrame:
    """req_id, path, status (ok, missing, error), kind, size, digest (files only, when asked for)."""
    valid = P.path_validate(F.col("path"))
    there = entries.select("path", "kind", "size", "digest")
    digest = F.when((F.col("kind") == "file") & F.lit(include_digest), F.col("digest"))
    status = F.when(valid != "ok", "error").when(F.col("kind").isNull(), "missing").otherwise("ok")
    return requests.join(there, "path", "left").select("req_id", "path", status.alias("status"), "kind", "size", digest.alias("digest"))


def read_link(requests: DataFrame, entries: DataFrame) -> DataFrame:
    there = entries.select("path", "kind", "symlink_target")
    status = F.when(F.col("kind").isNull(), "missing").when(F.col("kind") != "symlink", "not_link").otherwise("ok")
    return requests.join(there, "path", "left").select("req_id", "path", status.alias("status"), F.when(status == "ok", F.col("symlink_target")).alias("symlink_target"))


def mutation_status(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests(req_id, op, path, dest) with status. rename: missing, already_exists, parent_missing; mkdir:
    already_exists, parent_missing; chmod, set_mtime: missing; delete: missing, root_refused."""
    at = entries.select("path", F.col("kind").alias("_kind"))
    to = entries.select(F.col("path").alias("dest"), F.col("kind").alias("_dest_kind"))
    parent = entries.filter("kind = 'directory'").select(F.col("path").alias("_parent"), F.lit(True).alias("_parent_there"))
    target = F.when(F.col("op") == "rename", F.col("dest")).otherwise(F.col("path"))
    found = (
        requests.withColumn("_parent", P.path_parent(target)).join(at, "path", "left").join(to, "dest", "left").join(parent, "_parent", "left")
        .withColumn("_ok_parent", (F.col("_parent") == "") | F.coalesce("_parent_there", F.lit(False)))
    )
    op, there = F.col("op"), F.col("_kind").isNotNull()
    status = (
        F.when((op == "rename") & ~there, "missing")
        .when((op == "rename") & F.col("_dest_kind").isNotNull(), "already_exists")
        .when((op == "mkdir") & there, "already_exists")
        .when(op.isin("rename", "mkdir") & ~F.col("_ok_parent"), "parent_missing")
        .when((op == "delete") & (F.col("path") == ""), "root_refused")
        .when(op.isin("chmod", "set_mtime", "delete") & ~there, "missing")
        .otherwise("ok")
    )
    return found.withColumn("status", status).select(*requests.columns, "status")


def rename(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """entries with the subtrees of ok requests (path, dest) moved; the nearest request above an entry moves it."""
    moves = requests.select(F.col("path").alias("ancestor"), "dest")
    near = exploded(entries).join(moves, "ancestor").groupBy("path").agg(F.min_by(F.struct("ancestor", "dest"), "distance").alias("_m"))
    moved = P.with_prefix(P.strip_prefix(F.col("path"), F.col("_m.ancestor")), F.col("_m.dest"))
    return entries.join(near, "path", "left").withColumn("path", F.when(F.col("_m").isNull(), F.col("path")).otherwise(moved)).drop("_m").select(*entries.columns)


def mkdir(entries: DataFrame, requests: DataFrame, mode: int = 493) -> DataFrame:
    values = {"kind": F.lit("directory"), "size": F.lit(0), "mtime_ns": F.lit(0), "mode": F.lit(mode)}
    rows = requests.select("path").distinct().select("path", *[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in entries.dtypes if c != "path"])
    return entries.unionByName(rows.select(*entries.columns))


def delete_recursive(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """entries without what is at or below the requests' paths; the root is refused."""
    roots = requests.filter("path <> ''").select(F.col("path").alias("ancestor")).distinct()
    gone = exploded(entries).join(roots, "ancestor", "left_semi").select("path").distinct()
    return entries.join(gone, "path", "left_anti")


def delete_outcome(entries: DataFrame, requests: DataFrame, stuck: DataFrame) -> DataFrame:
    """path, place, outcome of a recursive deletion of requests(path), children first: `failed` for what stuck(path) says
    can't be removed, `not_empty` for the directories above, `removed` for all else. The root is refused."""
    from grovekit.operators.planning import numbered

    roots = requests.filter("path <> ''").select(F.col("path").alias("ancestor")).distinct()
    inside = exploded(entries).join(roots, "ancestor", "left_semi").select("path").distinct()
    fails = inside.join(stuck.select("path").distinct(), "path", "left_semi").withColumn("_bad", F.lit(True))
    above = fails.select(F.explode(P.path_ancestors(F.col("path"))).alias("path")).distinct().withColumn("_held", F.lit(True))
    outcome = F.when(F.col("_bad"), "failed").when(F.col("_held"), "not_empty").otherwise("removed")
    found = inside.join(fails, "path", "left").join(above, "path", "left").select("path", outcome.alias("outcome"))
    return numbered(found, P.path_depth(F.col("path")).desc(), F.col("path").cast("binary"))


def delete_result(progress: DataFrame) -> DataFrame:
    """req_id, removed_count, failures, outcome of rows (req_id, path, removed, cancelled)."""
    out = progress.groupBy("req_id").agg(
        F.count_if("removed").alias("removed_count"), F.count_if(~F.col("removed")).alias("failures"), F.coalesce(F.bool_or("cancelled"), F.lit(False)).alias("_c")
    )
    return out.withColumn("outcome", F.when(F.col("_c"), "cancelled").when(F.col("failures") > 0, "partial").otherwise("complete")).drop("_c")


def link_ends(links: DataFrame, most: int) -> DataFrame:
    """path, end of links(path, to): where a link leads after all links that follow it; null for one whose target is null,
    that leads through more than `most` links, or round in a circle.

    Every round joins the links with themselves, and each then leads twice as far: 6 rounds for 40 links, whatever their
    chains, and fewer where the chains are shorter."""
    reach = staged(links.select("path", F.col("to").alias("end"), F.lit(1).alias("hops")), "links")
    while True:
        beyond = reach.select(F.col("path").alias("end"), F.col("end").alias("_next"), F.col("hops").alias("_more"), F.lit(True).alias("_link"))
        # what has gone too far stands still, so numbers stay small and circles end
        joined = reach.join(beyond.filter(F.col("_more") <= most), "end", "left")
        reach = staged(joined.select("path", F.when(F.col("_link"), F.col("_next")).otherwise(F.col("end")).alias("end"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"), F.coalesce("_link", F.lit(False)).alias("moved")), "links")
        if not reach.filter(F.col("moved") & F.col("end").isNotNull() & (F.col("hops") <= most)).limit(1).count():
            break
        reach = reach.drop("moved")
    still = reach.select(F.col("path").alias("end"), F.lit(True).alias("_link"))
    done = reach.join(still, "end", "left")
    return done.select("path", F.when((F.col("hops") <= most) & F.col("_link").isNull(), F.col("end")).alias("end"))


def set_metadata(entries: DataFrame, requests: DataFrame, most_links: int = 40) -> DataFrame:
    """chmod and set_mtime: requests(path, mode, mtime_ns), nulls leave a value. A symlink at the end is followed, from the
    directory that it stands in; one that leads out of the tree, to nothing, or through more than most_links others, is
    left alone."""
    asked = requests.select("path", F.col("mode").alias("_mode"), F.col("mtime_ns").alias("_mtime"))
    if "symlink_target" in entries.columns:
        to = P.resolve(P.path_parent(F.col("path")), F.decode("symlink_target", "UTF-8"))
        ends = link_ends(entries.filter("kind = 'symlink'").select("path", to.alias("to")), most_links + 1)
        asked = asked.join(ends.select("path", "end", F.lit(True).alias("_link")), "path", "left").filter("_link is null or end is not null")
        asked = asked.select(F.coalesce("end", "path").alias("path"), "_mode", "_mtime")
    asked = asked.groupBy("path").agg(F.max("_mode").alias("_mode"), F.max("_mtime").alias("_mtime"))
    return entries.join(asked, "path", "left").withColumns({"mode": F.coalesce("_mode", "mode"), "mtime_ns": F.coalesce("_mtime", "mtime_ns")}).select(*entries.columns)


def fetch_chunks(df: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """path, identity, size, offset, data, digest (of the whole) of a table (path, identity, content)."""
    n = F.octet_length("content")
    whole = df.filter(n > 0).select("path", "identity", n.cast("long").alias("size"), "content", F.sha2("content", 256).alias("digest"))
    cut = whole.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("size").cast("int") - 1, F.lit(chunk))))
    return cut.select("path", "identity", "size", F.col("offset").cast("long").alias("offset"), F.substring("content", F.col("offset") + 1, F.lit(chunk)).alias("data"), "digest")


def publish_cas(requests: DataFrame, current: DataFrame) -> DataFrame:
    """req_id, path, status: requests(req_id, path, expected_identity, digest, payload) are ok if the file there is still
    the one expected and the payload is what its digest says."""
    there = current.select("path", "kind", F.col("identity").alias("current_identity"))
    status = (
        F.when(F.col("kind").isNull(), "changed")
        .when(F.col("kind") != "file", "error")
        .when(~F.col("expected_identity").eqNullSafe(F.col("current_identity")), "changed")
        .when(F.sha2(F.col("payload").cast("binary"), 256) != F.col("digest"), "error")
        .otherwise("ok")
    )
    return requests.join(there, "path", "left").select("req_id", "path", status.alias("status"), F.when(status == "changed", F.col("current_identity")).alias("current_identity"))


def publish_requests(requests: DataFrame, current: DataFrame) -> DataFrame:
    """current after the requests that publish_cas() lets through: size and digest are the payload's. Requests are held
    against `current` as it is read now; what publishes the result should read it again (sources.files.publish does)."""
    passed = publish_cas(requests, current).filter("status = 'ok'").select("req_id")
    new = requests.join(passed, "req_id", "left_semi").groupBy("path").agg(F.max_by(F.struct(F.octet_length("payload").cast("long").alias("size"), "digest"), "req_id").alias("_new"))
    put = {"size": F.coalesce("_new.size", "size"), "digest": F.coalesce("_new.digest", "digest")}
    return current.join(new, "path", "left").select(*[put.get(c, F.col(c)).alias(c) for c in current.columns])


def stable_read(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, status (stable, vanished, changed) by the fingerprint before and after a read."""
    later = after.select("path", F.col("fingerprint").alias("_after"))
    status = F.when(F.col("_after").isNull(), "vanished").when(F.col("fingerprint") == F.col("_after"), "stable").otherwise("changed")
    return before.join(later, "path", "left").select("path", status.alias("status"))


def stable_read_twice(before: DataFrame, after: DataFrame, again: DataFrame) -> DataFrame:
    """Entries that changed are read once more, against their new fingerprint; a second change is unstable."""
    first = stable_read(before, after)
    retried = stable_read(after.join(first.filter("status = 'changed'"), "path", "left_semi"), again)
    second = retried.withColumn("status", F.when(F.col("status") == "changed", "unstable").otherwise(F.col("status")))
    return first.filter("status <> 'changed'").unionByName(second)


def apply_plan(plan: DataFrame, destination: DataFrame, delete: bool = False, max_delete: int | None = None, failures: DataFrame | None = None, partial_work: bool = False) -> DataFrame:
    """The destination after the plan: new and changed rows and modes from the source.

    Extraneous ones stay unless they may be deleted. The deletion audit decides that first (an error if it says no), and
    then the gate: with a failure (failures: as in sync_report) or work left undone nothing is deleted. The plan is written
    once if deletion is asked for, as both read it."""
    from grovekit.operators.planning import delete_gate, deletion_audit, sync_report

    if delete:
        plan = staged(plan, "plan")
        if (verdict := deletion_audit(plan, max_delete).first()["verdict"]) != "allowed":
            raise ValueError(f"deletion refused: {verdict}")
        if failures is not None or partial_work:
            none = plan.select("path").limit(0) if failures is None else failures
            delete = delete_gate(sync_report(plan, none, partial_work)).first()["may_delete"]
    c = F.col("classification")
    rows = plan if not delete else plan.filter(c != "extraneous")
    # an unchanged row is the destination's own; a repaired one takes the mode alone
    own = [F.when(c == "unchanged", F.col(f"dst_{x}")).when((c == "metadata_only") & F.lit(x != "mode"), F.col(f"dst_{x}")).otherwise(F.col(x)).alias(x) for x in destination.columns if x != "path"]
    return rows.select("path", *own)


def repair_metadata(plan: DataFrame) -> DataFrame:
    """path, mode to set; no content moves."""
    return plan.filter("classification = 'metadata_only'").select("path", "mode")
