import os

import pytest
from pyspark.sql import functions as F

from grovekit import generate as G
from grovekit.functions.globs import Rule
from grovekit.operators import filtering as FL
from grovekit.operators import planning as PL
from grovekit.operators import ranges as R
from grovekit.operators import requests as RQ
from grovekit.operators import trees as T
from grovekit.operators import verifying as VF

ENTRY = "path string, kind string, size long, mtime_ns long, mode int, digest string"


def entries(spark, *rows):
    return spark.createDataFrame([(p, k, n, t, m, d) for p, k, n, t, m, d in rows], ENTRY)


def file(path, size=1, mtime=0, mode=420, digest="d"):
    return path, "file", size, mtime, mode, digest


def classes(df):
    return {r["path"]: r["classification"] for r in df.collect()}


def test_diff_classes(spark):
    second = 10**9
    src = entries(spark, file("same"), file("subsecond", mtime=5), file("before", mtime=-1), file("mode", mode=384), file("content", size=2), ("type", "directory", 0, 0, 420, None), file("new"))
    dst = entries(spark, file("same"), file("subsecond", mtime=second - 1), file("before", mtime=0), file("mode"), file("content", mode=1), file("type", size=0), file("gone"))
    assert classes(PL.manifest_diff(src, dst)) == {
        "same": "unchanged", "subsecond": "unchanged", "before": "changed", "mode": "metadata_only", "content": "changed", "type": "changed", "new": "new", "gone": "extraneous"
    }
    assert [r["kind"] for r in PL.manifest_diff(src, dst).filter("path = 'type'").collect()] == ["directory"]
    assert classes(PL.quick_check_exact(src, dst))["subsecond"] == "changed"


def test_checksum_ignores_time(spark):
    src, dst = entries(spark, file("a", mtime=10**12), file("b", digest="x")), entries(spark, file("a"), file("b"))
    assert classes(PL.manifest_diff_checksum(src, dst)) == {"a": "unchanged", "b": "changed"}


@pytest.mark.parametrize(("gone", "kept", "limit", "verdict"), [(99, 0, None, "allowed"), (100, 100, None, "suspicious"), (100, 101, None, "allowed"), (5, 0, 4, "over_limit"), (500, 0, 500, "allowed"), (0, 0, None, "allowed")])
def test_deletion_audit(spark, gone, kept, limit, verdict):
    plan = spark.range(gone + kept).select(F.when(F.col("id") < gone, "extraneous").otherwise("unchanged").alias("classification"))
    assert PL.deletion_audit(plan, limit).first()["verdict"] == verdict


def test_filter_order(spark):
    paths = spark.createDataFrame([("build/a.o",), ("build/keep.txt",), ("src/a.c",), ("src/tmp/x",), ("src/tmp/keep",)], "path string")
    rules = [Rule(0, 1, "include", "build/keep.txt"), Rule(0, 2, "exclude", "build"), Rule(1, 1, "include", "tmp/keep", "src"), Rule(1, 2, "exclude", "tmp/*", "src")]
    got = {r["path"]: r["included"] for r in FL.filter_decide(paths, rules).collect()}
    assert got == {"build/a.o": False, "build/keep.txt": True, "src/a.c": True, "src/tmp/x": False, "src/tmp/keep": True}
    table = spark.createDataFrame([(r.scope, r.ord, r.action, r.pattern) for r in rules[2:]] + [("", 1, "exclude", "src/a.c")], "scope string, ord int, action string, pattern string")
    scoped = {r["path"]: r["included"] for r in FL.ignore_scope_join(paths, table).collect()}
    assert scoped == {"build/a.o": True, "build/keep.txt": True, "src/a.c": False, "src/tmp/x": False, "src/tmp/keep": True}


def test_ranges(spark):
    r = spark.createDataFrame([("f", 0, 10), ("f", 10, 5), ("f", 12, 8), ("f", 30, 0)], "path string, offset long, length long")
    assert sorted(map(tuple, R.merge_ranges(r).collect())) == [("f", 0, 10), ("f", 10, 10)]
    files = spark.createDataFrame([("f", 45), ("g", 3), ("z", 0)], "path string, size long")
    assert sorted(map(tuple, R.missing_chunks(files, r, 10).collect())) == [("f", 20, 10), ("f", 30, 10), ("f", 40, 5), ("g", 0, 3)]
    cover = {x["path"]: (x["covered"], x["complete"]) for x in R.range_coverage(files, r).collect()}
    assert cover == {"f": (20, False), "g": (0, False), "z": (0, True)}


def test_addresses_beyond_a_collision_stay(spark, tmp_path):
    """The rows of the query's SQL: it names the colliding addresses alone. In a tree all below them goes too."""
    import duckdb

    import __spark_entry__ as entry

    pages = [(50, "http://h/1"), (1, "http://h/1/"), (2, "https://h/1/x"), (3, "http://h/2")]
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["j12_drop_collisions"]).fetchall())
    assert sorted(map(tuple, entry.queries()["j12_drop_collisions"](spark, str(tmp_path)).collect())) == want == [("h/1/",), ("h/1/x",), ("h/2",)]
    tree = spark.createDataFrame([("a",), ("A",), ("a/x",), ("ab",)], "path string")
    assert [r["path"] for r in T.drop_collisions(tree, T.path_collisions(tree)).collect()] == ["ab"]


def test_pack_small_files(spark):
    files = spark.createDataFrame([(f"f{i}", n) for i, n in enumerate([4, 6, 3, 9, 20, 1, 0])], "path string, size long").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = [r["batch_id"] for r in sorted(R.pack_small_files(files, target=10, most=3).collect())]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == [0, 0, 1, 2, 3, 4, 4]


def test_numbered_agrees_with_one_window(spark):
    df = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("path"))
    want = {r["path"]: i + 1 for i, r in enumerate(sorted(df.collect()))}
    assert {r["path"]: r["place"] for r in PL.numbered(df, F.col("path")).collect()} == want


def test_apply_then_diff_is_clean(spark):
    src = T.with_directories(G.corpus(spark, "deep-small", 60).drop("word").withColumn("digest", F.lit("d")).filter("kind = 'file'"))
    dst = src.filter("size % 3 <> 0").unionByName(entries(spark, file("extra")))
    after = RQ.apply_plan(PL.manifest_diff(src, dst), dst, delete=True, max_delete=10)
    assert set(classes(PL.manifest_diff(src, after)).values()) == {"unchanged"}
    with pytest.raises(ValueError, match="over_limit"):
        RQ.apply_plan(PL.manifest_diff(src, dst), dst, delete=True, max_delete=0)


def test_verify_names_fields(spark):
    a = entries(spark, file("x"), file("y", size=2, digest="e"), file("m"))
    b = entries(spark, file("x", mtime=1), file("y"), file("u"))
    assert dict(map(tuple, VF.manifest_verify(a, b).collect())) == {"x": "mtime", "y": "length, content", "m": "missing", "u": "unexpected"}
    assert VF.manifest_digest(a).first() == VF.manifest_digest(a.repartition(3)).first()


def test_rename_and_delete(spark):
    t = T.with_directories(entries(spark, file("a/b/c"), file("a/d"), file("e")))
    moved = RQ.rename(t, spark.createDataFrame([("a", "z")], "path string, dest string"))
    assert sorted(r["path"] for r in moved.collect()) == ["e", "z", "z/b", "z/b/c", "z/d"]
    left = RQ.delete_recursive(t, spark.createDataFrame([("a/b",), ("",)], "path string"))
    assert sorted(r["path"] for r in left.collect()) == ["a", "a/d", "e"]


def test_workloads(spark):
    src = G.corpus(spark, "flat-small", 300)
    for kind, want in {"no-op": {"unchanged"}, "initial-copy": {"new"}, "metadata-churn": {"unchanged", "changed"}, "delete": {"unchanged", "extraneous"}}.items():
        assert set(classes(PL.manifest_diff(*G.workload(src, kind))).values()) == want
    for kind in G.CLASSES:
        assert G.corpus(spark, kind, 40).count() in (1, 40)


def test_tree_source(spark, tmp_path):
    from grovekit.sources.tree import TreeDataSource

    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "f.txt").write_text("hello")
    os.symlink("f.txt", tmp_path / "d" / "l")
    spark.dataSource.register(TreeDataSource)
    got = {r["path_str"]: (r["kind"], r["symlink_target"]) for r in spark.read.format("tree").load(str(tmp_path)).collect()}
    assert got == {"d": ("directory", None), "d/e": ("directory", None), "d/f.txt": ("file", None), "d/l": ("symlink", b"f.txt")}


def test_files_round_trip(spark, tmp_path):
    from grovekit.sources import files as SF

    e = entries(spark, file("a/é", mtime=-1), file("b", size=3, mtime=10**18 + 7), file("c")).coalesce(1)
    SF.write_manifest_json(e, str(tmp_path / "m"))
    back = SF.read_manifest_json(spark, str(tmp_path / "m"), lines=True).select(*e.columns)
    assert sorted(back.collect()) == sorted(e.collect())
    SF.publish(e, str(tmp_path / "t"))
    SF.publish(e.filter("path = 'b'"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    (tmp_path / "log.json").write_text('{"type":"done","run_id":1,"new_field":2}\nnot json\n{"run_id":3}\n')
    assert [r["type"] for r in SF.read_event_log(spark, str(tmp_path / "log.json")).collect()] == ["done"]
    SF.append_failure_log(spark.createDataFrame([("error", None)], "type string, path string"), str(tmp_path / "fail"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "fail")).collect()] == ['{"type":"error"}']


def test_streams(spark, tmp_path):
    from grovekit.streaming import jobs as ST

    rows = [("f", 20, "x", 0, 10), ("f", 20, "x", 5, 10), ("f", 20, "x", 10, 10)]
    spark.createDataFrame(rows, "path string, size long, fingerprint string, offset long, length long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, size long, fingerprint string, offset long, length long").parquet(str(tmp_path / "in"))
    q = ST.range_tracker(stream).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["offset"], r["accepted"]) for r in spark.table("tracked").collect()) == [(0, True), (5, False), (10, True)]


def test_links_resolve_from_their_directory(spark):
    tree = spark.createDataFrame(
        [("a/l", "symlink", b"f.txt"), ("a/f.txt", "file", None), ("f.txt", "file", None), ("a/up", "symlink", b"../f.txt"), ("b/l", "symlink", b"../a/./l"), ("out", "symlink", b"../x"), ("loop", "symlink", b"loop"), ("abs", "symlink", b"/f.txt")],
        "path string, kind string, symlink_target binary",
    ).withColumns({"size": F.lit(0), "mtime_ns": F.lit(0).cast("long"), "mode": F.lit(420)})

    def changed(path):
        asked = spark.createDataFrame([(path, 511, None)], "path string, mode int, mtime_ns long")
        return [r["path"] for r in RQ.set_metadata(tree, asked, most_links=3).filter("mode = 511").collect()]

    assert [changed(p) for p in ("a/l", "a/up", "b/l", "out", "loop", "abs", "f.txt")] == [["a/f.txt"], ["f.txt"], ["a/f.txt"], [], [], [], ["f.txt"]]


def test_failures_keep_extraneous_rows(spark):
    src, dst = entries(spark, file("a"), file("b", size=2)), entries(spark, file("a"), file("old"))
    plan = PL.manifest_diff(src, dst)
    bad = spark.createDataFrame([("b", "error")], "path string, severity string")
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(RQ.apply_plan(plan, dst, delete=True)) == ["a", "b"]
    assert paths(RQ.apply_plan(plan, dst, delete=True, failures=bad)) == paths(RQ.apply_plan(plan, dst, delete=True, partial_work=True)) == ["a", "b", "old"]
    assert paths(RQ.apply_plan(plan, dst, delete=True, failures=bad.withColumn("severity", F.lit("warning")))) == ["a", "b"]


def test_large_directories_are_digested_in_buckets(spark):
    rows = entries(spark, *[file(f"d/f{i}", digest=str(i)) for i in range(40)], *[file(f"e/f{i}", digest=str(i)) for i in range(40)], file("e/g/h/i"))
    tree = T.with_directories(rows)
    got = {r["path"]: r["tree_digest"] for r in T.tree_digest(tree, bucket_rows=8).collect()}
    again = {r["path"]: r["tree_digest"] for r in T.tree_digest(tree.repartition(5), bucket_rows=8).collect()}
    other = {r["path"]: r["tree_digest"] for r in T.tree_digest(T.with_directories(rows.withColumn("digest", F.when(F.col("path") == "d/f7", "x").otherwise(F.col("digest")))), bucket_rows=8).collect()}
    assert got == again and set(got) == {"d", "e", "e/g", "e/g/h"} and {p for p in got if got[p] != other[p]} == {"d"}


def test_gate_findings(spark):
    from grovekit.operators import measuring as M

    def samples(factor, noisy=False, n=5, digest="c"):
        rows = [(name, base, i, (k + i) % 2, (1.0 if base is None else factor) * (1 + i * noisy), 1.0, 7, 9, (True, 0, digest, digest, 7, 9)) for k, (name, base) in enumerate((("base", None), ("fast", "base"))) for i in range(n)]
        schema = "result string, baseline string, repetition int, method_order int, wall_seconds double, cpu_seconds double, item_count long, logical_bytes long, oracle struct<passed: boolean, mismatch_count: long, expected_digest: string, actual_digest: string, item_count: long, logical_bytes: long>"
        return M.measured(spark.createDataFrame(rows, schema))

    def gate(*a, **k):
        return {(r["severity"], r["result"], r["message"]) for r in M.bench_gate(*a, **k).collect()}

    none = {("warn", "base", "skipped: no baseline")}
    assert gate(samples(0.5), samples(0.5)) == none
    assert gate(samples(0.6), samples(0.5)) == none | {("fail", "fast", "regressed")}
    assert ("fail", "fast", "too few repetitions") in gate(samples(0.5, n=4), samples(0.5))
    assert ("warn", "fast", "noisy") in gate(samples(0.5, noisy=True), samples(0.5))
    pinned = M.Report(corpus_digest="d")
    assert ("fail", "fast", "the result is not the corpus") in gate(samples(0.5), report=pinned)
    assert ("warn", "", "reports differ in environment") in gate(samples(0.5), samples(0.5), report=M.Report(), past_report=M.Report(environment="x"))
    assert ("warn", "", "the past report fails its own checks") in gate(samples(0.5), samples(0.5, n=2), past_report=M.Report())
    assert gate(samples(0.5), strict=True) == {("warn", "", "no history"), ("fail", "", "nothing was compared")}


def test_tree_source_splits_directories(spark, tmp_path, monkeypatch):
    from grovekit.sources import tree as TS

    for i in range(3):
        for j in range(3):
            (tmp_path / f"d{i}" / f"e{j}").mkdir(parents=True)
            (tmp_path / f"d{i}" / f"e{j}" / "f").write_text("x")
        (tmp_path / f"d{i}" / "g").write_text("x")
    monkeypatch.setattr(TS, "PARTITIONS", 5)
    reader = TS._Reader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) == 10  # nine directories of the second level, and all that stands above them
    rows = [r[1] for p in parts for r in reader.read(p)]
    assert len(rows) == len(set(rows)) == 3 + 9 + 9 + 3


@pytest.mark.parametrize("codec", ["zstd-3", "zlib-1"])
def test_compression_probe(spark, codec):
    import zlib

    import zstandard

    from grovekit.operators import measuring as M

    pack = zstandard.ZstdCompressor(level=3).compress if codec == "zstd-3" else lambda b: zlib.compress(b, 1)
    contents = [b"a" * 5000, os.urandom(3000), b"", None, b"ab" * 40 + os.urandom(900)]
    df = spark.createDataFrame([(c,) for c in contents], "content binary")
    got = {r["sample_bytes"]: r for r in M.compression_probe(df, [100, 4096], codec).collect()}
    for n in (100, 4096):
        chosen, adaptive = 0, 0
        for c in contents:
            sample, raw = (c or b"")[:n], len(c or b"")
            yes = bool(sample) and len(pack(sample)) * 100 < len(sample) * 95
            chosen += yes
            adaptive += raw * len(pack(sample)) // len(sample) if yes else raw
        assert (got[n]["selected"], got[n]["adaptive_bytes"], got[n]["codec"]) == (chosen, adaptive, codec)
    with pytest.raises(ValueError):
        M.compression_probe(df, [1], "other")


def test_chains_of_links_end_by_doubling(spark):
    chain = [(f"l{i}", f"l{i + 1}") for i in range(41)]  # l0 leads through 41 links to l41, which is none
    rows = [*chain, ("a", "b"), ("b", "c"), ("c", "a"), ("in", "a"), ("self", "self"), ("out", None), ("to out", "out"), ("one", "file"), ("two", "one")]
    df = spark.createDataFrame(rows, "path string, to string")
    got = {r["path"]: r["end"] for r in RQ.link_ends(df, 41).collect()}
    assert got == {**{f"l{i}": "l41" for i in range(41)}, **dict.fromkeys(["a", "b", "c", "in", "self", "out", "to out"]), "one": "file", "two": "file"}
    got = {r["path"]: r["end"] for r in RQ.link_ends(df, 5).collect()}
    assert [i for i in range(41) if got[f"l{i}"]] == [36, 37, 38, 39, 40] and got["in"] is None
