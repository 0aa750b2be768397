"""Order statistics, selection by a threshold, ranges over part edges, and batches at every shard size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit import generate as G
from grovekit.operators import ranges as R
from grovekit.operators import selection as SE
from grovekit.operators import trees as T


@pytest.mark.parametrize("kind", ["sizes", "signed", "ties", "far", "one"])
def test_quantiles_as_percentile(spark, kind):
    rng = random.Random(6)
    values = {
        "sizes": [int(2 ** rng.uniform(0, 40)) for _ in range(3000)],
        "signed": [rng.randint(-(10**9), 10**9) for _ in range(2001)],
        "ties": [7] * 900 + [8] * 100 + [-1] * 3,
        "far": [-(2**63), 2**63 - 1, 0, -1, 2**62, 2**62 + 1, 2**53 - 1, 2**53, 2**54 - 1, 2**54, -(2**62)],
        "one": [12345],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "v long").repartition(7)
    ranks = sorted({0, len(values) - 1, len(values) // 2, len(values) // 3})
    held = sorted(values)
    assert [tuple(s) for s in SE.order_statistics(df, F.col("v"), ranks)] == [(held[r], held.index(held[r]), held.count(held[r])) for r in ranks]
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    want = df.select(*[F.percentile("v", q) for q in shares]).first()
    if kind != "far":  # there percentile() itself rounds
        assert SE.exact_quantiles(df, F.col("v"), shares) == list(want)
    assert SE.exact_quantiles(df.filter("v is null"), F.col("v"), shares) == [None] * 5
    assert SE.order_statistics(df, F.col("v"), [len(values)]) == []


def test_profile_has_exact_quantiles_without_gathering(spark):
    src = G.corpus(spark, "mixed", 3000)
    got = T.tree_profile(src)
    size = F.when(F.col("kind") == "file", F.col("size"))
    assert (got.first()["median_size"], got.first()["p90_size"]) == tuple(src.select(F.percentile(size, 0.5), F.percentile(size, 0.9)).first())
    assert "percentile" not in got._jdf.queryExecution().toString()
    none = T.tree_profile(src.filter("false")).first()
    assert none["median_size"] is None and none["files"] == 0


def test_least_hashes_by_a_threshold(spark):
    files = G.corpus(spark, "flat-small", 12_345)
    got = G.select_hashed(files, "k")
    hashed = F.sha2(F.concat(F.lit("k:"), "path"), 256)
    want = {r["path"] for r in files.orderBy(hashed).limit(124).collect()}
    assert {r["path"] for r in got.collect()} == want and got.columns == files.columns
    plan = got._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan
    assert G.select_hashed(files.filter("false"), "k").count() == 0


def test_least_by_with_ties(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(100)], "k long, i long").repartition(4)
    for n in (0, 1, 19, 20, 21, 57, 100, 500):
        got = sorted((r["k"], r["i"]) for r in SE.least_by(df, F.col("k"), n, F.col("i")).collect())
        assert got == sorted((i % 5, i) for i in range(100))[:n]


def merged(rows):
    out = {}
    for p, a, n in sorted(r for r in rows if r[2] > 0):
        held = out.setdefault(p, [])
        if held and a < held[-1][1]:
            held[-1][1] = max(held[-1][1], a + n)
        else:
            held.append([a, a + n])
    return sorted((p, a, b - a) for p, held in out.items() for a, b in held)


@pytest.mark.parametrize(("parts", "most"), [(1, 100), (13, 100), (4, 10**6)])
def test_ranges_of_one_path_over_many_parts(spark, parts, most):
    rng = random.Random(7)
    rows = [("hot", rng.randint(0, 20_000), rng.randint(0, 12)) for _ in range(3000)] + [("long", 0, 10**6), ("long", 5, 1)] + [("long", k * 100, 30) for k in range(500)]
    rows += [(f"p{k % 40}", rng.randint(0, 500), rng.randint(0, 20)) for k in range(800)]
    df = spark.createDataFrame(rows, "path string, offset long, length long").repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = R._ordered(df, ("path",))
        assert ordered.filter("path = 'hot'").select("_part").distinct().count() > (parts > 1)
        want = merged(rows)
        assert sorted(map(tuple, R.merge_ranges(df, hot_ranges=most).collect())) == want
        files = spark.createDataFrame([("hot", 25_000), ("long", 100), ("none", 7), *[(f"p{k}", 400) for k in range(40)]], "path string, size long")
        lacking, by = [], {}
        for p, a, n in want:
            by.setdefault(p, []).append((a, a + n))
        for p, size in files.collect():
            at = 0
            for a, b in [*by.get(p, []), (size, size)]:
                end = min(a, size)
                lacking += [(p, x, min(64, end - x)) for x in range(at, end, 64)]
                at = max(at, b)
        assert sorted(map(tuple, R.missing_chunks(files, df, 64, most).collect())) == sorted(lacking)
        faults = {(r["path"], r["offset"], r["length"]) for r in R.range_overlaps(files, df, most).collect() if r["fault"] == "overlap"}
        seen, expected, size = {}, set(), {r["path"]: r["size"] for r in files.collect()}
        for p, a, n in sorted(rows):
            if a < seen.get(p, 0) and a + n <= size[p]:
                expected.add((p, a, n))
            seen[p] = max(seen.get(p, 0), a + n)
        assert faults == expected
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def scanned(sizes, target, most, flush):
    out, batch, held, n = [], 0, 0, 0
    for size in sizes:
        if n and held + size > target:
            batch, held, n = batch + 1, 0, 0
        out.append(batch)
        held, n = held + size, n + 1
        if n >= most or (flush and held == target) or held > target:
            batch, held, n = batch + 1, 0, 0
    return out


@pytest.mark.parametrize("kind", ["random", "equal", "empty", "zeros and full"])
def test_batches_do_not_depend_on_shards(spark, kind):
    rng = random.Random(8)
    n = 700
    sizes = {
        "random": [rng.choice([0, 1, 5, 30, 64, 65, 200]) for _ in range(n)],
        "equal": [25] * n,
        "empty": [0] * n,
        "zeros and full": [rng.choice([0, 64, 32]) for _ in range(n)],
    }[kind]
    df = spark.createDataFrame([(f"{i:05d}", s) for i, s in enumerate(sizes)], "path string, size long").repartition(5)
    for most, shard, flush in ((7, 7, True), (16, 33, False), (1000, 100, True)):
        got = [r["batch_id"] for r in R.pack_small_files(df, 64, most, flush, shard).orderBy("path").collect()]
        assert got == scanned(sizes, 64, most, flush), (most, shard, flush)
    assert R.pack_small_files(df.filter("false"), 64, 7).count() == 0


def test_ends_of_batches():
    sizes = np.array([10, 54, 0, 0, 70, 0, 1])
    assert R._batch_ends(sizes, 64, 9, True).tolist() == [2, 4, 4, 4, 5, 7, 7]
    assert R._batch_ends(sizes, 64, 9, False).tolist() == [4, 4, 4, 4, 5, 7, 7]
