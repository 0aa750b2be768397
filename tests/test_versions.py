"""Numbered versions, the digest cache's commits, totals that end and the range tracker's state."""

import glob
import hashlib
import os
import random
import shutil
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from grovekit.operators import events as E
from grovekit.operators import ranges as R
from grovekit.sources import versions as VS
from grovekit.streaming import jobs as ST

from tests.test_streaming import EVENTS, event, stream  # noqa: F401

sha = lambda x: hashlib.sha256(str(x).encode()).hexdigest()


def table(spark, n, word="a"):
    return spark.range(n).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit("file").alias("kind"), F.lit(word).alias("identity"), F.lit(1).cast("long").alias("size"), F.lit(sha(word)).alias("digest"))


def test_versions_follow_one_another(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        VS.read_version(spark, target)
    assert VS.publish_version(table(spark, 3), target) == "ok" and VS.current_version(spark, target) == 1
    reader = VS.read_version(spark, target)
    assert VS.publish_version(VS.read_version(spark, target).limit(2), target) == "ok"  # made from the table itself
    assert reader.count() == 3 and VS.read_version(spark, target).count() == 2
    assert VS.publish_version(table(spark, 9), target, base=1) == "changed"
    assert VS.read_version(spark, target).count() == 2 and not glob.glob(f"{tmp_path}/t/_stage*")
    assert VS.publish_version(table(spark, 0), target) == "ok" and VS.read_version(spark, target).count() == 0
    VS.drop_versions(spark, target, 1)
    assert sorted(os.listdir(tmp_path / "t")) == [VS._name("v", 3)]


def test_of_two_publishers_one_wins(spark, tmp_path):
    target, said = f"file://{tmp_path}/t", []
    VS.publish_version(table(spark, 1), target)
    for n in range(3):
        base = VS.current_version(spark, target)
        said.clear()
        both = [threading.Thread(target=lambda k=k: said.append((VS.publish_version(table(spark, 10 + k), target, base), k))) for k in range(3)]
        for t in both:
            t.start()
        for t in both:
            t.join()
        assert sorted(x for x, _ in said) == ["changed", "changed", "ok"]
        assert VS.current_version(spark, target) == base + 1 and VS.read_version(spark, target).count() == 10 + dict(said)["ok"]


def test_a_number_is_taken_once(spark, tmp_path):
    """Many renames to one number at the same time: one succeeds, and what the others staged is still whole."""
    target = f"file://{tmp_path}/t"
    spark.range(1).write.parquet(f"{target}/_stage-0")
    for k in range(1, 24):
        shutil.copytree(tmp_path / "t" / "_stage-0", tmp_path / "t" / f"_stage-{k}")
    for number in range(1, 7):
        start, won = threading.Barrier(4), []

        def take(k):
            start.wait()
            won.append(VS._take(spark, target, f"_stage-{k}", "v", number))

        both = [threading.Thread(target=take, args=(4 * (number - 1) + k,)) for k in range(4)]
        for t in both:
            t.start()
        for t in both:
            t.join()
        assert sorted(won) == [False, False, False, True]
        assert not glob.glob(f"{tmp_path}/t/v-*/_stage*") and len(glob.glob(f"{tmp_path}/t/_stage-*")) == 24 - number


def test_requests_are_held_against_what_came_between(spark, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/t"
    VS.publish_version(table(spark, 3), target)
    asked = spark.createDataFrame([(i, f"f{i}", "a", sha(f"p{i}"), f"p{i}") for i in range(3)], "req_id long, path string, expected_identity string, digest string, payload string")
    publish, between = VS.publish_version, []

    def interfering(df, to, base=None, retries=1):
        if not between:
            between.append(1)
            now = VS.read_version(spark, target)
            publish(now.withColumn("identity", F.when(F.col("path") == "f1", "b").otherwise(F.col("identity"))), to)
        return publish(df, to, base, retries)

    monkeypatch.setattr(VS, "publish_version", interfering)
    got = {r["path"]: (r["status"], r["current_identity"]) for r in VS.apply_requests(asked, target).collect()}
    assert got == {"f0": ("ok", None), "f1": ("changed", "b"), "f2": ("ok", None)}
    assert {r["path"]: r["digest"] for r in VS.read_version(spark, target).collect()} == {"f0": sha("p0"), "f1": sha("a"), "f2": sha("p2")}


def cached(spark, cache):
    return sorted(map(tuple, VS.read_cache(spark, cache).collect()))


def test_cache_commits_and_compaction(spark, tmp_path):
    cache = f"file://{tmp_path}/c"
    assert cached(spark, cache) == [] and VS.compact_cache(spark, cache) == 0
    rows = lambda a, b: spark.createDataFrame([(f"k{i}", sha(i)) for i in range(a, b)], VS.CACHE)
    assert [VS.commit_digests(rows(0, 5), cache), VS.commit_digests(rows(3, 8), cache)] == [1, 2]
    assert len(cached(spark, cache)) == 10  # two stand twice
    assert VS.compact_cache(spark, cache) == 8 and cached(spark, cache) == [(f"k{i}", sha(i)) for i in range(8)]
    assert os.listdir(tmp_path / "c") == [VS._name("base", 2)]
    assert VS.commit_digests(rows(8, 9), cache) == 3 and len(cached(spark, cache)) == 9
    assert VS.compact_cache(spark, cache) == 9 and VS.compact_cache(spark, cache) == 9
    VS.commit_digests(spark.createDataFrame([("bad", "short"), (None, sha(1)), ("none", None)], VS.CACHE), cache)
    assert len(cached(spark, cache)) == 9


def test_unreadable_commits_are_made_anew(spark, tmp_path):
    cache = f"file://{tmp_path}/c"
    entries = spark.createDataFrame([(f"p{i}", f"k{i % 30}", "x") for i in range(40)], "path string, fingerprint string, digest string")
    asked = []

    def digest(rows):
        asked.extend(r["fingerprint"] for r in rows.select("fingerprint").collect())
        return rows.select("fingerprint", F.sha2("fingerprint", 256).alias("digest"))

    def run():
        asked.clear()
        found = VS.digests_by_cache(entries, cache, digest, commit_rows=10).collect()
        assert {(r["path"], r["digest"]) for r in found} == {(f"p{i}", sha(f"k{i % 30}")) for i in range(40)}
        return sum(r["hit"] for r in found)

    assert run() == 0 and sorted(asked) == sorted(f"k{i}" for i in range(30)) and len(VS._numbers(spark, cache, "commit")) == 3
    assert run() == 40 and not asked
    one = glob.glob(f"{tmp_path}/c/{VS._name('commit', 2)}/*.parquet")
    lost = pd.concat([pd.read_parquet(f) for f in one])["fingerprint"].tolist()
    for f in one:  # cut short, and its check sum gone
        with open(f, "r+b") as x:
            x.truncate(os.path.getsize(f) // 2)
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    assert run() < 40 and sorted(asked) == sorted(lost)
    assert run() == 40
    # a commit in another schema counts as unreadable too
    spark.range(3).select((F.col("id") * 2).alias("digest"), F.col("id").alias("fingerprint")).write.parquet(f"{cache}/{VS._name('commit', 99)}")
    assert run() == 40 and VS.compact_cache(spark, cache) == 30 and run() == 40


def test_many_misses_take_few_commits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(VS, "MOST_COMMITS", 3, raising=False)
    cache, asked = f"file://{tmp_path}/c", []
    entries = spark.createDataFrame([(f"p{i}", f"k{i % 40}") for i in range(50)], "path string, fingerprint string")

    def digest(rows):
        asked.append(sorted(r["fingerprint"] for r in rows.select("fingerprint").collect()))
        return rows.select("fingerprint", F.sha2("fingerprint", 256).alias("digest"))

    found = VS.digests_by_cache(entries, cache, digest, commit_rows=1).collect()
    assert {(r["path"], r["digest"], r["hit"]) for r in found} == {(f"p{i}", sha(f"k{i % 40}"), False) for i in range(50)}
    assert len(asked) == len(VS._numbers(spark, cache, "commit")) == 3 and sorted(sum(asked, [])) == sorted(f"k{i}" for i in range(40))


def test_a_commit_works_its_rows_out_once(spark, tmp_path):
    """Rows that come out anew each time they are worked out are committed all the same."""
    cache = f"file://{tmp_path}/c"
    anew = F.udf(lambda _: sha(os.urandom(8).hex())).asNondeterministic()
    assert VS.commit_digests(spark.range(20).select(F.concat(F.lit("k"), "id").alias("fingerprint"), anew("id").alias("digest")), cache) == 1
    assert len(cached(spark, cache)) == 20


def test_totals_end_at_done(spark, stream):  # noqa: F811
    rows = [event(1, "transferred", 5), event(1, "failed", 6), event(1, "done", 7), event(1, "transferred", 8), event(2, "progress", 9), event(3, "other", 40_000), event(3, "finished", 40_001)]
    batch = {tuple(r) for r in E.totals_until_done(spark.createDataFrame(rows, EVENTS)).collect()}
    assert batch == {(1, 1, 1, 0, 3, "done"), (2, 0, 0, 1, 1, "open"), (3, 0, 0, 0, 2, "done")}
    got = {tuple(r) for r in stream(rows, EVENTS, lambda e: ST.final_totals_stream(e, "1 minute", idle_ms=3_600_000, keep_ms=1000))}
    assert got == {(1, 1, 1, 0, 3, "done"), (2, 0, 0, 1, 1, "idle"), (3, 0, 0, 0, 2, "done")}


def test_equal_rows_at_the_end_count_once(spark):
    rows = [event(1, "done", 7), event(1, "done", 7), event(1, "progress", 7)]
    assert [tuple(r) for r in E.totals_until_done(spark.createDataFrame(rows, EVENTS)).collect()] == [(1, 0, 0, 0, 1, "done")]


class Held:
    """State as the tracker's processor sees it, which counts what is written."""

    def __init__(self):
        self.value, self.map, self.written = None, {}, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        held = self

        class Map:
            exists = lambda _: bool(held.map)
            clear = lambda _: held.map.clear()
            containsKey = lambda _, k: k in held.map
            getValue = lambda _, k: held.map[k]

            def updateValue(_, k, v):
                held.map[k] = v
                held.written += len(v[0])

        return Map()

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def tracked(rows, batches):
    held, out = Held(), []
    job = ST.RangeTracker()
    job.init(held)
    step, most = -(-len(rows) // batches), 0
    for k in range(0, len(rows), step):
        part = pd.DataFrame(rows[k : k + step], columns=["path", "size", "fingerprint", "offset", "length"])
        for frame in job.handleInputRows(("f",), iter([part]), None):
            out += list(frame.itertuples(index=False, name=None))
        most = max(most, sum(len(v[0]) for v in held.map.values()))
    return out, held, most


def test_state_of_the_tracker_stays_flat():
    """10^5 ranges, in order and in any order: the state holds gaps, and what a range writes doesn't grow."""
    n, step = 100_000, 1 << 14
    size = n * step
    rows = [("f", size, "x", k * step, step) for k in range(n)]
    out, held, most = tracked(rows, 50)
    assert all(r[3] for r in out) and out[-1][4] and not held.map and most <= size // ST.SLOT_BYTES + 1
    assert held.written <= 2 * n
    random.Random(1).shuffle(rows)
    out, held, most = tracked(rows, 50)
    assert all(r[3] for r in out) and [r[4] for r in out].count(True) == 1 and not held.map
    again, _, _ = tracked([*rows, rows[0], ("f", size, "x", 5, 0), ("f", size, "y", 0, 7)], 3)
    assert [r[3:] for r in again[-3:]] == [(False, True), (True, True), (True, False)]


def test_tracker_as_in_batch(spark, stream, monkeypatch):  # noqa: F811
    rng = random.Random(11)
    rows = [(f"p{k % 3}", 5000, k, rng.randint(0, 5000), rng.choice([0, 1, 40, 300, 900])) for k in range(400)] + [("whole", 10, 0, 0, 10), ("whole", 10, 1, 3, 1), ("empty", 0, 0, 0, 0)]
    held, want = {}, []
    for p, size, seq, a, n in sorted(rows, key=lambda r: (r[0], r[2])):
        mine = held.setdefault(p, [])
        ok = a + n <= size and (not n or all(y <= a or a + n <= x for x, y in mine))
        if ok and n:
            mine.append((a, a + n))
        want.append((p, seq, a, n, ok, sum(y - x for x, y in mine) >= size))
    df = spark.createDataFrame(rows, "path string, size long, seq long, offset long, length long").repartition(5)
    assert sorted(map(tuple, R.track_ranges(df).collect())) == sorted(want)
    monkeypatch.setattr(ST, "SLOT_BYTES", 128)
    for p in ("p0", "p1", "p2", "whole", "empty"):
        mine = [(p, s, "x", a, n) for q, s, _, a, n in sorted(rows, key=lambda r: r[2]) if q == p]
        assert [r[1:] for r in tracked(mine, 7)[0]] == [r[2:] for r in want if r[0] == p]
    schema = "path string, size long, fingerprint string, offset long, length long"
    some = [("f", 9, "x", 0, 5), ("g", 4, "x", 0, 4)]
    assert sorted(map(tuple, stream(some, schema, ST.range_tracker))) == [("f", 0, 5, True, False), ("g", 0, 4, True, True)]
