"""Scans in rounds, pruning, contents in chunks, and long lists of rules."""

import hashlib
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from grovekit.functions.globs import Rule, glob_to_regex
from grovekit.functions.rulesets import Matcher, RuleSet
from grovekit.operators import filtering as FL
from grovekit.operators import verifying as VF
from grovekit.sources import tree as TS

ATOMS = ["a", "b", "c", "/", "*", "**", "?", "**/", "/**/", "/**", "[ab]", "[!a]", "[^b]", "[a-c]", "{a,b}", "{a*,/b,}", "\\*", ".", "{a,{b,c}d}", "}", ",", "é", "["]


def test_automata_match_as_expressions_do():
    rng = random.Random(1)
    for _ in range(3000):
        patterns = ["".join(rng.choice(ATOMS) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4))]
        try:
            expressions = [re.compile(glob_to_regex(p).replace("\\z", "\\Z")) for p in patterns]
        except re.error:
            continue
        m = Matcher(patterns, [True] * len(patterns))
        for _ in range(6):
            text = "".join(rng.choice("abc/.*é[},") for _ in range(rng.randint(0, 8)))
            want = next((i for i, e in enumerate(expressions) if e.match(text)), None)
            assert m.first(text) == want, (patterns, text)
            at = text.find("/")
            if want is not None and 0 <= at < len(text) - 1:
                assert m.open_below(text[:at]), (patterns, text)


def test_automata_forget_and_multiply(monkeypatch):
    from grovekit.functions import rulesets

    monkeypatch.setattr(rulesets, "KEPT_BYTES", 3000)
    patterns = ["{a,b,c}{a,b,c}{a,b,c}{a,b,c}x", "**/*.e1", "**/n*7", "d?/**/e"]  # 81 ways, matched by its expression
    m = Matcher(patterns, [False, True, False, False])
    assert m.slow and not m.slow_wanted
    expressions = [re.compile(glob_to_regex(p).replace("\\z", "\\Z")) for p in patterns]
    rng = random.Random(2)
    for _ in range(2000):
        text = rng.choice(["abcax", "bbbbx", "x/y.e1", "d1/q/e", f"k/n{rng.randint(0, 99)}", f"{rng.random()}"])
        assert m.first(text) == next((i for i, e in enumerate(expressions) if e.match(text)), None)
    with pytest.raises(ValueError):
        Matcher(["a{b,c"])


def rules_of(rng, n):
    return [
        Rule(rng.randint(0, 1), k, rng.choice(["include", "exclude"]), "".join(rng.choice(["a", "b", "*", "/", "**/", "?", "/**"]) for _ in range(rng.randint(1, 4))), rng.choice(["", "", "a", "a/b", "b"]), f"o{k}")
        for k in range(n)
    ]


def test_decisions_of_long_lists(spark, monkeypatch):
    rng = random.Random(5)
    paths = sorted({"/".join(rng.choice(["a", "b", "ab", "ba"]) for _ in range(rng.randint(1, 5))) for _ in range(300)})
    df = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, n int")
    for n in (3, 12, 20):
        rules = rules_of(rng, n)
        want = sorted(map(tuple, FL.filter_decide(df, rules).select("path", "n", "included", "pattern", "origin", "via").collect()))
        got = sorted(map(tuple, FL.decide_by_automaton(df, rules).select("path", "n", "included", "pattern", "origin", "via").collect()))
        assert got == want
        ignore = [r for r in rules if r.tier]
        if ignore:  # the same from a table, in one partition a scope and in several
            tiers = [Rule(1, r.ord, r.action, r.pattern, r.scope) for r in ignore]
            want = {r["path"]: r["included"] for r in FL.filter_decide(df, tiers).collect()}
            table = spark.createDataFrame([(r.scope, r.ord, r.action, r.pattern) for r in tiers], "scope string, ord int, action string, pattern string")
            for rows in (7, 10**6):
                assert {r["path"]: r["included"] for r in FL.ignore_scope_join(df, table, rows).collect()} == want
    again = FL.filter_decide(df, [*rules_of(rng, 40)])
    assert "MapInArrow" in again._jdf.queryExecution().toString()


def test_descent_never_misses(spark):
    rng = random.Random(9)
    for _ in range(150):
        rules = rules_of(rng, rng.randint(1, 6))
        rules = [Rule(r.tier, r.ord, r.action, r.pattern, r.scope) for r in rules]
        found = RuleSet(rules)
        for _ in range(40):
            path = "/".join(rng.choice(["a", "b", "ab"]) for _ in range(rng.randint(2, 5)))
            if found.included(path):
                parts = path.split("/")
                assert all(found.descend("/".join(parts[:k])) for k in range(1, len(parts))), (rules, path)


def test_stars_reach_further_down(spark):
    rules = [Rule(0, 1, "include", "a*c/d.txt"), Rule(0, 2, "exclude", "**")]
    df = spark.createDataFrame([(p,) for p in ("ab", "ab/xc", "ab/xd", "b", "", "abc")], "path string")
    got = {r["path"]: r["descend"] for r in FL.descend_set(df, rules).collect()}
    assert got == {"ab": True, "ab/xc": True, "ab/xd": True, "b": False, "": True, "abc": True}
    assert FL.descend_set(df, []).filter("descend").count() == 6


def test_time_hardly_depends_on_the_number_of_rules():
    """Of fifty times as many rules: far less than fifty times as long."""
    rng = random.Random(3)
    paths = [f"d{rng.randint(0, 40)}/s{i % 200:x}/f{i % 1000:x}.e{rng.randint(0, 900):x}" for i in range(20_000)]
    took = []
    for n in (100, 5000):
        decide = RuleSet([Rule(0, i, "exclude", f"**/*.e{i:x}" if i % 3 else f"d{i % 97}/**/n{i}*x?") for i in range(n)]).decide
        for p in paths[:5000]:
            decide(p)
        began = time.process_time()
        for p in paths:
            decide(p)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(4)
    for i in range(5):
        for j in range(4):
            d = tmp_path / f"d{i}" / f"e{j}"
            d.mkdir(parents=True)
            for k in range(rng.randint(0, 30)):
                (d / f"f{k}.txt").write_bytes(b"x" * rng.randint(0, 3000))
    (tmp_path / "flat").mkdir()
    for k in range(400):
        (tmp_path / "flat" / f"n{k}").write_text("y")
    os.symlink("d0", tmp_path / "link")
    (tmp_path / "one").write_text("z")
    return tmp_path


def walked(root):
    return sorted(os.path.relpath(os.path.join(at, x), root) for at, dirs, files in os.walk(root) for x in (*dirs, *files))


@pytest.mark.parametrize("most", [1, 7, 10**6])
def test_scan_in_rounds(spark, folder, most):
    found = TS.scan_tree(spark, str(folder), most=most).collect()
    assert sorted(r["path_str"] for r in found) == walked(folder)
    by = {r["path_str"]: r for r in found}
    assert by["link"]["kind"] == "symlink" and by["link"]["symlink_target"] == b"d0" and by["one"]["size"] == 1 and by["d0/e1"]["kind"] == "directory"
    spark.dataSource.register(TS.TreeDataSource)
    source = spark.read.format("tree").load(str(folder))
    assert sorted(r["path_str"] for r in source.select("path_str").collect()) == walked(folder)


def test_scan_reports_errors(spark, tmp_path):
    assert TS.scan_tree(spark, str(tmp_path)).count() == 0
    gone = TS.scan_tree(spark, str(tmp_path / "nowhere"), mode="PERMISSIVE").collect()
    assert [r["error"].split(":")[0] for r in gone] == ["FileNotFoundError"]
    with pytest.raises(Exception, match="FileNotFoundError"):
        TS.scan_tree(spark, str(tmp_path / "nowhere")).collect()


def test_pruned_directories_are_never_listed(folder, monkeypatch):
    listed = []
    scandir = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: listed.append(os.path.relpath(os.fsdecode(p), folder)) or scandir(p))
    rules = [Rule(0, 1, "include", "d1/e2/**"), Rule(0, 2, "exclude", "d?"), Rule(0, 3, "exclude", "flat")]
    enter = TS.Entering([b"d1/e2/no"], rules)
    rows = list(TS.walk(os.fsencode(folder), b"", enter))
    assert sorted(listed) == [".", "d1", "d1/e2"] and {r[1] for r in rows} >= {"d0", "flat", "d1/e0", "d1/e2"}
    listed.clear()
    names = [r for b in TS._frontier(os.fsencode(folder), enter, 3)([__import__("pyarrow").RecordBatch.from_pydict({"path": [b""]})]) for r in b.to_pylist()]
    assert listed == ["."] and [r["path"] for r in names if r["state"] == "open"] == [b"d1"]
    # filters on the path, pushed into the data source
    reader = TS._PushedReader({"path": str(folder)})
    starts = TS.StringStartsWith(("path_str",), "d3/e1")
    assert list(reader.pushFilters([starts])) == [starts]
    listed.clear()
    found = [r[1] for p in reader.partitions() for r in reader.read(p)]
    assert {x for x in found if x.startswith("d3/e1/")} == {f"d3/e1/{x}" for x in os.listdir(folder / "d3" / "e1")}
    assert set(listed) == {".", "d3", "d3/e1"}


def test_filters_reach_the_source(spark, folder):
    spark.dataSource.register(TS.TreeDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("tree").option("pushdown", "true").load(str(folder)).filter("path_str like 'd2/%'")
        assert sorted(r["path_str"] for r in df.select("path_str").collect()) == [p for p in walked(folder) if p.startswith("d2/")]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    rules = [Rule(0, 1, "exclude", "d?"), Rule(0, 2, "exclude", "flat")]
    df = spark.read.format("tree").option("rules", TS.rules_option(rules)).load(str(folder))
    assert sorted(r["path_str"] for r in df.select("path_str").collect()) == sorted(x for x in os.listdir(folder))


def test_large_directories_are_not_held_in_planning(folder, monkeypatch):
    monkeypatch.setattr(TS, "LOOK", 50)
    reader = TS._Reader({"path": str(folder)})
    parts = reader.partitions()
    assert [b"flat"] in [p.paths for p in parts if p.below]
    rows = [r[1] for p in parts for r in reader.read(p)]
    assert sorted(rows) == walked(folder)


def test_extended_attributes(spark, tmp_path):
    (tmp_path / "with").write_text("a")
    (tmp_path / "without").write_text("a")
    try:
        os.setxattr(tmp_path / "with", "user.note", b"1")
    except OSError:
        pytest.skip("no extended attributes here")
    got = {r["path_str"]: r["has_xattrs"] for r in TS.scan_tree(spark, str(tmp_path)).collect()}
    assert got == {"with": True, "without": False}


def test_chunks_hash_as_whole_contents(spark, folder):
    files = TS.scan_tree(spark, str(folder)).filter("kind = 'file'").select("path", "size")
    got = {os.fsdecode(bytes(r["path"])): (r["size"], r["digest"], r["fault"]) for r in TS.digest_tree(files, str(folder), 100).collect()}
    want = {p: (folder / p).read_bytes() for p in walked(folder) if (folder / p).is_file() and not (folder / p).is_symlink()}
    assert got == {p: (len(b), hashlib.sha256(b).hexdigest(), None) for p, b in want.items()}


def test_faults_of_chunks(spark):
    rows = [("ok", 3, b"de"), ("ok", 0, b"abc"), ("gap", 0, b"a"), ("gap", 2, b"b"), ("twice", 0, b"ab"), ("twice", 0, b"ab"), ("late", 1, b"x"), ("short", 0, b"a"), ("empty", 0, b""), ("null", 0, None)]
    chunks = spark.createDataFrame(rows, "path string, offset long, content binary").repartition(3)
    files = spark.createDataFrame([("ok", 5), ("gap", 3), ("twice", 2), ("late", 2), ("short", 2), ("empty", 0), ("null", 1), ("none", 0)], "path string, size long")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = {r["path"].decode(): (r["digest"], r["fault"]) for r in VF.chunk_digests(chunks, files).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {
        "ok": (sha(b"abcde"), None), "gap": (None, "gap"), "twice": (None, "overlap"), "late": (None, "gap"), "short": (None, "size"), "empty": (sha(b""), None), "null": (None, "missing"), "none": (None, "missing"),
    }
    assert {r["path"].decode() for r in VF.chunk_digests(chunks).filter("fault is null").collect()} == {"ok", "short", "empty"}
    assert VF.chunk_digests(chunks.filter("false")).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_contents_over_the_limit_of_a_cell(spark, tmp_path):
    """A sparse file of 2.2 GB with a few bytes written; no row holds more than a chunk."""
    size = 2_200_000_000
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)
        for at in (0, 2**31 - 3, size - 5):
            f.seek(at)
            f.write(b"bytes")
    h = hashlib.sha256()
    with open(tmp_path / "large", "rb") as f:
        while block := f.read(1 << 22):
            h.update(block)
    files = TS.scan_tree(spark, str(tmp_path)).select("path", "size")
    got = TS.digest_tree(files, str(tmp_path)).first()
    assert (got["size"], got["digest"], got["fault"]) == (size, h.hexdigest(), None)
    chunks = TS.content_chunks(files, str(tmp_path))
    assert chunks.agg(F.max(F.octet_length("content"))).first()[0] == TS.CHUNK_BYTES
