from pyspark.sql import functions as F

from grovekit.functions import paths as P
from grovekit.functions import scalars as S
from grovekit.functions.globs import glob_to_regex


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_path_validate(spark):
    got = column(spark, ["", "a/b", "/a", "a//b", "a/./b", "..", "a/..b", "a\0b", "a/", None], P.path_validate)
    assert got == ["ok", "ok", "unsafe", "unsafe", "unsafe", "unsafe", "ok", "nul", "unsafe", "ok"]


def test_prefix_goes_by_components(spark):
    assert column(spark, ["a", "a/b", "ab", "x"], lambda c: P.path_starts_with(c, F.lit("a"))) == [True, True, False, False]
    assert column(spark, ["a", "a/b", "ab"], lambda c: P.strip_prefix(c, F.lit("a"))) == ["", "b", None]


def test_ancestors_nearest_first(spark):
    assert column(spark, ["a/b/c", "a"], P.path_ancestors) == [["a/b", "a"], []]


def test_collision_key_composes_before_lowering(spark):
    assert column(spark, ["CAFÉ", "café"], P.collision_key) == ["café", "café"]


def test_seconds_before_1970(spark):
    assert column(spark, [-1, 0, 1_999_999_999, -1_000_000_001], S.whole_seconds, "long") == [-1, 0, 1, -2]


def test_buckets_and_samples(spark):
    m = 1 << 20
    assert column(spark, [m - 1, m, 32 * m, 32 * m + 1], S.size_bucket, "long") == ["small", "whole", "whole", "chunked"]
    assert column(spark, [1, 65536, 65537, 262145], S.sample_size, "long") == [1, 65536, 262144, m]
    assert column(spark, [1023, 1024, 1536, 1 << 30], S.human_bytes, "long") == ["1023 B", "1.0 KiB", "1.5 KiB", "1.0 GiB"]


def test_mix64_is_unsigned_and_known(spark):
    assert column(spark, [0], S.mix64, "long") == [16294208416658607535]


def test_globs():
    import re

    def match(p, s):
        return bool(re.match(glob_to_regex(p).replace(r"\z", r"\Z"), s))

    assert match("*.md", "docs/api/ref.md") and match("**/x", "x") and match("**/x", "a/b/x")
    assert match("x/**", "x/y") and not match("x/**", "x")
    assert match("a/**/b", "a/b") and match("a/**/b", "a/c/d/b") and match("{a,b}.[ch]", "b.h") and not match("[!a]", "a")
    assert match("*", "a\nb") and match("a?b", "a\nb") and not match("a", "a\n") and not match("b", "a\nb")
