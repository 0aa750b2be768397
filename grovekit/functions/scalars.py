"""Scalar functions of sizes, times, kinds and measures."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KIB, MIB = 1 << 10, 1 << 20
BILLION = 1_000_000_000
# Codes of the kinds.
KINDS = {"file": 1, "directory": 2, "symlink": 3, "other": 4}


def size_bucket(size: Column, small_below: int = MIB, whole_up_to: int = 32 * MIB) -> Column:
    return F.when(size < small_below, "small").when(size <= whole_up_to, "whole").otherwise("chunked")


def remote_size_bucket(size: Column, small_up_to: int = 8 * MIB) -> Column:
    return F.when(size <= small_up_to, "small").otherwise("chunked")


def nanoseconds_part(ns: Column) -> Column:
    return F.pmod(ns, F.lit(BILLION).cast("long"))


def whole_seconds(ns: Column) -> Column:
    """Towards minus infinity, so times before 1970 have seconds of their own."""
    return ((ns - nanoseconds_part(ns)) / BILLION).cast("long")


def from_seconds(seconds: Column, nanos: Column) -> Column:
    return seconds * F.lit(BILLION).cast("long") + nanos


def human_bytes(n: Column) -> Column:
    """B as it is; KiB to TiB with one decimal, ties to the even digit."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(n / float(1024**power), 1))).otherwise(out)
    return out


def format_rate(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.concat(human_bytes(F.floor(n / seconds)), F.lit("/s"))).otherwise("-")


def amplification(apparent: Column, allocated: Column) -> Column:
    return F.when(allocated == 0, F.lit(float("inf"))).otherwise(apparent / allocated)


def wasted_bytes(apparent: Column, allocated: Column) -> Column:
    return F.greatest(apparent - allocated, F.lit(0).cast("long"))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def share(part: Column, whole: Column) -> Column:
    return ratio(part, whole)


def noise_ratio(mad: Column, median: Column) -> Column:
    return ratio(mad, median, 1.0)


def speedup(baseline: Column, candidate: Column) -> Column:
    return F.when(candidate > 0, baseline / candidate)


def throughput(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / seconds)


def sample_size(n: Column) -> Column:
    """Bytes of a content that are sampled before it is compressed."""
    return F.when(n <= 64 * KIB, n).when(n <= 256 * KIB, F.lit(256 * KIB)).otherwise(F.lit(MIB)).cast("long")


def kind_code(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, code in KINDS.items():
        out = F.when(kind == name, code).otherwise(out)
    return out


def kind_name(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, c in KINDS.items():
        out = F.when(code == c, name).otherwise(out)
    return out


def fingerprint_key(*columns: Column) -> Column:
    """A digest of what a file is known by; nulls count as 0."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("0")) for c in columns]), 256)


def mode_drift(src_kind: Column, src_mode: Column, dst_mode: Column) -> Column:
    """Only where both ends have modes, and only of files and directories."""
    return F.coalesce(src_kind.isin("file", "directory") & (src_mode != dst_mode), F.lit(False))


def sparse_candidate(kind: Column, size: Column, allocated: Column) -> Column:
    return (kind == "file") & (size >= MIB) & (allocated < 0.5 * size)


def sample_position(key: Column, seed: str) -> Column:
    """A number in [0, 1) by a keyed hash: 52 bits, which a double holds exactly."""
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 13)
    return F.conv(digest, 16, 10).cast("long") / F.lit(float(1 << 52))


def sample_select(key: Column, seed: str, fraction: float) -> Column:
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")
    return sample_position(key, seed) < fraction


def mix64(x: Column | str) -> Column:
    """A 64-bit finaliser of a counter generator, unsigned."""
    signed = _mix64_bits(x)
    return (signed.cast("decimal(20,0)") + F.when(signed < 0, F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))).cast("decimal(20,0)")


@F.pandas_udf(T.LongType())
def _mix64_bits(x: pd.Series) -> pd.Series:
    with np.errstate(over="ignore"):
        z = x.to_numpy(np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return pd.Series(z.view(np.int64))


#: Codecs that a sample can be tried with, by name and level.
CODECS = ("zstd-3", "zlib-1")


def compressed_size(sample: Column, codec: str = "zstd-3") -> Column:
    """Bytes of a sample under a codec of CODECS. An executor that lacks it fails: another would give other sizes."""
    if codec not in CODECS:
        raise ValueError(f"no such codec: {codec}")

    @F.pandas_udf(T.LongType())
    def packed(part: pd.Series) -> pd.Series:
        if codec == "zlib-1":
            return part.map(lambda b: None if b is None else len(zlib.compress(bytes(b), 1)))
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        return part.map(lambda b: None if b is None else len(pack(bytes(b))))

    return packed(sample)


def should_compress(compressed: Column, sampled: Column) -> Column:
    """Worth it if under 95 of 100 bytes are left; an empty sample isn't."""
    return (sampled > 0) & (compressed * 100 < sampled * 95)


def action_sign(action: Column) -> Column:
    return F.when(action == "include", "+").otherwise("-")
