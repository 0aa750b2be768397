"""Exact order statistics of a whole-number column, by rounds of histograms: no task gathers values."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.staging import staged

#: Buckets into which a round divides each range that is still open.
BUCKETS = 4096
#: Values of a power of two that the first round tells apart, as a power of two.
FINE = 6


class Statistic(NamedTuple):
    """A value at a rank (from 0), how many rows are less, and how many equal it."""

    value: int
    below: int
    equal: int


def _logarithmic(v: Column) -> Column:
    """Buckets in order of the values, finer for small ones: small values by themselves, others by their leading bits."""
    u = F.when(v < 0, -(v + 1)).otherwise(v)
    small = 1 << FINE
    e = F.floor(F.log2(F.greatest(u, F.lit(small)).cast("double"))).cast("int") - FINE
    b = F.when(u < small, u).otherwise(small + e.cast("long") * small + F.call_function("shiftright", u, e) - small)
    return F.when(v < 0, -1 - b).otherwise(b)


def _round(values: DataFrame, bucket: Column) -> list:
    """(bucket, rows, least, greatest) in order: at most as many rows as there are buckets."""
    found = values.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).filter("b is not null")
    return sorted(found.collect(), key=lambda r: r["b"])


def order_statistics(df: DataFrame, column: Column, ranks: Sequence[int], kept: bool = False) -> list[Statistic]:
    """The values of `column` (long; nulls don't count) at the ranks, counted from 0 in rising order; none for ranks beyond
    the rows. The first pass tells values apart by their leading bits, each further one divides what is open by BUCKETS:
    two passes for numbers up to 2^18, three up to 2^30, seven at most. Only counts by bucket are exchanged. The column is written by itself
    first, so that the rest of df is worked out once, unless `kept` says that df is such a table."""
    values = df.select(column.cast("long").alias("v")).filter("v is not null")
    if not kept:
        values = staged(values, "selected-values")
    wanted, done = sorted(set(r for r in ranks if r >= 0)), {}
    if not wanted:
        return []
    found, below = _round(values, _logarithmic(F.col("v"))), 0
    open_: list[tuple[int, int, int, int]] = []  # least, greatest, rows below, rows
    for r in found:
        if any(below <= k < below + r["n"] for k in wanted):
            open_.append((r["least"], r["most"], below, r["n"]))
        below += r["n"]
    while open_:
        still = []
        for least, most, under, n in open_:
            if least == most:
                done |= {k: Statistic(least, under, n) for k in wanted if under <= k < under + n}
            else:
                still.append((least, most, under, n))
        if not still:
            break
        bucket = F.lit(None).cast("long")
        for i, (least, most, _, _) in enumerate(still):
            width = -(-(most - least + 1) // BUCKETS)
            # a bucket of the first round holds values of one sign, so the difference fits a long
            bucket = F.when(F.col("v").between(least, most), F.expr(f"(v - {least}) div {width}") + i * BUCKETS).otherwise(bucket)
        found, open_ = _round(values, bucket), []
        for i, (_, _, under, _) in enumerate(still):
            at = under
            for r in found:
                if r["b"] // BUCKETS == i:
                    if any(at <= k < at + r["n"] for k in wanted):
                        open_.append((r["least"], r["most"], at, r["n"]))
                    at += r["n"]
    return [done[k] for k in ranks if k in done]


def exact_quantiles(df: DataFrame, column: Column, shares: Sequence[float]) -> list[float | None]:
    """What percentile() gives for each share, between two neighbours in proportion; None without values."""
    values = staged(df.select(column.cast("long").alias("v")).filter("v is not null"), "quantile-values")
    n = values.count()
    if not n:
        return [None] * len(shares)
    places = [q * (n - 1) for q in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    at = dict(zip(ranks, (x.value for x in order_statistics(values, F.col("v"), ranks, kept=True))))
    out = []
    for p in places:
        a, b = math.floor(p), math.ceil(p)
        out.append(float(at[a]) if a == b or at[a] == at[b] else (b - p) * at[a] + (p - a) * at[b])
    return out


def least_by(df: DataFrame, key: Column, k: int, *ties: Column) -> DataFrame:
    """The k rows of df with the least keys (long); among rows that share the last key, by `ties`.

    The k-th key comes from order_statistics(), and rows pass by one comparison. Only where the rows that share the last
    key are more than are wanted are those numbered, by range."""
    if k <= 0:
        return df.limit(0)
    keyed = df.withColumn("_key", key.cast("long"))
    found = order_statistics(keyed, F.col("_key"), [k - 1])
    if not found:
        return df
    last = found[0]
    wanted = k - last.below
    if wanted >= last.equal:
        return keyed.filter(F.col("_key") <= last.value).drop("_key")
    from grovekit.operators.planning import numbered

    tied = numbered(keyed.filter(F.col("_key") == last.value), *ties, name="_place").filter(F.col("_place") <= wanted).drop("_place")
    return keyed.filter(F.col("_key") < last.value).unionByName(tied).drop("_key")
