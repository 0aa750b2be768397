"""A uniform shuffle into shards by a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn first, exactly as a uniform permutation of all rows
would have it: a multivariate hypergeometric draw per partition from what the shards still lack. The draw is made in
two steps, for groups of partitions in the driver and for the partitions of each group in a task; by the law's own
composition that is the same draw. Rows are then permuted inside their partition, dealt by those counts, exchanged, and
permuted again inside their shard. Shard sizes are exact. The driver holds one number per group and shard, never a row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grovekit.llm.common import documents, others, staged

SHARDS = 40
#: Rows that one task orders at the second permutation, about.
BLOCK_ROWS = 200_000
#: Populations that numpy draws from; beyond it draw() takes its own sampler of the same law.
NUMPY_MOST = 1_000_000_000


def _log_factorials(a: int, b: int) -> float:
    """log(a! / b!), to about 1e-8 also where both are large and near each other."""
    if min(a, b) < 1000:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    d = a - b
    # Stirling's series; the terms that cancel are taken together
    return (b + 0.5) * math.log1p(d / b) - d + d * math.log(a) + (1 / a - 1 / b) / 12 - (1 / a**3 - 1 / b**3) / 360


def draw(rng: np.random.Generator, good: int, bad: int, n: int, most: int = NUMPY_MOST) -> int:
    """How many of n rows, drawn without return from good + bad, are good: hypergeometric at every size.

    Large populations: by the ratio of uniforms (Stadlober 1990), with probabilities relative to the mode's."""
    total = good + bad
    if total < most or n <= 0 or n >= total or not good or not bad:
        if n <= 0 or not good:
            return 0
        return min(n, good) if n >= total or not bad else int(rng.hypergeometric(good, bad, n))
    # the smaller of both kinds among the smaller of what is drawn and what is left
    few, m = min(good, bad), min(n, total - n)
    share = few / total
    middle = m * share + 0.5
    spread = math.sqrt((total - m) * m * share * (1 - share) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = (m + 1) * (few + 1) // (total + 2)
    rest = total - few - m
    upper = min(min(m, few) + 1, int(middle + 16 * spread))
    while True:
        x, y = rng.random(), rng.random()
        w = middle + width * (y - 0.5) / x if x else -1.0
        if not 0 <= w < upper:
            continue
        z = int(w)
        if rest + z < 0:
            continue
        t = -sum(_log_factorials(a, b) for a, b in ((z, mode), (few - z, few - mode), (m - z, m - mode), (rest + z, rest + mode)))
        if 2 * math.log(x) <= t:
            break
    if good > bad:
        z = m - z
    return z if m == n else good - z


def communication_matrix(rows: list[int], shards: list[int], seed: int, most: int = NUMPY_MOST) -> np.ndarray:
    """Rows from each partition to each shard, drawn from the hypergeometric law; row and column sums are those given."""
    if sum(rows) != sum(shards):
        raise ValueError("partitions and shards must hold the same number of rows")
    rng, left = np.random.default_rng(seed), [int(x) for x in shards]
    out = np.zeros((len(rows), len(shards)), np.int64)
    for i, n in enumerate(rows):
        total = sum(left)
        if total < most:
            out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:
            wanted, others = int(n), total
            for j, x in enumerate(left):
                others -= x
                out[i, j] = draw(rng, x, others, wanted, most)
                wanted -= int(out[i, j])
        left = [x - int(y) for x, y in zip(left, out[i])]
    return out


def _deal(seed: int):
    """The rows of a group's partitions to each shard, summed up along the shards."""

    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        matrix = communication_matrix(parts["n"].tolist(), list(parts["sizes"].iloc[0]), seed + 2 + 7919 * (1 + int(key[0])))
        return pd.DataFrame({"part": parts["part"].to_numpy(), "upto": list(np.cumsum(matrix, axis=1))})

    return run


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with the columns shard (0 to shards - 1) and slot (0, 1, ... in each shard); counts differ by one at most.

    Every row, repeated or not, has a place of its own; values, nulls and very long texts included, play no part in it.
    An empty table gives an empty table. The same input files and seed give the same shards. Columns of df named shard
    or slot are replaced; all others, whatever their names, are kept."""
    spark = df.sparkSession
    names = others(df, ("shard", "slot"))
    # the number of a row is fixed by a written table, so a lost executor can't change it between the jobs below
    keyed = staged(df.select(F.struct(*names).alias("row"), F.monotonically_increasing_id().alias("rid")), "shard-rows").withColumn("part", F.shiftright("rid", 33))
    counts = staged(keyed.groupBy("part").agg(F.count("*").alias("n")), "shard-counts")
    parts, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    groups = math.isqrt(parts) + 1
    grouped = counts.withColumn("g", F.pmod(F.col("part"), F.lit(groups)))
    found = sorted((r["g"], r["n"]) for r in grouped.groupBy("g").agg(F.sum("n").alias("n")).collect())
    matrix = communication_matrix([n for _, n in found], sizes, seed)
    dealt = spark.createDataFrame([(int(g), row.tolist()) for (g, _), row in zip(found, matrix)], "g long, sizes array<long>")
    # as many rows as input partitions
    bounds = grouped.join(dealt, "g").groupBy("g").applyInPandas(_deal(seed), "part long, upto array<long>")
    bounds = staged(bounds, "shard-bounds")
    # which shards get the odd rows is random too
    numbers = F.array(*[F.lit(int(x)) for x in np.random.default_rng(seed + 1).permutation(shards)])
    first = F.row_number().over(W.partitionBy("part").orderBy(F.xxhash64("rid", F.lit(seed)), "rid")) - 1
    dealt = keyed.withColumn("rank", first).join(bounds, "part")
    column = F.size(F.filter("upto", lambda b: b <= F.col("rank")))
    # the second permutation: by a random key, its leading part (the block) and then the rest of it
    blocks = max(1, -(-total // (shards * block_rows)))
    key = F.xxhash64("rid", F.lit(seed + 2))
    dealt = dealt.select("row", "rid", F.element_at(numbers, (column + 1).cast("int")).alias("shard"), key.alias("key"), F.pmod(key, F.lit(blocks)).alias("block"))
    inside = F.row_number().over(W.partitionBy("shard", "block").orderBy("key", "rid")) - 1
    if blocks == 1:
        placed = dealt.withColumn("slot", inside.cast("long"))
    else:
        dealt = staged(dealt, "shard-dealt")
        sums = dealt.groupBy("shard", "block").count()
        before = F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        placed = dealt.withColumn("in", inside).join(sums.withColumn("before", before).drop("count"), ["shard", "block"])
        placed = placed.withColumn("slot", (F.col("in") + F.col("before")).cast("long"))
    return placed.select("row.*", "shard", "slot")


def op6_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards, under the law `rows`."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("text").isNull(), F.lit(16)).otherwise(F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    return shuffle_into_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
