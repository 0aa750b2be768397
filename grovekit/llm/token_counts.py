"""Token counts through a digest cache.

Every text is known by the SHA-256 of its normalised content: its UTF-8 bytes, a null as none. (Nothing that could
change a count is normalised away.) A count is stored under that digest and the digest of the tokenizer's file. Texts
whose digests have no count are reduced to one row each, encoded, and appended to the cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm.common import documents, others, scratch, text_batches, tidied
from grovekit.llm.encoders import file_digest, piece_counter

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
LIMIT = 4096
#: Characters that are encoded together.
ENCODE_CHARS = 1 << 20


def _encode(model_path: str, digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model_path)
        if file_digest(model_path) != digest:
            raise ValueError(f"{model_path} differs between driver and executor")
        for batch in batches:
            counts, part, size = [], [], 0
            for text in batch.column("text"):
                part.append(text.as_py())
                size += len(part[-1])
                if size >= ENCODE_CHARS:
                    counts += counter.count(part)
                    part, size = [], 0
            counts += counter.count(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("content_digest"), pa.array([digest] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                ["content_digest", "tokenizer_digest", "n_tokens"],
            )

    return tidied(run, keeps_caches=True)


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; none where nothing has been appended yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


KEY = ["content_digest", "tokenizer_digest"]


def count_tokens(docs: DataFrame, model_path: str, cache: str, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit.

    A null text is the empty text, with no bytes and no tokens. Equal texts are encoded once; repeated rows and
    ties in any other column keep a row each. Columns of docs with the new names are replaced, all others kept. The
    count of an empty table is an empty table. Very long texts are encoded whole. A pair of digests that stands in the
    cache more than once, as after two runs at a time, counts once."""
    spark = docs.sparkSession
    text_batches(spark)
    digest = file_digest(model_path)
    keep = others(docs, ("n_bytes", "n_tokens", "over_limit"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    content, tokenizer = F.unhex(F.sha2(body.cast("binary"), 256)).alias("content_digest"), F.lit(digest).alias("tokenizer_digest")
    keyed = docs.select(F.struct(*keep).alias("row"), F.octet_length(body).cast("long").alias("n_bytes"), content, tokenizer)
    stored = read_cache(spark, cache)
    misses = (
        docs.select(body.alias("text"), content)
        .groupBy("content_digest")
        .agg(F.first("text").alias("text"))
        .withColumn("tokenizer_digest", F.lit(digest))
        .join(stored.select(*KEY), KEY, "left_anti")
        .drop("tokenizer_digest")
    )
    misses.mapInArrow(_encode(model_path, digest), CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("tokenizer_digest") == digest).groupBy(*KEY).agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(counts, KEY).select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document under piece_bpe_32k.model, from a cache that begins empty."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), scratch(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
