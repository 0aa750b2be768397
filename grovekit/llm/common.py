"""What the operators of this subpackage share: scratch tables and skew-safe joins."""

from __future__ import annotations

import ctypes
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.staging import scratch, staged  # noqa: F401

#: Rows of an Arrow batch of texts. Spark's default of 10,000 of them would be tens of MB, in a worker and again in the JVM.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Sets the session to batches of TEXT_ROWS rows, unless it has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXT_ROWS))


def filesystem(uri: str):
    """Arrow's file system of a folder's URI, and its path there. Names that Hadoop uses for stores which Arrow knows by
    others (s3a, s3n, dbfs) are translated; hdfs needs libhdfs on the executors."""
    import pyarrow.fs

    scheme, colon, rest = uri.partition(":")
    if scheme == "dbfs":
        uri = "file:///dbfs/" + rest.lstrip("/")
    elif scheme in ("s3a", "s3n"):
        uri = "s3:" + rest
    return pyarrow.fs.FileSystem.from_uri(uri)


#: What empties the caches that tasks leave in their worker for later ones.
worker_caches: list = []


def tidied(run, keeps_caches: bool = False):
    """An Arrow function of a task that gives back to the system, when it ends, the memory that it no longer holds: workers
    are kept for later tasks, of other operators too. It begins by emptying the caches of others, unless it uses them."""

    @functools.wraps(run)
    def tidy(batches):
        import pyarrow as pa

        from grovekit.llm.common import worker_caches  # the worker's own list

        for empty in () if keeps_caches else worker_caches:
            empty()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidy


def others(df: DataFrame, results) -> list[str]:
    """The columns of df that aren't named as a result, letter case regarded only where the session regards it."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    taken = {c if exact else c.lower() for c in results}
    return [c for c in df.columns if (c if exact else c.lower()) not in taken]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(column, modulus: int):
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
