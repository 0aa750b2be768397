"""Tables written to the folder that driver and executors share, and read again: they cut lineage and survive lost
executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local master, where one machine does all, may fall back to a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-grovekit-"))
        root = _own[0]
    return root.rstrip("/")


#: The folder of this process, where a local master names none.
_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of so many bytes at most, for jobs that run inside; the session's own setting returns after them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
