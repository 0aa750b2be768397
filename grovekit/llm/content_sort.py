"""Exact deduplication by sorting contents.

Texts are normalised (each run of ASCII white space becomes one space) and their bytes dealt to ranges by sampled
splitters. A splitter is the head of a normalised text, then the SHA-256 of all of it, which orders texts that share the
head, then the identifier: a sample stays small whatever the length of texts, and a text that a third of all rows repeat
spreads over as many ranges as it fills. Inside a range Spark's external sort places equal texts adjacent, identifiers
ascending; neighbours are compared byte by byte. A run of equals that a splitter cuts is put together again from the
first and the last run of every range, by whole text too: two rows a range, however long the run."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from grovekit.llm.common import documents, others, staged, text_batches, tidied

#: Bytes of a normalised text in a splitter.
HEAD_BYTES = 64
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text):
    """Each run of ASCII white space as one space; a null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _changes(body: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """The rows whose text differs from that of the row before, all bytes compared."""
    out = np.ones(len(body), bool)
    if len(body):
        out[0] = before is None or body[0] != before
        out[1:] = pc.not_equal(body.slice(1), body.slice(0, len(body) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(out)


NAMES = ["row", "digest", "range", "run", "keep_id", "group_size", "first", "edge_text"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in sorted order, each with its run of equals in this range: the run's number, least identifier and size, and
    whether the row is its first. The first row of the range's first and of its last run holds the text too, since other
    ranges may go on with it. Rows of the open run wait for its end, without their texts."""
    part = TaskContext.get().partitionId()
    number, held, size, least, text = -1, [], 0, None, None

    def out(rows, digests, numbers, ids, sizes, first, texts) -> pa.RecordBatch:
        columns = [rows, digests, pa.array(np.full(len(rows), part, np.int64)), pa.array(numbers), ids, pa.array(sizes), pa.array(first), texts]
        return pa.RecordBatch.from_arrays(columns, NAMES)

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        for k, (rows, digests) in enumerate(held):
            n = len(rows)
            first = np.arange(n) + k == 0
            texts = pa.array([text.as_py() if x and (last or number == 0) else None for x in first], pa.binary())
            ids = pa.array([least] * n) if least.is_valid else pa.nulls(n, least.type)
            yield out(rows, digests, np.full(n, number, np.int64), ids.cast(least.type), np.full(n, size, np.int64), first, texts)

    def hold(batch: pa.RecordBatch, a: int, b: int):
        if a < b:  # copied, as a slice keeps all of its batch
            at = pa.array(np.arange(a, b))
            held.append((pc.take(batch.column("row"), at), pc.take(batch.column("digest"), at)))

    for batch in batches:
        body, ids = batch.column("body"), batch.column("id")
        starts = _changes(body, text)
        if not len(starts):
            hold(batch, 0, batch.num_rows)
            size += batch.num_rows
            continue
        hold(batch, 0, int(starts[0]))
        size += int(starts[0])
        yield from close(False)
        # runs that begin and end in this batch
        a, b = int(starts[0]), int(starts[-1])
        if a < b:
            sizes = np.diff(starts)
            of = np.repeat(np.arange(len(sizes)), sizes)
            first = np.zeros(b - a, bool)
            first[starts[:-1] - a] = True
            texts = pa.array([body[a].as_py() if number < 0 and not k else None for k in range(b - a)], pa.binary())
            keep = pc.take(ids, pa.array(starts[:-1][of]))
            yield out(batch.column("row").slice(a, b - a), batch.column("digest").slice(a, b - a), number + 1 + of, keep, sizes[of], first, texts)
        number += len(starts)
        held = []
        hold(batch, b, batch.num_rows)
        size, least, text = batch.num_rows - b, ids[b], pa.scalar(body[b].as_py(), body.type)
    yield from close(True)


def mark_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """A row for each row of docs: the columns `carry` (all, unless given), and keep_id, the least identifier of the rows
    with an equal text; group_size, how many these are; kept, true for one row of them, that of the least identifier;
    text_sha256 of the normalised text.

    A null text is the empty text, equal to other empty ones. Null identifiers come after all others, and keep_id is null
    where a text has no other. Of repeated rows one is kept. Texts of any length are compared whole. An empty table gives
    an empty table. Columns of docs with the names of results are replaced, all others kept. Ranges are as many as
    spark.sql.shuffle.partitions; a task holds its range's longest run without the texts."""
    spark = docs.sparkSession
    text_batches(spark)
    names = others(docs, RESULTS) if carry is None else list(carry)
    body = normalised(F.col(text)).cast("binary")
    kind = docs.schema[id].dataType
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.col(id).alias("id"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("digest"))
    order = [F.substring("body", 1, HEAD_BYTES), F.col("digest"), F.col("id").asc_nulls_last()]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType(
        [
            keyed.schema["row"],
            T.StructField("digest", T.BinaryType()),
            T.StructField("range", T.LongType()),
            T.StructField("run", T.LongType()),
            T.StructField("keep_id", kind),
            T.StructField("group_size", T.LongType()),
            T.StructField("first", T.BooleanType()),
            T.StructField("edge_text", T.BinaryType()),
        ]
    )
    found = staged(ordered.mapInArrow(tidied(_runs), schema), "content-sort")
    same = W.partitionBy("digest", "edge_text")
    # two rows a range at most
    cut = found.filter("edge_text is not null").select(
        "range", "run", F.min("keep_id").over(same).alias("least"), F.sum("group_size").over(same).alias("n"), F.min("range").over(same).alias("begins")
    )
    cut = cut.filter("n > 1")
    joined = found.drop("edge_text").join(F.broadcast(cut), ["range", "run"], "left")
    return joined.select(
        "row.*",
        F.coalesce("least", "keep_id").alias("keep_id"),
        F.coalesce("n", "group_size").alias("group_size"),
        (F.col("first") & (F.col("begins").isNull() | (F.col("begins") == F.col("range")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row for each normalised text, that of the least identifier; columns and texts as they were."""
    names = docs.columns
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("whole"), docs[id].alias("id"), docs[text].alias("text"))
    return mark_copies(whole, "id", "text", ["whole"]).filter("kept").select("whole.*")


def op11_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for its text."""
    return mark_copies(documents(spark, sf_dir).select("doc_id", "text"), carry=["doc_id"])


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
