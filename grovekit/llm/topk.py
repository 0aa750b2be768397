"""Exact top-k search by a bit-sliced index.

Vectors lie in blocks; of each block and dimension the index keeps the quantised values as bitmaps, one for each bit.
A query adds the bitmaps, weighted by its own quantised components, with carry-save bitmap arithmetic; the sums again
are bitmaps. Read from the most significant downward they give the k-th largest quantised sum, and every row that
could still be among the first k, given the bound on what quantising left out. Those rows alone are scored exactly.

Queries are first held against a small seed of rows. The k-th score there is what a row of any block must reach: blocks
whose longest vector can't are skipped, and the others give few rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grovekit.llm.common import staged, tidied

K = 10
BLOCK_ROWS = 16384
QUERY_ROWS = 128
#: Bits of a quantised component beside its sign.
BITS = 6
_ZERO = 1 << BITS
#: Rows of the seed, which is broadcast.
SEED_ROWS = 1024
_NONE = -(2**63)
BLOCK_SCHEMA = "block long, n long, d long, rows binary, ids binary, vectors binary, shift long, slices binary"


def rounded(x: np.ndarray, shift: int) -> np.ndarray:
    """x / 2^shift to the nearest integer; no step of it leaves 64 bits."""
    return (x >> shift) + ((x >> (shift - 1)) & 1) if shift else x


def quantise(x: np.ndarray) -> tuple[np.ndarray, int]:
    """x >> shift, rounded, so that it fits in BITS and a sign; and the shift."""
    top = int(np.abs(x).max(initial=0))
    shift = max(0, top.bit_length() - BITS)
    return rounded(x, shift), shift


def slices_of(quantised: np.ndarray) -> np.ndarray:
    """Bitmaps [dimension, bit, word] of the components, moved up so that none is negative."""
    n, d = quantised.shape
    up = (quantised + _ZERO).astype(np.uint8).T
    out = np.zeros((d, BITS + 2, -(-n // 64) * 8), np.uint8)
    for b in range(BITS + 2):
        packed = np.packbits((up >> b) & 1, axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.view(np.uint64)


def weighted_sum(slices: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Bitmaps, least significant first, of the sum of weights * components over all rows. Components of a negative
    weight are complemented, which adds a constant to every row."""
    columns: dict[int, list[np.ndarray]] = {}
    for i in np.flatnonzero(weights):
        size = abs(int(weights[i]))
        own = slices[i] if weights[i] > 0 else ~slices[i]
        for p in range(size.bit_length()):
            if size >> p & 1:
                for b in range(own.shape[0]):
                    columns.setdefault(p + b, []).append(own[b])
    out, w, carried = [], 0, {}
    while w <= max([*columns, *carried], default=-1):
        stack = np.array(columns[w]) if w in columns else np.empty((0, slices.shape[2]), np.uint64)
        if w in carried:
            stack = np.concatenate([stack, *carried[w]])
        while len(stack) > 1:
            m = len(stack) // 3
            if m:
                a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                half = a ^ b
                carried.setdefault(w + 1, []).append((a & b) | (c & half))
                stack = np.concatenate([half ^ c, stack[3 * m :]])
            else:
                carried.setdefault(w + 1, []).append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
        out.append(stack[0] if len(stack) else np.zeros(slices.shape[2], np.uint64))
        w += 1
    return out


def kth_largest(sums: list[np.ndarray], among: np.ndarray, k: int) -> int:
    """The k-th largest value of the rows in the bitmap `among`, which holds k rows at least."""
    tied, above, value = among, 0, 0
    for p in range(len(sums) - 1, -1, -1):
        ones = tied & sums[p]
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            tied, value = ones, value | 1 << p
        else:
            above, tied = above + n, tied & ~sums[p]
    return value


def at_least(sums: list[np.ndarray], among: np.ndarray, value: int) -> np.ndarray:
    """The bitmap of the rows in `among` whose sum is `value` or more."""
    if value <= 0:
        return among
    if value >> len(sums):
        return np.zeros_like(among)
    more, equal = np.zeros_like(among), among
    for p in range(len(sums) - 1, -1, -1):
        if value >> p & 1:
            equal = equal & sums[p]
        else:
            more, equal = more | (equal & sums[p]), equal & ~sums[p]
    return more | equal


class Block:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, shift: int, slices: np.ndarray):
        self.rows, self.ids, self.vectors, self.shift, self.slices = rows, ids, vectors, shift, slices
        real = vectors.astype(float)
        quantised = rounded(vectors, shift).astype(float) * 2.0**shift
        self.longest = float(np.sqrt((real**2).sum(axis=1)).max(initial=0))
        self.left_out = float(np.sqrt(((real - quantised) ** 2).sum(axis=1)).max(initial=0))
        full = np.zeros(slices.shape[2] * 64, np.uint8)
        full[: len(rows)] = 1
        self.all = np.packbits(full, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, rows, ids, vectors):
        quantised, shift = quantise(vectors)
        return cls(rows, ids, vectors, shift, slices_of(quantised))

    def exact(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        bound = int(np.abs(query).max(initial=0)) * int(np.abs(self.vectors).max(initial=0)) * max(1, len(query))
        if bound < 2**62:
            return self.vectors[at] @ query
        most = 2**63 - 1
        return np.array([max(-most, min(most, sum(int(a) * int(b) for a, b in zip(self.vectors[i], query)))) for i in at], np.int64)

    def search(self, row: int, query: np.ndarray, k: int, least: int = _NONE) -> list[tuple[int, int]]:
        """The first k (vec_id, score) of at least the score `least`, but for the row itself."""
        d = self.vectors.shape[1]
        if least > _NONE and float(np.sqrt((query.astype(float) ** 2).sum())) * self.longest * (1 + 1e-9) + 1 < least:
            return []
        query = np.pad(query, (0, max(0, d - len(query))))[:d]
        if len(self.rows) <= k + 1:
            at = np.arange(len(self.rows))
        else:
            weights, shift = quantise(query)
            sums = weighted_sum(self.slices, weights)
            rough = weights.astype(float) * 2.0**shift
            bound = float(np.sqrt((rough**2).sum())) * self.left_out + float(np.sqrt(((query - rough) ** 2).sum())) * self.longest
            unit = 2.0 ** (shift + self.shift)
            # the row itself may be one of the first; so one more is asked for
            floor = kth_largest(sums, self.all, k + 1) - int(np.ceil(2 * bound * (1 + 1e-9) / unit)) - 1
            if least > _NONE:
                # what the components' move upward and the complements add to every sum
                moved = int(weights[weights > 0].sum()) * _ZERO - int(weights[weights < 0].sum()) * ((1 << (BITS + 2)) - 1 - _ZERO)
                floor = max(floor, int(np.floor((least * (1 - 1e-12 * np.sign(least)) - bound * (1 + 1e-9)) / unit)) - 1 + moved)
            at = np.flatnonzero(np.unpackbits(at_least(sums, self.all, floor).view(np.uint8), bitorder="little"))
        at = at[self.rows[at] != row]
        scores = self.exact(at, query)
        at, scores = at[scores >= least], scores[scores >= least]
        order = np.lexsort((self.ids[at], -scores))[:k]
        return list(zip(self.ids[at][order].tolist(), scores[order].tolist()))


def integer_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, v (floor(1024 x) as 64-bit integers); rows without an id, a vector, or with a null or non-finite
    component are left out."""
    x = F.transform(vector, lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (
        df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
        .filter(F.forall("x", finite))
        .select("vec_id", F.transform("x", lambda x: F.greatest(F.floor(x * 1024), F.lit(1 - 2**63))).alias("v"))
    )


def _build(size: int, sliced: bool):
    """Blocks of `size` rows from rows (row, vec_id, v)."""
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]

    def emit(number, rows, ids, vectors):
        d = max((len(v) for v in vectors), default=0)
        x = np.zeros((len(vectors), d), np.int64)
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
        quantised, shift = quantise(x) if sliced else (x, 0)
        cut = slices_of(quantised).tobytes() if sliced else b""
        values = [number, len(rows), d, np.array(rows, np.int64).tobytes(), np.array(ids, np.int64).tobytes(), x.tobytes(), shift, cut]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows, ids, vectors = [], [], []
        for batch in batches:
            values = batch.column("v").flatten().to_numpy()
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            rows += batch.column("row").to_pylist()
            ids += batch.column("vec_id").to_pylist()
            vectors += np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []
            while len(rows) >= size:
                yield emit(number, rows[:size], ids[:size], vectors[:size])
                rows, ids, vectors, number = rows[size:], ids[size:], vectors[size:], number + 1
        if rows:
            yield emit(number, rows, ids, vectors)

    return run


def _block(r: dict) -> Block:
    n, d = r["n"], r["d"]
    rows, ids = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64)
    return Block(rows, ids, np.frombuffer(r["vectors"], np.int64).reshape(n, d), r["shift"], np.frombuffer(r["slices"], np.uint64).reshape(d, BITS + 2, -1))


def _prime(k: int):
    """Query blocks with q_least: the k-th score of each query in the seed, or the least number for fewer rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = None
        for batch in batches:
            least = []
            for r in batch.to_pylist():
                seed = seed or _block(r)
                queries = np.frombuffer(r["q_vectors"], np.int64).reshape(r["q_n"], r["q_d"])
                found = [seed.search(int(row), q, k) for row, q in zip(np.frombuffer(r["q_rows"], np.int64), queries)]
                least.append(np.array([x[-1][1] if len(x) == k else _NONE for x in found], np.int64).tobytes())
            asked = batch.select(["q_n", "q_d", "q_rows", "q_ids", "q_vectors"])
            yield pa.RecordBatch.from_arrays([*asked.columns, pa.array(least, pa.binary())], [*asked.schema.names, "q_least"])

    return tidied(run)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held != r["block"]:
                    held, block = r["block"], _block(r)
                queries = np.frombuffer(r["q_vectors"], np.int64).reshape(r["q_n"], r["q_d"])
                each = (np.frombuffer(r[c], np.int64) for c in ("q_rows", "q_ids", "q_least"))
                for row, id_, least, q in zip(*each, queries):
                    out += [(int(row), int(id_), v, s) for v, s in block.search(int(row), q, k, int(least))]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "query_id", "vec_id", "score"])

    return tidied(run)


def top_k(df: DataFrame, queries: Column, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of each row where `queries` holds, among
    all other rows of df(vec_id, embedding); ties go to the smaller vec_id.

    A repeated row is a row of its own, as a query and as a candidate. Shorter vectors count as padded with zeros.
    Components beyond 2^63 / 1024 and scores beyond 64 bits count as the nearest number that has 64 bits. Vectors that
    are null or hold what is null or not finite take no part; other columns, whatever their names, neither.
    Fewer candidates than k give as many ranks; an empty table gives none. Queries are sent to every block of the
    index, in blocks; a block gives k rows a query at most, and only those that reach the k-th score of the seed."""
    rows = staged(integer_vectors(df).withColumn("row", F.monotonically_increasing_id()), "vectors")
    index = staged(rows.mapInArrow(_build(block_rows, True), BLOCK_SCHEMA), "bit-sliced-index")
    asked = rows.filter(queries).mapInArrow(_build(query_rows, False), BLOCK_SCHEMA)
    groups = max(1, index.count())
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("n", "d", "rows", "ids", "vectors")])
    # a block of at most seed_rows vectors
    seed = rows.limit(seed_rows).coalesce(1).mapInArrow(_build(seed_rows, True), BLOCK_SCHEMA)
    asked = asked.withColumn("_s", F.lit(0)).join(F.broadcast(seed.withColumn("_s", F.lit(0))), "_s").mapInArrow(_prime(k), "q_n long, q_d long, q_rows binary, q_ids binary, q_vectors binary, q_least binary")
    asked = staged(asked, "primed-queries").withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = asked.join(index.withColumn("_g", F.pmod(F.hash("block"), F.lit(groups))), "_g").drop("_g")
    found = pairs.mapInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    order = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP4_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
