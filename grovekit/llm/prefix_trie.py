"""A trie of conversation prefixes, built from padded matrices of turn ids.

A turn's id is 16 bytes of the SHA-256 of its role and text. A conversation is the run of its ids, and conversations are
dealt to ranges of these runs by sampled splitters, identifiers last, so that even equal conversations spread. A task
takes its range in blocks: rows of ids padded with zeros to the block's longest, put in order by numpy's lexsort. Where
a column differs from the row above, it or any column before it, a node begins: the changes are OR-accumulated along
the row. One reduceat a depth then gives every node's counts.

Only nodes on the path that two neighbouring blocks share are cut. What a block adds to such a node is a plain sum once
the block knows how many turns its first row shares with the row before it and its last row with the row after it: a
node is counted where it begins, a leaf where it ends. Such parts are added up by the node's own digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grovekit.llm.common import staged, tidied

ID_BYTES = 16
#: Ids of a block, padding included, about.
BLOCK_CELLS = 1 << 20
#: Turns of a range, about; there are at least as many ranges as the session has shuffle partitions.
RANGE_TURNS = 1 << 20
#: Bytes of identifiers, as text, that stand in one row of what is hashed for a cut node.
CHUNK_BYTES = 1 << 16
#: Every SHARED-th identifier opens the conversations of its class with its own first turns, at most three.
SHARED, HEADS = 20, 4
NONE_SHA256 = hashlib.sha256(b"").hexdigest()

SCHEMA = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, block long, range long, node binary, parent binary, ends binary"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Kinds of rows that a block gives: whole nodes, its parts of cut nodes, identifiers that end at a cut node.
WHOLE, PART, ENDS = 0, 1, 2


def rebuilt_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, ids (binary, 16 bytes a turn) and words (of each turn) of every rebuilt conversation.

    Turns stand in order of `turn`, nulls first; turns of one number in order of their digests. Rows without a conv_id
    belong to no conversation. Of a turn only its digest and count of words are exchanged."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length keeps role and text apart
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"),
        F.col("turn").alias("turn"),
        F.substring(F.unhex(digest), 1, ID_BYTES).alias("id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    conv = F.col("conv_id").cast("long")
    rows = turns.filter(F.col("conv_id").isNotNull()).select((conv - conv % SHARED).alias("base"), conv.alias("conv_id"), turn.alias("t"))
    # one exchange serves both the gathering and the opening turns of the class
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, HEADS - 1))).over(W.partitionBy("base"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    head = F.slice(F.coalesce("first", F.slice("own", 1, 0)), 1, h)
    tail = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    made = own.select("conv_id", "own", first.alias("first")).select("conv_id", F.concat(head, tail).alias("turns"))
    return made.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("ids"), F.col("turns.words").alias("words"))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many turns two conversations share, from the first."""
    n = min(len(a), len(b))
    differ = np.flatnonzero((a[:n] != b[:n]).any(axis=1))
    return int(differ[0]) if len(differ) else n


class Block:
    """Conversations that follow one another in the order of their ids: everything that they add to nodes.

    `before` and `after`: turns that the first row shares with the row before it, and the last with the row after it;
    -1 where there is none."""

    def __init__(self, conv: np.ndarray, lens: np.ndarray, ids: np.ndarray, words: np.ndarray, before: int, after: int):
        n, longest = len(conv), int(lens.max())
        cells = np.arange(longest) < lens[:, None]
        hi, lo, w = (np.zeros((n, longest), t) for t in (np.uint64, np.uint64, np.int64))
        hi[cells], lo[cells], w[cells] = ids[:, 0], ids[:, 1], words
        order = np.lexsort([conv, *[c for d in range(longest - 1, -1, -1) for c in (lo[:, d], hi[:, d])]])
        self.conv, self.lens, self.before, self.after, self.n = conv[order], lens[order], before, after, n
        self.hi, self.lo, self.cells = hi[order], lo[order], cells[order]
        w = w[order]
        change = np.zeros((n, longest), bool)
        change[0] = True
        change[1:] = np.logical_or.accumulate((self.hi[1:] != self.hi[:-1]) | (self.lo[1:] != self.lo[:-1]), axis=1)
        starts = change & self.cells
        self.starts = np.hstack([np.arange(n)[:, None] == 0, starts])  # column d: nodes of depth d
        counted = self.starts.copy()  # where it begins, and not in a block before
        counted[0, : before + 1] = False
        saved = np.zeros((n, longest + 2), np.int64)
        saved[:, 1:-1] = w * ~counted[:, 1:]
        self.saved = np.cumsum(saved[:, ::-1], axis=1)[:, ::-1]  # column d: from depth d on
        self.children = np.zeros((n, longest + 1), np.int64)
        self.children[:, :-1] = counted[:, 1:]
        # a row is the end of a leaf if the next one doesn't hold all of it
        shared = np.argmax(np.hstack([change[1:], np.ones((n - 1, 1), bool)]), axis=1) if n > 1 else np.empty(0, np.int64)
        shared = np.minimum(shared, np.minimum(self.lens[1:], self.lens[:-1]))
        self.leaf = (np.append(shared, after) < self.lens).astype(np.int64)
        self.longest = longest

    def _path(self, row: int) -> list[bytes]:
        """Digests of all prefixes of a row, the empty one first."""
        h, out = hashlib.sha256(), []
        raw = np.stack([self.hi[row], self.lo[row]], axis=1)[: self.lens[row]].astype(">u8").tobytes()
        for d in range(len(raw) // ID_BYTES + 1):
            out.append(h.copy().digest()[:ID_BYTES])
            h.update(raw[d * ID_BYTES : (d + 1) * ID_BYTES])
        return out

    def rows(self, block: int, part: int) -> Iterator[dict]:
        """A dict of columns for each depth."""
        first, last = self._path(0), self._path(self.n - 1)
        up = None  # of the depth above: where its nodes begin, their least conversations, their digests if cut
        for d in range(self.longest + 1):
            starts = np.flatnonzero(self.starts[:, d])
            member = self.lens >= d
            reach = np.where(member, self.conv, np.iinfo(np.int64).max)
            least = np.minimum.reduceat(reach, starts)
            total = lambda x: np.add.reduceat(np.where(member, x, 0), starts)
            node: list[bytes | None] = [None] * len(starts)
            # cut: on the first row's path down to `before`, or on the last row's down to `after`
            if d <= self.before:
                node[0] = first[d]
            if d <= self.after:
                node[-1] = last[d]
            ends = self.lens == d
            n_ends = np.add.reduceat(ends.astype(np.int64), starts)
            cut = np.array([x is not None for x in node])
            at = np.searchsorted(up[0], starts, "right") - 1 if up else np.zeros(len(starts), np.int64)
            parent_node = [up[2][i] for i in at] if up else [None] * len(starts)
            parent_conv = [int(up[1][i]) if up[2][i] is None else None for i in at] if up else [None] * len(starts)
            digests, chunks = [], []
            for k, (s, m) in enumerate(zip(starts, n_ends)):
                members = self.conv[s : s + m]  # the shortest come first
                if node[k] is None:
                    digests.append(hashlib.sha256(",".join(map(str, members.tolist())).encode()).hexdigest() if m else NONE_SHA256)
                    continue
                digests.append(None)
                step = CHUNK_BYTES // 21
                chunks += [(node[k], int(members[i]), ",".join(map(str, members[i : i + step].tolist())).encode()) for i in range(0, m, step)]
            yield {
                "kind": np.where(cut, PART, WHOLE), "conv_id": least, "depth": np.full(len(starts), d), "parent_conv_id": parent_conv, "n_convs": total(np.ones(self.n, np.int64)),
                "n_children": total(self.children[:, d]), "n_leaves": total(self.leaf), "saved_tokens": total(self.saved[:, max(d, 1)]), "ends_sha256": digests,
                "block": np.full(len(starts), block), "range": np.full(len(starts), part), "node": node, "parent": parent_node,
            }
            if chunks:
                yield {"kind": [ENDS] * len(chunks), "node": [x[0] for x in chunks], "conv_id": [x[1] for x in chunks], "ends": [x[2] for x in chunks]}
            up = (starts, least, node)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(columns: dict) -> pa.RecordBatch:
    n = len(columns["kind"])
    kinds = [_TYPES[x.split()[1]] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(NAMES, kinds)], NAMES)


def _nodes(edges: dict[int, tuple[int, int]], cells: int):
    """Sorted conversations of ranges -> rows of SCHEMA. edges: of each range, what its first and last row share with
    their neighbours in other ranges."""

    def flat(batch: pa.RecordBatch, a: int, b: int) -> tuple:
        ids, words = batch.column("ids").slice(a, b - a), batch.column("words").slice(a, b - a)
        raw = b"".join(x.as_py() for x in ids)
        return (
            batch.column("conv_id").slice(a, b - a).to_numpy(),
            np.array([len(x) for x in words], np.int64),
            np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2),
            words.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part, number, count, longest, before = None, 0, 0, 0, -1

        def close(after: int) -> Iterator[pa.RecordBatch]:
            conv, lens, ids, words = (np.concatenate(x) for x in zip(*held))
            for columns in Block(conv, lens, ids, words, before, after).rows(number, part):
                yield _batch(columns)

        for batch in batches:
            parts = batch.column("range").to_pylist()
            lens = [len(x) // ID_BYTES for x in batch.column("ids").to_pylist()]
            a = 0
            for i in range(batch.num_rows + 1):
                done = i == batch.num_rows
                if not done and parts[i] == part and max(longest, lens[i]) * (count + 1) <= cells:
                    count, longest = count + 1, max(longest, lens[i])
                    continue
                if i > a:
                    held.append(flat(batch, a, i))
                    a = i
                if done:
                    break
                if held:
                    if parts[i] == part:
                        after = _shared(held[-1][2][len(held[-1][2]) - held[-1][1][-1] :], flat(batch, i, i + 1)[2])
                        yield from close(after)
                        before, number = after, number + 1
                    else:
                        yield from close(edges[part][1])
                if parts[i] != part:
                    part, number = parts[i], 0
                    before = edges[part][0]
                held, count, longest = [], 1, lens[i]
        if held:
            yield from close(edges[part][1])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of identifiers, sorted by node and first identifier -> the SHA-256 of each node's, comma-joined."""
    node, h = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], ["node", "ends_sha256"])

    for batch in batches:
        for key, ends in zip(batch.column("node").to_pylist(), batch.column("ends")):
            if key != node:
                if node is not None:
                    yield row()
                node, h = key, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ends.as_py())
    if node is not None:
        yield row()


def prefix_trie(turns: DataFrame, block_cells: int = BLOCK_CELLS, ranges: int | None = None) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: conv_id (the least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; null turns come first; turns of one number stand in order of their digests, so
    repeated rows are turns of their own. Rows without a conv_id are left out; without any other there is no node.
    Other columns are ignored, whatever their names. Texts of any length count whole. A task holds a block of ids, or
    one conversation where that is longer: 24 bytes a turn; texts aren't exchanged."""
    spark = turns.sparkSession
    made = staged(rebuilt_conversations(turns.select("conv_id", "turn", "role", "text")), "trie-conversations")
    total = made.agg(F.sum(F.size("words")), F.count("*")).first()
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-((total[0] or 0) + total[1]) // RANGE_TURNS))
    dealt = staged(made.repartitionByRange(n, "ids", "conv_id").withColumn("range", F.spark_partition_id().cast("long")), "trie-ranges")
    # two rows a range
    edge = dealt.groupBy("range").agg(F.min(F.struct("ids", "conv_id")).alias("least"), F.max(F.struct("ids", "conv_id")).alias("most"))
    near = W.orderBy("range")
    edge = edge.select("range", F.col("least.ids").alias("here"), F.lag("most.ids").over(near).alias("there"))
    edge = edge.mapInArrow(_shared_at_edges, "range long, shared long").collect()
    shared = [r["shared"] for r in sorted(edge, key=lambda r: r["range"])] + [-1]
    edges = {r["range"]: (shared[k], shared[k + 1]) for k, r in enumerate(sorted(edge, key=lambda r: r["range"]))}
    rows = dealt.repartitionById(n, F.col("range").cast("int")).sortWithinPartitions("range", "ids", "conv_id")
    found = staged(rows.mapInArrow(tidied(_nodes(edges, block_cells)), SCHEMA), "trie-nodes")

    parts = found.filter(F.col("kind") == PART)
    chunks = found.filter(F.col("kind") == ENDS).select("node", "conv_id", "ends").repartition("node").sortWithinPartitions("node", "conv_id")
    ends = chunks.mapInArrow(_joined, "node binary, ends_sha256 string")
    cut = parts.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    cut = staged(cut.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE_SHA256))), "trie-cut")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = cut.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # children of a cut node look it up in their own block, so that no key is that of a third of all rows
    here = parts.select("range", "block", F.col("node").alias("parent")).join(above, "parent")
    whole = found.filter(F.col("kind") == WHOLE)
    return (
        whole.filter("parent is null")
        .select(*names)
        .unionByName(whole.filter("parent is not null").drop("parent_conv_id").join(here, ["range", "block", "parent"]).select(*names))
        .unionByName(cut.join(above, "parent", "left").select(*names))
    )


def _shared_at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part, here, there = (batch.column(c).to_pylist() for c in ("range", "here", "there"))
        turns = lambda raw: np.frombuffer(raw, ">u8").reshape(-1, 2)
        shared = [-1 if b is None else _shared(turns(a), turns(b)) for a, b in zip(here, there)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(shared, pa.int64())], ["range", "shared"])


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
               sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
             xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
                 lambda acc, b: xor(acc >> 8, entries[1 + (xor(acc, b) & 255)]))) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base WHERE t.pos <= h
      UNION ALL SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t USING (conv_id) WHERE t.pos > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, sha256(strlen(role)::VARCHAR || ':' || role || text) AS id,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
p AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS words FROM c
      UNION ALL SELECT conv_id, depth, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth), words FROM s),
m AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS node, max(depth) OVER (PARTITION BY conv_id) AS length FROM p),
n AS (SELECT node, depth, count(*) AS n_convs, any_value(words) AS words,
             coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '') AS ends FROM m GROUP BY node, depth),
up AS (SELECT n.*, m.node AS parent_conv_id FROM n LEFT JOIN m ON m.conv_id = n.node AND m.depth = n.depth - 1),
k AS (SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
f AS (SELECT up.*, coalesce(k.n_children, 0) AS n_children FROM up LEFT JOIN k ON k.parent_conv_id = up.node AND k.depth = up.depth),
sub AS (SELECT m.node, m.depth, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved
        FROM f JOIN m ON m.conv_id = f.node AND m.depth <= f.depth GROUP BY ALL)
SELECT f.node AS conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n_convs, f.n_children, sub.n_leaves::BIGINT AS n_leaves,
       sub.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN sub USING (node, depth)
"""
