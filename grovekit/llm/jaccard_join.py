"""Jaccard self-join of texts over word n-grams by token-combination prefixes.

A text's tokens are its distinct shingles, as 64-bit hashes, in one global order: by how frequent they are, roughly,
and then by hash; tokens of one text only come first. Two texts that are alike share a token in prefixes of |x| - ceil(t |x|) + 1, and 1 + e tokens when
both prefixes are e longer. Rare tokens are indexed alone. Tokens of frequent classes are indexed as combinations of
two: the extended prefix is split into e groups by hash, so of 1 + e shared frequent tokens two fall into one group.

Texts with equal token sets are one class and meet nowhere. Classes that share an index entry are verified on their
whole token sets, first each with the entry's most common-place member (in groups of near copies that is the one they
come from), then all that are not yet in one component. For components only links between unlike ones are looked for
(link_components); all_links verifies every pair of classes that shares an entry."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm.common import documents, staged, text_batches, tidied
from grovekit.llm.components import connected
from grovekit.llm.hashing import blocks, mix, runs, word_hashes

#: Words of a shingle and the least similarity in percent (above 50), where a caller gives no others.
SIZE = 4
PERCENT = 85
#: Counters of the frequency sketch; its size doesn't depend on the corpus.
COUNTERS = 1 << 22
PARTS = 16
#: A shingle whose counter stands this far above the mean belongs to a frequent class.
FREQUENT = 24
#: Tokens are told from those of one class only by a bitmap of 2^32 / FOLD bits (16 MB), made in slices.
SLICE_BITS, FOLD = 8, 32
SLICES = 1 << SLICE_BITS
#: Groups of frequent tokens: one for so many tokens of a text.
GROUP_TOKENS = 32
#: Rounds that compare with one member of each entry, before all that is left is compared.
PIVOT_ROUNDS = 4
#: A round of those that finds less than this share of the first one's links is the last.
WORTH = 0.05
#: Bins of a text's histogram of tokens, and of its shorter one.
BINS, SHORT_BINS = 128, 64
#: Longer index entries are compared with a pivot first.
LONG_RUN = 16
#: Where all of an entry is compared, rows that one task compares with one another, or with as many others.
BLOCK_RUN = 2048
#: Tokens, and index entries, that a task holds before it puts them out; and classes that it remembers.
HELD_TOKENS, HELD_ENTRIES, REMEMBERED = 1_500_000, 500_000, 200_000

_U = np.uint64


def token_sets(column: pa.Array, size: int = SIZE) -> Iterator[tuple[int, np.ndarray]]:
    """(number, sorted distinct shingle hashes) of every text, in order."""
    for i, data, edges in blocks(column):
        words, first = word_hashes(data, edges)
        h, begin = runs(words, first, size)
        text = np.repeat(np.arange(len(begin) - 1, dtype=np.int64), np.diff(begin))
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[new], text[new]
        at = np.searchsorted(text, np.arange(len(begin)))
        for j in range(len(begin) - 1):
            yield i + j, h[at[j] : at[j + 1]]


def class_id(tokens: np.ndarray) -> int:
    """The class of texts with these tokens: a 64-bit digest of them all."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _batch(columns: list[tuple[str, list | pa.Array | np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for _, c, t in columns], [n for n, _, _ in columns])


def _binned(tokens: np.ndarray, bins: int) -> np.ndarray:
    return np.bincount((tokens >> _U(40)).astype(np.int64) % bins, minlength=bins)


def histogram(tokens: np.ndarray) -> bytes:
    """How many of the tokens that other classes may hold fall into each of BINS: two texts share at most the sum of the
    lesser counts."""
    counts = _binned(tokens, BINS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def _counts(hist: bytes) -> np.ndarray:
    return np.frombuffer(hist, np.uint8 if len(hist) == BINS else np.uint32).astype(np.int64)


def short_histogram(tokens: np.ndarray) -> bytes:
    """The same in SHORT_BINS bytes; all 0 where a count doesn't fit, which rules nothing out."""
    counts = _binned(tokens, SHORT_BINS)
    return (counts if counts.max() < 256 else np.zeros(SHORT_BINS)).astype(np.uint8).tobytes()


def _triangles(g: int, runs: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside each of the runs of g rows that begin at `first`."""
    i, j = np.triu_indices(g, 1)
    return (first[:, None] + i).ravel(), (first[:, None] + j).ravel()


def _run_pairs(mode: str, turn: int, percent: int):
    """Pairs (a, b) of rows with one key, from rows sorted by key (key, cid, n, common, root, brief): in `first` all pairs
    of short runs, and those with one row (the pivot) of long ones; in `pivot` those with a pivot of another root; in
    `rest` all pairs of unlike roots of long ones; in `all` all pairs. A run of two sides (see _in_blocks) gives the pairs
    between them. Sizes and histograms must allow the link."""

    def allowed(c: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small, large = np.minimum(c["n"][i], c["n"][j]).astype(np.int64), np.maximum(c["n"][i], c["n"][j]).astype(np.int64)
        keep = (c["root"][i] != c["root"][j]) & (small * 100 >= large * percent)
        i, j = i[keep], j[keep]
        out = np.ones(len(i), bool)
        for at in range(0, len(i), 200_000):
            x, y = c["brief"][i[at : at + 200_000]], c["brief"][j[at : at + 200_000]]
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            total = c["n"][i[at : at + 200_000]].astype(np.int64) + c["n"][j[at : at + 200_000]]
            whole = (x.sum(axis=1, dtype=np.int64) > 0) & (y.sum(axis=1, dtype=np.int64) > 0)
            out[at : at + 200_000] = ~whole | (100 * most >= percent * (total - most))
        return i[out], j[out]

    def nearest(c: dict, member: list[np.ndarray], pivot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of long runs, for each class that with the most common-place pivot: what these pairs find only
        saves later comparisons, and a group of near copies has many runs with the same members."""
        m, p = np.concatenate(member), np.concatenate(pivot)
        order = np.lexsort((c["cid"][p], c["common"][p], c["cid"][m]))
        m, p = m[order], p[order]
        last = np.append(c["cid"][m][1:] != c["cid"][m][:-1], True)
        return m[last], p[last]

    def candidates(c: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        members: list[np.ndarray] = []
        pivots: list[np.ndarray] = []
        first = np.flatnonzero(np.diff(c["key"], prepend=c["key"][:1] - 1)) if len(c["key"]) else np.empty(0, np.int64)
        size = np.diff(first, append=len(c["key"]))
        if mode in ("first", "all"):
            for g in range(2, LONG_RUN + 1):
                if (of := first[size == g]).size:
                    for at in range(0, len(of), 20_000):
                        yield allowed(c, *_triangles(g, len(of), of[at : at + 20_000]))
        for a, g in zip(first, size):
            if g <= LONG_RUN and mode != "rest":
                continue
            rows = np.arange(a, a + g)
            if mode in ("rest", "all"):
                other = int(np.searchsorted(c["side"][rows], 1))
                for k in range(other if other < g else g - 1):  # row by row, so that memory follows the run and not its square
                    against = rows[max(k + 1, other if other < g else 0) :]
                    yield allowed(c, np.full(len(against), a + k), against)
            else:
                order = mix((c["root"][rows] ^ (c["cid"][rows] + turn)).view(_U)) if turn else c["common"][rows]
                p = rows[np.lexsort((c["cid"][rows], order))[-1]]
                member, pivot = allowed(c, rows, np.full(g, p))
                if len(member):
                    members.append(member)
                    pivots.append(pivot)
        if members:
            yield nearest(c, members, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None

        def emit(c: dict) -> Iterator[pa.RecordBatch]:
            found, n = [], 0
            for i, j in [*candidates(c)] if mode in ("first", "pivot") else candidates(c):
                if len(i):
                    x, y = c["cid"][i], c["cid"][j]
                    found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1) if len(i) > 1000 else np.stack([np.minimum(x, y), np.maximum(x, y)]))
                    n += len(i)
                if n > 1_000_000:
                    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                    yield _batch([("a", pairs[0], pa.int64()), ("b", pairs[1], pa.int64())])
                    found, n = [], 0
            if found:
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                yield _batch([("a", pairs[0], pa.int64()), ("b", pairs[1], pa.int64())])

        for batch in batches:
            c = {name: batch.column(name).to_numpy() for name in ("key", "cid", "n", "common", "root", "side")}
            c["brief"] = np.frombuffer(b"".join(batch.column("brief").to_pylist()), np.uint8).reshape(-1, SHORT_BINS)
            held = c if held is None else {k: np.concatenate([held[k], c[k]]) for k in c}
            # the last run may go on in the next batch
            cut = int(np.searchsorted(held["key"], held["key"][-1])) if len(held["key"]) else 0
            if cut > 100_000:
                yield from emit({k: v[:cut] for k, v in held.items()})
                held = {k: v[cut:] for k, v in held.items()}
        if held is not None:
            yield from emit(held)

    return tidied(run)


def _possible(percent: int):
    """Pairs whose sizes and histograms allow the link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("xn").to_numpy() + batch.column("yn").to_numpy()
            most = np.array([np.minimum(_counts(x.as_py()), _counts(y.as_py())).sum() for x, y in zip(batch.column("x"), batch.column("y"))], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(100 * most >= percent * (total - most), pa.bool_()))

    return tidied(run)


DESCRIBED = "doc_id long, cid long, n long, part int, sketch binary, slice long, twice boolean, values binary"


def _describe(size: int):
    """A row (doc_id, cid, n) for each text. Besides, the task's part of the frequency sketch in PARTS rows; and its token
    hashes, cut to 32 bits: a row for each of SLICES, sorted, as differences in two bytes or more. Those that two classes
    of the task hold come once more, with `twice`."""
    names = [x.split()[0] for x in DESCRIBED.split(", ")]
    types = dict(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.binary())))

    def rows(number: int, **columns) -> pa.RecordBatch:
        return _batch([(k, columns.get(k, pa.nulls(number, types[k])), types[k]) for k in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(COUNTERS, np.int32)
        held, waiting, seen, any_ = [], 0, Seen(), False

        def flush() -> pa.RecordBatch:
            values, count = np.unique(np.concatenate(held), return_counts=True)
            found = []
            for twice, v in ((False, values), (True, values[count > 1])):
                v = v.astype(np.int64)
                edges = np.searchsorted(v, np.arange(SLICES + 1) << (32 - SLICE_BITS))
                found += [(b, twice, _narrow(np.diff(v[edges[b] : edges[b + 1]], prepend=b << (32 - SLICE_BITS)))) for b in range(SLICES) if edges[b + 1] > edges[b]]
            return rows(len(found), slice=[r[0] for r in found], twice=[r[1] for r in found], values=[r[2] for r in found])

        for batch in batches:
            cid, n = [], []
            for _, tokens in token_sets(batch.column("text"), size):
                cid.append(class_id(tokens) if len(tokens) else None)
                n.append(len(tokens))
                np.add.at(sketch, (tokens & _U(COUNTERS - 1)).astype(np.int64), 1)
                any_ = True
                if len(tokens) and seen.new(cid[-1]):
                    held.append((tokens >> _U(32)).astype(np.uint32))
                    waiting += len(tokens)
                    if waiting > HELD_TOKENS:
                        yield flush()
                        held, waiting = [], 0
            yield rows(len(n), doc_id=batch.column("doc_id"), cid=cid, n=n)
        if held:
            yield flush()
        if any_:
            parts = [zlib.compress(np.minimum(p, 65535).astype(np.uint16).tobytes(), 1) for p in np.split(sketch, PARTS)]
            yield rows(PARTS, part=list(range(PARTS)), sketch=parts)

    return tidied(run)


class Seen:
    """Whether a class is new to a task, as far as remembered: what is said to be new twice is only done twice."""

    def __init__(self):
        self.known: set[int] = set()

    def new(self, cid: int) -> bool:
        if cid in self.known:
            return False
        if len(self.known) < REMEMBERED:
            self.known.add(cid)
        return True


def _narrow(values: np.ndarray) -> bytes:
    width = 2 if values.max(initial=0) < 1 << 16 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _shared(part: pa.Table) -> pa.Table:
    """A slice's tokens that stand in more than one class, as a bitmap; each bit stands for FOLD neighbouring hashes."""
    number = part.column("slice")[0].as_py()
    seen, twice = np.zeros(1 << (32 - SLICE_BITS), bool), np.zeros(1 << (32 - SLICE_BITS), bool)
    for again, values in zip(part.column("twice").to_pylist(), part.column("values")):
        data = values.as_py()
        at = np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1), dtype=np.int64)
        if again:
            twice[at] = True
        else:
            twice[at] |= seen[at]
            seen[at] = True
    bits = np.packbits(twice.reshape(-1, FOLD).any(axis=1), bitorder="little")
    return pa.table({"slice": pa.array([number], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})


def _add_sketches(part: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // PARTS, np.int64)
    for x in part.column("sketch"):
        total += np.frombuffer(zlib.decompress(x.as_py()), np.uint16)
    return pa.table({"part": pa.array(part.column("part")[:1].to_pylist(), pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def levels_of(counts: np.ndarray, mean: float) -> np.ndarray:
    """The frequency class of each counter: 0 for rare tokens, then one for each doubling above the mean of all."""
    over = (counts - mean - 6 * np.sqrt(mean)) / FREQUENT
    return np.where(over < 1, 0, 1 + np.floor(np.log2(np.maximum(over, 1)))).astype(np.uint8)


def prefix_entries(tokens: np.ndarray, level: np.ndarray, shared: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The index keys of a text with these tokens (sorted), their frequency classes, and whether others may hold them.
    Tokens that no other class holds come first and need no entry."""
    n = len(tokens)
    order = np.lexsort((tokens, level, shared))
    tokens, level, shared = tokens[order], level[order], shared[order]
    short = n - -(-percent * n // 100) + 1
    if n < 2:
        return tokens[:0]  # one like it has the same token, and so is the same class
    keys = []
    # a partner may be smaller or larger; the group count goes by the smaller one's size, so a text takes part under
    # every group count that its partners of a smaller size have
    for groups in sorted({group_count(n), group_count(-(-percent * n // 100))}):
        size = min(n, short + groups)
        rare = (level[:size] == 0) & shared[:size]
        keys.append(tokens[:size][rare])
        frequent = tokens[:size][(level[:size] > 0) & shared[:size]]
        if len(frequent) > 1:
            group = mix(frequent) % _U(groups)
            order = np.lexsort((frequent, group))
            frequent, group = frequent[order], group[order]
            edges = np.flatnonzero(np.diff(group, prepend=group[:1] + _U(1), append=group[-1:] + _U(1)))
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    i, j = np.triu_indices(b - a, 1)
                    keys.append(mix(mix(frequent[a + i] + _U(groups)) ^ frequent[a + j]))
    return np.unique(np.concatenate(keys))


def group_count(n: int) -> int:
    """The extension e of the prefix, and the number of groups, of a text with n tokens: a power of two."""
    return max(1, (1 << max(0, n.bit_length() - 1)) // GROUP_TOKENS)


INDEXED = "bucket long, keys binary, cids binary, ns binary, common binary, cid long, n long, hist binary, brief binary"


def _index(levels, shared, buckets: int, size: int, percent: int):
    """Rows (bucket, keys, cids, ns, common) of the index entries of the classes that a task meets, and a row (cid, n,
    hist, brief) of each class that has an entry."""
    names = [x.split()[0] for x in INDEXED.split(", ")]
    types = dict(zip(names, (pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64(), pa.binary(), pa.binary())))

    def rows(number: int, **columns) -> pa.RecordBatch:
        return _batch([(k, columns.get(k, pa.nulls(number, types[k])), types[k]) for k in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, several, seen = np.frombuffer(levels.value, np.uint8), np.frombuffer(shared.value, np.uint8), Seen()
        keys, cids, ns, common, hists, briefs, held = [], [], [], [], [], [], 0

        def flush():
            k = np.concatenate(keys)
            sizes = np.array([len(x) for x in keys])
            c, n, m = (np.repeat(np.array(v, t), sizes) for v, t in ((cids, np.int64), (ns, np.int32), (common, np.float32)))
            bucket = (mix(k) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            found = [(b, order[edges[b] : edges[b + 1]]) for b in range(buckets) if edges[b + 1] > edges[b]]
            yield rows(len(found), bucket=[b for b, _ in found], **{name: [v[o].tobytes() for _, o in found] for name, v in (("keys", k), ("cids", c), ("ns", n), ("common", m))})
            yield rows(len(cids), cid=cids, n=ns, hist=hists, brief=briefs)

        for batch in batches:
            for _, tokens in token_sets(batch.column("text"), size):
                if not len(tokens) or not seen.new(cid := class_id(tokens)):
                    continue
                own = level[(tokens & _U(COUNTERS - 1)).astype(np.int64)]
                at = (tokens >> _U(32)).astype(np.int64) // FOLD
                others = (several[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                found = prefix_entries(tokens, own, others, percent)
                if not len(found):
                    continue
                keys.append(found)
                cids.append(cid)
                ns.append(len(tokens))
                common.append(float(own.mean()))
                hists.append(histogram(tokens[others]))
                briefs.append(short_histogram(tokens[others]))
                held += len(found)
                if held > HELD_ENTRIES:
                    yield from flush()
                    keys, cids, ns, common, hists, briefs, held = [], [], [], [], [], [], 0
        if held:
            yield from flush()

    return tidied(run)


ENTRY = "key long, cid long, n int, common float"


def _entries(part: pa.Table) -> pa.Table:
    """The entries of a bucket whose key more than one class has."""
    read = lambda name, t: np.concatenate([np.frombuffer(x.as_py(), t) for x in part.column(name)])
    key, cid, n, common = read("keys", np.int64), read("cids", np.int64), read("ns", np.int32), read("common", np.float32)
    order = np.lexsort((cid, key))
    key, cid, n, common = key[order], cid[order], n[order], common[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])  # a class may come from several tasks
    key, cid, n, common = key[new], cid[new], n[new], common[new]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    run = np.cumsum(first) - 1
    many = np.bincount(run)[run] > 1 if len(key) else np.zeros(0, bool)
    return pa.table({"key": key[many], "cid": cid[many], "n": n[many], "common": common[many]})


def _sets(wanted, size: int):
    """Token sets of the classes whose bit is set, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(wanted.value, np.uint8), Seen()
        for batch in batches:
            cids, sets = [], []
            for _, tokens in token_sets(batch.column("text"), size):
                if not len(tokens):
                    continue
                cid = class_id(tokens)
                at = cid & (len(bits) * 8 - 1)
                if bits[at >> 3] >> (at & 7) & 1 and seen.new(cid):
                    cids.append(cid)
                    sets.append(tokens.tobytes())
            yield _batch([("cid", cids, pa.int64()), ("tokens", sets, pa.binary())])

    return tidied(run)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return tidied(run)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's ids as a bitmap, in PARTS."""
    bits = np.zeros(COUNTERS, bool)
    for batch in batches:
        bits[batch.column("cid").to_numpy() & (COUNTERS - 1)] = True
    packed = np.packbits(bits, bitorder="little")
    yield _batch([("part", list(range(PARTS)), pa.int32()), ("bits", [p.tobytes() for p in np.split(packed, PARTS)], pa.binary())])


def _or_bits(part: pa.Table) -> pa.Table:
    total = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in part.column("bits")])
    return pa.table({"part": pa.array(part.column("part")[:1].to_pylist(), pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})


def _gathered(rows: list, width: int) -> bytes:
    """The parts of a sketch in order; missing ones (an empty corpus) are zero."""
    found = {r[0]: bytes(r[1]) for r in rows}
    return b"".join(found.get(p, bytes(width)) for p in range(PARTS))


def _prepared(docs: DataFrame, size: int, percent: int):
    """Rows (doc_id, cid, n) of docs, index entries with sizes and short histograms (each class its own root), the number
    of buckets, and what verifies pairs of classes."""
    sc = docs.sparkSession.sparkContext
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = staged(docs.mapInArrow(_describe(size), DESCRIBED), "jaccard-docs")
    rows = described.filter("part is null and slice is null").select("doc_id", "cid", "n")
    # counters and bitmaps below have a fixed size (8 bytes and 1 bit for each of COUNTERS), whatever the corpus
    summed = described.filter("part is not null").select("part", "sketch").groupBy("part").applyInArrow(_add_sketches, "part int, counts binary")
    counts = {r[0]: np.frombuffer(r[1], np.int64) for r in summed.collect()}
    total = sum(int(c.sum()) for c in counts.values())
    # part by part, as the driver would hold several numbers for each counter otherwise
    none = np.zeros(COUNTERS // PARTS, np.int64)
    levels = sc.broadcast(b"".join(levels_of(counts.get(p, none), total / COUNTERS).tobytes() for p in range(PARTS)))
    del counts
    buckets = max(64, total // 500_000)
    # of a fixed size too, and as whole: a bit is set wherever a token may stand in two classes
    once = described.filter("slice is not null").select("slice", "twice", "values")
    found = {r[0]: bytes(r[1]) for r in once.groupBy("slice").applyInArrow(_shared, "slice long, bits binary").collect()}
    shared = sc.broadcast(b"".join(found.get(b, bytes((1 << (32 - SLICE_BITS)) // FOLD // 8)) for b in range(SLICES)))
    indexed = staged(docs.select("text").mapInArrow(_index(levels, shared, buckets, size, percent), INDEXED), "jaccard-indexed")
    packed = indexed.filter("bucket is not null").select("bucket", "keys", "cids", "ns", "common")
    entries = staged(packed.groupBy("bucket").applyInArrow(_entries, ENTRY), "jaccard-index")

    hists = indexed.filter("cid is not null").groupBy("cid").agg(F.max("n").alias("n"), F.max("hist").alias("hist"), F.max("brief").alias("brief"))
    hists = staged(hists.join(entries.select("cid").distinct(), "cid", "left_semi"), "jaccard-histograms")

    def both_sides(pairs: DataFrame, of: DataFrame, value: str, *more: str) -> DataFrame:
        x = pairs.join(of.select(F.col("cid").alias("a"), F.col(value).alias("x"), *[F.col(m).alias(f"x{m}") for m in more]), "a")
        return x.join(of.select(F.col("cid").alias("b"), F.col(value).alias("y"), *[F.col(m).alias(f"y{m}") for m in more]), "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that link. Histograms leave few of the others; for what they leave, the token sets are
        made anew from the texts, each class once a task, by a bitmap of the classes that are asked for."""
        left = staged(both_sides(pairs, hists, "hist", "n").mapInArrow(_possible(percent), "a long, b long"), "jaccard-possible")
        asked = left.select(F.col("a").alias("cid")).union(left.select("b"))
        parts = asked.mapInArrow(_bits, "part int, bits binary").groupBy("part").applyInArrow(_or_bits, "part int, bits binary").collect()
        bits = sc.broadcast(_gathered(parts, COUNTERS // PARTS // 8))
        sets = docs.select("text").mapInArrow(_sets(bits, size), "cid long, tokens binary")
        sets = staged(sets.groupBy("cid").agg(F.first("tokens").alias("tokens")), "jaccard-sets")
        return both_sides(left, sets, "tokens").mapInArrow(_verify(percent), "a long, b long")

    # one row of 88 bytes an index entry from here on; the entries of one key meet in one task, sorted
    left = staged(entries.join(hists.select("cid", "brief"), "cid").withColumn("root", F.col("cid")), "jaccard-entries")
    return rows, left, buckets, verified


def _in_blocks(entries: DataFrame) -> DataFrame:
    """entries for a comparison of all with all: a key of more than BLOCK_RUN rows is cut into blocks of about as many, by
    the class, and each pair of blocks is a key of its own, in which the blocks are the sides 0 and 1. So what one key
    takes, which grows with the square of its rows, is dealt over as many tasks as it needs. (Two keys that fall on one
    64-bit hash would only be compared with one another too.)"""
    # at most one row for BLOCK_RUN entries
    long = entries.groupBy("key").count().filter(F.col("count") > BLOCK_RUN).select("key", F.ceil(F.col("count") / BLOCK_RUN).cast("int").alias("_m"))
    m = F.coalesce("_m", F.lit(1))
    own = entries.join(F.broadcast(long), "key", "left").withColumn("_own", F.pmod(F.xxhash64("cid"), m).cast("int"))
    cells = own.withColumn("_other", F.explode(F.sequence(F.lit(0), m - 1)))
    key = F.when(m > 1, F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))).otherwise(F.col("key"))
    return cells.select(key.alias("key"), "cid", "n", "common", "root", "brief", (F.col("_own") > F.col("_other")).cast("int").alias("side"))


def link_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text): shingles of `size` words, links from a
    Jaccard similarity of `percent` hundredths.

    Null and empty texts have no shingles and are linked with nothing. Repeated rows and ids each keep a row; a null
    id never names a component others have ids for, and is the component's id where no row has one. Very long texts
    count whole. Other columns play no part; an empty table gives an empty table."""
    spark = docs.sparkSession
    rows, left, buckets, verified = _prepared(docs, size, percent)
    links = roots = None
    first, turn, mode = 0, 0, "first"
    while True:
        run = _in_blocks(left) if mode == "rest" else left.withColumn("side", F.lit(0))
        sorted_ = run.repartition(max(8, buckets // 32), "key").sortWithinPartitions("key", "side")
        pairs = sorted_.mapInArrow(_run_pairs(mode, turn, percent), "a long, b long").distinct()
        new = staged(verified(pairs), "jaccard-links")
        found = new.count()
        if found:
            links = new if links is None else links.unionByName(new)
            roots = connected(links)
        if mode == "rest":
            break
        first = first or found
        turn += 1
        mode = "rest" if turn > 1 and found <= WORTH * first or turn >= PIVOT_ROUNDS else "pivot"
        # long entries whose classes aren't all in one component
        at = left if roots is None else left.drop("root").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        mixed = at.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("_n")).filter((F.col("_a") != F.col("_b")) & (F.col("_n") > LONG_RUN)).select("key")
        left = staged(at.join(mixed, "key", "left_semi"), "jaccard-left")
        if not left.limit(1).count():
            break

    # the smallest id of each class, and then of each component
    classes = rows.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
    roots = roots if roots is not None else spark.createDataFrame([], "node long, root long")
    at = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = at.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(at.join(least, "root").select("cid", "component_id"), "jaccard-named")
    return rows.join(named, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def all_links(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links between classes, (a, b) with a < b, and the class of each row: (doc_id, cid, n), without one where a
    text has no shingles. Rows of one class are linked too. There are as many links as near copies have pairs."""
    rows, entries, buckets, verified = _prepared(docs, size, percent)
    sorted_ = _in_blocks(entries).repartition(max(8, buckets // 32), "key").sortWithinPartitions("key", "side")
    return staged(verified(sorted_.mapInArrow(_run_pairs("all", 0, percent), "a long, b long").distinct()), "jaccard-all-links"), rows


def link_counts(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_links for every row of docs(doc_id, text): with how many other rows it is linked."""
    links, rows = all_links(docs, size, percent)
    classes = rows.filter("cid is not null").groupBy("cid").agg(F.count("*").alias("_k"))
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(classes.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("_k").alias("_near"))
    counts = classes.join(near, "cid", "left").select("cid", (F.col("_k") - 1 + F.coalesce("_near", F.lit(0))).alias("n_links"))
    return rows.join(counts, "cid", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose id names their component, so one of each, with their columns. Rows without an id stay;
    of rows with one id and text one stays."""
    named = link_components(docs, size, percent).filter("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    kept = rows.join(named, "doc_id", "left_semi").dropDuplicates(["doc_id", "h"])
    return kept.unionByName(rows.filter("doc_id is null")).select("row.*")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(documents(spark, sf_dir))


#: All pairs that share a shingle, and the links' closure: for tables of a size that a comparison by SQL is meant for.
OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
h AS (SELECT g.doc_id, g.k, n.n FROM g JOIN n USING (doc_id)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n AS total, count(*) AS common FROM h x JOIN h y ON x.k = y.k AND x.doc_id < y.doc_id AND 100 * x.n >= 85 * y.n AND 100 * y.n >= 85 * x.n GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (total - common) UNION ALL SELECT b, a FROM p WHERE 100 * common >= 85 * (total - common)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.b), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
