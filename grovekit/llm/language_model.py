"""A language model in an Elias-Fano n-gram trie.

Level 1 holds the words (by 64-bit hash), level k the k-grams that occur `least` times or more, in the order of the
place that their first k-1 words have in the level before, and of the number of their last word. Beside each entry of a
level stands a pointer to where its successors begin in the next one. Pointers are monotone and stored in Elias-Fano
form (low bits packed, high bits in unary with a directory for select). So are the entries: a word number relative to
its context, made monotone by the place where the context's successors begin. An entry is found by its context's range
and the successor search within it; a context without successors needs no search. Beside each entry stand its discounted
probability and the weight that its own successors leave to the shorter context, on a grid of 16 bits.

A level lies in parts, each a stretch of that order, which scorers map into memory. The number of parts follows the
size of the corpus, and stretches have about equally many tokens; a very frequent context is split between parts.
Counts are made level by level: a k-gram is counted only where both its (k-1)-grams are in the level before, which
loses none that occurs `least` times. Each task combines its own counts and sends one packed piece to each part."""

from __future__ import annotations

import functools
import io
import os
import tempfile
import urllib.parse
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm.common import documents, filesystem, fold, scratch, staged, text_batches, tidied
from grovekit.llm.hashing import blocks, mix, word_hashes

ORDER = 3
DISCOUNT = 0.6
#: How often a bigram or trigram occurs at least to be kept, unless a caller says otherwise. 1 keeps all.
LEAST_COUNT = 2
#: Steps of a quantised logarithm to the base 10; values are rounded down, so that no sum exceeds 1.
STEPS = 6000
#: Tokens whose n-grams a task holds before it combines their counts.
HELD_TOKENS = 3_000_000
#: Tokens that are looked up together, about.
RUN_TOKENS = 600_000
#: Bytes of text for each part of a level, about, and parts at least.
PART_BYTES, LEAST_PARTS = 16 << 20, 16
_U = np.uint64
END = int(mix(np.array([0x656E64], _U))[0])
_NONE = np.iinfo(np.int64).max


# ---- Elias-Fano ----------------------------------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence of unsigned 64-bit integers below `top`; distinct ones where find() is used."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.l, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        l = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> _U(l)).astype(np.int64) if l < 64 else np.zeros(n, np.int64)
        bits = np.zeros(n + int(top >> l) + 2 + 64, np.uint8)
        bits[high + np.arange(n)] = 1
        bits = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
        words = np.packbits(bits, bitorder="little").view(_U)
        zeros = np.cumsum(64 - np.bitwise_count(words).astype(np.int64))
        low = np.zeros(n * l // 64 + 2, _U)
        if l:
            part = values & _U((1 << l) - 1)
            at = np.arange(n, dtype=np.int64) * l
            shift = (at & 63).astype(_U)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = (at & 63) + l > 64
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (_U(64) - shift[over]))
        return cls(n, l, low, words, zeros.astype(np.uint32 if zeros[-1] < 1 << 32 else np.int64))

    def low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), _U)
        at = i * self.l
        word, shift = at >> 6, (at & 63).astype(_U)
        x = (self.low[word] >> shift) | np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return x & _U((1 << self.l) - 1)

    @staticmethod
    def _in_word(word: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Where the need-th set bit of each word stands, by halves."""
        base = np.zeros(len(need), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(word & _U((1 << half) - 1)).astype(np.int64)
            skip = n <= need
            need = np.where(skip, need - n, need)
            base += skip * half
            word = np.where(skip, word >> _U(half), word & _U((1 << half) - 1))
        return base

    def select0(self, h: np.ndarray) -> np.ndarray:
        """Where the h-th zero (from 0) of the high bits stands."""
        word = np.searchsorted(self.zeros, h.astype(self.zeros.dtype), "right")
        need = h - np.where(word > 0, self.zeros[np.maximum(word - 1, 0)], 0).astype(np.int64)
        return (word << 6) + self._in_word(~self.high[word], need)

    @functools.cached_property
    def ones(self) -> np.ndarray:
        """How many ones stand in the high bits up to the end of each word; for access() alone."""
        return ((np.arange(1, len(self.zeros) + 1, dtype=np.int64) << 6) - self.zeros).astype(self.zeros.dtype)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        return self.access_two(i, False)[0]

    def access_two(self, i: np.ndarray, next_too: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The values at the places i and i + 1."""
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right")
        need = i - np.where(word > 0, self.ones[np.maximum(word - 1, 0)], 0).astype(np.int64)
        bit = self._in_word(self.high[word], need)
        value = (((word << 6) + bit - i) << self.l) + self.low_at(i).astype(np.int64)
        if not next_too:
            return value, value
        # the next one mostly stands in the same word
        ahead = self.high[word] >> bit.astype(_U) >> _U(1)
        more = np.bitwise_count((ahead & (~ahead + _U(1))) - _U(1)).astype(np.int64)
        after = (((word << 6) + bit + 1 + more - (i + 1)) << self.l) + self.low_at(i + 1).astype(np.int64)
        if (far := np.flatnonzero(ahead == 0)).size:
            after[far] = self.access(i[far] + 1)
        return value, after

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1: the first entry of the range of its high bits that is not below it."""
        if not self.n:
            return np.full(len(values), -1, np.int64)
        high = (values >> _U(self.l)).astype(np.int64) if self.l < 64 else np.zeros(len(values), np.int64)
        at = np.where(high > 0, self.select0(np.maximum(high - 1, 0)) + 1, 0)
        begin = at - high
        # the ones from there to the next zero; runs that leave the word are looked up by select
        ahead = ~self.high[at >> 6] >> (at & 63).astype(_U)
        end = begin + np.bitwise_count((ahead & (~ahead + _U(1))) - _U(1))
        if (far := np.flatnonzero(ahead == 0)).size:
            end[far] = self.select0(high[far]) - high[far]
        low = values & _U((1 << self.l) - 1)
        out = np.full(len(values), -1, np.int64)
        # the first entry of the range that is not below the value: a frequent context has many in one range
        stop = end.copy()
        todo = np.flatnonzero(begin < end)
        while len(todo):
            middle = (begin[todo] + end[todo]) >> 1
            below = self.low_at(middle) < low[todo]
            begin[todo[below]] = middle[below] + 1
            end[todo[~below]] = middle[~below]
            todo = todo[begin[todo] < end[todo]]
        at = np.flatnonzero(begin < stop)
        hit = at[self.low_at(begin[at]) == low[at]]
        out[hit] = begin[hit]
        return out

    def save(self) -> dict[str, np.ndarray]:
        return {"head": np.array([self.n, self.l], np.int64), "low": self.low, "high": self.high, "zeros": self.zeros}


# ---- files ---------------------------------------------------------------------------------------------------------


def _put(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes <name>.<array>.npy files; a task that runs again writes the same bytes."""
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    for key, a in arrays.items():
        out = io.BytesIO()
        np.save(out, a)
        path, own = f"{base}/{name}.{key}.npy", f"{base}/{name}.{key}.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(out.getbuffer())
        fs.move(own, path)


@functools.lru_cache(maxsize=30_000)
def _get(folder: str, name: str) -> np.ndarray:
    """A file mapped into memory; where the folder is no mounted one, a copy of it on the executor."""
    if folder.startswith("file:"):
        path = urllib.parse.unquote(urllib.parse.urlparse(folder).path) + f"/{name}.npy"
    else:
        path = os.path.join(tempfile.gettempdir(), f"{urllib.parse.quote(folder, safe='')}-{name}.npy")
        if not os.path.exists(path):
            fs, base = filesystem(folder)
            own = f"{path}.{uuid.uuid4().hex}"
            with fs.open_input_stream(f"{base}/{name}.npy") as f, open(own, "wb") as g:
                g.write(f.read())
            os.replace(own, path)
    return np.load(path, mmap_mode="r").view(np.ndarray)


def _grid(p: np.ndarray) -> np.ndarray:
    """Probabilities on the grid of logarithms, rounded down; 65535 stands for 0."""
    with np.errstate(divide="ignore"):
        steps = np.ceil(-np.log10(p) * STEPS - 1e-9)
    return np.where(p > 0, np.clip(steps, 0, 65534), 65535).astype(np.uint16)


_TABLE = np.append(10.0 ** (-np.arange(65535) / STEPS), 0.0)


class Trie:
    """The model in `folder`; every level in `parts` parts. What the driver sends to tasks is a few numbers for each part:
    how many entries a part of a level has (sizes) and how many tokens they count (mass), the first entry of each
    (firsts), and where the successors of a part's entries begin in the next level (begins)."""

    def __init__(self, folder: str, parts: int, least: int):
        self.folder, self.parts, self.least = folder, parts, least
        self.sizes: list[list[int]] = []
        self.mass: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.begins: list[np.ndarray] = []
        self.offsets: list[np.ndarray] = []
        self.vocabulary = self.tokens = self.starts = 0

    def add_level(self, found: dict[int, tuple[int, int, int]]) -> None:
        """A level of parts with (entries, tokens, first entry's value)."""
        self.sizes = [*self.sizes, [found.get(b, (0, 0, 0))[0] for b in range(self.parts)]]
        self.mass = [*self.mass, np.concatenate([[0], np.cumsum([found.get(b, (0, 0, 0))[1] for b in range(self.parts)])]).astype(np.int64)]
        self.offsets = [*self.offsets, np.concatenate([[0], np.cumsum(self.sizes[-1])]).astype(np.int64)]
        firsts = [found[b][2] if self.sizes[-1][b] else None for b in range(self.parts)]
        after = 2**64 - 1
        for b in reversed(range(self.parts)):  # an empty part begins where the next one does
            after = firsts[b] = after if firsts[b] is None else firsts[b]
        self.firsts = [*self.firsts, np.array(firsts, _U)]

    def array(self, level: int, part: int, key: str) -> np.ndarray:
        return _get(self.folder, f"{level}-{part}.{key}")

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "opened"}

    def coded(self, level: int, part: int, prefix: str = "") -> EliasFano:
        opened = self.__dict__.setdefault("opened", {})
        if (level, part, prefix) not in opened:
            head = self.array(level, part, f"{prefix}head")
            opened[level, part, prefix] = EliasFano(int(head[0]), int(head[1]), *(self.array(level, part, prefix + k) for k in ("low", "high", "zeros")))
        return opened[level, part, prefix]

    def value(self, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """What a k-gram is sorted by: its context's place, and its last word's number."""
        return parents.astype(_U) * _U(self.vocabulary + 1) + words.astype(_U)

    def part_of(self, level: int, values: np.ndarray) -> np.ndarray:
        """The part of each of the sorted values while a level is counted. Words: by the high bits of their hash. n-grams:
        by how many tokens the contexts before theirs count and, of their own context's, by the word's number."""
        if level == 1:
            return ((values >> _U(32)) * _U(self.parts) >> _U(32)).astype(np.int64)
        parents, words = (values // _U(self.vocabulary + 1)).astype(np.int64), (values % _U(self.vocabulary + 1)).astype(float)
        before, own = np.full(len(parents), float(self.tokens)), np.full(len(parents), float(self.starts))
        if (inside := np.flatnonzero(parents < self.offsets[level - 2][-1])).size:
            before[inside], own[inside] = self.read(level - 1, parents[inside], "before"), self.read(level - 1, parents[inside], "counts")
            owner = np.searchsorted(self.offsets[level - 2], parents[inside], "right") - 1
            before[inside] += self.mass[level - 2][owner]
        total = float(self.mass[level - 2][-1] + (self.starts if level == 2 else 0))
        return np.minimum((before + own * (words / max(1, self.vocabulary))) / max(total, 1.0) * self.parts, self.parts - 1).astype(np.int64)

    def _by_part(self, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(part.astype(np.uint16) if self.parts < 65536 else part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(self.parts + 2))
        for b in np.flatnonzero(np.diff(edges)):
            yield int(b), order[edges[b] : edges[b + 1]]

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """The places of words in level 1, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        for b, at in self._by_part(self.part_of(1, hashes)):
            if self.sizes[0][b]:
                found = self.coded(1, b).find(hashes[at])
                out[at] = np.where(found >= 0, found + self.offsets[0][b], -1)
        return out

    def successors(self, level: int, places: np.ndarray, left: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Where the successors of the entries at `places` begin and end in the next level, by the level's pointers; and the
        weight that they leave."""
        begin, end, weights = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64), np.zeros(len(places), np.uint16) if left else None
        owner = np.searchsorted(self.offsets[level - 1], places, "right") - 1  # the start of a text comes after all words
        for b, at in self._by_part(owner):
            first = places[at] - self.offsets[level - 1][b]
            x, y = self.coded(level, b, "to-").access_two(first)
            begin[at], end[at] = x + self.begins[level - 1][b], y + self.begins[level - 1][b]
            if left:
                weights[at] = self.array(level, b, "left")[first]
        return begin, end, weights

    def find(self, level: int, parents: np.ndarray, words: np.ndarray, begin: np.ndarray, share: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The places of k-grams in their level, or -1, and their shares. Their contexts' successors begin at `begin`."""
        out, shares = np.full(len(parents), -1, np.int64), np.full(len(parents), 65535, np.uint16) if share else None
        part = np.searchsorted(self.firsts[level - 1], self.value(parents, words), "right") - 1
        first = np.maximum(begin - self.offsets[level - 1][part], 0)
        some = np.flatnonzero((part >= 0) & (first < np.diff(self.offsets[level - 1])[part]))
        relative = first[some].astype(_U) * _U(self.vocabulary + 1) + words[some].astype(_U)
        for b, at in self._by_part(part[some]):
            found = self.coded(level, b).find(relative[at])
            at, found = some[at[found >= 0]], found[found >= 0]
            out[at] = found + self.offsets[level - 1][b]
            if share:
                shares[at] = self.array(level, b, "share")[found]
        return out, shares

    def read(self, level: int, places: np.ndarray, key: str) -> np.ndarray:
        """What stands beside the entries at `places` (all found)."""
        out = None
        for b, at in self._by_part(np.searchsorted(self.offsets[level - 1], places, "right") - 1):
            values = self.array(level, b, key)[places[at] - self.offsets[level - 1][b]]
            out = np.zeros(len(places), values.dtype) if out is None else out
            out[at] = values
        return np.zeros(0, np.int64) if out is None else out


# ---- building ------------------------------------------------------------------------------------------------------


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, token hashes with the end of each text, where each text begins), for runs of texts of
    about RUN_TOKENS."""
    held, sizes, at = [], [], 0
    for i, data, edges in blocks(column):
        words, first = word_hashes(data, edges)
        n = len(first) - 1
        out = np.empty(len(words) + n, _U)
        ends = first[1:] + np.arange(n)
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep], out[ends] = words, _U(END)
        held.append(out)
        sizes.append(np.diff(ends, prepend=-1))
        if sum(map(len, held)) >= RUN_TOKENS:
            yield at, np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            held, sizes, at = [], [], i + n
    if held:
        yield at, np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def grams(trie: Trie, order: int, tokens: np.ndarray, begin: np.ndarray, weights: list | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Where each token's k-gram (that ends with it) stands in level k, for k from 1 to order, or -1; and the counts of
    the words. The start of a text stands before its first token as a word of its own. To `weights` are added, for each k
    from 2, the tokens with a context, what this one leaves to the shorter one, and the k-grams' shares."""
    inverse, distinct = pd.factorize(tokens)
    found = trie.words(distinct)
    counts = np.zeros(len(distinct), np.int64)
    if (hit := found >= 0).any():
        counts[hit] = trie.read(1, found[hit], "counts")
    words, counts = found[inverse], counts[inverse]
    common = counts >= trie.least
    places, scored = [words], weights is not None
    for k in range(2, order + 1):
        before = preceding(trie, k, places[-1], begin)
        at = np.flatnonzero(before >= 0)
        # runs of texts repeat words, contexts and n-grams: each that differs is looked up once
        context, contexts = pd.factorize(before[at])
        start, stop, left = trie.successors(k - 1, contexts, scored)
        look = np.flatnonzero(common[at] & (stop > start)[context])
        gram, first = _numbered(context[look] * np.int64(len(distinct) + 1) + inverse[at[look]])
        own = look[first]
        here, share = trie.find(k, before[at[own]], words[at[own]], start[context[own]], scored)
        place = np.full(len(tokens), -1, np.int64)
        place[at[look]] = here[gram]
        places.append(place)
        if scored:
            weights.append((at, left[context], at[look], share[gram]))
    return places, counts


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each value among those that differ, and where each of these stands first."""
    number, distinct = pd.factorize(values)
    first = np.empty(len(distinct), np.int64)
    first[number[::-1]] = np.arange(len(values) - 1, -1, -1)
    return number, first


def preceding(trie: Trie, k: int, places: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The context of each token's k-gram: where the (k-1)-gram before it stands, given those of level k - 1."""
    before = np.concatenate([[-1], places[:-1]])
    before[begin[:-1]] = trie.vocabulary if k == 2 else -1
    return before


PACKED = "part long, keys binary, counts binary"


def _pack(trie: Trie, level: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each part. Sorted keys go as differences, so that the exchange's compression has something to do."""
    part = trie.part_of(level, keys)
    edges = np.searchsorted(part, np.arange(trie.parts + 1))
    rows = [(b, slice(edges[b], edges[b + 1])) for b in range(trie.parts) if edges[b + 1] > edges[b]]
    packed = [_narrow(np.diff(keys[o], prepend=_U(0))) for _, o in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in rows], pa.int64()), pa.array(packed, pa.binary()), pa.array([_narrow(counts[o].astype(_U)) for _, o in rows], pa.binary())],
        ["part", "keys", "counts"],
    )


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned integers in as many byte planes as the largest needs, after their number."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _widen(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8")[:, 0].astype(_U)


def _count(trie: Trie, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _pack(trie, level, keys, counts)

        for batch in batches:
            for _, tokens, begin in _tokens(batch.column("text")):
                if level == 1:
                    keys = tokens
                else:
                    places, counts = grams(trie, level - 1, tokens, begin)
                    words, context = places[0], preceding(trie, level, places[-1], begin)
                    # the (k-1)-gram that ends with the token must be known too
                    usable = (context >= 0) & (places[-1] >= 0) & (counts >= trie.least)
                    keys = trie.value(context[usable], words[usable])
                held.append(keys)
                n += len(keys)
                if n >= HELD_TOKENS:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return tidied(run)


def _merge(trie: Trie, level: int):
    """Counts of a part; its entries as a file; and for the contexts how many entries they have and what these take, by the
    context's part."""

    def run(part: pa.Table) -> pa.Table:
        number = part.column("part")[0].as_py()
        keys = np.concatenate([np.cumsum(_widen(x.as_py()), dtype=_U) for x in part.column("keys")])
        counts = np.concatenate([_widen(x.as_py()) for x in part.column("counts")]).astype(np.int64)
        keys, back = np.unique(keys, return_inverse=True)
        counts = np.bincount(back, counts).astype(np.int64)
        tokens, rows = int(counts.sum()), []
        if level == 1:
            arrays = EliasFano.of(keys, 1 << 64).save()
        else:
            keep = counts >= trie.least
            keys, counts = keys[keep], counts[keep]
            tokens = int(counts.sum())
            context = (keys // _U(trie.vocabulary + 1)).astype(np.int64)
            places, begin, at, entries = np.unique(context, return_index=True, return_inverse=True, return_counts=True)
            relative = begin[at].astype(_U) * _U(trie.vocabulary + 1) + keys % _U(trie.vocabulary + 1)
            arrays = EliasFano.of(relative, max(1, len(keys)) * (trie.vocabulary + 1)).save()
            whole = np.full(len(places), trie.starts, np.int64)
            if (inside := np.flatnonzero(places < trie.offsets[level - 2][-1])).size:
                whole[inside] = trie.read(level - 1, places[inside], "counts")
            share = (counts - DISCOUNT) / np.maximum(whole, 1)[at]
            arrays["share"] = _grid(share)
            taken = np.bincount(at, share, minlength=len(places))
            owner = np.searchsorted(trie.offsets[level - 2], places, "right") - 1
            edges = np.searchsorted(owner, np.arange(trie.parts + 2))
            rows = [(b, *(x[edges[b] : edges[b + 1]].tobytes() for x in (places, taken, entries.astype(np.int64))), 0, 0, 0) for b in range(trie.parts + 1) if edges[b + 1] > edges[b]]
        arrays |= {"counts": counts, "before": np.cumsum(counts) - counts}
        _put(trie.folder, f"{level}-{number}", arrays)
        first = int(keys[:1].view(np.int64)[0]) if len(keys) else 0
        rows.append((-1 - number, b"", b"", b"", len(keys), tokens, first))
        names = ("owner", "places", "taken", "successors", "entries", "tokens", "first")
        types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))})

    run.__annotations__ = {"part": pa.Table, "return": pa.Table}
    return run


def _leave(trie: Trie, level: int):
    """For the entries of a part of `level`: the weight that their successors leave to the shorter context, and the pointers
    to where these begin, as files. A row (owner, successors)."""

    def run(part: pa.Table) -> pa.Table:
        owner = part.column("owner")[0].as_py()
        column = lambda name, t: np.concatenate([np.frombuffer(x.as_py(), t) for x in part.column(name)])
        places = column("places", np.int64)
        n = trie.sizes[level - 1][owner] if owner < trie.parts else 1
        at = places - trie.offsets[level - 1][owner]
        taken = np.bincount(at, column("taken", float), minlength=n)
        pointers = np.concatenate([[0], np.cumsum(np.bincount(at, column("successors", np.int64), minlength=n))]).astype(_U)
        _put(trie.folder, f"{level}-{owner}", {"left": _grid(np.maximum(1.0 - taken, 0.0))} | _pointers(pointers))
        return pa.table({"owner": pa.array([owner], pa.int64()), "successors": pa.array([int(pointers[-1])], pa.int64())})

    run.__annotations__ = {"part": pa.Table, "return": pa.Table}
    return run


def _pointers(values: np.ndarray) -> dict[str, np.ndarray]:
    return {f"to-{k}": v for k, v in EliasFano.of(values, int(values[-1]) + 1).save().items()}


MERGED = "owner long, places binary, taken binary, successors binary, entries long, tokens long, first long"


def build(texts: DataFrame, order: int = ORDER, parts: int | None = None, least: int = LEAST_COUNT) -> Trie:
    """A model of the texts in df(text), of n-grams that occur `least` times or more (1: all; words always are).

    A null text is an empty one, which is an end alone. Repeated rows count each; very long texts count whole; other
    columns play no part. From an empty table comes a model that knows no word. Without `parts` their number follows the
    size of the texts. The driver holds a few numbers for each part and level."""
    spark = texts.sparkSession
    text_batches(spark)
    texts = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    starts, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    trie = Trie(scratch(spark, "trie"), parts or max(LEAST_PARTS, -(-size // PART_BYTES)), least)
    trie.starts = starts
    for level in range(1, order + 1):
        packed = texts.mapInArrow(_count(trie, level), PACKED)
        merged = staged(packed.groupBy("part").applyInArrow(_merge(trie, level), MERGED), f"trie-level-{level}")
        found = {-1 - r["owner"]: (r["entries"], r["tokens"], r["first"] % 2**64) for r in merged.filter("owner < 0").select("owner", "entries", "tokens", "first").collect()}
        if level == 1:
            trie.tokens, trie.vocabulary = sum(t for _, t, _ in found.values()), sum(n for n, _, _ in found.values())
        else:
            left = merged.filter("owner >= 0").groupBy("owner").applyInArrow(_leave(trie, level - 1), "owner long, successors long")
            have = {r[0]: r[1] for r in left.collect()}
            for b in range(trie.parts + (level == 2)):
                n = trie.sizes[level - 2][b] if b < trie.parts else 1
                if b not in have and n:  # none of the part's entries has a successor: no weight is taken
                    _put(trie.folder, f"{level - 1}-{b}", {"left": np.zeros(n, np.uint16)} | _pointers(np.zeros(n + 1, _U)))
            trie.begins = [*trie.begins, np.concatenate([[0], np.cumsum([have.get(b, 0) for b in range(trie.parts + 1)])]).astype(np.int64)]
        trie.add_level(found)
    return trie


# ---- scoring -------------------------------------------------------------------------------------------------------


def token_scores(trie: Trie, order: int, tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: known or not, log10 of the base probability, log10 of the model's."""
    weights: list = []
    places, counts = grams(trie, order, tokens, begin, weights)
    base = (counts + 0.5) / (trie.tokens + 0.5 * (trie.vocabulary + 1))
    p = base.copy()
    for at, left, looked, share in weights:
        p[at] *= _TABLE[left]
        p[looked] += _TABLE[share]
    known = places[0] >= 0
    return known, np.log10(base), np.log10(np.maximum(p, 1e-300))


def _score(trie: Trie, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for _, tokens, begin in _tokens(batch.column("text")):
                known, base, model = token_scores(trie, order, tokens, begin)
                columns[0].append(np.diff(begin))
                for c, values in zip(columns[1:], (known.astype(np.int64), base, model)):
                    c.append(np.add.reduceat(values, begin[:-1]))
            n_tokens, n_known, base, model = (np.concatenate(c) if c else np.empty(0) for c in columns)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(np.full(len(n_tokens), trie.tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64())],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return tidied(run)


def score_texts(docs: DataFrame, trie: Trie, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of df(doc_id, text, held_out).

    A null or empty text is an end alone. Repeated rows score alike; very long texts are scored whole; an empty table gives
    an empty table; other columns play no part."""
    text_batches(docs.sparkSession)
    body = docs.select("doc_id", "held_out", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return body.mapInArrow(_score(trie, order), schema)


def op8_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (fold(F.col("doc_id"), 5) == 1).alias("held_out"))
    return score_texts(docs, build(docs.filter("not held_out")))
