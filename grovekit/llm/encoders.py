"""Exact encoders of public tokenizers that keep what they have seen.

Both split a text where the tokenizer itself can never join two sides, encode each distinct chunk once with
the library, and put the results together; so ids and counts are those of the library for the whole text."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import numpy as np

from grovekit.llm.common import worker_caches

#: Bytes, about, of the chunks that a process keeps; beyond it, new chunks are encoded once a batch and forgotten.
MEMORY_BYTES = 96 << 20
#: The same for ids, of which a chunk keeps more than a count.
ID_MEMORY_BYTES = 64 << 20
#: What a kept chunk takes beside its characters, about.
CHUNK_BYTES = 150


def _forget(known: dict[str, int], size: int, memory: int) -> int:
    """Takes the newest chunks out of `known` until they take `memory` bytes; what they then take."""
    while size > memory and known:
        size -= len(known.popitem()[0]) + CHUNK_BYTES
    return size


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class PieceCounter:
    """Token counts of a sentencepiece BPE model.

    A piece of the vocabulary holds the space mark only in a run at its start (checked when loaded). So BPE never
    joins across the place where a run of spaces follows something else, and a text may be cut there."""

    MARK = "▁"

    def __init__(self, path: str, memory: int = MEMORY_BYTES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.cuts = not any(self.MARK in p.lstrip(self.MARK) for p in pieces) and self._plain_spaces()
        self.memory, self.size, self.known = memory, 0, {}

    def _plain_spaces(self) -> bool:
        """The model puts one space before a text and keeps all others."""
        pieces = self.model.encode(" a  b ", out_type=str)
        return "".join(pieces) == self.MARK * 2 + "a" + self.MARK * 2 + "b" + self.MARK

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        chunks: dict[int, list[str]] = {}
        new: dict[str, None] = {}
        rest = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.cuts or self.MARK in t or "\0" in t:
                rest.append(i)
                continue
            chunks[i] = parts = t.split(" ")
            if None in map(self.known.get, parts):
                new.update((p, None) for p in parts if p not in self.known)
        if new:
            self._keep(new, self.whole(list(new)))
        for i, parts in chunks.items():
            if "" in parts:  # runs of spaces make pieces of their own
                out[i] = sum(map(self._run, *zip(*_runs(parts))))
            else:
                out[i] = sum(map(self.known.__getitem__, parts))
        for i, n in zip(rest, self.whole([texts[i] for i in rest])):
            out[i] = n
        self.size = _forget(self.known, self.size, self.memory)
        return out

    def _keep(self, chunks, counts) -> None:
        self.known.update(zip(chunks, counts))
        self.size += sum(map(len, chunks)) + CHUNK_BYTES * len(chunks)

    def _run(self, spaces: int, part: str) -> int:
        """Tokens of a run of spaces (with the one that the model adds) and what follows it."""
        if spaces == 1 and part:
            return self.known[part]
        key = " " * (spaces - 1) + part
        if not key:
            return 1
        if key not in self.known:
            self._keep([key], [len(self.model.encode(key))])
        return self.known[key]


def _runs(parts: list[str]):
    spaces = 0
    for p in parts:
        spaces += 1
        if p:
            yield spaces, p
            spaces = 0
    if spaces:
        yield spaces, ""


class WordIds:
    """Ids of a tokenizers BPE file whose pre-tokenizer takes contractions after an apostrophe, letter runs, single
    digits and runs of all other signs, drops white space, and marks the end of each with a suffix. Texts are cut at
    ASCII spaces and line ends, and around a run of ASCII signs without an apostrophe that has ASCII letters, digits
    or white space on both sides: no piece reaches across such a place, and no sign there composes with another. Each
    distinct chunk is encoded once. Chunks of ASCII letters alone end with the only suffixed id they have, so many
    of them are encoded as one text; all others are encoded one by one. A text with an added token goes whole."""

    SIGNS = re.compile(r"(?<![^A-Za-z0-9 \t\r\n])([!-&(-/:-@\[-`{-~]+)(?![^A-Za-z0-9 \t\r\n])")

    def __init__(self, path: str, memory: int = ID_MEMORY_BYTES):
        import json

        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        suffix = spec["model"]["end_of_word_suffix"]
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.cuts = bool(suffix) and not any(x["lstrip"] or x["rstrip"] or " " in x["content"] for x in spec["added_tokens"])
        self.ends = np.zeros(self.model.get_vocab_size() + 1, bool)
        for piece, i in self.model.get_vocab().items():
            self.ends[i] = bool(suffix) and piece.endswith(suffix)
        self.memory, self.size = memory, 0
        self.place: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.start = np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        plain = [p for p in new if p.isascii() and p.isalpha()]
        other = [p for p in new if not (p.isascii() and p.isalpha())]
        ids, sizes = [], []
        for i in range(0, len(plain), 500):
            part = plain[i : i + 500]
            got = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.ends[got])
            if len(at) != len(part):  # never for the files above; kept as the general way
                got = [np.array(x, np.uint32) for x in self.whole(part)]
                sizes.append(np.array([len(x) for x in got], np.int64))
                ids += got
                continue
            ids.append(got)
            sizes.append(np.diff(at, prepend=-1))
        rest = self.whole(other) if other else []
        ids += [np.array([x for row in rest for x in row], np.uint32)]
        sizes.append(np.array([len(x) for x in rest], np.int64))
        n = len(self.place)
        self.place.update(zip(plain + other, range(n, n + len(new))))
        self.size += sum(map(len, new)) + CHUNK_BYTES * len(new)
        self.flat = np.concatenate([self.flat, *ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(sizes))])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.cuts:
            return [np.array(x, np.uint32) for x in self.whole(texts)]
        apart = {i: np.array(x, np.uint32) for i in range(len(texts)) if any(x in texts[i] for x in self.added) for x in self.whole([texts[i]])}
        if apart:
            rest = iter(self.ids([t for i, t in enumerate(texts) if i not in apart]))
            return [apart[i] if i in apart else next(rest) for i in range(len(texts))]
        chunks = [self.SIGNS.sub(r" \1 ", t.replace("\n", " ")).split(" ") for t in texts]
        parts = list(itertools.chain.from_iterable(chunks))
        at = np.fromiter(map(self.place.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        if (missing := np.flatnonzero(at < 0)).size:
            absent = [parts[i] for i in missing]
            self._learn(list(dict.fromkeys(absent)))
            at[missing] = np.fromiter(map(self.place.__getitem__, absent), np.int64, len(absent))
        begin = self.start[at]
        size = self.start[at + 1] - begin
        ends = np.cumsum(size)
        index = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        flat = self.flat[index]
        ends = np.concatenate([[0], ends])
        edges = ends[np.cumsum([0, *map(len, chunks)])]
        out = [flat[a:b] for a, b in zip(edges, edges[1:])]
        if self.size > self.memory:
            self.size = _forget(self.place, self.size, self.memory)
            self.start = self.start[: len(self.place) + 1].copy()
            self.flat = self.flat[: self.start[-1]].copy()
        return out


@functools.lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """One for each worker process, so that later tasks find what earlier ones have encoded."""
    return WordIds(path)


@functools.lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


worker_caches += [word_ids.cache_clear, piece_counter.cache_clear]
