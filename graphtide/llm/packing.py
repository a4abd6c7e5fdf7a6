"""Packing into fixed windows by minimum bin slack.

A document is its token ids and a closing id; it is cut into full windows and a rest. Rests are
packed by length: the longest rest left opens a window and a bitset subset-sum dynamic programme
over the remaining lengths (bounded by their counts) finds the multiset that fills the window
closest to its capacity; counts are backtracked and the multiset is used as often as the counts
allow. If the best filling leaves slack, the next rest is cut to close it. What is left at the very
end of a task (less than one window) is cut into sequences of power-of-two lengths.

Each task packs its own share of documents, `window_tokens` at a time, and carries what does not
fill a window to the next share: no shuffle, bounded memory, and nothing to gather. The ids of a
sequence are its pieces in order of offset.

Null texts are empty: such a document is just its closing id. Every row is packed, repeated rows
and rows with a null doc_id too. An empty table gives an empty result; further columns are not used.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import column, ranges, slices, utf8

CAPACITY, END_ID, WINDOW_TOKENS, CACHED_WORDS = 2048, 1, 8_000_000, 1_600_000
_SLICE_BYTES = 8_000_000


def stem(word: str) -> tuple[str, str]:
    """A word as lower-case stem and the stop or comma behind it, where the tokenizer treats both alike; else the word itself.

    Only letters below U+0130 are touched: there lower case goes letter by letter and normalisation changes nothing.
    """
    if not word or max(word) >= "\u0130":
        return word, ""
    word = word.lower()
    return (word[:-1], word[-1]) if word[-1] in ".," and word[-2:-1].isalpha() else (word, "")


class IdStore:
    """Id lists under string keys, all in one array."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, end = len(self.index), len(self.index) + len(keys)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while end > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[first:end] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first:end] = sizes
        self.index.update(zip(keys, range(first, end), strict=True))
        self.used += len(ids)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[numbers]
        return self.flat[ranges(self.starts[numbers], sizes)], sizes


class WordIds:
    """Token ids of texts, word by word: the tokenizer never joins across a space or line feed, so each word is encoded once.

    New stems are encoded many at a time with a special token between them, which the tokenizer cuts out before anything else.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        special = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized and not t.lstrip and not t.rstrip and not t.single_word]
        self.mark = (special[-1][0], special[-1][1].content) if special else None
        self.words = IdStore()

    def _encode(self, new: list[str]) -> None:
        plain = [w for w in new if self.mark and self.mark[1] not in w]
        for at in range(0, len(plain), 64 * 256):
            groups = [plain[i : i + 64] for i in range(at, min(len(plain), at + 64 * 256), 64)]
            encoded = self.tokenizer.encode_batch_fast([self.mark[1].join(g) + self.mark[1] for g in groups], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
            cuts = np.flatnonzero(ids == self.mark[0])
            self.words.add([w for g in groups for w in g], ids[ids != self.mark[0]], np.diff(cuts, prepend=-1) - 1)
        for w in new if not self.mark else [w for w in new if self.mark[1] in w]:
            ids = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32)
            self.words.add([w], ids, np.array([len(ids)]))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct words in the store; unknown ones are encoded first."""
        index = self.words.index
        new = [w for w in words if w not in index]
        if new:
            if len(index) + 2 * len(new) > self.most:
                self.words, new = IdStore(), words
                index = self.words.index
            pairs = [(w, *stem(w)) for w in new]
            self._encode(list({x for _, s, t in pairs for x in (s, t)}.difference(index)))
            rest = [(w, s, t) for w, s, t in pairs if w not in index]
            ids, sizes = self.words.get(np.fromiter((index[x] for _, s, t in rest for x in (s, t)), np.int64, 2 * len(rest)))
            self.words.add([w for w, _, _ in rest], ids, sizes.reshape(-1, 2).sum(1))
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of each text's ids."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        known = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ids, sizes = self.words.get(known)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(pc.list_value_length(split).to_numpy())]
        return ids, np.diff(ends, prepend=0)


_TOKENIZERS: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, most: int = CACHED_WORDS) -> WordIds:
    """One per worker process: its cache lasts over tasks."""
    if (path, most) not in _TOKENIZERS:
        _TOKENIZERS[path, most] = WordIds(path, most)
    return _TOKENIZERS[path, most]


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is as close to room as can be without exceeding it."""
    full, reach, stages = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        stages.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << (length * step)) & full
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        n = 0
        while not before >> total & 1:
            n, total = n + 1, total - length
        if n:
            chosen[length] = n
    return chosen


class Packer:
    """Packs the pieces of one task. A piece is (document, start, length)."""

    def __init__(self, capacity: int):
        self.capacity, self.pools, self.done = capacity, {}, []

    def add(self, doc: int, start: int, length: int) -> None:
        self.pools.setdefault(length, []).append((doc, start, length))

    def _take(self, length: int) -> tuple[int, int, int]:
        pool = self.pools[length]
        piece = pool.pop()
        if not pool:
            del self.pools[length]
        return piece

    def run(self) -> None:
        """Fills windows until what is left is less than one; that stays for the next share."""
        for piece in self.pools.pop(self.capacity, []):
            self.done.append([piece])
        while self.pools:
            seed = max(self.pools)
            counts = {n: len(p) for n, p in self.pools.items()}
            counts[seed] -= 1
            chosen = fill(counts, self.capacity - seed)
            pattern = dict(chosen)
            pattern[seed] = pattern.get(seed, 0) + 1
            slack = self.capacity - sum(n * k for n, k in pattern.items())
            times = 1 if slack else min(len(self.pools[n]) // k for n, k in pattern.items())
            for _ in range(times):
                window = [self._take(n) for n in sorted(pattern, reverse=True) for _ in range(pattern[n])]
                if slack:
                    if not self.pools:
                        for piece in window:
                            self.add(*piece)
                        return
                    doc, start, length = self._take(max(self.pools))
                    window.append((doc, start, slack))
                    self.add(doc, start + slack, length - slack)
                self.done.append(window)

    def close(self) -> None:
        """Cuts what is left into sequences of power-of-two lengths."""
        rest = [p for n in sorted(self.pools, reverse=True) for p in self.pools[n]]
        self.pools = {}
        total = sum(p[2] for p in rest)
        for bit in reversed(range(total.bit_length())):
            room, window = total & (1 << bit), []
            while room:
                doc, start, length = rest.pop(0)
                n = min(length, room)
                window.append((doc, start, n))
                room -= n
                if length > n:
                    rest.insert(0, (doc, start + n, length - n))
            if window:
                self.done.append(window)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, window_tokens: int = WINDOW_TOKENS, cached_words: int = CACHED_WORDS) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset: one row per piece of docs(doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = word_ids(tokenizer, cached_words), Packer(capacity)
        base, sequence = TaskContext.get().partitionId() << 36, 0
        names: list[int | None] = []
        tokens: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence, names, tokens
            pieces = [(doc, start, length, base + sequence + k, offset) for k, w in enumerate(packer.done) for offset, (doc, start, length) in zip(np.cumsum([0, *(p[2] for p in w[:-1])]).tolist(), w, strict=True)]
            sequence += len(packer.done)
            packer.done = []
            data = np.concatenate([np.zeros(0, np.uint32), *(tokens[d][s : s + n] for d, s, n, _, _ in pieces)])
            ends = np.cumsum([0, *(4 * p[2] for p in pieces)], dtype=np.int32)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([names[p[0]] for p in pieces], pa.int64()),
                    pa.array([p[1] for p in pieces], pa.int64()),
                    pa.array([p[2] for p in pieces], pa.int64()),
                    pa.Array.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(data.astype("<u4"))]),
                    pa.array([len(tokens[p[0]]) for p in pieces], pa.int64()),
                    pa.array([p[3] for p in pieces], pa.int64()),
                    pa.array([p[4] for p in pieces], pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            left = [p for pool in packer.pools.values() for p in pool]
            used = sorted({p[0] for p in left})
            number = {d: i for i, d in enumerate(used)}
            names, tokens = [names[d] for d in used], [tokens[d] for d in used]
            packer.pools = {}
            for d, s, n in left:
                packer.add(number[d], s, n)
            return out

        waiting = 0
        for batch in batches:
            ids, texts = column(batch, "doc_id").to_pylist(), column(batch, "text")
            for first, last in slices(utf8(texts)[1], _SLICE_BYTES):
                flat, sizes = encoder.encode(texts.slice(first, last - first))
                for doc, one in zip(ids[first:last], np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                    names.append(doc)
                    tokens.append(np.append(one, np.uint32(end_id)))
                    whole, size = len(tokens) - 1, len(one) + 1
                    for start in range(0, size, capacity):
                        packer.add(whole, start, min(capacity, size - start))
                    waiting += size
                if waiting >= window_tokens:
                    packer.run()
                    yield flush()
                    waiting = 0
        packer.run()
        packer.close()
        if packer.done:
            yield flush()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, schema)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
