"""Exact removal of repeated passages: the common-prefix interval tree of sparse suffix arrays.

Every byte covered by a string of `least` bytes that also starts in a document with a smaller
doc_id goes; strings are judged on the input. Texts are cut into super-windows: runs of
neighbouring `least`-byte windows whose smallest hash among their 16-byte substrings (their anchor)
is the same, at most CUT windows long. Equal windows have equal anchors, so a bucket of anchors sees
every occurrence of its windows.

1. Each chunk of documents sends its distinct anchors (40 bits of them) to the anchors' buckets and
   learns which stand in two documents or more, and which of those have HOT windows or more. Windows
   of such a hot anchor are keyed by a hash of the whole window instead, so that a passage that very
   many documents share is dealt over all buckets; such a window is a tree of its own.
2. It sends its distinct super-windows with repeated anchors, each with its smallest doc_id, to the
   buckets. A bucket builds an enhanced suffix array of their window starts: suffixes in order and
   the common prefix of neighbours, each suffix up to its super-window's end. A stack scan gives the
   tree of common-prefix intervals of `least` bytes and more, with the smallest doc_id of each
   and its left-extension diversity: whether its occurrences differ in the byte to their left, or one
   of them begins a super-window (its left neighbours are then in another tree). The diverse
   intervals are the maximal repeat groups. In its smallest document a super-window loses, at each
   start, the prefix of the deepest maximal group around it that has a smaller doc_id; in other
   documents all of it goes, as it is itself a repeat. Intervals that are not diverse add nothing: their
   occurrences lie inside those of the group one to the left.
3. Chunks apply the answers to all their documents.

`maximal_repeats` gives the groups themselves, with all occurrences. A repeat that runs over several
super-windows is listed in the pieces that these cut it into.

Copies within a chunk are sent once, so a text with many copies costs a bucket one entry for each
chunk. Documents stay in a table bucketed by chunk: answers travel to them and they do not move.
Chunks are bounded in rows and bytes (a longer text is a chunk of its own); the number of buckets
follows the input. Tables are in the shared folder.

Null texts are empty. A null doc_id is not smaller than another and none is smaller than it: such
rows keep all bytes. Repeated rows with one doc_id do not remove each other. An empty table gives an
empty result; further columns are not used.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import ranges, slices, utf8
from graphtide.session import discard, materialize, own_dir, remove

LEAST, GRAM, CUT = 50, 16, 512
CHUNK_ROWS, CHUNK_BYTES, BUCKET_BYTES, MOST_PARTS = 8192, 3 << 24, 16_000_000, 20_000
HOT = 1 << 18  # windows of an anchor above which it is split
_NOBODY = np.iinfo(np.int64).max
_SLICE = 2_000_000
_BATCH = 1_500_000  # window starts sorted at once
_DIVERSE = 256  # what stands left of a suffix: a byte, or this


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number."""
    out = np.zeros(max(len(data) - 7, 0), np.uint64)
    for o in range(8):
        place = out[o::8]
        if len(place):
            place[:] = data[o : o + 8 * len(place)].view("<u8")
    return out


def _minima(data: np.ndarray, least: int) -> np.ndarray:
    """For each window start the smallest hash of its GRAM-byte substrings."""
    words = _words(data)
    n = len(data) - GRAM + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= words[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    width, size = least - GRAM + 1, 1
    while size * 2 <= width:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


class Chunk:
    """A chunk's texts as bytes and its super-windows: anchor, document, first window, number of windows."""

    def __init__(self, table: pa.Table, least: int, cut: int):
        table = table.sort_by("uid")
        ids = table.column("doc_id").combine_chunks()
        self.ids = ids.to_pylist()
        self.null = np.array(ids.is_null().to_pylist(), bool)
        self.docs = np.where(self.null, _NOBODY, ids.fill_null(0).to_numpy())
        text = table.column("text").combine_chunks()
        self.data, self.offsets = utf8(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
        self.least, self.cut = least, cut
        found = [self._runs(a, b) for a, b in slices(self.offsets, _SLICE)]
        self.anchor, self.row, self.start, self.count = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(4))
        self.anchor = self.anchor.astype(np.uint64)

    def _runs(self, first: int, last: int) -> tuple:
        begin, end = self.offsets[first], self.offsets[last]
        none = np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
        if end - begin < self.least:
            return none
        minima = _minima(self.data[begin:end], self.least)
        windows = np.maximum(np.diff(self.offsets[first : last + 1]) - self.least + 1, 0)
        at = ranges(self.offsets[first:last] - begin, windows)
        if not len(at):
            return none
        values = minima[at]
        new = np.append(True, (values[1:] != values[:-1]) | (at[1:] != at[:-1] + 1))
        new[np.cumsum(windows[windows > 0])[:-1]] = True
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(at)))
        pieces = -(-count // self.cut)
        head = np.repeat(head, pieces) + self.cut * ranges(np.zeros(len(pieces), np.int64), pieces)
        start = at[head] + begin
        return values[head], np.searchsorted(self.offsets, start, side="right") - 1, start, np.diff(np.append(head, len(at)))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors, sorted, which of them stand in several of the chunk's documents, and about how many different windows they have."""
        if not len(self.anchor):
            return self.anchor, np.zeros(0, bool), np.zeros(0, np.int64)
        ends = self.start + self.count + self.least - 9
        looks = [self.data[at[:, None] + np.arange(8)].view("<u8").ravel() for at in (self.start, ends)]
        look = looks[0] * np.uint64(0x9E3779B97F4A7C15) ^ looks[1] ^ self.count.astype(np.uint64)
        order = np.lexsort((look, self.anchor))
        anchor, doc, look = self.anchor[order], self.docs[self.row[order]], look[order]
        head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (look[1:] != look[:-1]))
        weight = np.add.reduceat(np.where(fresh, self.count[order], 0), head)
        return anchor[head], np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head), weight

    def shared(self, repeated: np.ndarray, hot: np.ndarray) -> Contents:
        """The super-windows whose anchor is in `repeated` (sorted), those in `hot` window by window."""
        runs = np.flatnonzero(np.isin(self.anchor, repeated))
        split = np.isin(self.anchor[runs], hot)
        whole, single = runs[~split], runs[split]
        start = np.concatenate([self.start[whole], ranges(self.start[single], self.count[single])])
        count = np.concatenate([self.count[whole], np.ones(int(self.count[single].sum()), np.int64)])
        row = np.concatenate([self.row[whole], np.repeat(self.row[single], self.count[single])])
        data, size = memoryview(self.data), self.least - 1
        digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[s : s + n + size]) for s, n in zip(start.tolist(), count.tolist(), strict=True)]), "<u8").reshape(-1, 2)
        key = np.concatenate([self.anchor[whole], digest[len(whole) :, 0]])
        order = np.lexsort((self.docs[row], digest[:, 1], digest[:, 0], key))
        key, digest = key[order], digest[order]
        new = np.append(True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1]).any(1))[: len(key)]
        alone = (np.arange(len(start)) >= len(whole))[order]
        return Contents(row[order], start[order], count[order], np.cumsum(new) - 1, np.flatnonzero(new), key[new], digest[new], alone[new])


@dataclass
class Contents:
    """Members (sorted by key, content and doc_id) of different contents; the first member of each content, its key and digest, and whether it is a window of a hot anchor."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    content: np.ndarray
    first: np.ndarray
    key: np.ndarray
    digest: np.ndarray
    alone: np.ndarray


def _by_bucket(anchor: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions), the order within a bucket unchanged."""
    if not len(anchor):
        return
    of = (anchor % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(of[order]) != 0)[: len(order)])
    for a, b in zip(heads, [*heads[1:], len(order)], strict=True):
        yield int(of[order[a]]), order[a:b]


def _short(anchor: np.ndarray, buckets: int) -> bytes:
    """Forty bits of each anchor beside its bucket; anchors that agree in them are treated as one, which changes no result."""
    return _narrow(((anchor // np.uint64(buckets)) & np.uint64((1 << 40) - 1)).astype("<u8"), 8, 5)


def _narrow(numbers: np.ndarray, size: int, kept: int) -> bytes:
    """The first `kept` of each `size` bytes."""
    return np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, size)[:, :kept]).tobytes()


def _wide(data: np.ndarray, size: int, kept: int) -> np.ndarray:
    out = np.zeros((len(data) // kept, size), np.uint8)
    out[:, :kept] = data.reshape(-1, kept)
    return out.view("<u8").reshape(-1, size // 8)


_SENT = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("anchors", pa.binary()), ("flags", pa.binary())])
_KNOWN = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("known", pa.binary()), ("hot", pa.binary())])
_ASKED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("digests", pa.binary()), ("members", pa.binary()), ("text", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("owners", pa.binary()), ("runs", pa.binary()), ("begins", pa.binary()), ("lengths", pa.binary())])
_FOUND = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("groups", pa.list_(pa.string())), ("owners", pa.binary()), ("begins", pa.binary()), ("lengths", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
_HASHED = pa.schema([*list(_RESULT)[:4], ("kept_sha256", pa.string())])
_GROUPS = pa.schema([("group_id", pa.string()), ("length", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "long", "list<item: string>": "array<string>"}
    return ", ".join(f"{f.name} {names.get(str(f.type), str(f.type))}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])


@dataclass
class Setting:
    """What all steps of a run share."""

    least: int
    cut: int
    buckets: int
    hot: int
    groups: bool


def _send(to: Setting) -> Callable:
    def work(table: pa.Table) -> pa.Table:
        anchor, several, weight = Chunk(table, to.least, to.cut).anchors()
        flags = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.uint8) | several.astype(np.uint8) << 7
        number = table.column("chunk")[0].as_py()
        rows = []
        for bucket, at in _by_bucket(anchor, to.buckets):
            rows.append((number, bucket, _short(anchor[at], to.buckets), flags[at].tobytes()))
        return _table(rows, _SENT)

    return work


def _which(to: Setting) -> Callable:
    def work(table: pa.Table) -> pa.Table:
        """For each chunk, which of its anchors stand in several documents and which of those are hot."""
        values, flags = _wide(_joined(table, "anchors", np.uint8), 8, 5).ravel(), _joined(table, "flags", np.uint8)
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        head = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        sizes = np.diff(np.append(head, len(ranked)))
        many = (sizes > 1) | (np.maximum.reduceat(flags[order] >> 7, head) > 0)
        weight = np.add.reduceat(np.int64(1) << (flags[order] & 127).astype(np.int64), head)
        known, hot = np.zeros((2, len(values)), bool)
        known[order], hot[order] = np.repeat(many, sizes), np.repeat(many & (weight >= to.hot), sizes)
        ends = np.cumsum([len(f) for f in table.column("flags").to_pylist()])
        rows = [
            (c, b, np.packbits(k).tobytes(), np.packbits(h).tobytes() if h.any() else None)
            for c, b, k, h in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), np.split(known, ends[:-1]), np.split(hot, ends[:-1]), strict=True)
        ]
        return _table(rows, _KNOWN)

    return work


def _contents(chunk: Chunk, known: list[tuple[int, bytes, bytes | None]], buckets: int) -> Contents:
    """The chunk's super-windows of repeated anchors, as the buckets told it."""
    anchor, told = np.unique(chunk.anchor), {b: (k, h) for b, k, h in known}
    repeated, hot = [anchor[:0]], [anchor[:0]]
    for b, at in _by_bucket(anchor, buckets):
        for bits, out in zip(told.get(b, (None, None)), (repeated, hot), strict=True):
            if bits is not None:
                out.append(anchor[at][np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)])
    return chunk.shared(np.concatenate(repeated), np.concatenate(hot))


def _listed(table: pa.Table, *names: str) -> list[tuple]:
    return list(zip(*(table.column(n).to_pylist() for n in names), strict=True))


def _ask(to: Setting) -> Callable:
    def work(docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], _ASKED)
        chunk = Chunk(docs, to.least, to.cut)
        c = _contents(chunk, _listed(known, "bucket", "known", "hot"), to.buckets)
        members, packed = np.diff(np.append(c.first, len(c.row))), zstandard.ZstdCompressor(level=1).compress
        number, rows = docs.column("chunk")[0].as_py(), []
        for bucket, at in _by_bucket(c.key, to.buckets):
            first = c.first[at]
            count = np.where(c.alone[at] & (not to.groups), 0, c.count[first])  # 0: a window that no other content can meet, sent without its text
            text = chunk.data[ranges(c.start[first], np.where(count, count + to.least - 1, 0))]
            parts = chunk.docs[c.row[first]].tobytes(), _narrow(c.digest[at], 16, 10), members[at].astype("<i4").tobytes() if to.groups else None, packed(text.tobytes())
            rows.append((number, bucket, _short(c.key[at], to.buckets), count.astype("<u2").tobytes(), *parts))
        return _table(rows, _ASKED)

    return work


def suffix_groups(words: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The given starts ordered by their first `least` bytes, and where a new prefix begins."""
    steps = [*range(0, least - 8, 8), least - 8]
    keys = [words[starts + s] for s in steps]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(starts), bool)
    new[:1] = True
    for k in keys:
        ranked = k[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    return order, new


def enhanced(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, new: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of starts (each up to its end) and each entry's common prefix with the one before it; below `least` it is zero.

    order and new are those of suffix_groups. Groups are ordered further by eight bytes at a time, as long as some are equal.
    """
    order, lcp = order.copy(), np.zeros(len(starts) + 1, np.int64)
    tied = np.zeros(len(starts), bool)
    tied[1:] = ~new[1:]
    tied[:-1] |= ~new[1:]
    at, group, depth = np.flatnonzero(tied), np.cumsum(new)[tied], least
    while len(at):
        s = order[at]
        left = np.minimum(ends[s] - starts[s] - depth, 8)
        shift = ((8 - left) % 8 * 8).astype(np.uint64)
        word = np.where(left > 0, words[starts[s] + depth] >> shift << shift, np.uint64(0))
        rank = np.lexsort((left, word, group))
        order[at], word, left = s[rank], word[rank], left[rank]
        differ, shorter, same = word[1:] ^ word[:-1], np.minimum(left[1:], left[:-1]), group[1:] == group[:-1]
        common = np.minimum(sum((differ >> np.uint64(8 * k)) == 0 for k in range(8)), shorter)
        on = same & (differ == 0) & (shorter == 8)
        known = same & ~on
        lcp[at[1:][known]] = depth + common[known]
        stay = np.append(on, False) | np.append(False, on)
        at, group, depth = at[stay], np.cumsum(~np.append(False, on))[stay], depth + 8
    return order, lcp


@dataclass
class Tree:
    """Common-prefix intervals: depth, first and last place in the suffix array, smallest doc_id, left-extension diversity, parent (-1: none); and each place's deepest interval (-1: none)."""

    depth: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    diverse: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray


def interval_tree(lcp: np.ndarray, left: np.ndarray, docs: np.ndarray) -> Tree:
    """A stack scan over the common prefixes of an enhanced suffix array (lcp ends with a zero); left holds the byte before each suffix or _DIVERSE."""
    depth, first, last, low, side, parent, leaf, stack = [], [], [], [], [], [], [], []

    def push(d: int, at: int, doc: int, byte: int) -> int:
        depth.append(d)
        first.append(at)
        last.append(at)
        low.append(doc)
        side.append(byte)
        parent.append(-1)
        stack.append(len(depth) - 1)
        return stack[-1]

    for j, (ahead, byte, doc) in enumerate(zip(lcp[1:].tolist(), left.tolist(), docs.tolist(), strict=True)):
        if ahead and (not stack or ahead > depth[stack[-1]]):
            leaf.append(push(ahead, j, doc, byte))
            continue
        if not stack:
            leaf.append(-1)
            continue
        top = stack[-1]
        leaf.append(top)
        low[top] = min(low[top], doc)
        if side[top] != byte:
            side[top] = _DIVERSE
        while stack and depth[stack[-1]] > ahead:
            done = stack.pop()
            last[done] = j
            if stack and depth[stack[-1]] >= ahead:
                up = stack[-1]
                low[up] = min(low[up], low[done])
                if side[up] != side[done]:
                    side[up] = _DIVERSE
            elif ahead:
                up = push(ahead, first[done], low[done], side[done])
            else:
                continue
            parent[done] = up
    return Tree(*(np.array(x, np.int64) for x in (depth, first, last, low)), np.array(side, np.int64) == _DIVERSE, np.array(parent, np.int64), np.array(leaf, np.int64))


def covers(tree: Tree, docs: np.ndarray) -> np.ndarray:
    """For each place of the suffix array the depth of the deepest maximal group around it that has a smaller doc_id than the place (0: none)."""
    if not len(tree.depth):
        return np.zeros(len(docs), np.int64)
    parent, low, diverse = tree.parent.tolist(), tree.low.tolist(), tree.diverse.tolist()
    group, lower = [-1] * len(parent), [-1] * len(parent)  # the maximal group at or above; the nearest interval above with a smaller doc_id
    for i in np.argsort(tree.depth, kind="stable").tolist():
        up = parent[i]
        group[i] = i if diverse[i] else group[up] if up >= 0 else -1
        if up >= 0:
            lower[i] = up if low[up] < low[i] else lower[up]
    node = np.where(tree.low[tree.leaf] < docs, tree.leaf, np.array(lower)[tree.leaf])
    node = np.where((tree.leaf >= 0) & (node >= 0), np.array(group)[node], -1)
    return np.where(node >= 0, tree.depth[node], 0)


class Bucket:
    """All super-windows of a bucket's keys: what each chunk asked, and the different contents."""

    def __init__(self, table: pa.Table, least: int, groups: bool = False):
        self.least = least
        self.asked = _listed(table, "chunk", "bucket")
        key, doc, count = _wide(_joined(table, "keys", np.uint8), 8, 5).ravel(), _joined(table, "docs", "<i8"), _joined(table, "counts", "<u2").astype(np.int64)
        digest, unpacked = _wide(_joined(table, "digests", np.uint8), 16, 10), zstandard.ZstdDecompressor().decompress
        members = _joined(table, "members", "<i4").astype(np.int64) if groups else np.ones(len(key), np.int64)
        text = np.frombuffer(b"".join(unpacked(x) for x in table.column("text").to_pylist()), np.uint8)
        sizes = np.where(count, count + least - 1, 0)
        begin = np.cumsum(sizes) - sizes
        order = np.lexsort((doc, digest[:, 1], digest[:, 0], key))
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (digest[order][1:] != digest[order][:-1]).any(1))
        self.content = np.empty(len(order), np.int64)  # of each entry asked for
        self.content[order] = np.cumsum(new) - 1
        self.members = np.add.reduceat(members[order], np.flatnonzero(new))
        first = order[new]  # of each content, the entry with the smallest doc_id
        self.key, self.doc, self.count, self.begin, self.text = key[first], doc[first], count[first], begin[first], text
        self.sizes = [len(x) // 5 for x in table.column("keys").to_pylist()]

    def batches(self, wanted: np.ndarray) -> Iterator[np.ndarray]:
        """The wanted contents in order, whole keys at a time, so that no interval is cut and memory is bounded."""
        weight, at = np.cumsum(self.count[wanted]), 0
        while at < len(wanted):
            to = int(np.searchsorted(weight, (weight[at - 1] if at else 0) + _BATCH)) + 1
            while to < len(wanted) and self.key[wanted[to]] == self.key[wanted[to - 1]]:
                to += 1
            yield wanted[at:to]
            at = to

    def trees(self, wanted: np.ndarray, across: bool) -> Iterator[tuple]:
        """(content and start of each place of the suffix array, its doc_id, tree) for the wanted contents; with `across`, only prefixes that lie in several documents."""
        for some in self.batches(wanted):
            lengths = self.count[some] + self.least - 1
            words = _words(np.append(self.text[ranges(self.begin[some], lengths)], np.zeros(8, np.uint8))).byteswap()
            base = np.cumsum(lengths) - lengths
            of = np.repeat(np.arange(len(some)), self.count[some])
            starts = ranges(base, self.count[some])
            order, new = suffix_groups(words, starts, self.least)
            docs = self.doc[some][of]
            head = np.flatnonzero(new)
            sizes = np.diff(np.append(head, len(order)))
            use = sizes > 1
            if across:
                use &= np.minimum.reduceat(docs[order], head) < np.maximum.reduceat(docs[order], head)
            use = np.repeat(use, sizes)
            kept = order[use]
            back = np.arange(len(kept))
            starts_, of, docs = starts[kept], of[kept], docs[kept]
            order, lcp = enhanced(words, starts_, (base + lengths)[of], back, new[use], self.least)
            starts_, of, docs = starts_[order], of[order], docs[order]
            left = np.where(starts_ > base[of], (words[np.maximum(starts_ - 1, 0)] >> np.uint64(56)).astype(np.int64), _DIVERSE)
            yield some[of], starts_ - base[of], docs, interval_tree(lcp, left, docs)


def _answer(to: Setting) -> Callable:
    def work(table: pa.Table) -> pa.Table:
        b = Bucket(table, to.least)
        alone = (b.count == 0) | np.append(True, b.key[1:] != b.key[:-1]) & np.append(b.key[1:] != b.key[:-1], True)
        contents, begins, lengths = [], [], []
        for content, start, docs, tree in b.trees(np.flatnonzero(~alone), True):
            cover = covers(tree, docs)
            hit = np.flatnonzero(cover)
            hit = hit[np.lexsort((start[hit], content[hit]))]
            if not len(hit):
                continue
            # runs of covered bytes within each content
            content, start, stop = content[hit], start[hit], start[hit] + cover[hit]
            width = int(b.count.max()) + to.least
            reach = np.maximum.accumulate(content * width + stop) - content * width
            new = np.append(True, (content[1:] != content[:-1]) | (start[1:] > reach[:-1]))
            head = np.flatnonzero(new)
            contents.append(content[head])
            begins.append(start[head])
            lengths.append(reach[np.append(head[1:], len(content)) - 1] - start[head])
        content, begin, length = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (contents, begins, lengths))
        per = np.bincount(content, minlength=len(b.key))
        head = np.cumsum(per) - per
        rows, done = [], 0
        for (number, bucket), size in zip(b.asked, b.sizes, strict=True):
            mine = b.content[done : done + size]
            done += size
            pick = ranges(head[mine], per[mine])
            rows.append((number, bucket, b.doc[mine].tobytes(), *(x.astype("<i4").tobytes() for x in (per[mine], begin[pick], length[pick]))))
        return _table(rows, _ANSWER)

    return work


def _apply(to: Setting, texts: bool) -> Callable:
    schema = _RESULT if texts else _HASHED

    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], schema)
        chunk = Chunk(docs, to.least, to.cut)
        found = _listed(answers, "bucket", "known", "hot", "owners", "runs", "begins", "lengths")
        c = _contents(chunk, [f[:3] for f in found if f[1] is not None], to.buckets)
        told = {f[0]: f[3:] for f in found if f[3] is not None}
        owner, per, offset = np.zeros((3, len(c.first)), np.int64)
        begins, lengths, filled = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for bucket, at in _by_bucket(c.key, to.buckets):
            owners, *rest = told[bucket]
            runs, begin, length = (np.frombuffer(x, "<i4").astype(np.int64) for x in rest)
            owner[at], per[at], offset[at] = np.frombuffer(owners, "<i8"), runs, filled + np.cumsum(runs) - runs
            begins.append(begin)
            lengths.append(length)
            filled += len(begin)
        begin, length = np.concatenate(begins), np.concatenate(lengths)
        change = np.zeros(len(chunk.data) + 1, np.int32)
        doc, live = chunk.docs[c.row], ~chunk.null[c.row]
        copy = np.flatnonzero(live & (doc > owner[c.content]))
        np.add.at(change, c.start[copy], 1)
        np.add.at(change, c.start[copy] + c.count[copy] + to.least - 1, -1)
        own = np.flatnonzero(live & (doc == owner[c.content]))
        runs = per[c.content[own]]
        pick = ranges(offset[c.content[own]], runs)
        at = np.repeat(c.start[own], runs) + begin[pick]
        np.add.at(change, at, 1)
        np.add.at(change, at + length[pick], -1)
        out, data = [], chunk.data
        covered = np.cumsum(change[:-1]) > 0
        for i, doc_id in enumerate(chunk.ids):
            a, b = chunk.offsets[i], chunk.offsets[i + 1]
            mask = covered[a:b]
            removed = int(mask.sum())
            spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if removed else 0
            kept = (data[a:b][~mask] if removed else data[a:b]).tobytes()
            out.append((doc_id, int(b - a), removed, spans, kept if texts else hashlib.sha256(kept).hexdigest()))
        return _table(out, schema)

    return work


def _groups(to: Setting) -> Callable:
    """For each chunk the maximal groups of its contents: group, content (by place among those asked for), start, length."""

    def work(table: pa.Table) -> pa.Table:
        b = Bucket(table, to.least, True)
        contents, starts, lengths = [], [], []
        whole = b.count + to.least - 1
        listed = np.zeros(len(b.key), bool)  # contents that are a group as a whole
        for content, start, _, tree in b.trees(np.arange(len(b.key)), False):
            maximal = np.flatnonzero(tree.diverse)
            spread = tree.last[maximal] - tree.first[maximal] + 1
            place, length = ranges(tree.first[maximal], spread), np.repeat(tree.depth[maximal], spread)
            contents.append(content[place])
            starts.append(start[place])
            lengths.append(length)
            listed[content[place][(start[place] == 0) & (length == whole[content[place]])]] = True
        copied = np.flatnonzero((b.members > 1) & ~listed)
        content, start, length = (np.concatenate(x) for x in ([*contents, copied], [*starts, np.zeros(len(copied), np.int64)], [*lengths, whole[copied]]))
        order = np.argsort(content, kind="stable")
        content, start, length = content[order], start[order], length[order]
        text = memoryview(b.text)
        names = [xxhash.xxh3_128_hexdigest(text[a : a + n]) for a, n in zip((b.begin[content] + start).tolist(), length.tolist(), strict=True)]
        per = np.bincount(content, minlength=len(b.key))
        head = np.cumsum(per) - per
        rows, done = [], 0
        for (number, bucket), size in zip(b.asked, b.sizes, strict=True):
            mine = b.content[done : done + size]
            done += size
            pick = ranges(head[mine], per[mine])
            rows.append((number, bucket, [names[i] for i in pick.tolist()], *(x.astype("<i4").tobytes() for x in (np.repeat(np.arange(size), per[mine]), start[pick], length[pick]))))
        return _table(rows, _FOUND)

    return work


def _occurrences(to: Setting) -> Callable:
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], _GROUPS)
        chunk = Chunk(docs, to.least, to.cut)
        found = _listed(answers, "bucket", "known", "hot", "groups", "owners", "begins", "lengths")
        c = _contents(chunk, [f[:3] for f in found if f[1] is not None], to.buckets)
        told, rows = {f[0]: f[3:] for f in found if f[3] is not None}, []
        members = np.diff(np.append(c.first, len(c.row)))
        for bucket, at in _by_bucket(c.key, to.buckets):
            names, *rest = told[bucket]
            content, begin, length = (np.frombuffer(x, "<i4").astype(np.int64) for x in rest)
            content = at[content]
            member = ranges(c.first[content], members[content])
            which = np.repeat(np.arange(len(content)), members[content])
            place = c.start[member] + begin[which] - chunk.offsets[c.row[member]]
            rows += [(names[w], n, chunk.ids[r], p) for w, n, r, p in zip(which.tolist(), length[which].tolist(), c.row[member].tolist(), place.tolist(), strict=True)]
        return _table(rows, _GROUPS)

    return work


def _chunk(rows: int, size: int) -> Column:
    """The number of a row's chunk: `rows` neighbouring ones, or fewer the longer their texts are, so that a chunk holds `size` bytes at most (a longer text is alone)."""
    shift = max(0, (rows - 1).bit_length())
    longer = F.ceil(F.log2(F.octet_length("text") * F.lit(float(rows)) / F.lit(float(size)))).cast("int")
    step = F.least(F.greatest(F.coalesce(longer, F.lit(0)), F.lit(0)), F.lit(shift))
    return F.call_function("shiftright", F.col("uid"), F.lit(shift) - step) * 64 + step


def _run(docs: DataFrame, least: int, chunk_rows: int, chunk_bytes: int, bucket_bytes: int, hot: int, cut: int, answer: Callable, answered: pa.Schema, apply: Callable, result: pa.Schema) -> DataFrame:
    if least < 24 or not 0 < cut < 1 << 16:
        raise ValueError("least must be 24 or more, cut from 1 to 65535")
    spark, name = docs.sparkSession, f"graphtide_chunks_{uuid.uuid4().hex}"
    path = f"{own_dir(spark)}/{name}"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("uid"))
    source = source.withColumn("chunk", _chunk(chunk_rows, chunk_bytes))
    parts = min(MOST_PARTS, max(8, 2 * docs.rdd.getNumPartitions()))
    written: list[DataFrame] = []
    try:
        source.write.bucketBy(parts, "chunk").option("path", path).option("compression", "zstd").saveAsTable(name)
        table = spark.table(name)
        total = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        to = Setting(least, cut, max(12, -(-total // bucket_bytes)), hot, answer is _groups)
        dealt = lambda df: df.repartition(min(MOST_PARTS, to.buckets), "bucket").groupBy("bucket")
        sent = table.groupBy("chunk").applyInArrow(_send(to), _ddl(_SENT))
        written.append(materialize(dealt(sent).applyInArrow(_which(to), _ddl(_KNOWN)), "known"))
        asked = table.groupBy("chunk").cogroup(written[0].groupBy("chunk")).applyInArrow(_ask(to), _ddl(_ASKED))
        written.append(materialize(dealt(asked).applyInArrow(answer(to), _ddl(answered)), "answers"))
        both = written[0].unionByName(written[1], allowMissingColumns=True)
        return materialize(table.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(apply(to), _ddl(result)), "kept")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(*written)
        remove(spark, path)


def remove_repeats(docs: DataFrame, least: int = LEAST, texts: bool = False, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, cut: int = CUT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (or, with texts, the kept bytes) for every row of docs(doc_id, text)."""
    return _run(docs, least, chunk_rows, chunk_bytes, bucket_bytes, hot, cut, _answer, _ANSWER, lambda to: _apply(to, texts), _RESULT if texts else _HASHED)


def maximal_repeats(docs: DataFrame, least: int = LEAST, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, cut: int = CUT) -> DataFrame:
    """group_id, length, doc_id, start (bytes): all occurrences of every maximal repeat group of `least` bytes or more whose anchor stands in two documents or more."""
    return _run(docs, least, chunk_rows, chunk_bytes, bucket_bytes, hot, cut, _groups, _FOUND, _occurrences, _GROUPS)
