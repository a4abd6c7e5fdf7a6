"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A document is contaminated by a benchmark item if some region of it is within `rate` of the item's
length in edits (insertions, deletions, substitutions of characters, A-Z folded, white space alike).
Filter: an item of m characters with at most k edits keeps m - q + 1 - k q of its q-grams, and all
of them on diagonals (document position less item position) at most k apart. Shared q-grams are
counted in overlapping diagonal bands; bands below that bound cannot hold a match and the others
are verified by an alignment that stays within the band. Items too short for their k take the
largest k for which the bound is still one. Items shorter than q are matched exactly: they must
stand, white space at the ends aside, as a line of their own.

A q-gram that repeats in an item and in a text (rules, indentation) is not counted pair by pair: its
runs of neighbouring places give each diagonal's count by differences, other repeats by a correlation.
Bands are verified together, and one that could only give a find that overlaps a better one is left
out, so long texts of a few characters take bounded time and memory.

The benchmark becomes index files of at most `block_chars` characters each, written to the shared
folder and mapped by the executors; only one block at a time passes through the driver. Documents
are read once and never shuffled.

Null or empty texts and items match nothing. Every row is searched, repeated rows too; a null doc_id
is carried along, a null item_id too. Equal items are found each. Empty tables give an empty result; further columns are
not used by `matches` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import column, ranges, ship, shipped
from graphtide.session import materialize

Q, RATE, BLOCK_CHARS = 8, 0.1, 2_000_000
_PART, _BITS = 500_000, 22
_BLANKS = " \t\n\x0b\x0c\r"  # what `folded` makes spaces
_NULL = np.iinfo(np.int64).min
_REPEATS, _PAIRS, _SLICE = 16, 100_000, 2_000_000  # a q-gram with so many places and pairs is counted by diagonals; pairs counted at once
_P, _M = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def folded(texts: list[str]) -> np.ndarray:
    """Code points of all texts, A-Z lower-cased and white space as spaces."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).copy()
    chars[(chars >= 65) & (chars <= 90)] += 32
    chars[(chars >= 9) & (chars <= 13)] = 32
    return chars


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A mixed rolling hash of the q-gram at each position."""
    h = chars[: max(len(chars) - q + 1, 0)].copy()
    for i in range(1, q):
        h *= _P
        h += chars[i : i + len(h)]
    h ^= h >> np.uint32(15)
    return h * _M


def edits_allowed(length: int, q: int, rate: float) -> int:
    return max(0, min(int(rate * length), (length - q) // q))


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of neighbouring numbers."""
    new = np.flatnonzero(np.append(True, np.diff(places) != 1))
    return places[new], places[np.append(new[1:], len(places)) - 1]


def diagonal_counts(hits: np.ndarray, places: np.ndarray, size: int, length: int) -> np.ndarray:
    """For each diagonal from -length to size - 1, how many (hit, place) pairs lie on it; hits < size, places < length."""
    a, b = _runs(hits)
    c, e = _runs(places)
    if len(a) * len(c) <= 1_000_000:
        twice = np.zeros(size + length + 3, np.int64)
        for start, stop in zip(c.tolist(), e.tolist(), strict=True):
            for at, sign in ((a - stop, 1), (a - start + 1, -1), (b - stop + 1, -1), (b - start + 2, 1)):
                np.add.at(twice, at + length, sign)
        return np.cumsum(np.cumsum(twice))[: size + length]
    n = 1 << (size + length).bit_length()
    there, here = np.zeros(n), np.zeros(n)
    there[hits], here[places] = 1, 1
    found = np.rint(np.fft.irfft(np.fft.rfft(there) * np.conj(np.fft.rfft(here)), n)).astype(np.int64)
    return np.concatenate([found[n - length :], found[:size]])


_FIELDS = {"ids": np.int64, "ends": np.int64, "chars": np.uint32, "edits": np.int64, "hash": np.uint32, "first": np.int64, "many": np.int64, "item": np.int64, "place": np.int64, "seen": np.bool_, "short_ids": np.int64, "short": np.uint8}


class Items:
    """Benchmark items with their q-grams: sorted hashes and postings (item, position), as arrays that can be mapped."""

    def __init__(self, q: int, arrays: dict[str, np.ndarray]):
        self.q = q
        for name in _FIELDS:
            setattr(self, name, arrays[name])
        self.starts = np.append(0, self.ends)[:-1]
        self.length = self.ends - self.starts
        self.least = self.length - q + 1 - self.edits * q
        self.lines: dict[str, list[int]] = {}
        for i, text in zip(self.short_ids.tolist(), bytes(self.short).decode().split("\n"), strict=False):
            self.lines.setdefault(text, []).append(i)

    @staticmethod
    def of(items: list[tuple[int, str]], q: int, rate: float) -> Items:
        items = [(_NULL if i is None else i, t) for i, t in items if t]
        short = [(i, line) for i, t in items if len(t) < q for line in [_line(t)] if line]
        items = [(i, t) for i, t in items if len(t) >= q]
        texts = [folded([t]) for _, t in items]
        hashes = [grams(t, q) for t in texts]
        h = np.concatenate([np.zeros(0, np.uint32), *hashes])
        item = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in hashes)])
        order = np.argsort(h, kind="stable")
        values, first = np.unique(h[order], return_index=True)
        seen = np.zeros(1 << _BITS, bool)
        seen[values >> np.uint32(32 - _BITS)] = True
        arrays = {
            "ids": [i for i, _ in items], "ends": np.cumsum([len(t) for t in texts]), "chars": np.concatenate([np.zeros(0, np.uint32), *texts]), "edits": [edits_allowed(len(t), q, rate) for t in texts],
            "hash": values, "first": first, "many": np.diff(np.append(first, len(h))), "item": item[order], "place": place[order], "seen": seen,
            "short_ids": [i for i, _ in short], "short": np.frombuffer("\n".join(t for _, t in short).encode(), np.uint8),
        }
        return Items(q, {n: np.asarray(v).astype(_FIELDS[n]) for n, v in arrays.items()})

    def parts(self) -> Iterator[bytes]:
        for name, kind in _FIELDS.items():
            data = getattr(self, name).astype(kind).tobytes()
            yield np.array([len(getattr(self, name))], np.int64).tobytes() + data + b"\0" * (-len(data) % 8)

    @staticmethod
    def open(data: memoryview, q: int) -> Items:
        at, arrays = 0, {}
        for name, kind in _FIELDS.items():
            n = int(np.frombuffer(data, np.int64, 1, at)[0])
            arrays[name] = np.frombuffer(data, kind, n, at + 8)
            at += 8 + arrays[name].nbytes + -arrays[name].nbytes % 8
        return Items(q, arrays)

    def text(self, item: int) -> np.ndarray:
        return self.chars[self.starts[item] : self.ends[item]]

    def bands(self, chars: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of every band with enough shared q-grams."""
        h = grams(chars, self.q)
        at = np.flatnonzero(self.seen[h >> np.uint32(32 - _BITS)])
        at = at[text_of[at] == text_of[at + self.q - 1]]
        k = np.searchsorted(self.hash, h[at])
        k[k == len(self.hash)] = 0
        hit = self.hash[k] == h[at]
        at, k = at[hit], k[hit]
        hits = np.bincount(k, minlength=len(self.hash))
        keys, counts, most = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], int(self.length.max(initial=0))
        heavy = np.flatnonzero((self.many >= _REPEATS) & (hits >= _REPEATS) & (self.many * hits > _PAIRS))
        single = np.zeros(len(self.item), bool)  # postings counted here and not pair by pair
        for g in heavy.tolist():
            post = slice(self.first[g], self.first[g] + self.many[g])
            item, number = np.unique(self.item[post], return_counts=True)
            where = np.sort(at[k == g])
            for i in item[number >= _REPEATS].tolist():
                mine = self.item[post] == i
                single[post] |= mine
                found = diagonal_counts(where, np.sort(self.place[post][mine]), len(chars), int(self.length[i]))
                first = most - int(self.length[i])
                band = (np.arange(len(found)) + first) // (int(self.edits[i]) + 1)
                total = np.bincount(band - band[0], found).astype(np.int64)
                used = np.flatnonzero(total)
                for step in (0, 1):
                    keys.append((i << 40) | (used + band[0] + step))
                    counts.append(total[used])
        weight = np.cumsum(self.many[k])
        begin = 0
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(weight, (weight[begin - 1] if begin else 0) + _SLICE, side="right")))
            post = ranges(self.first[k[begin:stop]], self.many[k[begin:stop]])
            place = np.repeat(at[begin:stop], self.many[k[begin:stop]])
            if len(heavy):
                plain = ~single[post]
                post, place = post[plain], place[plain]
            item = self.item[post]
            band = (place - self.place[post] + most) // (self.edits[item] + 1)
            both = np.concatenate([(item << 40) | (band + 1), (item << 40) | band])  # a band spans two steps, and each step is in two bands
            key, count = np.unique(both, return_counts=True)
            keys.append(key)
            counts.append(count)
            begin = stop
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(of, np.concatenate(counts), minlength=len(key))
        item, band = key >> 40, (key & ((1 << 40) - 1)) - 1
        enough = count >= self.least[item]
        return item[enough], (band[enough] * (self.edits[item[enough]] + 1)) - most


def _line(text: str) -> str:
    return "".join(map(chr, folded([text]))).strip(" ")


def fewest_edits(pattern: np.ndarray, chars: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, most: int) -> np.ndarray:
    """For many bands at once, a lower bound of the edits of the pattern's best alignment in the band that begins at low, in the text from start to end; above `most` it is most + 1."""
    out, m, steps = np.full(len(low), most + 1), len(pattern), np.arange(width, dtype=np.int32)
    size = max(1, 4_000_000 // (m + width))
    for at in range(0, len(low), size):
        alive = np.arange(at, min(len(low), at + size))
        place = low[alive, None] + np.arange(m + width)
        line = np.where((place >= start[alive, None]) & (place < end[alive, None]), chars[np.clip(place, 0, len(chars) - 1)], np.uint32(0xFFFFFFFF))
        above = np.zeros((len(alive), width), np.int32)
        for r in range(1, m + 1):
            cell = above + (line[:, r - 1 : r - 1 + width] != pattern[r - 1])
            cell[:, :-1] = np.minimum(cell[:, :-1], above[:, 1:] + 1)
            above = np.minimum.accumulate(cell - steps, axis=1) + steps
            if r % 16 == 0:
                ok = above.min(1) <= most
                if not ok.all():
                    alive, line, above = alive[ok], line[ok], above[ok]
                if not len(alive):
                    break
        if len(alive):
            out[alive] = np.minimum(above.min(1), most + 1)
    return out


def banded(pattern: np.ndarray, text: np.ndarray, width: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of the whole pattern to a region of text, or None above `most`.

    Only cells with 0 <= column - row < width are looked at.
    """
    m, pad = len(pattern), np.uint32(0xFFFFFFFF)
    line = np.concatenate([text, np.full(max(0, m + width - len(text)), pad, np.uint32)])
    steps, table = np.arange(width), np.zeros((m + 1, width), np.int32)
    table[0] = np.where(steps <= len(text), 0, 1 << 20)
    for r in range(1, m + 1):
        above = table[r - 1]
        cell = above + (line[r - 1 : r - 1 + width] != pattern[r - 1])
        cell[:-1] = np.minimum(cell[:-1], above[1:] + 1)
        cell = np.minimum.accumulate(cell - steps) + steps
        cell[steps + r > len(text)] = 1 << 20
        table[r] = cell
        if cell.min() > most:
            return None
    c = int(table[m].argmin())
    best, end, r = int(table[m, c]), m + c, m
    if best > most:
        return None
    while r:
        if table[r, c] == table[r - 1, c] + (line[r - 1 + c] != pattern[r - 1]):
            r -= 1
        elif c + 1 < width and table[r, c] == table[r - 1, c + 1] + 1:
            r, c = r - 1, c + 1
        else:
            c -= 1
    return best, c, end


def search(items: Items, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits), overlapping finds of an item reduced to the best."""
    if not len(items.ids) or not texts:
        return []
    sizes = np.array([len(t) for t in texts], np.int64)
    chars, starts = folded(texts), np.cumsum(sizes) - sizes
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    item, diagonal = items.bands(chars, text_of)
    if not len(item):
        return []
    edits, length = items.edits[item], items.length[item]
    touched = np.stack([text_of[np.clip(p, 0, len(chars) - 1)] for p in (diagonal, diagonal + edits + length // 2, diagonal + 2 * edits + length)], 1)
    tried = np.unique(np.stack([np.repeat(item, 3), np.repeat(diagonal, 3), touched.ravel()], 1), axis=0)
    out: list[tuple[int, int, int, int, int]] = []
    for i in np.unique(tried[:, 0]).tolist():
        pattern, e, m = items.text(i), int(items.edits[i]), int(items.length[i])
        _, diagonal, text = tried[tried[:, 0] == i].T
        first, last = starts[text], starts[text] + sizes[text]
        fits = np.minimum(diagonal + 3 * e + 2 + m, last) - np.maximum(diagonal - e, first) >= m - e
        diagonal, text, first, last = diagonal[fits], text[fits], first[fits], last[fits]
        bound = fewest_edits(pattern, chars, diagonal - e, first, last, 4 * e + 3, e)
        found: dict[int, list[tuple[int, int]]] = {}
        pending: list[tuple[int, int, int, int]] = []
        for j in np.lexsort((diagonal, text, bound)).tolist():
            if bound[j] > e:
                break
            t, low, high = int(text[j]), max(int(diagonal[j]) - e, int(first[j])), min(int(diagonal[j]) + 3 * e + 2 + m, int(last[j]))
            core = high - (m - e), low + (m - e)  # every find of this band covers this
            if core[0] < core[1] and any(a < core[1] and core[0] < b for a, b in found.get(t, ())):
                continue
            width = int(diagonal[j]) + 3 * e + 2 - low + 1
            best = banded(pattern, chars[low:high], width, e) if width > 0 else None
            if best:
                pending.append((best[0], t, low + best[1], low + best[2]))
                found.setdefault(t, []).append((low + best[1], low + best[2]))
        kept: dict[int, list[tuple[int, int]]] = {}
        for k, t, a, b in sorted(set(pending)):
            if not any(a < y and x < b for x, y in kept.get(t, ())):
                kept.setdefault(t, []).append((a, b))
                out.append((t, i, a - int(starts[t]), b - int(starts[t]), k))
    return sorted(out)


def _short(items: Items, text: str) -> Iterator[tuple[int, int, int]]:
    """(item id, start, end) of the short items that stand as a line."""
    at = 0
    for line in text.split("\n") if items.lines else ():
        left = line.lstrip(_BLANKS)
        bare = left.rstrip(_BLANKS)
        if 0 < len(bare) < items.q:
            start = at + len(line) - len(left)
            for i in items.lines.get(_line(bare), ()):
                yield i, start, start + len(bare)
        at += len(line) + 1


def _work(files: list[str], q: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Items.open(shipped(f), q) for f in files]
        for batch in batches:
            ids, texts = column(batch, "doc_id").to_pylist(), [t or "" for t in column(batch, "text").to_pylist()]
            rows, at = [], 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= _PART):
                    chars += len(texts[stop])
                    stop += 1
                for items in blocks:
                    rows += [(ids[at + t], int(items.ids[i]), s, e, k) for t, i, s, e, k in search(items, texts[at:stop])]
                    rows += [(ids[t], i, s, e, 0) for t in range(at, stop) for i, s, e in _short(items, texts[t])]
                at = stop
            rows = [(d, None if i == _NULL else i, *rest) for d, i, *rest in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names=["doc_id", "item_id", "start", "end", "edits"])

    return work


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start, end (code points), edits: every region of docs(doc_id, text) that holds an item of benchmark(item_id, text)."""
    known = benchmark.select(F.col("item_id").cast("long"), "text").where(F.length("text") > 0)
    blocks = max(1, -(-(known.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    files = []
    for b in range(blocks):
        items = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        files.append(ship(docs.sparkSession, "items", Items.of([(r[0], r[1]) for r in items], q, rate).parts()))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_work(files, q), "doc_id long, item_id long, start long, end long, edits long")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows whose doc_id has a match; rows with a null doc_id stay."""
    hit = materialize(matches(docs, benchmark, **options).select("doc_id").distinct(), "hit")
    side = F.broadcast(hit) if hit.count() <= 1_000_000 else hit.hint("merge")
    return docs.join(side, "doc_id", "left_anti").select(docs.columns)
