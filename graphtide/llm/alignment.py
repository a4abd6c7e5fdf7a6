"""Alignment of two tokenizers over a corpus: where their tokens end together, and which of their ids go together.

A text, with a blank before it, is encoded by a byte-level BPE (A) and a sentence-piece BPE with byte fallback (B).
Byte offsets where tokens of both end cut the text into groups; a link is a pair of an A and a B
token whose byte ranges end together. An id pair's count is the number of links that hold it in the whole corpus.

The work is an Arrow pipeline in each task: token lists are flattened with their parent indices, token lengths become
end offsets by cumulative sums in segments, an Acero hash join on (document, end) finds the links, and
`Table.group_by` counts id pairs by document. Spark merges the counts. At most POPULAR pairs have a share of 1/POPULAR
or more of all links: their counts go to every task as one mapped file of that bounded size; all other
pairs find theirs by a shuffled join, where none can be heavy.

Both tokenizers see words one by one and keep their ids: neither joins tokens over a blank or line feed that a
printable character follows and, for a blank, none precedes. A long text is worked on in blocks of whole words, so
memory is bounded unless a text has no such place.

Null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens: all numbers are zero
and groups is ''. Every row is a document of its own, repeated rows and null doc_ids too. An empty table gives
an empty result; further columns aren't used. Strings of special tokens inside texts are plain text.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import column, ship, shipped, slices, utf8
from graphtide.llm.packing import IdStore
from graphtide.session import discard, materialize

POPULAR, BLOCK_BYTES, CACHED_WORDS, HELD_PAIRS = 1 << 19, 1_000_000, 300_000, 2_000_000
_SLICE_BYTES = 16_000_000
_END_BITS = 40
#: Bytes of which it's sure that they begin no white space: printable ASCII, and first bytes of characters but those of U+0085, U+00A0, U+1680, U+2000 and on, U+3000.
_PRINTS = np.zeros(256, bool)
_PRINTS[0x21:0x7F] = True
_PRINTS[0xC3:0xF5] = True
_PRINTS[[0xE1, 0xE2, 0xE3]] = False


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes and digest strings of a tokenizer's ids. ends: what stands behind an id within a group and at its end."""

    def __init__(self, tokens: list[bytes], ends: str):
        self.size, self.bytes = len(tokens), pa.array(tokens, pa.binary())
        self.lengths = pc.binary_length(self.bytes).cast(pa.int64())
        self.texts = [f"{i}{end}" for i in range(len(tokens)) for end in ends]


class Tokenizers:
    """Both tokenizers; words are encoded once and kept, at most `most` of them."""

    def __init__(self, path_a: str, path_b: str, most: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.most, self.a, self.b = most, Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        of, entries = byte_level(), {i: t for t, i in self.a.get_vocab().items()}
        special = self.a.get_added_tokens_decoder()
        entry = lambda i: b"" if i in special or i not in entries else bytes(of[c] for c in entries[i])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces run over blanks or line feeds: texts can't be encoded word by word")
        piece = lambda i, p: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode()
        self.of_a = Vocabulary([entry(i) for i in range(max(entries) + 1)], ",|")
        self.of_b = Vocabulary([piece(i, p) for i, p in enumerate(pieces)], ",;")
        self.texts = pa.array(self.of_a.texts + self.of_b.texts, pa.binary())
        self.blank = self.b.piece_to_id("▁")
        self._empty()

    def _empty(self) -> None:
        self.words_a, self.words_b = IdStore(), IdStore()

    def _pieces(self, words: list[str]) -> list[list[int]]:
        """Ids of words by B, which puts a blank before each text: a word's own blank is that one, another word's is taken off again."""
        found = self.b.encode([w.removeprefix(" ") for w in words], num_threads=1)
        return [[self.blank] if w == " " else ids if w[0] == " " else ids[1:] for w, ids in zip(words, found, strict=True)]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct words in both stores; unknown ones are encoded first."""
        new = [w for w in words if w not in self.words_a.index]
        if new and len(self.words_a.index) + len(new) > self.most:
            self._empty()
            new = words
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            for store, ids in ((self.words_a, [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]), (self.words_b, self._pieces(some))):
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                store.add(some, np.fromiter((i for one in ids for i in one), np.uint32, sizes.sum()), sizes)
        return np.fromiter(map(self.words_a.index.__getitem__, words), np.int64, len(words))


_TOKENIZERS: dict[tuple[str, str, int], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str, most: int = CACHED_WORDS) -> Tokenizers:
    """One of each per worker process: the words it knows last over tasks."""
    if (path_a, path_b, most) not in _TOKENIZERS:
        _TOKENIZERS[path_a, path_b, most] = Tokenizers(path_a, path_b, most)
    return _TOKENIZERS[path_a, path_b, most]


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin in concatenated texts that each begin with a blank; all texts begin one."""
    starts = np.zeros(len(raw), bool)
    if len(raw) > 2:
        here, before = raw[1:-1], raw[:-2]
        starts[1:-1] = _PRINTS[raw[2:]] & ((here == 10) | ((here == 32) & (before != 32)))
    starts[offsets[:-1]] = True
    return np.flatnonzero(starts)


class Side:
    """The tokens of some texts by one tokenizer: ids, the text of each, and its end in bytes from the text's start."""

    def __init__(self, vocabulary: Vocabulary, store: IdStore, numbers: np.ndarray, words: np.ndarray):
        flat, sizes = store.get(numbers)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(words)])]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.uint32()))
        self.vocabulary, self.counts, self.ids = vocabulary, np.diff(ends), lists.flatten()
        self.parents = pc.list_parent_indices(lists).cast(pa.int64())
        summed = pc.cumulative_sum(pc.take(vocabulary.lengths, self.ids)).to_numpy()
        passed = np.concatenate([[0], summed])[ends]
        self.bytes = np.diff(passed)
        self.ends = pa.array(summed - passed[:-1][self.parents.to_numpy()])

    def gives_back(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of each text's tokens are the text."""
        same = self.bytes == np.diff(offsets)
        joined = pc.take(self.vocabulary.bytes, self.ids)
        made = utf8(joined.cast(pa.large_binary()).view(pa.large_string()))[0]
        if same.all() and np.array_equal(made, raw):
            return same
        at = np.concatenate([[0], np.cumsum(self.bytes)])
        return np.array([ok and np.array_equal(made[at[i] : at[i + 1]], raw[offsets[i] : offsets[i + 1]]) for i, ok in enumerate(same)], bool)

    def table(self, name: str) -> pa.Table:
        keys = pc.add(pc.shift_left(self.parents, _END_BITS), self.ends)
        return pa.table({"key": keys, name: self.ids.cast(pa.int64()), f"at_{name}": np.arange(len(self.ids))})


def align_words(both: Tokenizers, numbers: np.ndarray, words: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, bytes, np.ndarray, np.ndarray] | None]:
    """For each text of `words` words: A tokens, B tokens, links, groups, id pairs and their counts; None if a tokenizer doesn't give it back."""
    a, b = Side(both.of_a, both.words_a, numbers, words), Side(both.of_b, both.words_b, numbers, words)
    good = a.gives_back(raw, offsets) & b.gives_back(raw, offsets)
    if not good.all():
        if not good.any():
            return [None] * len(good)
        bytes_of = np.repeat(good, np.diff(offsets))
        found = iter(align_words(both, numbers[np.repeat(good, words)], words[good], raw[bytes_of], np.concatenate([[0], np.cumsum(np.diff(offsets)[good])])))
        return [next(found) if ok else None for ok in good]

    links = a.table("a").join(b.table("b"), "key", join_type="inner", use_threads=False)
    texts = pc.shift_right(links["key"], _END_BITS)
    n_links = np.bincount(texts.to_numpy(), minlength=len(words))
    code = pc.add(pc.shift_left(texts, _END_BITS), pc.add(pc.multiply(links["a"], both.of_b.size), links["b"]))
    pairs = pa.table({"code": code}).group_by("code", use_threads=False).aggregate([([], "count_all")]).sort_by("code")
    codes, counts = pairs["code"].to_numpy(), pairs["count_all"].to_numpy()
    cuts = np.searchsorted(codes, np.arange(len(words) + 1) << _END_BITS)
    codes = codes & ((1 << _END_BITS) - 1)

    place, index, at = [], [], []  # in the groups' text a group's A ids come first, then its B ids
    for side, name in ((a, "at_a"), (b, "at_b")):
        last = np.zeros(len(side.ids), bool)
        last[links[name].to_numpy()] = True
        at.append(np.concatenate([[0], np.flatnonzero(last) + 1]))
        place.append(np.cumsum(last) - last)
        index.append(side.ids.to_numpy().astype(np.int64) * 2 + last)
    order = np.empty(len(a.ids) + len(b.ids), np.int64)
    order[np.arange(len(a.ids)) + at[1][place[0]]] = index[0]
    order[np.arange(len(b.ids)) + at[0][place[1] + 1]] = index[1] + 2 * both.of_a.size
    written, ends = utf8(pc.take(both.texts, pa.array(order)).cast(pa.large_binary()).view(pa.large_string()))
    groups, tokens = memoryview(written), np.concatenate([[0], np.cumsum(a.counts + b.counts)])
    return [(int(a.counts[i]), int(b.counts[i]), int(n_links[i]), bytes(groups[ends[tokens[i]] : ends[tokens[i + 1]]]), codes[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]]) for i in range(len(words))]


class _Document:
    """What the blocks of one text have given so far."""

    def __init__(self, digest: bool):
        self.n, self.good, self.digest = [0, 0, 0], True, hashlib.sha256() if digest else None
        self.parts: list[bytes] = []
        self.pairs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, found: tuple | None) -> None:
        if found is None:
            self.good = False
        if not self.good:
            return
        written = found[3][:-1] if not self.n[2] else b";" + found[3][:-1]
        if self.digest:
            self.digest.update(written)
        else:
            self.parts.append(written)
        self.n = [x + y for x, y in zip(self.n, found, strict=False)]
        self.pairs.append(found[4])
        self.counts.append(found[5])

    def row(self) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        if not self.good or not self.n[2]:
            return 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, counts = self.pairs[0], self.counts[0]
        if len(self.pairs) > 1:
            pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
            counts = np.bincount(at, np.concatenate(self.counts)).astype(np.int64)
        return *self.n, self.digest.hexdigest() if self.digest else b"".join(self.parts).decode(), pairs, counts


_ALIGNED = "doc_id long, n_a long, n_b long, n_links long, groups string, pairs array<long>, counts array<long>"


def _aligned_texts(both: Tokenizers, ids: pa.Array, texts: pa.Array, digest: bool, block_bytes: int) -> pa.RecordBatch:
    rows = [_Document(digest) for _ in range(len(texts))]
    full = pc.greater(pc.binary_length(pc.fill_null(texts, "")), 0)
    owners = np.flatnonzero(full.to_numpy(zero_copy_only=False))
    if len(owners):
        raw, offsets = utf8(pc.binary_join_element_wise(" ", texts.filter(full), ""))
        starts = word_starts(raw, offsets)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw))
        text_of, bounds = np.searchsorted(offsets, starts, side="right") - 1, np.append(starts, len(raw))
        for first, last in slices(bounds, block_bytes):
            coded = words.slice(first, last - first).dictionary_encode()
            numbers = both.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            found, counts = np.unique(text_of[first:last], return_counts=True)
            cuts = bounds[first + np.concatenate([[0], np.cumsum(counts)])]
            for text, one in zip(found, align_words(both, numbers, counts, raw[cuts[0] : cuts[-1]], cuts - cuts[0]), strict=True):
                rows[owners[text]].add(one)
    made = [row.row() for row in rows]
    ends = pa.array(np.concatenate([[0], np.cumsum([len(m[4]) for m in made])]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *(m[k] for m in made)]).astype(np.int64))) for k in (4, 5)]
    return pa.RecordBatch.from_arrays([ids, *(pa.array([m[k] for m in made], pa.int64()) for k in range(3)), pa.array([m[3] for m in made], pa.string()), *lists], names=["doc_id", "n_a", "n_b", "n_links", "groups", "pairs", "counts"])


def aligned(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, block_bytes: int = BLOCK_BYTES, most_words: int = CACHED_WORDS) -> DataFrame:
    """For each row of docs(doc_id, text): tokens of A and B, links, groups like `a1,a2|b1;a3|b2,b3` (or their SHA-256), and its id pairs with counts.

    A pair is a number: id of A times size of B, plus id of B. The number of groups is that of links, as no token is empty.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b, most_words)
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for first, last in slices(utf8(texts)[1], _SLICE_BYTES):
                yield _aligned_texts(both, ids.slice(first, last - first), texts.slice(first, last - first), digest, block_bytes)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, _ALIGNED)


def pair_counts(rows: DataFrame, size_b: int, held: int = HELD_PAIRS) -> DataFrame:
    """(pair, n, best) over all rows of `aligned`; best: no pair with the same id of B has a higher count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(parts).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["pair", "n"])

        parts = []
        for batch in batches:
            parts.append(summed([pa.table({"pair": column(batch, "pairs").flatten(), "n": column(batch, "counts").flatten()})]))
            if sum(len(p) for p in parts) > held:
                parts = [summed(parts)]
                if len(parts[0]) > held // 2:
                    yield from parts.pop().combine_chunks().to_batches()
        if parts:
            yield from summed(parts).combine_chunks().to_batches()

    counts = rows.select("pairs", "counts").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "pair_counts")
    highest = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))  # as many rows as B has ids at most
    out = materialize(counts.join(F.broadcast(highest), F.col("pair") % size_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair_counts")
    discard(counts)
    return out


def _scored(rows: DataFrame, popular: str) -> DataFrame:
    """Rows of `aligned` with a row number, n_best and count_sum over their popular pairs, and the pairs that are not."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shipped(popular), np.int64).reshape(2, -1)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            pairs, counts = column(batch, "pairs"), column(batch, "counts").flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(pairs).to_numpy())])
            flat = pairs.flatten().to_numpy()
            at = np.minimum(np.searchsorted(known[0], flat), max(0, known.shape[1] - 1))
            hit = known[0][at] == flat if known.shape[1] else np.zeros(len(flat), bool)
            code = np.where(hit, known[1][at], 0) if known.shape[1] else np.zeros(len(flat), np.int64)
            by_row = lambda x, ends=ends: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends]), pa.int64())
            left = pa.array(np.concatenate([[0], np.cumsum(~hit)])[ends], pa.int32())
            rest = [pa.ListArray.from_arrays(left, pa.array(x[~hit], pa.int64())) for x in (flat, counts)]
            kept = [column(batch, name) for name in ("doc_id", "n_a", "n_b", "n_links", "groups")]
            numbers = pa.array(np.arange(row, row + len(batch)), pa.int64())
            row += len(batch)
            yield pa.RecordBatch.from_arrays([numbers, *kept, by_row(np.where(hit, code & 1, 0) * counts), by_row((code >> 1) * counts), *rest], names=["row", "doc_id", "n_a", "n_b", "n_links", "groups", "n_best", "count_sum", "pairs", "counts"])

    schema = "row long, doc_id long, n_a long, n_b long, n_links long, groups string, n_best long, count_sum long, pairs array<long>, counts array<long>"
    return rows.mapInArrow(work, schema)


def align(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, popular: int = POPULAR, block_bytes: int = BLOCK_BYTES, most_words: int = CACHED_WORDS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row of docs(doc_id, text).

    n_best: links whose pair has the highest count of all pairs with that id of B, ties included; count_sum: the sum of
    the counts over all links. digest: groups holds the SHA-256 of the text, '' where there are no tokens.
    """
    spark, size_b = docs.sparkSession, tokenizers(path_a, path_b, most_words).of_b.size
    rows = materialize(aligned(docs, path_a, path_b, digest, block_bytes, most_words), "aligned")
    counts = pair_counts(rows, size_b)
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") * popular >= total).select("pair", (F.col("n") * 2 + F.col("best").cast("long")).alias("code")).toArrow().sort_by("pair")
    name = ship(spark, "popular_pairs", [often[c].to_numpy().astype(np.int64).tobytes() for c in ("pair", "code")])
    scored = materialize(_scored(rows, name), "scored")
    discard(rows)
    rare = scored.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("times"))
    rare = rare.hint("merge").join(counts.where(F.col("n") * popular < total).hint("merge"), "pair")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    both = scored.drop("pairs", "counts").hint("merge").join(more.hint("merge"), "row", "left")
    return both.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups")
