"""Nearest neighbours by inner product with a hash-prefix forest.

Equal vectors are one entry with their smallest vec_ids (as many as a result can need), so repeated
rows neither fill buckets nor lose links. Entries are dealt into shards of about `shard_rows`. A
shard has `trees` sorted arrays of 32-bit hash strings, bit i being the side of the i-th hyperplane
of the tree (rows of random rotations; vectors are first lifted by one coordinate to equal norms, so
that angle follows inner product). A query descends to its longest matching prefixes and all trees
ascend together, one bit at a time, until at least `share` of the shard's entries (counted with
repetition over the trees) share a prefix with it; those are scored. Every row is in the index,
nothing is fitted on a sample.

Different query vectors are broadcast in blocks of at most BLOCK_BYTES (about `block_rows` rows); a
pass over the shards answers one block, each task keeping a query's best over all its shards, so
neither entries nor queries are ever multiplied. A pass is written before the next one begins.

On vectors without structure the neighbours of a query are hardly nearer than the rest, so much of a
shard has to be scored for a high recall; `share` is that price.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a
null vec_id. Of repeated vec_ids each row is a candidate of its own vector; a query never gets its
own vec_id. Ties go to the smaller vec_id. Empty tables give an empty result; further columns are
not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphtide.llm.common import column
from graphtide.session import discard, materialize

K, QUERY_STEP, TREES, SHARE, SHARD_ROWS, BLOCK_ROWS = 20, 20, 32, 0.9, 8192, 16_384
BLOCK_BYTES = 64_000_000
_BITS, _LEAST, _SEED = 32, 1024, 11


def _valid(vectors: pa.Array) -> list[bytes | None]:
    """Each vector as the bytes of its doubles, or None if it takes no part."""
    out = []
    for v in vectors.to_pylist():
        if not v or any(x is None for x in v):
            out.append(None)
            continue
        a = np.array(v, np.float64) + 0.0
        out.append(a.tobytes() if np.isfinite(a).all() and a.any() else None)
    return out


def _entries(most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: dict[bytes, list[int]] = {}
            for key, name in zip(_valid(column(batch, "embedding")), column(batch, "vec_id").to_pylist(), strict=True):
                if key is not None and name is not None:
                    kept.setdefault(key, []).append(name)
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array([sorted(set(v))[:most] for v in kept.values()], pa.list_(pa.int64()))], names=["key", "ids"])

    return work


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_valid(column(batch, "embedding")), pa.binary()), column(batch, "vec_id")], names=["key", "query_id"])


class Forest:
    """Sorted hash strings of a shard's vectors, one array per tree."""

    def __init__(self, vectors: np.ndarray, trees: int):
        norms = (vectors * vectors).sum(1)
        self.vectors, self.single = vectors, vectors.astype(np.float32)
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))])
        self.planes = self._planes(lifted.shape[1], trees)
        self.order, self.strings = [], []
        for p in self.planes:
            h = self._hash(lifted, p)
            o = np.argsort(h, kind="stable")
            self.order.append(o)
            self.strings.append(h[o])

    @staticmethod
    def _planes(dims: int, trees: int) -> list[np.ndarray]:
        out = []
        for t in range(trees):
            rng = np.random.default_rng([_SEED, t, dims])
            turns = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-_BITS // dims))]
            out.append(np.concatenate(turns, 1)[:, :_BITS])
        return out

    @staticmethod
    def _hash(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
        bits = np.packbits(vectors @ planes > 0, axis=1)
        return np.ascontiguousarray(bits).view(">u4").ravel().astype(np.uint64)

    def ranges(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree the range of entries at the depth where the trees together reach `wanted` entries."""
        lifted = np.column_stack([queries, np.zeros(len(queries))])
        hashes = [self._hash(lifted, p) for p in self.planes]
        low, high = np.zeros((2, len(self.planes), len(queries)), np.int64)
        rest = np.arange(len(queries))
        for depth in range(_BITS, -1, -1):
            width = np.uint64(_BITS - depth)
            for t, (h, strings) in enumerate(zip(hashes, self.strings, strict=True)):
                prefix = (h[rest] >> width) << width
                low[t, rest] = np.searchsorted(strings, prefix, "left")
                high[t, rest] = np.searchsorted(strings, prefix + ((np.uint64(1) << width) - np.uint64(1)), "right")
            rest = rest[(high - low)[:, rest].sum(0) < min(wanted, len(self.planes) * len(self.vectors))]
            if not len(rest):
                break
        return low, high

    def nearest(self, queries: np.ndarray, k: int, wanted: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, entries, scores) with the k best entries found, ties at the end included."""
        low, high = self.ranges(queries, wanted)
        single = queries.astype(np.float32)
        for i, q in enumerate(queries):
            mask = np.zeros(len(self.vectors), bool)
            for t, o in enumerate(self.order):
                mask[o[low[t, i] : high[t, i]]] = True
            found = np.flatnonzero(mask)
            if len(found) > k:
                rough = self.single[found] @ single[i]
                scale = 1e-5 * max(float(np.abs(rough).max()), 1e-30)
                found = found[rough >= np.partition(rough, -k)[-k] - scale]
            scores = (self.vectors[found] * q).sum(1)
            if len(found) > k:
                best = scores >= np.partition(scores, -k)[-k]
                found, scores = found[best], scores[best]
            yield i, found, scores


def _search(shared, k: int, trees: int, share: float, shard_rows: int):
    """The k best entries of each query of the block in a task's shards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list[bytes]] = {}
        for key in shared.value:
            by_size.setdefault(len(key), []).append(key)
        best: dict[bytes, list[tuple[float, list[int]]]] = {}
        held: dict[int, tuple[list[bytes], list[list[int]]]] = {}

        def answer(size: int) -> None:
            stored, ids = held.pop(size)
            asked = np.frombuffer(b"".join(by_size[size]), np.float64).reshape(len(by_size[size]), -1)
            vectors = np.frombuffer(b"".join(stored), np.float64).reshape(len(stored), -1)
            for i, found, scores in Forest(vectors, trees).nearest(asked, k, max(_LEAST, int(share * len(stored)))):
                mine = best.setdefault(by_size[size][i], [])
                mine += [(s, ids[e]) for e, s in zip(found.tolist(), scores.tolist(), strict=True)]
                if len(mine) > 4 * k:
                    mine.sort(key=lambda f: (-f[0], f[1][0]))
                    del mine[k:]

        for batch in batches:
            for key, ids in zip(column(batch, "key").to_pylist(), column(batch, "ids").to_pylist(), strict=True):
                if len(key) not in by_size:
                    continue
                one = held.setdefault(len(key), ([], []))
                one[0].append(key)
                one[1].append(ids)
                if len(one[0]) >= shard_rows:
                    answer(len(key))
        for size in list(held):
            answer(size)
        rows = [(key, ids, s) for key, mine in best.items() for s, ids in sorted(mine, key=lambda f: (-f[0], f[1][0]))[:k]]
        for at in range(0, len(rows), 20_000):
            part = list(zip(*rows[at : at + 20_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.binary()), pa.array(part[1], pa.list_(pa.int64())), pa.array(part[2], pa.float64())], names=["key", "ids", "score"])

    return work


def nearest(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, trees: int = TREES, share: float = SHARE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose vec_id is divisible by query_step, among all rows of vectors(vec_id, embedding)."""
    named = vectors.select(F.col("vec_id").cast("long"), "embedding")
    shards = max(1, -(-named.count() // shard_rows))
    parts = named.mapInArrow(_entries(k + 1), "key binary, ids array<long>").repartition(shards, "key")
    entries = materialize(parts.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")), "entries")
    queries = materialize(named.where(F.col("vec_id") % query_step == 0).mapInArrow(_asked, "key binary, query_id long").where(F.col("key").isNotNull()), "queries")
    asked = queries.select("key").distinct()
    rows, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    blocks = max(1, -(-rows // block_rows), -(-size // BLOCK_BYTES))
    passes = []
    for b in range(blocks):
        keys = [bytes(r[0]) for r in asked.where(F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(blocks)) == b).collect()]  # a block
        if keys:
            shared = vectors.sparkSession.sparkContext.broadcast(sorted(keys))
            found = entries.mapInArrow(_search(shared, k + 1, trees, share, shard_rows), "key binary, ids array<long>, score double")
            each = found.select("key", "score", F.explode("ids").alias("vec_id"))
            best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
            passes.append(materialize(each.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"), "pass"))
            shared.unpersist()
    if not passes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = reduce(DataFrame.unionByName, passes)
    pairs = queries.distinct().hint("merge").join(top.hint("merge"), "key").where(F.col("vec_id") != F.col("query_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    out = materialize(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(entries, queries, *passes)
    return out
