"""Cosine similarity and top-k over vector tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtide.session import materialize

PLACES = 6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.round(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), PLACES)


def unit(a: Column) -> Column:
    """The vector at length one: normalise before a join, so that each pair costs one product."""
    norm = F.sqrt(dot(a, a))
    return F.aggregate(F.array(norm), F.array().cast("array<double>"), lambda s, n: F.transform(a, lambda v: v.cast("double") / n))


def pair_cosines(pairs: DataFrame, questions: DataFrame, items: DataFrame, block_rows: int = 20_000, bucket_pairs: int = 500_000) -> DataFrame:
    """q_id, v, sim of pairs(q_id, v) for questions(q_id, vec) and items(v, vec), where both are vectors (see usable).

    Only the items that pairs name are dealt out.     Pairs and items meet in buckets of v, sized by the number of pairs, so a vector travels once and not
    once a pair; questions are sent to the buckets in blocks of at most block_rows.
    """
    total, count = pairs.count(), questions.count()
    items = items.hint("merge").join(pairs.select("v").distinct().hint("merge"), "v", "left_semi")
    buckets, blocks = max(16, -(-total // bucket_pairs)), max(1, -(-count // block_rows))
    place = F.pmod(F.xxhash64("v"), F.lit(buckets))
    found = None
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b
        rows = questions.where(mine).select(F.col("q_id").cast("long").alias("q_id"), "vec").orderBy("q_id").toArrow()
        kept, matrix = usable(rows.column("vec").combine_chunks())
        if not len(kept):
            continue
        shared = pairs.sparkSession.sparkContext.broadcast((rows.column("q_id").to_numpy()[kept], _unit(matrix)))
        left = pairs.where(mine).select(F.col("q_id").cast("long").alias("q_id"), F.col("v").cast("long").alias("v"), place.alias("bucket")).groupBy("bucket")
        right = items.select(F.col("v").cast("long").alias("v"), "vec", place.alias("bucket")).groupBy("bucket")
        one = left.cogroup(right).applyInArrow(_pair_sims(shared), "q_id long, v long, sim double")
        found = one if found is None else found.unionByName(one)
    return found if found is not None else pairs.sparkSession.createDataFrame([], "q_id long, v long, sim double")


def _pair_sims(shared):
    def work(pairs: pa.Table, items: pa.Table) -> pa.Table:
        ids, matrix = shared.value
        q, v = pairs.column("q_id").to_numpy(), pairs.column("v").to_numpy()
        kept, vectors = usable(items.column("vec").combine_chunks(), matrix.shape[1])
        if not len(q) or not len(kept):
            return pa.table({"q_id": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        known = items.column("v").to_numpy()[kept]
        order = np.argsort(known, kind="stable")
        units, known = _unit(vectors)[order], known[order]
        i, j = np.minimum(np.searchsorted(ids, q), len(ids) - 1), np.minimum(np.searchsorted(known, v), len(known) - 1)
        both = (ids[i] == q) & (known[j] == v)
        q, v, i, j = q[both], v[both], i[both], j[both]
        sims = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", matrix[i[a : a + 50_000]], units[j[a : a + 50_000]]) for a in range(0, len(q), 50_000))])
        return pa.table({"q_id": q, "v": v, "sim": np.round(sims, PLACES) + 0.0})

    return work


def usable(vectors: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and matrix of the rows that are vectors: of dimension dim (by default the most common one), with finite components, not all of them zero.

    Others take no part in any similarity: a null, ragged or zero vector is like nothing.
    """
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    if dim is None:
        dim = int(np.bincount(lengths[lengths > 0]).argmax()) if (lengths > 0).any() else 0
    rows = np.flatnonzero(lengths == dim) if dim else np.zeros(0, np.int64)
    matrix = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), max(dim, 1))
    good = np.isfinite(matrix).all(1) & (matrix != 0).any(1)
    return rows[good], matrix[good]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def top_k(questions: DataFrame, items: DataFrame, k: int, threshold: float | None = None, block_rows: int = 20_000, deal: bool = False) -> DataFrame:
    """q_id, name, sim, rank: the k most similar items of each question, ties by name.

    Questions are sent to all items in blocks of at most block_rows, so what is broadcast is bounded;
    items that share a vector are scored once a batch, and each task keeps its k best before anything
    is shuffled. With a threshold and k = 0, all items above it. deal: a table of few bytes is one task by its size, though each of
    its rows meets all questions; it is dealt out to the cores, as long as the tasks' k best stay some millions of rows.
    """
    count = questions.count()
    if deal:
        most = 8_000_000 // max(1, min(count, block_rows) * max(1, k))
        items = materialize(items.select("name", "vec").repartition(max(4, min(questions.sparkSession.sparkContext.defaultParallelism, most))), "dealt")
    blocks = max(1, -(-count // block_rows))
    found = None
    for b in range(blocks):
        part = questions if blocks == 1 else questions.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b)
        rows = part.select(F.col("q_id").cast("long").alias("q_id"), "vec").orderBy("q_id").toArrow()
        kept, matrix = usable(rows.column("vec").combine_chunks())
        if not len(kept):
            continue
        matrix, of = np.unique(matrix, axis=0, return_inverse=True)  # questions that share a vector are scored once
        order = np.argsort(of.ravel(), kind="stable")
        shared = questions.sparkSession.sparkContext.broadcast((rows.column("q_id").to_numpy()[kept][order], np.bincount(of.ravel()), _unit(matrix)))
        one = materialize(items.select("name", "vec").mapInArrow(_best(shared, k, threshold), "q_id long, name string, sim double"), "block")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return questions.sparkSession.createDataFrame([], "q_id long, name string, sim double, rank int")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("sim"), "name"))
    ranked = found.withColumn("rank", rank)
    return ranked.where(F.col("rank") <= k) if k else ranked


def _best(shared, k: int, threshold: float | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, matrix = shared.value
        begins = np.cumsum(asked) - asked
        for batch in batches:
            kept, items = usable(batch.column(1), matrix.shape[1])
            if not len(kept):
                continue
            names = np.array(batch.column(0).take(pa.array(kept)).to_pylist(), object)
            order = np.argsort(names, kind="stable")
            names, items = names[order], np.ascontiguousarray(items[order])
            # one row a vector, with its names in order
            _, first, group = np.unique(items.view(np.dtype((np.void, items.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
            by_group = np.argsort(group, kind="stable")
            sizes = np.bincount(group, minlength=len(first))
            heads, distinct = np.cumsum(sizes) - sizes, _unit(items[first])
            rows, cols, sims = [], [], []
            for at in range(0, len(matrix), 256):
                sim = matrix[at : at + 256] @ distinct.T
                least = np.full((len(sim), 1), -np.inf if threshold is None else threshold)  # rounded below, where few are left
                if k and k < sim.shape[1]:
                    least = np.maximum(least, np.partition(sim, -k, axis=1)[:, -k, None])
                r, c = np.nonzero(sim >= least - 2 * 10**-PLACES)
                s = np.round(sim[r, c], PLACES)
                if threshold is not None:
                    r, c, s = (a[s > threshold] for a in (r, c, s))
                many = np.minimum(sizes[c], k) if k else sizes[c]
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(heads[c], many)
                r, s, name = np.repeat(r, many), np.repeat(s, many), by_group[place]
                if k:  # the first k of each question, ties by name
                    best = np.lexsort((name, -s, r))
                    r, s, name = r[best], s[best], name[best]
                    begin = np.searchsorted(r, np.arange(len(sim)))
                    top = np.arange(len(r)) - begin[r] < k
                    r, s, name = r[top], s[top], name[top]
                askers = asked[at + r]
                rows.append(ids[np.arange(askers.sum()) - np.repeat(np.cumsum(askers) - askers, askers) + np.repeat(begins[at + r], askers)])
                cols.append(np.repeat(names[name], askers))
                sims.append(np.repeat(s, askers))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols), pa.string()), pa.array(np.concatenate(sims))], names=["q_id", "name", "sim"])

    return work


def filter_stats(scored: DataFrame, threshold: float) -> DataFrame:
    """Per question the number of items above the threshold, and max, min, median and mean over all."""
    return scored.groupBy("q_id").agg(
        F.count_if(F.col("sim") > threshold).alias("n_kept"),
        F.max("sim").alias("max_sim"),
        F.min("sim").alias("min_sim"),
        F.round(F.median("sim"), 8).alias("median_sim"),
        F.round(F.avg("sim"), 12).alias("mean_sim"),
    )


def vector_index(embeddings: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """keyed rows with the vector that the first digits of md5(key) choose: a deterministic stand-in for an encoder."""
    n = embeddings.agg(F.count("*").alias("n"))
    number = F.conv(F.substring(F.md5(F.col(key)), 1, 6), 16, 10).cast("long")
    return keyed.crossJoin(F.broadcast(n)).withColumn("__v", number % F.col("n")).join(embeddings.select(F.col("vec_id").alias("__v"), F.col("embedding").alias("vec")), "__v").drop("__v", "n")
