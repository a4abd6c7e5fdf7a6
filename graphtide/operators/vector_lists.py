"""An index of vectors in lists around centroids, kept as files by list.

The number of lists grows with the root of the number of vectors (at most MOST_LISTS). Centroids are k-means of all vectors:
each task sums its own by nearest centroid, and only one row a list reaches the driver. The index is a table partitioned by
list, so a search reads just the lists that its questions probe; a large list is many files, and so many tasks. Questions
go to the lists in blocks of bounded size, and every task keeps its k best of each question before anything is shuffled.

How many lists a good search needs depends on the vectors: clustered ones need few, and vectors without structure about
half of all, so `probes` may be a number or a share. Rows without a usable vector take no part. Ties go by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtide.operators.vectors import PLACES, _unit, usable
from graphtide.session import materialize

MOST_LISTS, ROUNDS, FILE_ROWS, SAMPLE = 4096, 8, 200_000, 16
_PER_LIST = "list_id int, total array<double>, many long"


def _rows(matrix: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), matrix.shape[1]).cast(pa.list_(pa.float64()))


def _equal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows as one: the first place of each, the number of each row's, and how many there are."""
    flat = np.ascontiguousarray(rows)
    _, first, of, many = np.unique(flat.view(np.dtype((np.void, flat.shape[1] * flat.itemsize))).ravel(), return_index=True, return_inverse=True, return_counts=True)
    return first, of.ravel(), many


def centroids(items: DataFrame, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """k-means on the sphere over items(name, vec) of the most common dimension; starts from at most `lists` vectors in a seeded order, the driver sees no more than one row a list."""
    size = items.groupBy(F.size("vec").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), F.desc("dim")).first()
    first = items.select("name", "vec").where(F.size("vec") == (size.dim if size else 0)).orderBy(F.xxhash64("name", F.lit(seed)), "name").limit(lists).select("vec").toArrow()
    _, start = usable(first.column("vec").combine_chunks()) if first.num_rows else (None, np.zeros((0, 1)))
    centres = np.unique(_unit(start), axis=0) if len(start) else start
    context = items.sparkSession.sparkContext
    for _ in range(rounds if len(centres) > 1 else 0):
        shared = context.broadcast(centres)

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            sums, many = np.zeros_like(now), np.zeros(len(now), np.int64)
            for batch in batches:
                _, matrix = usable(batch.column(0), now.shape[1])
                if not len(matrix):
                    continue
                first, _, times = _equal(matrix)  # a vector that many rows share is looked up once
                unit = _unit(matrix[first])
                near = (unit @ now.T).argmax(1)
                np.add.at(sums, near, unit * times[:, None])
                np.add.at(many, near, times)
            used = np.flatnonzero(many)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), _rows(sums[used]), pa.array(many[used])], names=["list_id", "total", "many"])

        # partial sums are merged component by component: a list has one row a task
        each = items.select("vec").mapInArrow(partial, _PER_LIST).select("list_id", F.posexplode("total").alias("at", "x"))
        merged = each.groupBy("list_id", "at").agg(F.sum("x").alias("x")).groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))
        found = merged.select("list_id", F.transform("xs", lambda e: e["x"]).alias("total")).toArrow().sort_by("list_id")
        moved = centres.copy()
        totals = np.array(found.column("total").to_pylist(), np.float64).reshape(-1, centres.shape[1])
        norms = np.sqrt((totals * totals).sum(1))
        ids = found.column("list_id").to_numpy()
        moved[ids[norms > 0]] = totals[norms > 0] / norms[norms > 0, None]
        settled = np.allclose(moved, centres, atol=1e-6)
        centres = moved
        shared.unpersist()
        if settled:
            break
    return centres


class VectorLists:
    """The index in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def build(cls, items: DataFrame, folder: str, lists: int | None = None, rounds: int = ROUNDS) -> VectorLists:
        """Builds an index of items(name, vec)."""
        made = cls(items.sparkSession, folder)
        count = items.count()
        centres = centroids(items, lists or max(1, min(MOST_LISTS, round(count**0.5))), rounds)
        rows = [(i, c.tolist()) for i, c in enumerate(centres)]
        made.spark.createDataFrame(rows, "list_id int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{made.folder}/centres")
        made._write(items, "overwrite")
        return made

    def append(self, items: DataFrame) -> None:
        """Adds items(name, vec) to the lists of their nearest centroids."""
        self._write(items, "append")

    def centres(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.folder}/centres").orderBy("list_id").toArrow()
        return np.array(found.column("centre").to_pylist(), np.float64) if found.num_rows else np.zeros((0, 1))

    def _write(self, items: DataFrame, mode: str) -> None:
        shared = self.spark.sparkContext.broadcast(self.centres())

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            for batch in batches:
                kept, matrix = usable(batch.column(1), centres.shape[1] if len(centres) else None)
                if len(kept) and len(centres):
                    near = (_unit(matrix) @ centres.T).argmax(1)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), _rows(matrix), pa.array(near, pa.int32())], names=["name", "vec", "list_id"])

        dealt = materialize(items.select("name", "vec").mapInArrow(deal, "name string, vec array<double>, list_id int"), "dealt")
        # a list goes to as many tasks as it has blocks of FILE_ROWS rows
        sizes = dealt.groupBy("list_id").agg(F.ceil(F.count("*") / FILE_ROWS).alias("blocks"))
        placed = dealt.join(F.broadcast(sizes), "list_id").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")))
        placed.repartition("list_id", "block").drop("blocks", "block").write.mode(mode).partitionBy("list_id").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.folder}/lists")

    def search(self, questions: DataFrame, k: int, probes: float = 0.5, block_rows: int = 4096) -> DataFrame:
        """q_id, name, sim, rank: the k most similar names of questions(q_id, vec) in their nearest lists. probes: a number of lists, or below 1 a share of them."""
        empty = self.spark.createDataFrame([], "q_id long, name string, sim double, rank int")
        centres = self.centres()
        if not len(centres):  # no vector was there
            return empty
        many = min(len(centres), max(1, round(probes if probes >= 1 else probes * len(centres))))
        index = self.spark.read.schema("name string, vec array<double>, list_id int").parquet(f"{self.folder}/lists")
        blocks, found = max(1, -(-questions.count() // block_rows)), None
        for b in range(blocks):
            part = questions if blocks == 1 else questions.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b)
            rows = part.select(F.col("q_id").cast("long").alias("q_id"), "vec").orderBy("q_id").toArrow()
            kept, matrix = usable(rows.column("vec").combine_chunks(), centres.shape[1]) if rows.num_rows else ([], None)
            if not len(kept):
                continue
            unit = _unit(matrix)
            near = np.argpartition(-(unit @ centres.T), many - 1, axis=1)[:, :many]
            shared = self.spark.sparkContext.broadcast((rows.column("q_id").to_numpy()[kept], unit, near))
            wanted = index.where(F.col("list_id").isin([int(i) for i in np.unique(near)]))
            one = materialize(wanted.select("name", "vec", "list_id").mapInArrow(_best_of_lists(shared, k), "q_id long, name string, sim double"), "block")
            found = one if found is None else found.unionByName(one)
        if found is None:
            return empty
        rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("sim"), "name"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _best_of_lists(shared, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, near = shared.value
        asking: dict[int, np.ndarray] = {}
        best: list[list[tuple[float, str]]] = [[] for _ in ids]
        for batch in batches:
            names, (_, matrix), lists = batch.column(0).to_pylist(), usable(batch.column(1), unit.shape[1]), batch.column(2).to_numpy()
            if len(names):  # of rows that share a vector, only the k first names can be among the k best
                _, of, many = _equal(np.column_stack([matrix, lists]))
                order = np.lexsort((np.array(names, object), of))
                begin = np.cumsum(many) - many
                order = np.sort(order[np.arange(len(order)) - begin[of[order]] < k])
                names, matrix, lists = [names[i] for i in order], matrix[order], lists[order]
            rows = _unit(matrix)
            for one in np.unique(lists):
                if one not in asking:
                    asking[one] = np.flatnonzero((near == one).any(1))
                mine = np.flatnonzero(lists == one)
                sims = np.round(unit[asking[one]] @ rows[mine].T, PLACES)
                floor = -np.partition(-sims, k - 1, axis=1)[:, k - 1] if sims.shape[1] > k else np.full(len(sims), -np.inf)
                for q, row, least in zip(asking[one], sims, floor, strict=True):
                    new = [(-row[j], names[mine[j]]) for j in np.flatnonzero(row >= least)]
                    best[q] = sorted(best[q] + new)[:k]
        out = [(int(ids[q]), name, -s) for q, found in enumerate(best) for s, name in found]
        for i in range(0, len(out), 50_000):
            q, name, sim = zip(*out[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(name, pa.string()), pa.array(sim, pa.float64())], names=["q_id", "name", "sim"])

    return work
