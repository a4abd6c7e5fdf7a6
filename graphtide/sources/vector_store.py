"""A persisted store of name vectors: appended batches, removals as rows of their own, snapshots by iteration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.session import discard, materialize


TASK_ROWS = 500_000


class VectorStore:
    """Vectors under a folder. An operation appends rows with its number; nothing stored is rewritten.

    encoder(names) gives (name, vec) for a table of distinct names: a model_udf, or a join. A name is
    there if its last addition is later than its last removal.
    """

    def __init__(self, spark: SparkSession, path: str, encoder: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.encoder = spark, path.rstrip("/"), encoder

    def _read(self, part: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}") if there else None

    def _stored(self) -> DataFrame | None:
        return self._read("vectors", "name string, vec array<float>, op long")

    def _removed(self) -> DataFrame | None:
        return self._read("removed", "name string, op long")

    def _next(self) -> int:
        ops = [df.agg(F.max("op")).first()[0] or 0 for df in (self._stored(), self._removed()) if df is not None]
        return max(ops, default=0) + 1

    def load(self) -> DataFrame:
        """name, vec of all names that are there."""
        stored, removed = self._stored(), self._removed()
        if stored is None:
            return self.spark.createDataFrame([], "name string, vec array<float>")
        if removed is None:
            return stored.select("name", "vec")
        gone = removed.groupBy(F.col("name").alias("gone")).agg(F.max("op").alias("at"))
        return stored.hint("merge").join(gone.hint("merge"), (F.col("name") == F.col("gone")) & (F.col("at") > F.col("op")), "left_anti").select("name", "vec")

    def add(self, names: DataFrame) -> DataFrame:
        """Encodes and appends the names that are not there yet; returns the rows added.

        Names are written first, so that their number gives the number of tasks: a task has about TASK_ROWS of them, however many come.
        """
        asked = materialize(names.select("name").where("name IS NOT NULL"), "asked")
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-asked.count() // TASK_ROWS))
        new, there = (rows.repartition(tasks, "name") for rows in (asked, self.load().select("name")))
        fresh = new.distinct().hint("merge").join(there.hint("merge"), "name", "left_anti")
        op, written = self._next(), materialize(fresh, "fresh")
        self.encoder(written).select("name", F.col("vec").cast("array<float>").alias("vec"), F.lit(op).cast("long").alias("op")).write.mode("append").parquet(f"{self.path}/vectors")
        discard(written, asked)
        return self._stored().where(F.col("op") == op).select("name", "vec")

    def build(self, names: DataFrame) -> DataFrame:
        """The store of these names; one that is already there is loaded as it is."""
        if self._stored() is None:
            self.add(names)
        return self.load()

    def remove(self, names: DataFrame) -> None:
        names.select("name", F.lit(self._next()).cast("long").alias("op")).distinct().write.mode("append").parquet(f"{self.path}/removed")

    def subset(self, names: DataFrame) -> DataFrame:
        """Vectors of the given names; unknown names have no row."""
        return self.load().hint("merge").join(names.select("name").distinct().hint("merge"), "name", "left_semi")

    def snapshot(self, iteration: int) -> DataFrame:
        """Writes what is there now as that iteration and reads it back."""
        self.load().write.mode("overwrite").parquet(f"{self.path}/snapshots/iteration={iteration}")
        return self.spark.read.parquet(f"{self.path}/snapshots").where(F.col("iteration") == iteration)
