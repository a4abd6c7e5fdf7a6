"""The feedback loop as streams: micro-batches over a versioned score table, and keyed score state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graphtide.operators import feedback
from graphtide.operators.graph import having_keys, send_or_sort
from graphtide.session import materialize

KEY = ["head", "rel", "tail"]
DELTAS = "head string, rel string, tail string, q_ord long, idx long, event_id long, delta double"
ORDER = ["q_ord", "idx", "event_id"]


def _parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def current(spark: SparkSession, folder: str, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """The scores: those of the base, or of a triple's last change (of the batches before `before`); of: a written table of keys, the only ones wanted.

    Only triples that can have changed are joined with the changes, the others pass through.
    """
    changes = _parquet(spark, f"{folder}/changes", "head string, rel string, tail string, score double, batch long")
    if before is not None:
        changes = changes.where(F.col("batch") < before)
    base = spark.read.parquet(f"{folder}/base").select(*KEY, "score")
    if of is not None:
        base, changes = having_keys(base, of), having_keys(changes, of)
    last = materialize(changes.groupBy(*KEY).agg(F.max_by("score", "batch").alias("changed")), "last")
    moved = having_keys(base, last).join(send_or_sort(last), KEY, "left").select(*KEY, F.coalesce("changed", "score").alias("score"))
    return moved.unionByName(having_keys(base, last, others=True))


def apply_batch(spark: SparkSession, folder: str, deltas: DataFrame, batch_id: int) -> None:
    """Writes the changes of a batch: the scores of its triples as the batches before left them, with the batch's deltas folded in.

    Only changed triples are written. A batch that is replayed sees the same scores and overwrites its own
    changes, so it changes nothing.
    """
    keys = materialize(deltas.select(*KEY).distinct(), "keys")
    folded = feedback.fold(current(spark, folder, batch_id, keys), deltas, ORDER)
    folded.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")


def run_microbatches(spark: SparkSession, scores: DataFrame, source: str, folder: str, checkpoint: str, files_per_batch: int = 4) -> DataFrame:
    """All delta files in source, one micro-batch after the other; the scores after the last."""
    folder = folder.rstrip("/")
    scores.select(*KEY, "score").write.mode("overwrite").parquet(f"{folder}/base")
    stream = spark.readStream.schema(DELTAS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(lambda df, i: apply_batch(df.sparkSession, folder, df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return current(spark, folder)


def run_score_state(spark: SparkSession, source: str, folder: str, checkpoint: str, files_per_batch: int = 4) -> DataFrame:
    """The same with the scores as keyed state: the last score of each triple with deltas."""
    folder = folder.rstrip("/")
    setting, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(setting)
    spark.conf.set(setting, provider)
    try:
        stream = spark.readStream.schema(f"{DELTAS}, base double").option("maxFilesPerTrigger", files_per_batch).parquet(source)
        query = score_state(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/batch={i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return _parquet(spark, folder, "head string, rel string, tail string, score double, batch long").groupBy(*KEY).agg(F.max_by("score", "batch").alias("score"))


class ScoreState(StatefulProcessor):
    """Score per triple; the rows of a micro-batch are sorted by feedback order before they are applied."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.score = handle.getValueState("score", "score double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(ORDER, kind="stable")
        now = self.score.get()[0] if self.score.exists() else float(frame["base"].iloc[0])
        for delta in frame["delta"]:
            now = max(feedback.LOW, min(feedback.HIGH, now + delta))
        self.score.update((now,))
        yield pd.DataFrame({"head": [key[0]], "rel": [key[1]], "tail": [key[2]], "score": [now]})

    def close(self) -> None:
        pass


def score_state(deltas: DataFrame) -> DataFrame:
    """Stream of scores after each micro-batch of a stream of deltas with their triple's base score; needs the RocksDB state store."""
    return deltas.groupBy(*KEY).transformWithStateInPandas(ScoreState(), "head string, rel string, tail string, score double", "update", "none")
