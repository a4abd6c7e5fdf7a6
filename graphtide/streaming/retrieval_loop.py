"""The loop as published: retrieve for a batch of questions, judge what was found, fold the judgements into the scores, go on.

All retrieval of a batch sees the scores that the batches before have left. What lies in a folder:

* hops: every hop of every path of each seed, with its first score, in parts by seed;
* edges: the seeds of each triple, in parts by triple;
* and logs with a table for each batch: changes (triple, score), touched (seeds with a changed triple), states
  (a seed's ranked-for paths under the scores of that batch), versions (seeds whose states a batch made), ranked (the result).

A batch reads only the parts of its own seeds, makes new states only for seeds that have none or were touched since, and
takes the scores of what it changes from the states, so no batch reads all scores. A batch that is run again sees the same logs of the
batches before and overwrites its own tables. Now and then logs are compacted to their last rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.operators import feedback, ranking
from graphtide.operators.graph import KEY, hop_edge
from graphtide.session import discard, materialize, remove

PARTS, COMPACT = 64, 32
ORDER = ["q_ord", "idx", "event_id"]
_LOGS = {
    "changes": ("head string, rel string, tail string, score double, batch long", KEY),
    "touched": ("seed string, batch long", ["seed"]),
    "versions": ("seed string, batch long", ["seed"]),
}
_HOP = "struct<hop_ord:int,src:string,rel:string,dst:string,dir:string,score:double>"
_STATES = f"seed string, path_ord long, v long, n_kept int, product double, hops array<{_HOP}>, batch long, part int"


class Loop:
    """The loop in a folder. judge: facts(q_id, pos, fact, head, rel, tail) to feedback(q_ord, idx, kind, degree, event_id); similar: pairs(q_id, v) to (q_id, v, sim)."""

    def __init__(self, spark: SparkSession, folder: str, judge: Callable[[DataFrame], DataFrame], similar: Callable[[DataFrame], DataFrame], sim_threshold: float = 0.0, score_threshold: float = 61.0, pruning: int = 5, parts: int = PARTS, compact_every: int = COMPACT):
        self.spark, self.folder, self.judge, self.similar = spark, folder.rstrip("/"), judge, similar
        self.sim_threshold, self.score_threshold, self.pruning, self.parts, self.compact_every = sim_threshold, score_threshold, pruning, parts, compact_every

    # tables

    def _part(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.parts)).cast("int")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def _log(self, name: str, before: int) -> DataFrame:
        return self._read(name, _LOGS[name][0]).where(F.col("batch") < before)

    def _append(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/{name}/log={batch}")

    def _last_changes(self, before: int) -> DataFrame:
        return self._log("changes", before).groupBy(*KEY).agg(F.max_by("score", "batch").alias("changed"))

    def scores(self, base: DataFrame, before: int = 1 << 62) -> DataFrame:
        """base(head, rel, tail, score) with the changes of the batches before `before`."""
        last = self._last_changes(before)
        return base.hint("merge").join(last.hint("merge"), KEY, "left").select(*KEY, F.coalesce("changed", "score").alias("score"))

    def changed(self, before: int = 1 << 62) -> DataFrame:
        """The triples with changes and their scores."""
        return self._last_changes(before).withColumnRenamed("changed", "score")

    def _parts_of(self, rows: DataFrame, *columns: str) -> list[int]:
        return [r[0] for r in rows.select(self._part(*columns)).distinct().collect()]  # at most `parts` numbers

    # steps

    def prepare(self, paths: DataFrame) -> None:
        """Writes the indexes of paths(seed, path_ord, v, hops with src, rel, dst, dir, score)."""
        each = paths.select("seed", F.col("path_ord").cast("long").alias("path_ord"), F.col("v").cast("long").alias("v"), F.posexplode("hops").alias("hop_ord", "h"))
        rows = each.select("seed", "path_ord", "v", "hop_ord", "h.src", "h.rel", "h.dst", "h.dir", F.col("h.score").cast("double").alias("base"), hop_edge(F.col("h")).alias("edge"))
        rows = rows.select(*(c for c in rows.columns if c != "edge"), F.col("edge.head").alias("head"), F.col("edge.tail").alias("tail"), self._part("seed").alias("part"))
        rows.repartition("part", "seed").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/hops")
        edges = self.spark.read.parquet(f"{self.folder}/hops").select("seed", *KEY).distinct().withColumn("part", self._part(*KEY))
        edges.repartition("part", *KEY).write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/edges")

    def _stale(self, needed: DataFrame, batch: int) -> DataFrame:
        made = self._log("versions", batch).groupBy("seed").agg(F.max("batch").alias("made"))
        touched = self._log("touched", batch).groupBy("seed").agg(F.max("batch").alias("touched"))
        known = needed.hint("merge").join(made.hint("merge"), "seed", "left").hint("merge").join(touched.hint("merge"), "seed", "left")
        return known.where(F.col("made").isNull() | (F.col("touched") >= F.col("made"))).select("seed")

    def _refresh(self, stale: DataFrame, batch: int) -> None:
        """States of the seeds under the scores before this batch."""
        hops = self.spark.read.parquet(f"{self.folder}/hops").where(F.col("part").isin(self._parts_of(stale, "seed")))
        mine = hops.hint("merge").join(stale.hint("merge"), "seed", "left_semi").hint("merge").join(self._last_changes(batch).hint("merge"), KEY, "left")
        hop = F.struct("hop_ord", "src", "rel", "dst", "dir", F.coalesce("changed", "base").alias("score"))
        whole = mine.groupBy("seed", "path_ord", "v", "part").agg(F.array_sort(F.collect_list(hop)).alias("hops")).where(~F.exists("hops", lambda h: h["score"].isNull()))
        kept = whole.withColumn("hops", F.filter("hops", lambda h: h["score"] >= self.score_threshold)).where(F.size("hops") > 0)
        states = kept.select("seed", "path_ord", "v", F.size("hops").alias("n_kept"), F.aggregate("hops", F.lit(1.0), lambda a, h: a * h["score"]).alias("product"), "hops", "part")
        states.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/states/batch={batch}")
        self._append("versions", stale, batch)

    def _states(self, needed: DataFrame, batch: int) -> DataFrame:
        made = self._log("versions", batch + 1).groupBy("seed").agg(F.max("batch").alias("batch"))
        wanted = needed.hint("merge").join(made.hint("merge"), "seed")
        states = self._read("states", _STATES).where(F.col("part").isin(self._parts_of(needed, "seed")))
        return states.hint("merge").join(wanted.hint("merge"), ["seed", "batch"])

    def _ranked(self, asked: DataFrame, states: DataFrame) -> DataFrame:
        near = materialize(asked.hint("merge").join(states.hint("merge"), "seed").select("q_id", "seed", "seed_ord", "path_ord", "v", "n_kept", "product"), "asked")
        sims = self.similar(near.select("q_id", "v").distinct())
        valued = near.hint("merge").join(sims.hint("merge"), ["q_id", "v"]).where(F.col("sim") > self.sim_threshold)
        valued = valued.withColumn("value", ranking.basic_value(F.col("sim"), F.col("product"), F.col("n_kept")))
        best = materialize(ranking.top_paths(valued, "value", self.pruning).select("q_id", "seed", "seed_ord", "path_ord", "value", "rank"), "best")
        return best.hint("merge").join(states.select("seed", "path_ord", "hops").hint("merge"), ["seed", "path_ord"])

    def step(self, asked: DataFrame, batch: int) -> None:
        """One batch of asked(q_id, seed, seed_ord)."""
        if self.compact_every and batch and batch % self.compact_every == 0:
            self.compact(batch)
        needed = materialize(asked.select("seed").distinct(), "needed")
        stale = materialize(self._stale(needed, batch), "stale")
        self._refresh(stale, batch)
        self._append("ranked", self._ranked(asked, materialize(self._states(needed, batch), "states")), batch)
        ranked = self.spark.read.parquet(f"{self.folder}/ranked/log={batch}")
        each = ranked.select("q_id", "seed_ord", F.col("rank").alias("path_ord"), F.posexplode("hops").alias("at", "h")).select("q_id", "seed_ord", "path_ord", "h.hop_ord", hop_edge(F.col("h")).alias("e"), "h.score")
        hops = each.select("q_id", "seed_ord", "path_ord", "hop_ord", "e.*", "score")
        facts = materialize(ranking.unique_facts(hops), "facts")
        said = self.judge(facts).withColumnsRenamed({"q_ord": "q_id", "idx": "pos"})
        judged = facts.hint("merge").join(said.hint("merge"), ["q_id", "pos"]).withColumnsRenamed({"q_id": "q_ord", "pos": "idx"})
        deltas = materialize(feedback.leaderboard_deltas(judged).select(*KEY, *(F.col(c).cast("long").alias(c) for c in ORDER), F.col("delta").cast("double").alias("delta")), "deltas")
        now = hops.hint("merge").join(deltas.select(*KEY).distinct().hint("merge"), KEY, "left_semi").groupBy(*KEY).agg(F.max("score").alias("score"))
        self._append("changes", feedback.fold(now, deltas, ORDER), batch)
        changed = self.spark.read.parquet(f"{self.folder}/changes/log={batch}")
        edges = self.spark.read.parquet(f"{self.folder}/edges").where(F.col("part").isin(self._parts_of(changed, *KEY)))
        self._append("touched", edges.hint("merge").join(changed.select(*KEY).hint("merge"), KEY, "left_semi").select("seed").distinct(), batch)
        discard(needed, stale, facts, deltas)

    def compact(self, before: int) -> None:
        """Puts the logs of the batches before `before` into one table each, with the last row of each key. Interrupted, it leaves repeated rows, which don't matter."""
        for name, (_, key) in _LOGS.items():
            if not self._exists(f"{self.folder}/{name}"):
                continue
            old = self._read(name, f"{_LOGS[name][0]}, log string").where(F.col("batch") < before)
            logs = [r[0] for r in old.select("log").distinct().collect()]  # one for each batch since the last time
            last = old.groupBy(*key).agg(F.max("batch").alias("batch"), *([F.max_by("score", "batch").alias("score")] if name == "changes" else []))
            last.write.mode("overwrite").parquet(f"{self.folder}/{name}/log=before-{before}")
            for log in logs:
                if log != f"before-{before}":
                    remove(self.spark, f"{self.folder}/{name}/log={log}")

    def run(self, asked: DataFrame, checkpoint: str) -> None:
        """All batches of asked(batch, q_id, seed, seed_ord), numbered from 0, as a stream of batch numbers; goes on after a failure with the batch that failed."""
        if not self._exists(f"{self.folder}/asked"):
            asked.write.partitionBy("batch").parquet(f"{self.folder}/asked")
            table = self.spark.read.parquet(f"{self.folder}/asked")
            for number in sorted(r[0] for r in table.select("batch").distinct().collect()):
                self.spark.range(number, number + 1, 1, 1).write.mode("append").parquet(f"{self.folder}/batches")

        def one(numbers: DataFrame, _: int) -> None:
            for number in [r[0] for r in numbers.collect()]:  # the number of one batch
                session = numbers.sparkSession
                self.step(session.read.parquet(f"{self.folder}/asked").where(F.col("batch") == number).drop("batch"), number)

        stream = self.spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/batches")
        stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
