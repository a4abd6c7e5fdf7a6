"""Line dedup over levelled sorted runs of line hashes.

Each batch of documents adds one run to `LineRuns`: for every line key (128 bits of XXH3) the number of its documents
and the largest doc_id among them. A run is a table bucketed and sorted by key, so joins of runs need no
shuffle. When a level holds FANOUT runs they are compacted, by a merge of equal keys, into one run of
the level above: a key is rewritten a logarithmic number of times, however many batches come. Batches
come with falling doc_ids, so a key that the runs already know from `least` documents is settled: the largest doc_id
holding it can't change. A new batch is merge-anti-joined with the runs, and only what isn't settled becomes its run.

A line's key is the line without white space (blank, tab to carriage return) at both ends, with A-Z
lower-cased. Keys of at least `chars` code points found in at least `least` documents lose all their lines except
in the largest doc_id holding them; shorter keys, empty ones too, always stay.

Scale: keys are taken where the text is read, and only keys move. A key found in over 1/HOT of a batch's (key,
document) pairs is hot; a batch has at most HOT of them, so they are broadcast, and what is left to
the shuffle has no heavy key. Texts move once, to the keys that they lose.

Null or empty texts are one empty line. Rows with a null doc_id are no document: they count for nothing and lose
nothing. Rows that repeat a doc_id are one document for the counts, and each loses its own lines. An empty table
gives an empty result; further columns aren't used.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.llm.common import column, slices, utf8
from graphtide.session import discard, materialize, own_dir, remove

CHARS, LEAST, BATCHES, FANOUT, HOT = 20, 3, 4, 2, 4096
BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SLICE_BYTES = 8_000_000


def line_key(line: bytes, chars: int = CHARS) -> bytes | None:
    """The 128-bit hash of the line's key; None for a short key."""
    key = line.strip(BLANKS).translate(_LOWER)
    size = len(key)
    if chars <= size < 4 * chars and not key.isascii():
        size = len(key.decode())
    return xxhash.xxh3_128_digest(key) if size >= chars else None


def line_keys(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """(doc_id, key) for each row with a doc_id and each of its different keys that are long enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for first, last in slices(utf8(texts)[1], _SLICE_BYTES):
                owners, found = [], []
                for i, text in zip(ids.slice(first, last - first).to_pylist(), texts.slice(first, last - first).cast(pa.binary()).to_pylist(), strict=True):
                    own = {key for line in (text or b"").split(b"\n") if (key := line_key(line, chars))}
                    found.extend(own)
                    owners.extend([i] * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "key"])

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, key binary")


class LineRuns:
    """Runs of (key, docs, largest), level by level."""

    def __init__(self, spark: SparkSession, least: int = LEAST, fanout: int = FANOUT, hot: int = HOT):
        self.spark, self.least, self.fanout, self.most_hot = spark, least, fanout, hot
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.batches: list[DataFrame] = []
        self.hot = spark.createDataFrame([], "key binary")
        self.lowest: int | None = None

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = run.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key")
        writer.option("path", f"{own_dir(self.spark)}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{own_dir(self.spark)}/{name}")

    def _merged(self, names: list[str]) -> DataFrame:
        """Equal keys of several runs as one: each key from the first run that holds it, with what the runs after it add.

        Joins by bucket, and a union of parts without a common key: Spark 4.1 takes a union of bucketed tables as partitioned by key, but
        reads their buckets one after the other, so an aggregate over it would leave equal keys apart.
        """
        parts = []
        for i, name in enumerate(names):
            part = self.spark.table(name)
            for before in names[:i]:
                part = part.hint("merge").join(self.spark.table(before).select("key"), "key", "left_anti")
            docs, largest = F.col("docs"), [F.col("largest")]
            for k, after in enumerate(names[i + 1 :]):
                more = self.spark.table(after).select("key", F.col("docs").alias(f"docs_{k}"), F.col("largest").alias(f"largest_{k}"))
                part = part.hint("merge").join(more, "key", "left")
                docs, largest = docs + F.coalesce(f"docs_{k}", F.lit(0)), [*largest, F.col(f"largest_{k}")]
            parts.append(part.select("key", docs.alias("docs"), (F.greatest(*largest) if len(largest) > 1 else largest[0]).alias("largest")))
        return reduce(DataFrame.union, parts)

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, pairs: DataFrame) -> None:
        """Adds a batch of (doc_id, key), whose doc_ids must all be below those of the batches before."""
        counts = pairs.distinct().groupBy("key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest"))
        batch = materialize(counts, "batch_lines")
        total, low, high = batch.agg(F.sum("docs"), F.min("smallest"), F.max("largest")).first()
        self.batches.append(batch)
        if total is None:
            return
        if self.lowest is not None and high >= self.lowest:
            raise ValueError(f"doc_id {high} after {self.lowest}: batches must come with falling doc_ids")
        self.lowest = low
        self.hot = self.hot.union(batch.where(F.col("docs") * self.most_hot > total).select("key"))
        new, known = batch, F.lit(0)
        for k, name in enumerate(self._names()):
            new = new.hint("merge").join(self.spark.table(name).select("key", F.col("docs").alias(f"known_{k}")), "key", "left")
            known = known + F.coalesce(f"known_{k}", F.lit(0))
        self._settle(self._write(new.where(known < self.least).select("key", "docs", "largest")))

    def _settle(self, run: str, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            below, self.levels[level] = self.levels[level], []
            above = self._write(self._merged(below))
            for name in below:
                self._drop(name)
            self._settle(above, level + 1)

    def settled(self) -> DataFrame:
        """(key, largest) of the keys in at least `least` documents."""
        if not self._names():
            return self.spark.createDataFrame([], "key binary, largest long")
        return self._merged(self._names()).where(F.col("docs") >= self.least).select("key", "largest")

    def hot_keys(self) -> DataFrame:
        """At most HOT keys for each batch."""
        return self.hot.distinct()

    def close(self) -> None:
        for name in self._names():
            self._drop(name)
        discard(*self.batches)
        self.levels, self.batches = [], []


def lost_lines(docs: DataFrame, chars: int = CHARS, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT, hot: int = HOT) -> DataFrame:
    """(doc_id, lost): for each document that loses lines, their keys."""
    pairs = materialize(line_keys(docs, chars), "line_keys")
    runs = LineRuns(docs.sparkSession, least, fanout, hot)
    bounds = pairs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(bounds or [])), None]
    for above, upto in reversed(list(zip(edges, edges[1:], strict=False))):
        some = pairs if above is None else pairs.where(F.col("doc_id") > above)
        runs.add(some if upto is None else some.where(F.col("doc_id") <= upto))
    settled, heavy = materialize(runs.settled(), "settled_lines"), materialize(runs.hot_keys(), "hot_lines")
    runs.close()
    few = pairs.join(F.broadcast(settled.hint("merge").join(heavy, "key")), "key")
    rest = pairs.join(F.broadcast(heavy), "key", "left_anti").hint("merge").join(settled.hint("merge"), "key")
    lost = few.select("doc_id", "key", "largest").union(rest.select("doc_id", "key", "largest")).where("doc_id < largest")
    out = materialize(lost.groupBy("doc_id").agg(F.collect_list("key").alias("lost")), "lost_lines")
    discard(pairs, settled, heavy)
    return out


def dedup_lines(docs: DataFrame, chars: int = CHARS, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT, hot: int = HOT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row of docs(doc_id, text); text: the lines that stay."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lost = (column(batch, name) for name in ("doc_id", "text", "lost"))
            for first, last in slices(utf8(texts)[1], _SLICE_BYTES):
                counts, dropped, kept = [], [], []
                for text, gone in zip(texts.slice(first, last - first).cast(pa.binary()).to_pylist(), lost.slice(first, last - first).to_pylist(), strict=True):
                    lines = (text or b"").split(b"\n")
                    gone = set(gone or ())
                    stay = [line for line in lines if line_key(line, chars) not in gone] if gone else lines
                    counts.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay))
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    lost = lost_lines(rows, chars, least, batches, fanout, hot)
    named = rows.where(F.col("doc_id").isNotNull()).join(lost.hint("shuffle_hash"), "doc_id", "left")
    nameless = rows.where(F.col("doc_id").isNull()).withColumn("lost", F.lit(None).cast("array<binary>"))
    return named.unionByName(nameless).mapInArrow(work, "doc_id long, n_lines long, n_dropped long, text string")
