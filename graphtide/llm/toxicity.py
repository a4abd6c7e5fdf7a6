"""Toxicity by a character n-gram linear classifier with naive Bayes feature scaling.

Texts are lower-cased and padded with a space; each distinct n-gram of 4 to 6 characters, hashed
to 2^20 buckets, is a binary feature. A bucket's value is its naive Bayes log-count ratio: the
smoothed share of toxic documents' features against that of the others'. All buckets whose ratio
stands out from its standard error by MIN_Z stay, and a logistic regression with an L2 penalty is
fitted on them. A score is the predicted probability.

The model is fitted on at most `fit_rows` labelled rows, those with the smallest hashes of doc_id,
so the sample and all that is gathered on the driver have a bound; every row is scored, over its
whole text. Only the text is an input of a score.

Null and empty texts score as a text without features. Null labels teach nothing; a doc_id labelled
twice is toxic if either label says so. Without labelled rows of both classes, every score is the
smoothed share of toxic labels. An empty table gives an empty result; further columns are not used
by `score` and kept by `reject`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import column, trimmed
from graphtide.session import discard, materialize

ORDERS, BITS, FIT_ROWS, THRESHOLD = (4, 5, 6), 20, 20_000, 0.7
MIN_Z, SMOOTHING, PENALTY, STEPS = 3.5, 1.0, 1e-4, 300
_PART = 250_000
_P, _M = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _parts(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (text number, string) with about _PART characters; long texts come in parts that overlap."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        text = f" {text.lower()} " if text else ""
        for at in range(0, max(len(text) - max(ORDERS) + 1, 1), _PART):
            part = text[at : at + _PART + max(ORDERS) - 1]
            owners.append(i)
            parts.append(part)
            size += len(part)
            if size >= _PART or len(parts) == 1 << (32 - BITS):
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def features(texts: list[str | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs, sorted; only buckets marked in keep, if given."""
    pairs, low = [np.zeros(0, np.int64)], (1 << BITS) - 1
    for owners, parts in _parts(texts):
        sizes = np.array([len(p) for p in parts])
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).copy()
        chars[(chars >= 9) & (chars <= 13)] = 32
        number = np.repeat(np.arange(len(parts), dtype=np.uint32), sizes)
        rolled, found = chars, []
        for n in range(2, max(ORDERS) + 1):
            rolled = rolled[: max(len(chars) - n + 1, 0)] * _P + chars[n - 1 :]
            if n in ORDERS and len(rolled):
                bucket = (rolled * _M) >> np.uint32(32 - BITS)
                ok = np.flatnonzero(number[: len(bucket)] == number[n - 1 :]) if keep is None else np.flatnonzero(keep[bucket])
                if keep is not None:
                    ok = ok[number[ok] == number[ok + n - 1]]
                found.append((number[ok] << np.uint32(BITS)) | bucket[ok])
        if found:
            pair = _distinct(np.concatenate(found)).astype(np.int64)
            pairs.append((np.array(owners, np.int64)[pair >> BITS] << BITS) | (pair & low))
    pairs = _distinct(np.concatenate(pairs))
    return pairs >> BITS, pairs & low


@dataclass
class Model:
    """Weights by bucket (zero: no feature) and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        weight = np.zeros(1 << BITS, np.float64)
        weight[self.buckets] = self.weights
        return weight, weight != 0

    def scores(self, texts: list[str | None], tables=None) -> np.ndarray:
        weight, keep = tables or self.tables()
        owner, bucket = features(texts, keep)
        total = self.bias + np.bincount(owner, weight[bucket], minlength=len(texts))[: len(texts)]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, toxic) of at most fit_rows labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("of"), (F.col("toxic") > 0).alias("toxic")))  # fit_rows at most
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("of")).select("text", "toxic")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        toxic = np.array(column(batch, "toxic").to_pylist(), bool)
        owner, bucket = features(column(batch, "text").to_pylist())
        for k in (0, 1):
            counts[k] += np.bincount(bucket[toxic[owner] == bool(k)], minlength=1 << BITS)
            rows[k] += int((toxic == bool(k)).sum())
    seen = np.flatnonzero(counts.any(0))
    bucket = np.concatenate([[-1], seen])  # -1: the numbers of rows
    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.concatenate([rows[:1], counts[0, seen]])), pa.array(np.concatenate([rows[1:], counts[1, seen]]))], names=["bucket", "clean", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The classifier, fitted on labelled rows that are not held out."""
    sample = _sample(docs, labels, fit_rows)
    counted = sample.mapInArrow(trimmed(_count), "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = materialize(counted, "counts")  # 2^20 + 1 rows at most
    rows = counted.where("bucket < 0").agg(F.sum("clean"), F.sum("toxic")).first()
    clean_rows, toxic_rows = (int(n or 0) for n in rows)
    bias = float(np.log((toxic_rows + SMOOTHING) / (clean_rows + SMOOTHING)))
    none = Model(np.zeros(0, np.int64), np.zeros(0), bias)
    real = counted.where("bucket >= 0").select("bucket", (F.col("toxic") + SMOOTHING).alias("p"), (F.col("clean") + SMOOTHING).alias("q"))
    p_sum, q_sum = real.agg(F.sum("p"), F.sum("q")).first()
    if not clean_rows or not toxic_rows or not p_sum:
        return none
    ratio = F.log(F.col("p") / p_sum) - F.log(F.col("q") / q_sum)
    z = F.round(F.abs(ratio) / F.sqrt(1 / F.col("p") + 1 / F.col("q")), 9)
    best = real.select("bucket", ratio.alias("ratio"), z.alias("z")).where(F.col("z") >= MIN_Z).orderBy("bucket").select("bucket", "ratio").toArrow()  # 2^20 rows at most
    discard(counted)
    if not best.num_rows:
        return none
    buckets, ratio = best.column("bucket").to_numpy(), best.column("ratio").to_numpy()
    keep = np.zeros(1 << BITS, bool)
    keep[buckets] = True
    shared = docs.sparkSession.sparkContext.broadcast(keep)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = column(batch, "toxic")
            owner, bucket = features(column(batch, "text").to_pylist(), shared.value)
            ends = np.searchsorted(owner, np.arange(len(toxic) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([toxic, pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], names=["toxic", "buckets"])

    chosen = sample.mapInArrow(trimmed(select), "toxic boolean, buckets array<int>").toArrow()  # fit_rows rows at most
    place = np.zeros(1 << BITS, np.min_scalar_type(len(buckets)))
    place[buckets] = np.arange(len(buckets))
    y = np.array(chosen.column("toxic").to_pylist(), float)
    lists = chosen.column("buckets").combine_chunks()
    sizes, feature = np.diff(lists.offsets.to_numpy()), place[lists.flatten().to_numpy()]
    del chosen, lists
    weights, bias = _logistic(y, sizes, feature, ratio, bias)
    pa.default_memory_pool().release_unused()
    return Model(buckets, weights * ratio, bias)


def _logistic(y: np.ndarray, sizes: np.ndarray, feature: np.ndarray, ratio: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by Adam over all rows; row i has the next sizes[i] entries of feature, each of value ratio."""
    full = np.flatnonzero(sizes)
    row_starts = (np.cumsum(sizes) - sizes)[full]
    rows = np.repeat(np.arange(len(y), dtype=np.min_scalar_type(len(y))), sizes)[np.argsort(feature, kind="stable")]
    counts = np.bincount(feature, minlength=len(ratio))
    some = np.flatnonzero(counts)
    feature_starts = (np.cumsum(counts) - counts)[some]
    w, b, margin, slope = np.zeros(len(ratio)), bias, np.zeros(len(y)), np.zeros(len(ratio))
    m = v = np.zeros(len(ratio) + 1)
    for step in range(1, STEPS + 1):
        margin[full] = np.add.reduceat((w * ratio)[feature], row_starts)
        error = (1 / (1 + np.exp(-np.clip(margin + b, -40, 40))) - y) / len(y)
        slope[some] = np.add.reduceat(error[rows], feature_starts)
        g = np.append(slope * ratio + PENALTY * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for batch in batches:
            scores = shared.value.scores(column(batch, "text").to_pylist(), tables)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(work), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(column(batch, "text").to_pylist(), tables) < threshold))

    return docs.mapInArrow(trimmed(work), docs.schema)
