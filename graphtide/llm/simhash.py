"""SimHash near-duplicates with BK-trees over fingerprint shards.

Fingerprints: texts are lower-cased (A-Z), cut into words and 3-word shingles (repeats count);
a bit is set if it is set in over half of the shingles' XXH64. Fingerprints that differ in at most
`radius` bits are linked; a component is everything reachable, named by its smallest doc_id.

Search: if two fingerprints differ in at most r bits and the 64 bits are cut into k > r parts, they
agree on some k - r parts. So every distinct fingerprint goes to one shard for each choice of k - r
parts, keyed by their bits. In each shard a BK-tree is built (children keyed by their integer
distance to the parent) and probed with the shard's own fingerprints, following only edges within
the radius of the distance at hand. The trees travel to their probes by shuffle, not by broadcast:
all trees together grow with the corpus, and no fingerprint outside a shard can match in it.
A shard with more than `shard_rows` fingerprints is cut into chunks and each pair of chunks is a
tree of its own, so no task holds an unbounded group and no link is lost. A tree reports a spanning
forest of its links, not its pairs.

Null and empty texts have fingerprint zero, which is linked like any other. Rows with a null
doc_id get the component of their fingerprint's other rows (null if there are none). Repeated rows
share a fingerprint. An empty table gives an empty result; further columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import column
from graphtide.operators.components import components
from graphtide.session import discard, materialize

SEED, WORDS, RADIUS, SHARD_ROWS, MANY = 42, 3, 3, 512, 1 << 24
_BLOCK = 200_000  # shingles hashed before their bits are counted


def _bit_counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    return bits.sum(0, dtype=np.int64)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text."""
    found = text.lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    ends = list(accumulate((len(w) + 1 for w in found), initial=0))
    stops = [e - 1 for e in (ends[words:] if len(found) >= words else ends[-1:])]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        counts += _bit_counts([hashed(joined[s:e], seed) for s, e in zip(ends[at : min(n, at + _BLOCK)], stops[at : at + _BLOCK], strict=True)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit integer."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.encode() if t else b"", words, seed) for t in column(batch, "text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, fp long")


def build_trees(fps: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """BK-trees of many shards at once: children[node, distance], -1 where there is none.

    roots[i] is the first item of i's shard. Items go down level by level; at each empty place the
    earliest item settles, which gives the tree that inserting them one by one gives.
    """
    children = np.full((len(fps), 65), -1, np.int32)
    items = np.flatnonzero(roots != np.arange(len(fps)))
    at = roots[items]
    while len(items):
        distance = np.bitwise_count(fps[items] ^ fps[at]).astype(np.int64)
        free = children[at, distance] < 0
        if free.any():
            _, first = np.unique(at[free] * 65 + distance[free], return_index=True)
            settled = np.flatnonzero(free)[first]
            children[at[settled], distance[settled]] = items[settled]
        at = children[at, distance].astype(np.int64)
        going = at != items
        items, at = items[going], at[going]
    return children


def probe_trees(fps: np.ndarray, roots: np.ndarray, children: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (query, node) within the radius in the query's own shard, the query itself left out."""
    asks, nodes, left, right = queries, roots[queries], [], []
    while len(asks):
        distance = np.bitwise_count(fps[asks] ^ fps[nodes]).astype(np.int64)
        hit = (distance <= radius) & (asks != nodes)
        left.append(asks[hit])
        right.append(nodes[hit])
        more = [(asks[ok], found[ok]) for step in range(-radius, radius + 1) for found in [_child(children, nodes, distance + step)] for ok in [found >= 0]]
        asks, nodes = np.concatenate([m[0] for m in more]), np.concatenate([m[1] for m in more]).astype(np.int64)
    return np.concatenate(left), np.concatenate(right)


def _child(children: np.ndarray, nodes: np.ndarray, distance: np.ndarray) -> np.ndarray:
    return np.where((distance >= 0) & (distance <= 64), children[nodes, np.clip(distance, 0, 64)], -1)


def forest(fps: np.ndarray, roots: np.ndarray, sizes: np.ndarray, radius: int, most: int = 1_000_000) -> np.ndarray:
    """For each item the earliest item of its shard that it is linked to, directly or through others."""
    children, labels = build_trees(fps, roots), np.arange(len(fps))
    bounds = np.cumsum(sizes)
    start = 0
    while start < len(fps):
        stop = max(start + 1, int(np.searchsorted(bounds, (bounds[start - 1] if start else 0) + most)))
        a, b = probe_trees(fps, roots, children, np.arange(start, stop), radius)
        while len(a):
            la, lb = labels[a], labels[b]
            differ = la != lb
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            low = np.minimum(la, lb)
            np.minimum.at(labels, la, low)
            np.minimum.at(labels, lb, low)
            while (labels[labels] != labels).any():
                labels = labels[labels]
        start = stop
    return labels


def _links(radius: int):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = pd.DataFrame()
        for frame in frames:
            rest = pd.concat([rest, frame]) if len(rest) else frame
            if len(rest) < 50_000:
                continue
            last = rest[["shard", "cell"]].iloc[-1]
            open_ = (rest["shard"].to_numpy() == last["shard"]) & (rest["cell"].to_numpy() == last["cell"])
            yield done(rest[~open_])
            rest = rest[open_]
        if len(rest):
            yield done(rest)

    def done(part: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        shard, cell, fps, reps = (part[c].to_numpy() for c in ("shard", "cell", "fp", "rep"))
        order = np.lexsort((reps, cell, shard))
        shard, cell, fps, reps = shard[order], cell[order], fps[order].view(np.uint64), reps[order]
        new = np.r_[True, (shard[1:] != shard[:-1]) | (cell[1:] != cell[:-1])]
        starts = np.flatnonzero(new)
        lengths = np.diff(np.r_[starts, len(fps)])
        labels = forest(fps, np.repeat(starts, lengths), np.repeat(lengths, lengths), radius)
        linked = np.flatnonzero(labels != np.arange(len(fps)))
        return pd.DataFrame({"a": reps[linked], "b": reps[labels[linked]]}).drop_duplicates()

    return work


def shards(reps: DataFrame, radius: int, parts: int, shard_rows: int) -> DataFrame:
    """(shard, cell, fp, rep): every fingerprint once for each shard, and there once for each cell that needs it."""
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in combinations(range(parts), parts - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    keyed = reps.select("fp", "rep", F.explode(keys).alias("shard"))
    large = materialize(keyed.groupBy("shard").count().where(F.col("count") > shard_rows).select(F.col("shard").alias("large"), F.ceil(F.col("count") / shard_rows).cast("int").alias("chunks")), "large")
    side = F.broadcast(large) if large.count() <= 300_000 else large.hint("merge")
    joined = keyed.join(side, F.col("shard") == F.col("large"), "left")
    own = F.pmod(F.xxhash64(F.lit(7), "fp"), F.coalesce("chunks", F.lit(1))).cast("long")
    n = F.coalesce("chunks", F.lit(1)).cast("long")
    others = F.filter(F.sequence(F.lit(0).cast("long"), n - 1), lambda o: o != own)
    cells = F.when(n == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, lambda o: F.least(o, own) * n + F.greatest(o, own)))
    return joined.select("shard", F.explode(cells).alias("cell"), "fp", "rep")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, seed: int = SEED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row of docs(doc_id, text)."""
    prints = materialize(fingerprints(docs, words, seed), "prints")
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    known = reps.where(F.col("rep").isNotNull())
    parts = radius + 1 if known.count() <= MANY else radius + 2
    cells = shards(known, radius, parts, shard_rows).repartition("shard", "cell").sortWithinPartitions("shard", "cell")
    labels = components(cells.mapInPandas(_links(radius), "a long, b long"))
    named = materialize(known.hint("merge").join(labels.hint("merge"), F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("label", "rep").alias("component_id")), "named")
    joined = prints.hint("merge").join(named.hint("merge"), F.col("fp") == F.col("of"), "left")
    out = materialize(joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "components")
    discard(prints, reps, labels, named)
    return out


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that are not the first of their component; all columns stay.

    A row stays if its doc_id is its component_id; of repeated rows with that doc_id, all stay.
    Rows with a null doc_id stay.
    """
    found = near_duplicates(docs, **options).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(materialize(found, "copies").hint("merge"), "doc_id", "left_anti")
