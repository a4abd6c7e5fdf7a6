"""Redundant facts and duplicate entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtide.operators.components import components
from graphtide.operators.graph import KEY, rename, send_or_sort
from graphtide.operators.vectors import usable
from graphtide.session import materialize


def pair_groups(facts: DataFrame) -> DataFrame:
    """Groups of two or more facts of a question between the same two entities, either way round: q_id, a, b, facts."""
    grouped = facts.groupBy("q_id", F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b"))
    return grouped.agg(F.array_sort(F.collect_list(F.concat_ws(" ", *KEY))).alias("facts")).where(F.size("facts") > 1)


def directed_groups(facts: DataFrame) -> DataFrame:
    """The same by ordered (head, tail), with all relations."""
    return facts.groupBy("q_id", "head", "tail").agg(F.array_sort(F.collect_set("rel")).alias("rels")).where(F.size("rels") > 1)


def keep_delete(groups: DataFrame, keep: DataFrame) -> DataFrame:
    """q_id, fact, decision of groups(q_id, group_ord, facts) for keep(q_id, id), ids counting a question's facts over its groups.

    Facts of a group without a kept fact have no decision and stay.
    """
    before = F.coalesce(F.sum(F.size("facts")).over(Window.partitionBy("q_id").orderBy("group_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flat = groups.withColumn("before", before).select("q_id", "group_ord", "before", F.posexplode("facts").alias("i", "fact")).withColumn("id", F.col("before") + F.col("i"))
    kept = keep.select("q_id", F.col("id").cast("long").alias("id"), F.lit(True).alias("kept")).distinct()
    joined = flat.withColumn("id", F.col("id").cast("long")).hint("merge").join(kept.hint("merge"), ["q_id", "id"], "left")
    decided = F.max(F.coalesce("kept", F.lit(False))).over(Window.partitionBy("q_id", "group_ord"))
    return joined.withColumn("decided", decided).select("q_id", "fact", F.when(F.col("kept"), "keep").when(F.col("decided"), "delete").otherwise("undecided").alias("decision"))


def apply_deletes(scores: DataFrame, gone: DataFrame) -> DataFrame:
    return scores.join(gone.select(*KEY).distinct(), KEY, "left_anti")


def missing_deletes(scores: DataFrame, gone: DataFrame) -> DataFrame:
    """Deletes that name no stored triple."""
    return gone.select(*KEY).distinct().join(scores.select(*KEY), KEY, "left_anti")


def replacement_map(groups: DataFrame) -> DataFrame:
    """dup, canonical of groups(group_ord, members): all but the first go to the first; a later group overwrites; one level only."""
    pairs = groups.where(F.size("members") > 1).select("group_ord", F.element_at("members", 1).alias("canonical"), F.explode(F.slice("members", F.lit(2), F.size("members"))).alias("dup"))
    return pairs.groupBy("dup").agg(F.max_by("canonical", "group_ord").alias("canonical"))


def rename_scores(scores: DataFrame, mapping: DataFrame) -> DataFrame:
    """Scores after renaming; of triples that become equal the highest score stays."""
    return rename(scores, mapping).groupBy(*KEY).agg(F.max("score").alias("score"))


def merge_rewire(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """action, head, rel, tail: the edges of duplicates to delete and those to insert at their canonical entity."""
    dup = mapping.select(F.col("dup").alias("name"))
    touched = triples.join(dup, F.col("head") == F.col("name"), "left_semi").union(triples.join(dup, F.col("tail") == F.col("name"), "left_semi")).distinct()
    new = rename(touched, mapping).join(triples, KEY, "left_anti").distinct()
    return touched.select(F.lit("delete").alias("action"), *KEY).union(new.select(F.lit("insert").alias("action"), *KEY))


def redundancy_rate(decisions: DataFrame) -> DataFrame:
    """Per question the share of facts deleted."""
    return decisions.groupBy("q_id").agg(F.round(F.count_if(F.col("decision") == "delete") / F.count("*"), 6).alias("rate"))


def average_linkage(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster numbers of average-linkage clustering on cosine distance, cut at the threshold; numbered by first member.

    The average cosine of two clusters is the product of their sums of unit vectors over the product of their sizes, so a cluster
    is its sum and memory is linear. A chain of nearest neighbours is followed until two clusters are each other's nearest: they
    merge, in whatever order, to the same tree. A cluster whose nearest is not below the threshold is done: no later merge comes nearer.
    """
    unit = vectors / np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-12)
    if len(unit) < 2 or threshold <= 0:
        return np.arange(len(unit))
    points, first, of, size = np.unique(np.round(unit, 12), axis=0, return_index=True, return_inverse=True, return_counts=True)  # equal vectors merge at 0
    of = of.ravel()
    owner = np.arange(len(points))  # of each point: the point that stands for its cluster
    name, sums, size = np.arange(len(points)), points * size[:, None], size.astype(float)
    alive, left, chain = np.ones(len(points), bool), len(points), []
    while left:
        if 2 * left < len(alive) and len(alive) > 64:  # forget what is done
            place = np.cumsum(alive) - 1
            chain = [int(place[c]) for c in chain]
            name, sums, size, alive = name[alive], sums[alive], size[alive], alive[alive]
        if not chain:
            chain.append(int(alive.argmax()))
        top = chain[-1]
        distance = np.round(1 - (sums @ sums[top]) / (size * size[top]), 9)
        distance[~alive] = np.inf
        distance[top] = np.inf
        near = int(distance.argmin())
        if len(chain) > 1 and distance[chain[-2]] <= distance[near]:
            near = chain[-2]
        if not distance[near] < threshold:
            alive[top] = False
            left -= 1
            chain.pop()
        elif len(chain) > 1 and near == chain[-2]:
            del chain[-2:]
            sums[near] += sums[top]
            size[near] += size[top]
            owner[name[top]] = name[near]
            alive[top] = False
            left -= 1
        else:
            chain.append(near)
    while (up := owner[owner] != owner).any():
        owner[up] = owner[owner[up]]
    lowest = np.full(len(points), len(unit))
    np.minimum.at(lowest, owner, first)
    return np.unique(lowest[owner[of]], return_inverse=True)[1]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group, whole, of rows sorted by their first `keys` columns (whole numbers)."""
    parts, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        begins = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for first, end in zip([0, *begins.tolist()], [*begins.tolist(), batch.num_rows], strict=True):
            key = tuple(c[first] for c in columns)
            if parts and key != last:
                yield pa.Table.from_batches(parts)
                parts = []
            last = key
            parts.append(batch.slice(first, end - first))
    if parts:
        yield pa.Table.from_batches(parts)


def _gathered(tables: Iterator[pa.Table], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Small tables put together to larger batches."""
    some, size = [], 0
    for table in tables:
        some.append(table)
        size += table.num_rows
        if size >= rows:
            yield from pa.concat_tables(some).combine_chunks().to_batches()
            some, size = [], 0
    if size:
        yield from pa.concat_tables(some).combine_chunks().to_batches()


def _near(table: pa.Table) -> pa.Table:
    """The close pairs (a, b) of two chunks (or of one, in itself) of a question."""
    kept, matrix = usable(table.column("vec").combine_chunks())
    matrix /= np.sqrt((matrix * matrix).sum(1, keepdims=True))
    ids, own, x, y = table.column("id").to_numpy()[kept], table.column("own").to_numpy()[kept], table.column("x")[0].as_py(), table.column("y")[0].as_py()
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    i, j = np.nonzero(np.round(1 - matrix[left] @ matrix[right].T, 9) < table.column("limit")[0].as_py())
    a, b = ids[left[i]], ids[right[j]]
    keep = a < b if x == y else a != b
    return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})


def close_pairs(items: DataFrame, threshold: float | str, chunk_rows: int = 1024) -> DataFrame:
    """(a, b) of items(q_id, id, vec), ids of one question whose cosine distance is below the threshold (a number or a column of the items).

    A question with over chunk_rows items is cut into chunks and each pair of chunks compared by itself; only close pairs leave
    the task. Small questions come to a task many at a time, sorted, and vectors are shuffled once.
    """
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    rows = items.select("q_id", "id", "vec", limit.cast("double").alias("limit")).where("q_id IS NOT NULL")
    sizes = rows.groupBy(F.col("q_id").alias("of")).agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))
    large = send_or_sort(materialize(sizes, "sizes"))
    dealt = rows.join(large, F.col("q_id") == F.col("of"), "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", own).select("q_id", "id", "vec", "limit", "own", F.explode(others).alias("c"))
    dealt = dealt.select("q_id", "c.x", "c.y", "id", "vec", "limit", "own").repartition("q_id", "x", "y").sortWithinPartitions("q_id", "x", "y")
    return dealt.mapInArrow(lambda batches: _gathered(map(_near, _runs(batches, 3))), "a long, b long")


def numbered_items(items: DataFrame) -> DataFrame:
    """items with an id; written, so that the ids stay."""
    return materialize(items.withColumn("id", F.monotonically_increasing_id()), "items")


def _linked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows(id, ...) with label, the smallest id that close pairs lead to; null where nothing is close."""
    return rows.join(send_or_sort(labels), F.col("id") == F.col("node"), "left").drop("node")


def cluster(items: DataFrame, threshold: float | str = 0.25, alone: bool = True) -> DataFrame:
    """q_id, name, cluster for items(q_id, name, vec): average linkage on cosine distance within each question; a cluster is named by its first name.

    threshold is a number or a column of the items. Clusters that merge have a pair below the threshold,
    so a cluster lies within a component of close pairs: linkage runs inside the components, in memory linear in their members. Items that
    nothing is close to are clusters of their own without it; alone=False leaves these out.
    """
    rows = numbered_items(items)
    linked = _linked(rows, components(close_pairs(rows, threshold)))
    cut = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    members = linked.where("label IS NOT NULL").select(F.col("q_id").cast("long"), "label", "name", "vec", cut.cast("double").alias("cut"))

    def work(table: pa.Table) -> pa.Table:
        matrix = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
        number = average_linkage(matrix, table.column("cut")[0].as_py())
        _, first = np.unique(number, return_index=True)  # rows come in the order of their names
        return pa.table({"q_id": table.column("q_id"), "name": table.column("name"), "cluster": table.column("name").take(pa.array(first[number]))})

    ordered = members.repartition("q_id", "label").sortWithinPartitions("q_id", "label", "name")
    found = ordered.mapInArrow(lambda batches: _gathered(map(work, _runs(batches, 2))), "q_id long, name string, cluster string")
    if not alone:
        return found
    return found.unionByName(linked.where("label IS NULL").select(F.col("q_id").cast("long"), "name", F.col("name").alias("cluster")))


def dbscan(items: DataFrame, eps: float = 0.05) -> DataFrame:
    """q_id, name, cluster: density clustering with two points as least, which is components of pairs within eps; noise stays alone. A cluster is named by its first name."""
    rows = numbered_items(items)
    linked = _linked(rows.select("q_id", "id", "name"), components(close_pairs(rows, eps)))
    first = materialize(linked.where("label IS NOT NULL").groupBy(F.col("label").alias("of")).agg(F.min("name").alias("cluster")), "first")
    return linked.join(send_or_sort(first), F.col("label") == F.col("of"), "left").select("q_id", "name", F.coalesce("cluster", "name").alias("cluster"))


def large_clusters(clusters: DataFrame, least: int = 2) -> DataFrame:
    """q_id, cluster, names of the clusters with `least` members or more."""
    return clusters.groupBy("q_id", "cluster").agg(F.array_sort(F.collect_list("name")).alias("names")).where(F.size("names") >= least)


def adaptive_threshold(items: DataFrame, text: str = "name", most_numbers: int = 25, few: float = 0.15, many: float = 0.05) -> DataFrame:
    """items with threshold: `many` for questions with more than most_numbers different numbers in their texts, else `few`."""
    numbers = items.select(F.col("q_id").alias("of"), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\d+"), F.lit(0))).alias("number")).distinct()
    counted = materialize(numbers.groupBy("of").agg(F.count("*").alias("numbers")), "numbers")
    threshold = F.when(F.coalesce("numbers", F.lit(0)) > most_numbers, many).otherwise(few)
    return items.hint("merge").join(counted.hint("merge"), F.col("q_id") == F.col("of"), "left").withColumn("threshold", threshold).drop("of", "numbers")
