"""Graph scans, joins and mutations over triples(head, rel, tail).

Triples are plain rows; a mutation returns the next version of the table. Joins use the three
columns, never the concatenated key, which is not injective.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtide.session import materialize

KEY = ["head", "rel", "tail"]


def triple_key(head: str = "head", rel: str = "rel", tail: str = "tail") -> Column:
    return F.concat_ws(" ", head, rel, tail)


def sentence(head: str = "head", rel: str = "rel", tail: str = "tail") -> Column:
    return F.concat_ws(" ", F.col(head), F.translate(rel, "_", " "), F.col(tail))


def all_triples(triples: DataFrame) -> DataFrame:
    return triples.select(*KEY).distinct()


def entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("head", "tail")).alias("name")).distinct()


def relations(triples: DataFrame) -> DataFrame:
    return triples.select("rel").distinct()


def count_edges(triples: DataFrame) -> DataFrame:
    return triples.agg(F.count("*").alias("n_edges"))


def show_edges(triples: DataFrame, n: int) -> DataFrame:
    return triples.select(*KEY).orderBy(*KEY).limit(n)


def nodes_by_property(nodes: DataFrame, label: str, limit: int = 10, **properties) -> DataFrame:
    found = nodes.where(F.col("label") == label)
    for name, value in properties.items():
        found = found.where(F.col(name) == value)
    return found.orderBy("name").limit(limit)


def neighbours_1hop(triples: DataFrame, seeds: DataFrame, limit: int = 30) -> DataFrame:
    """Edges with a seed at either end, as text `s-r->t`, in order of their ends."""
    seed = seeds.select(F.col("name").alias("seed")).distinct()
    out = triples.join(seed.hint("merge"), F.col("head") == F.col("seed"), "left_semi").select(*KEY)
    into = triples.join(seed.hint("merge"), F.col("tail") == F.col("seed"), "left_semi").select(*KEY)
    edges = out.union(into).distinct().orderBy(*KEY).limit(limit)
    return edges.select(F.concat("head", F.lit("-"), "rel", F.lit("->"), "tail").alias("edge"))


def neighbours_2hop(triples: DataFrame, seeds: DataFrame, limit: int = 30) -> DataFrame:
    """Directed chains of two edges with a seed at either end, the first `limit` in order of their ends.

    Chains are ordered by their first edge, and each first edge begins one at least: no chain of the first `limit`
    begins with a later one than the first `limit` of these edges, so only they are joined with what follows.
    """
    edges = materialize(triples.select(*KEY), "triples")
    a = edges.select(F.col("head").alias("n"), F.col("rel").alias("r1"), F.col("tail").alias("o1"))
    b = edges.select(F.col("head").alias("via"), F.col("rel").alias("r2"), F.col("tail").alias("o2"))
    seed = materialize(seeds.select(F.col("name").alias("seed")).distinct(), "seeds")
    sent = send_or_sort(seed)
    begins = a.join(sent, F.col("n") == F.col("seed"), "left_semi").hint("merge").join(b.hint("merge"), F.col("o1") == F.col("via"), "left_semi")
    leads = b.join(sent, F.col("o2") == F.col("seed"), "left_semi").select("via").distinct()
    ends = a.hint("merge").join(leads.hint("merge"), F.col("o1") == F.col("via"), "left_semi")
    some = materialize(begins.union(ends).distinct().orderBy("n", "r1", "o1").limit(limit), "first")  # limit rows
    found = b.join(F.broadcast(some), F.col("o1") == F.col("via"))
    at_n = F.broadcast(seed.join(F.broadcast(some), F.col("n") == F.col("seed"), "left_semi").select(F.col("seed").alias("at_n")))  # limit rows at most
    cols = ["n", "r1", "o1", "r2", "o2"]
    first = found.join(at_n, F.col("n") == F.col("at_n"), "left_semi")
    last = found.join(sent, F.col("o2") == F.col("seed"), "left_semi")
    return first.select(*cols).union(last.select(*cols)).distinct().orderBy(*cols).limit(limit)


def undirected(triples: DataFrame, *carry: str) -> DataFrame:
    """Both readings of each edge: src, rel, dst, dir and the carried columns."""
    there = F.struct(F.col("head").alias("src"), "rel", F.col("tail").alias("dst"), F.lit("->").alias("dir"), *carry)
    back = F.struct(F.col("tail").alias("src"), "rel", F.col("head").alias("dst"), F.lit("<-").alias("dir"), *carry)
    return triples.select(F.explode(F.array(there, back)).alias("e")).select("e.*")


def hop_edge(hop: Column) -> Column:
    """The stored edge of a hop, as one struct."""
    return F.when(hop["dir"] == "->", F.struct(hop["src"].alias("head"), hop["rel"].alias("rel"), hop["dst"].alias("tail"))).otherwise(
        F.struct(hop["dst"].alias("head"), hop["rel"].alias("rel"), hop["src"].alias("tail"))
    )


def path_text(hops: Column, n: int) -> Column:
    """`A - r -> B <- r2 - C` of an array of n hops."""
    step = lambda h: F.when(h["dir"] == "->", F.concat(F.lit(" - "), h["rel"], F.lit(" -> "), h["dst"])).otherwise(F.concat(F.lit(" <- "), h["rel"], F.lit(" - "), h["dst"]))
    return F.concat(hops[0]["src"], *(F.coalesce(step(hops[i]), F.lit("")) for i in range(n)))


def _same_edge(a: Column, b: Column) -> Column:
    """Whether two hops use one stored edge, in whatever direction."""
    along = F.when(a["dir"] == b["dir"], a["src"].eqNullSafe(b["src"]) & a["dst"].eqNullSafe(b["dst"])).otherwise(a["src"].eqNullSafe(b["dst"]) & a["dst"].eqNullSafe(b["src"]))
    return along & a["rel"].eqNullSafe(b["rel"])


FEW = 200_000


def send_or_sort(rows: DataFrame) -> DataFrame:
    """A written table with the join hint for its number of rows: few are sent to all tasks, more are sorted."""
    return rows.hint("broadcast" if rows.count() <= FEW else "merge")


HASHES = 4_000_000


def having_keys(rows: DataFrame, keys: DataFrame, others: bool = False) -> DataFrame:
    """The rows whose head, rel, tail can be among those of keys, a written table (others: the rows whose can't): a filter by hashes, which go to all
    tasks, before a join that sorts; rows of other keys with an equal hash are kept too. With more keys than HASHES nothing is left out."""
    if keys.count() > HASHES:
        return rows.where(F.lit(not others))
    hashes = keys.select(F.xxhash64(*KEY).alias("__hash")).distinct()
    return rows.join(F.broadcast(hashes), F.xxhash64(*KEY) == F.col("__hash"), "left_anti" if others else "left_semi")


PAIRS = 2_000_000


def _grown(ends: DataFrame, edges: DataFrame, tips: DataFrame) -> DataFrame:
    """ends(seed, hops, end) with the edges(src, ...) at their ends; tips(tip, front) are the ends with the number of rows that end there, written.

    Where many rows end in a node of many edges, their product is work of one key though neither side is large: the rows are dealt out to
    as many shares as there are PAIRS in it, each with all edges of the node, and the join has as many tasks as there are shares.
    """
    shared = send_or_sort(materialize(tips.where("front > 1"), "shared"))
    work = shared.join(edges, F.col("tip") == F.col("src")).groupBy("tip").agg(F.ceil(F.first("front") * F.count("*") / PAIRS).cast("int").alias("shares"))
    heavy = materialize(work.where("shares > 1"), "heavy")
    tasks = heavy.agg(F.sum("shares")).first()[0]
    if tasks is None:
        return ends.hint("merge").join(edges.hint("merge"), F.col("end") == F.col("src"))
    tasks = min(20_000, tasks + int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent, many = send_or_sort(heavy), F.coalesce("shares", F.lit(1))
    left = ends.join(sent, F.col("end") == F.col("tip"), "left").withColumn("share", F.pmod(F.xxhash64("seed", "hops"), many).cast("int")).drop("tip", "shares")
    right = edges.join(sent, F.col("src") == F.col("tip"), "left").withColumn("of", F.explode(F.sequence(F.lit(0), many - 1))).drop("tip", "shares")
    left, right = left.repartition(tasks, "end", "share"), right.repartition(tasks, "src", "of")
    return left.hint("merge").join(right.hint("merge"), (F.col("end") == F.col("src")) & (F.col("share") == F.col("of")))


def expand_paths(triples: DataFrame, seeds: DataFrame, depth: int = 2, max_degree: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """All undirected paths of 1..depth edges from each seed(seed), no edge twice: seed, hops, path.

    Only the frontier is joined at each level, and written unless it is the last; if it ends in few nodes, only their edges are sorted, and
    what meets in a hub is dealt out. Hops
    hold the carried columns of their triple too. The number of paths grows with the product of the
    degrees on the way: `max_degree` leaves out expansion through nodes with more edges than that
    (`hubs` lists them); None keeps them all.
    """
    written = materialize(triples.select(*KEY, *carry), "triples")  # both readings are made as they are read
    edges = undirected(written, *carry)
    if max_degree is not None:
        edges = edges.hint("merge").join(hubs(triples, max_degree).select(F.col("name").alias("src")).hint("merge"), "src", "left_anti")
        edges = materialize(edges, "edges")
    starts = materialize(seeds.select("seed").distinct(), "starts")
    hop = F.struct("src", "rel", "dst", "dir", *carry)
    level = send_or_sort(starts).join(edges, F.col("seed") == F.col("src")).select("seed", F.array(hop).alias("hops"))
    found = []
    for n in range(1, depth + 1):
        if n > 1:
            ends = level.select("seed", "hops", F.col("hops")[n - 2]["dst"].alias("end"))
            tips = materialize(ends.groupBy(F.col("end").alias("tip")).agg(F.count("*").alias("front")), "tips")
            near = edges if tips.count() > FEW else edges.join(F.broadcast(tips.select("tip")), F.col("src") == F.col("tip"), "left_semi")
            grown = _grown(ends, near, tips)
            fresh = reduce(lambda a, b: a & b, (~_same_edge(F.col("hops")[i], hop) for i in range(n - 1)))
            level = grown.where(fresh).select("seed", F.array(*(F.col("hops")[i] for i in range(n - 1)), hop).alias("hops"))
        if n < depth:
            level = materialize(level, "level")
        found.append(level.select("seed", "hops", path_text(F.col("hops"), n).alias("path")))
    return reduce(DataFrame.union, found)


def path_counts(triples: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """seed, n: the number of paths of each seed that expand_paths finds; those of up to two edges are counted without being listed.

    A first hop goes on over all edges at its end but its own: rows of one edge, copies and both readings of a loop, leave each other out.
    """
    if depth > 2:
        return expand_paths(triples, seeds, depth).groupBy("seed").agg(F.count("*").alias("n"))
    edges = undirected(materialize(triples.select(*KEY), "triples"))
    starts = materialize(seeds.select("seed").distinct(), "starts")
    first = send_or_sort(starts).join(edges, F.col("seed") == F.col("src")).groupBy("seed", hop_edge(F.struct("src", "rel", "dst", "dir")).alias("edge"), F.col("dst").alias("end")).agg(F.count("*").alias("same"))
    if depth == 1:
        return first.groupBy("seed").agg(F.sum("same").alias("n"))
    first = materialize(first.select("seed", "end", "same"), "first")
    tips = materialize(first.select(F.col("end").alias("tip")).where("end IS NOT NULL").distinct(), "tips")
    near = edges if tips.count() > FEW else edges.join(F.broadcast(tips), F.col("src") == F.col("tip"), "left_semi")
    degrees = send_or_sort(materialize(near.groupBy("src").agg(F.count("*").alias("degree")), "degrees"))
    onward = F.coalesce(F.col("degree") - F.col("same"), F.lit(0))
    return first.join(degrees, F.col("end") == F.col("src"), "left").groupBy("seed").agg(F.sum(F.col("same") * (1 + onward)).alias("n"))


def covering_paths(triples: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """seed, hops, path: some of the paths of expand_paths, which together have all hops that any of those paths has, as an edge.

    Of the paths that end in one node only one goes on, over all edges there that it doesn't have yet: it has the same edges ahead as the others,
    and one that it has itself is a hop already. So there are no more paths than readings of edges at each level.
    """
    edges = undirected(materialize(triples.select(*KEY), "triples"))
    starts = materialize(seeds.select("seed").distinct(), "starts")
    hop = F.struct("src", "rel", "dst", "dir")
    level = send_or_sort(starts).join(edges, F.col("seed") == F.col("src")).select("seed", F.array(hop).alias("hops"))
    found = []
    for n in range(1, depth + 1):
        if n > 1:
            ends = level.select("seed", "hops", F.col("hops")[n - 2]["dst"].alias("end")).where("end IS NOT NULL")
            ends = materialize(ends.groupBy("end").agg(F.min(F.struct("seed", "hops")).alias("one")).select("end", "one.seed", "one.hops"), "ends")
            fresh = reduce(lambda a, b: a & b, (~_same_edge(F.col("hops")[i], hop) for i in range(n - 1)))
            grown = send_or_sort(ends).join(edges, F.col("end") == F.col("src")).where(fresh)
            level = grown.select("seed", F.array(*(F.col("hops")[i] for i in range(n - 1)), hop).alias("hops"))
        if n < depth:
            level = materialize(level, "level")
        found.append(level.select("seed", "hops", path_text(F.col("hops"), n).alias("path")))
    return reduce(DataFrame.union, found)


def edges_in_reach(triples: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """The edges that expand_paths uses, each as often as it is in triples: those with an end less than `depth` edges away from a seed.

    A shortest way to that end either has the edge on it or goes on over it, so no path needs to be listed.
    """
    ends = triples.select(F.explode(F.array(F.struct(F.col("head").alias("src"), F.col("tail").alias("dst")), F.struct(F.col("tail").alias("src"), F.col("head").alias("dst")))).alias("e")).select("e.*")
    near = materialize(seeds.select(F.col("seed").alias("node")).where("node IS NOT NULL").distinct(), "near")
    for _ in range(depth - 1):
        more = send_or_sort(near).join(ends, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).where("node IS NOT NULL")
        near = materialize(near.union(more).distinct(), "near")
    sent = [send_or_sort(near.select(F.col("node").alias(end))) for end in ("at_head", "at_tail")]
    joined = triples.select(*KEY).join(sent[0], F.col("head") == F.col("at_head"), "left").join(sent[1], F.col("tail") == F.col("at_tail"), "left")
    return joined.where("at_head IS NOT NULL OR at_tail IS NOT NULL").select(*KEY)


def sample(triples: DataFrame, n: int, seed: str = "") -> DataFrame:
    """n triples in a seeded order; fewer than n raise."""
    found = triples.orderBy(F.md5(F.concat(F.lit(seed), triple_key())), *KEY).limit(n)
    there = triples.limit(n).count()
    if there < n:
        raise ValueError(f"a sample of {n} of {there} triples")
    return found


def hubs(triples: DataFrame, max_degree: int) -> DataFrame:
    """name, degree of the nodes with more than max_degree edges."""
    return undirected(triples).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("degree")).where(F.col("degree") > max_degree)


def upsert(triples: DataFrame, new: DataFrame) -> DataFrame:
    return triples.select(*KEY).union(new.select(*KEY).distinct().join(triples, KEY, "left_anti"))


def delete(triples: DataFrame, gone: DataFrame) -> DataFrame:
    return triples.join(gone.select(*KEY), KEY, "left_anti")


def delete_with_orphans(triples: DataFrame, nodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples, nodes) without the given edges and without the ends that they leave bare."""
    left = delete(triples, gone)
    orphans = entities(gone).hint("merge").join(entities(left).hint("merge"), "name", "left_anti")
    return left, nodes.hint("merge").join(orphans.hint("merge"), "name", "left_anti")


def delete_nodes(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    return nodes.join(gone, [c for c in gone.columns], "left_anti")


def rename(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Heads and tails replaced through mapping(dup, canonical), one level."""
    h = mapping.select(F.col("dup").alias("h_dup"), F.col("canonical").alias("h_new"))
    t = mapping.select(F.col("dup").alias("t_dup"), F.col("canonical").alias("t_new"))
    joined = triples.hint("merge").join(h.hint("merge"), F.col("head") == F.col("h_dup"), "left").join(t.hint("merge"), F.col("tail") == F.col("t_dup"), "left")
    rest = [c for c in triples.columns if c not in ("head", "tail")]
    return joined.select(F.coalesce("h_new", "head").alias("head"), F.coalesce("t_new", "tail").alias("tail"), *rest)


def three_hop_candidates(triples: DataFrame, relations: list[str] | None = None, max_degree: int | None = None) -> DataFrame:
    """Chains A -> B -> C -> D with four different nodes, over the given three relations or over any.

    The middle edges come first, with the number of edges into B and out of C: what a chain's middle multiplies to is known before it is
    joined, and max_degree leaves out middles of more chains than that (none by default).
    """
    def hop(i: int) -> DataFrame:
        rows = triples if relations is None else triples.where(F.col("rel") == relations[i])
        return rows.select(F.col("head").alias(f"s{i}"), F.col("rel").alias(f"r{i}"), F.col("tail").alias(f"t{i}"))

    into = hop(0).groupBy(F.col("t0").alias("s1")).agg(F.count("*").alias("n_in"))
    out_of = hop(2).groupBy(F.col("s2").alias("t1")).agg(F.count("*").alias("n_out"))
    middle = hop(1).hint("merge").join(into.hint("merge"), "s1").hint("merge").join(out_of.hint("merge"), "t1")
    if max_degree is not None:
        middle = middle.where(F.col("n_in") * F.col("n_out") <= max_degree)
    middle = materialize(middle.select("s1", "r1", "t1"), "middle")
    joined = middle.hint("merge").join(hop(0).hint("merge"), F.col("t0") == F.col("s1")).hint("merge").join(hop(2).hint("merge"), F.col("t1") == F.col("s2"))
    nodes = [F.col("s0"), F.col("s1"), F.col("t1"), F.col("t2")]
    for i in range(4):
        for j in range(i):
            joined = joined.where(nodes[i] != nodes[j])
    return joined.select(F.col("s0").alias("a"), "r0", F.col("s1").alias("b"), "r1", F.col("t1").alias("c"), "r2", F.col("t2").alias("d"))


def chain_text() -> Column:
    """A chain of three_hop_candidates as `A -r-> B -r-> C -r-> D`."""
    return F.concat("a", F.lit(" -"), "r0", F.lit("-> "), "b", F.lit(" -"), "r1", F.lit("-> "), "c", F.lit(" -"), "r2", F.lit("-> "), "d")


def shortcuts(triples: DataFrame, replies: DataFrame, iteration: int) -> DataFrame:
    """New edges head, rel, tail with provenance via, n_chains, iteration, of replies(via, raw): JSON with source_node, inferred_relationship.label and target_node.

    A reply that lacks one of them, or is no JSON, proposes nothing; an edge that is there already is not new.
    """
    said = F.from_json("raw", "struct<source_node:string,target_node:string,inferred_relationship:struct<label:string>>")
    edges = replies.select("via", said.alias("s")).select(F.trim("s.source_node").alias("head"), F.trim("s.inferred_relationship.label").alias("rel"), F.trim("s.target_node").alias("tail"), "via")
    whole = edges.where((F.coalesce("head", F.lit("")) != "") & (F.coalesce("rel", F.lit("")) != "") & (F.coalesce("tail", F.lit("")) != ""))
    new = whole.groupBy(*KEY).agg(F.min("via").alias("via"), F.count("*").alias("n_chains"))
    return new.hint("merge").join(triples.select(*KEY).hint("merge"), KEY, "left_anti").withColumn("iteration", F.lit(iteration))


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with their place, from 0, in the order of `by` (which must be unique), without one task for all.

    Rows are dealt into ranges and written, so that the ranges are fixed; a place is the one within
    its range plus the size of the ranges before.
    """
    ranged = materialize(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*by)))
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__size")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size")).select("__part", before.alias("__before"))  # one row a partition
    return local.join(F.broadcast(sizes), "__part").withColumn(name, F.col("__n") + F.col("__before") - 1).drop("__part", "__n", "__before")


def dictionary_encode(triples: DataFrame) -> DataFrame:
    """head_id, rel_id, tail_id with dense ids from 0, in alphabetical order."""
    triples = materialize(triples.select(*KEY), "triples")
    names = materialize(numbered(entities(triples), ["name"], "id"), "names")
    rels = materialize(numbered(relations(triples), ["rel"], "rel_id"), "rels")
    return (
        triples.hint("merge")
        .join(names.select(F.col("name").alias("head"), F.col("id").alias("head_id")).hint("merge"), "head")
        .hint("merge")
        .join(names.select(F.col("name").alias("tail"), F.col("id").alias("tail_id")).hint("merge"), "tail")
        .join(rels, "rel")
        .select("head_id", "rel_id", "tail_id")
    )
