"""What depends on a seed's paths alone is found by seed, in the same results as by question."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphtide import catalog, session
from graphtide.functions import text
from graphtide.operators import evaluate, graph, ranking, vectors
from graphtide.plans import retrieve
from graphtide.plans.fixtures import Inputs


def _rows(df):
    columns = sorted(df.columns)
    return sorted(str([r[c] for c in columns]) for r in df.collect())


def test_first_entities_give_the_nearest_of_all(spark, small):
    x = Inputs(spark, small)
    for k in (1, 2, 5):
        few = retrieve.first_entities(x, k)
        assert few.count() < x.entity_vectors.count()
        assert _rows(vectors.top_k(x.q_vectors, few, k)) == _rows(vectors.top_k(x.q_vectors, x.entity_vectors, k))


def test_counted_similarities_give_the_statistics_of_all_paths(spark):
    rows = [(q, s, round((q * 7 + s * 3 + i * i) % 11 / 11, 6)) for q in range(3) for s in range(2) for i in range(9 + q)]
    scored = spark.createDataFrame(rows, "q_id long, seed_ord int, sim double")
    counted = scored.groupBy("q_id", "seed_ord", "sim").agg(F.count("*").alias("n"))
    assert counted.count() < len(rows) and _rows(evaluate.counted_sim_stats(counted)) == _rows(evaluate.sim_stats(scored))


@pytest.mark.parametrize("flip", [False, True])
def test_edge_runs_are_fragments(spark, flip):
    hop = lambda a, b, d, s: {"src": a, "rel": "r", "dst": b, "dir": d, "score": s}
    d = "<-" if flip else "->"
    paths = [[hop("a", "b", d, 99.0), hop("b", "c", d, 97.0), hop("c", "d", "->", 10.0), hop("d", "b", "->", 96.0)], [hop("a", "a", d, 96.0), hop("a", "c", "->", None)], [hop("a", "b", d, 5.0)]]
    schema = "q_id long, seed_ord int, path_ord long, hops array<struct<src:string,rel:string,dst:string,dir:string,score:double>>"
    df = spark.createDataFrame([(1, 0, i, p) for i, p in enumerate(paths)], schema)
    rows = ranking.hop_rows(df)
    old = ranking.fragments(rows.withColumn("score", F.col("hop.score")), 96.0)
    new = df.select(*ranking.PATH, F.explode(ranking.edge_runs(F.col("hops"), 96.0)).alias("f")).select(*ranking.PATH, "f.*")
    assert _rows(new.select(*old.columns)) == _rows(old) and old.count() > 1


def test_an_edge_is_used_once_in_either_direction(spark):
    triples = spark.createDataFrame([("a", "r", "b"), ("b", "r", "a"), ("b", "s", "c"), ("a", "r", "a"), ("c", None, "d")], "head string, rel string, tail string")
    found = graph.expand_paths(triples, spark.createDataFrame([("a",)], "seed string"), 3).collect()
    edges = [[(h.src, h.rel, h.dst) if h.dir == "->" else (h.dst, h.rel, h.src) for h in r.hops] for r in found]
    assert all(len(set(e)) == len(e) for e in edges) and {len(e) for e in edges} == {1, 2, 3}
    assert any(r.path == "a - r -> b - s -> c" for r in found)


def test_texts_are_parsed_once_a_row(spark):
    df = spark.createDataFrame([("A{name: A} -[relationship:{relationship: r}]-> B{name: B}<-[relationship:{relationship: s}]- C{name: C}", "A - r -> B <- s - C")], "store string, path string")
    found = df.select(text.store_path(F.col("store")).alias("hops"), text.split_hops(F.col("path")).alias("split"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(store") == 3 and plan.count("regexp_extract_all(path") == 1
    row = found.first()
    assert [(h.src, h.rel, h.dst, h.dir) for h in row.hops] == [("A", "r", "B", "->"), ("B", "s", "C", "<-")] and row.split == ["A -r-> B", "C -s-> B"]


def test_two_hop_chains_join_only_the_first_edges(spark):
    edges = [(f"s{i}", "r", "hub") for i in range(40)] + [("hub", "r", f"t{i:03}") for i in range(50)] + [("t001", "r", "s3"), ("hub", "q", "s5")]
    triples, seeds = spark.createDataFrame(edges, "head string, rel string, tail string"), ["s7", "s3", "s5", "t002"]
    want = sorted({(a, r, b, s, d) for a, r, b in edges for c, s, d in edges if b == c and (a in seeds or d in seeds)})
    for limit in (3, 30, 1000):
        got = graph.neighbours_2hop(triples, spark.createDataFrame([(s,) for s in seeds], "name string"), limit)
        assert [tuple(r) for r in got.collect()] == want[:limit]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_edges_in_reach_are_those_of_the_paths(spark, monkeypatch, depth):
    rng = random.Random(depth)
    rows = {(rng.choice("abcdefgh"), rng.choice("rs"), rng.choice("abcdefgh")) for _ in range(9)} | {("x", "r", None), ("x", None, "y"), ("y", "r", "z")}
    triples = spark.createDataFrame(sorted(rows, key=str), "head string, rel string, tail string")
    seeds = spark.createDataFrame([("a",), ("x",), (None,), ("a",)], "seed string")
    used = graph.expand_paths(triples, seeds, depth).select(F.explode("hops").alias("h")).select(graph.hop_edge(F.col("h")).alias("e")).select("e.*").distinct()
    want = _rows(used)
    assert _rows(graph.edges_in_reach(triples, seeds, depth)) == want and want
    monkeypatch.setattr(graph, "FEW", 0)
    assert _rows(graph.edges_in_reach(triples, seeds, depth)) == want


def test_hop_vectors_need_no_paths(spark, small, monkeypatch):
    def never(*a, **k):
        raise AssertionError("paths are listed")

    monkeypatch.setattr(graph, "expand_paths", never)
    assert catalog.QUERIES["j_hop_vector"](spark, small).count() > 0


def test_dealt_items_give_the_same_nearest(spark):
    rng = np.random.default_rng(3)
    vec = [np.round(rng.normal(size=4), 1).tolist() for _ in range(40)]
    items = spark.createDataFrame([(f"n{i:03}", vec[i % 30]) for i in range(90)] + [("none", None), ("zero", [0.0] * 4)], "name string, vec array<float>").coalesce(1)
    asked = spark.createDataFrame([(i, vec[i % 7 + 25] if i % 7 + 25 < 40 else None) for i in range(20)], "q_id long, vec array<float>")
    unit = [np.float32(v).astype(float) / np.sqrt((np.float32(v).astype(float) ** 2).sum()) for v in vec]
    for k, least in ((1, None), (7, None), (0, 0.4), (3, 0.9)):
        want = []
        for q in range(20):
            found = sorted((-round(float(unit[q % 7 + 25] @ unit[i % 30]), 6) + 0.0, f"n{i:03}") for i in range(90))
            found = [f for f in found if least is None or -f[0] > least]
            want += [(q, n, -s) for s, n in (found[:k] if k else found)]
        for deal in (False, True):
            got = vectors.top_k(asked, items, k, threshold=least, deal=deal)
            assert sorted((r.q_id, r.name, r.sim + 0.0) for r in got.collect()) == sorted((q, n, s + 0.0) for q, n, s in want), (k, least)


def test_only_edges_of_the_frontier_are_sorted(spark, monkeypatch):
    rows = [("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("x", "r", "y"), ("y", "r", "z")]
    written = {}

    def seen(df, name="step"):
        out = session.materialize(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(graph, "materialize", seen)
    found = graph.expand_paths(spark.createDataFrame(rows, "head string, rel string, tail string"), spark.createDataFrame([("a",)], "seed string"), 2)
    assert sorted(r.path for r in found.collect()) == ["a - r -> b", "a - r -> b - r -> c"]
    assert written["triples"] == 5 and "edges" not in written and "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()
