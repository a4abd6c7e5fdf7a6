"""Paths are counted, and their hops found, without listing every path."""

import random

import pytest
from pyspark.sql import functions as F

from graphtide import catalog
from graphtide.operators import graph
from graphtide.plans import retrieve

T = "head string, rel string, tail string"


def _graph(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abcdefgh"), rng.choice("rs"), rng.choice("abcdefgh")) for _ in range(12)]  # with copies, loops and both directions
    rows += [("x", "r", None), ("x", None, "y"), ("y", "r", "z"), ("l", "r", "l"), ("l", "r", "l"), ("l", "s", "a"), rows[0]]
    return spark.createDataFrame(rows, T), spark.createDataFrame([("a",), ("x",), ("l",), (None,), ("a",), ("nowhere",)], "seed string")


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_paths_are_counted_by_degrees(spark, monkeypatch, depth):
    triples, seeds = _graph(spark, depth)
    listed = graph.expand_paths(triples, seeds, depth).groupBy("seed").count().collect()
    want = {r["seed"]: r["count"] for r in listed}
    for few in (graph.FEW, 0):
        monkeypatch.setattr(graph, "FEW", few)
        assert {r["seed"]: r["n"] for r in graph.path_counts(triples, seeds, depth).collect()} == want and len(want) == 3


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_covering_paths_have_all_hops(spark, monkeypatch, depth):
    triples, seeds = _graph(spark, 10 + depth)
    edges = lambda df: {tuple(r.e) for r in df.select(F.explode("hops").alias("h")).select(graph.hop_edge(F.col("h")).alias("e")).collect()}
    whole = graph.expand_paths(triples, seeds, depth)
    paths = {(r.seed, str(r.hops), r.path) for r in whole.collect()}
    for few in (graph.FEW, 0):
        monkeypatch.setattr(graph, "FEW", few)
        some = graph.covering_paths(triples, seeds, depth)
        assert edges(some) == edges(whole) and {(r.seed, str(r.hops), r.path) for r in some.collect()} <= paths


@pytest.mark.parametrize("name", ["ev_path_counts", "path_distinct_hops"])
def test_no_path_of_a_hub_is_listed(spark, small, monkeypatch, name):
    def never(*a, **k):
        raise AssertionError("paths are listed")

    monkeypatch.setattr(graph, "expand_paths", never)
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_hop_vectors_need_no_scores(spark, small, monkeypatch):
    def never(*a, **k):
        raise AssertionError("scores are derived")

    monkeypatch.setattr(retrieve, "triples", never)
    assert catalog.QUERIES["j_hop_vector"](spark, small).count() > 0
