"""Paths through hubs, and their text."""

from pyspark.sql import functions as F

from graphtide.functions import text
from graphtide.operators import graph

T = "head string, rel string, tail string"


def test_paths_through_a_hub_are_dealt_out(spark, monkeypatch):
    rows = [(f"c{i}", "in", "hub") for i in range(60)] + [("hub", "part_of", "top"), ("c1", "knows", "c2"), ("c3", "in", "hub"), ("lone", "knows", "c1")]
    triples, seeds = spark.createDataFrame(rows, T), spark.createDataFrame([(f"c{i}",) for i in range(40)] + [("lone",)], "seed string")
    path = lambda df: sorted((r.seed, r.path, str(r.hops)) for r in df.collect())
    want = {depth: path(graph.expand_paths(triples, seeds, depth)) for depth in (2, 3)}
    monkeypatch.setattr(graph, "PAIRS", 100)
    for depth in (2, 3):
        assert path(graph.expand_paths(triples, seeds, depth)) == want[depth]
    made = graph.expand_paths(triples, seeds, 2).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in made) < sum(r["count"] for r in made) / 3


def test_rendering_of_so_many_hops_equals_the_loop(spark):
    hop = "struct<src:string,rel:string,dst:string,dir:string>"
    rows = [([("a", "r", "b", "->"), ("b", "s", "c", "<-")],), ([("a", "r", "b", "->"), ("x", "s", "c", "<-")],), ([("a", "r", None, "->"), ("x", "s", "c", "->")],), ([("a", "r", "b", "<-")],), ([],)]
    got = spark.createDataFrame(rows, f"hops array<{hop}>").select(text.path_render(F.col("hops")).alias("loop"), text.path_render(F.col("hops"), 2).alias("made")).collect()
    assert [r.made for r in got] == [r.loop for r in got] and got[0].made == "a - r -> b <- s - c"
