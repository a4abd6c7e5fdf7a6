"""Line numbers of files that are read in many splits, and the shortcut replies."""

import pytest
from pyspark.sql import functions as F

from graphtide.operators import graph
from graphtide.sources import readers


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "20"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_lines_are_numbered_in_file_order(spark, tmp_path, small_splits):
    lines = [f"line {i * 7919 % 10007} of file" for i in range(5000)]
    (tmp_path / "b.txt").write_text("\n".join(lines[2000:]) + "\n")
    (tmp_path / "a.txt").write_text("\n".join(lines[:2000]))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = readers.in_file_order(spark, str(tmp_path)).orderBy("line").collect()
    assert [r.value for r in got] == lines and [r.line for r in got] == list(range(5000))


def test_first_lines_of_each_hop(spark, tmp_path, small_splits):
    for hop in (1, 2):
        (tmp_path / f"{hop}.tsv").write_text("".join(f"q [{hop}] {i}\ta{i}| b\n" for i in range(700)))
    (tmp_path / "3.tsv").write_text("no answer\nq\t")
    got = readers.qa_tsv_hops(spark, {h: str(tmp_path / f"{h}.tsv") for h in (3, 2, 1)}, 300).orderBy("q_id").collect()
    assert [(r.q_id, r["query"], r.hop) for r in got] == [(i, f"q {1 + i // 300} {i % 300}", 1 + i // 300) for i in range(600)] + [(600, "no answer", 3), (601, "q", 3)]
    assert got[5].answer == [["a5", "b"]] and got[600].answer == [[""]]


def test_shortcuts_accept_whole_replies_only(spark):
    triples = spark.createDataFrame([("A", "r", "B"), ("B", "s", "C"), ("C", "t", "D"), ("A", "x", "D"), ("D", "u", "A"), ("B", "s", "A")], "head string, rel string, tail string")
    chains = {tuple(r) for r in graph.three_hop_candidates(triples).collect()}
    want = {(a[0], a[1], a[2], b[1], b[2], c[1], c[2]) for a in triples.collect() for b in triples.collect() for c in triples.collect() if a[2] == b[0] and b[2] == c[0] and len({a[0], a[2], b[2], c[2]}) == 4}
    assert chains == want and chains
    assert {tuple(r) for r in graph.three_hop_candidates(triples, ["r", "s", "t"]).collect()} == {("A", "r", "B", "s", "C", "t", "D")}
    assert graph.three_hop_candidates(triples, max_degree=0).count() == 0
    edge = '{"source_node": "A", "inferred_relationship": {"label": "%s"}, "target_node": "D"}'
    replies = [("p2", edge % "far"), ("p1", edge % "far"), ("p3", edge % "x"), ("p4", edge % " "), ("p5", edge.replace("target_node", "t") % "y"), ("p6", "no"), ("p7", None), ("p8", '{"source_node": "A", "target_node": "D"}')]
    got = graph.shortcuts(triples, spark.createDataFrame(replies, "via string, raw string"), 4).collect()
    assert [tuple(r) for r in got] == [("A", "far", "D", "p1", 2, 4)]
    assert graph.shortcuts(triples, spark.createDataFrame([], "via string, raw string"), 4).where(F.lit(True)).count() == 0
