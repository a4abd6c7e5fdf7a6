"""Knowledge-graph operators on hand-made frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphtide import session
from graphtide.functions import text
from graphtide.functions.models import hash_encoder, model_udf
from graphtide.operators import evaluate, feedback, graph, ranking, redundancy, vectors
from graphtide.sources import readers, sinks
from graphtide.sources.vector_store import VectorStore
from graphtide.streaming import feedback_loop

T = "head string, rel string, tail string"


@pytest.fixture(scope="module")
def triples(spark):
    return spark.createDataFrame([("A", "r", "B"), ("B", "s", "C"), ("C", "t", "D"), ("A", "r", "B")], T).distinct()


def test_expand_paths_uses_no_edge_twice(spark, triples):
    seeds = spark.createDataFrame([("B",)], "seed string")
    got = {r.path for r in graph.expand_paths(triples, seeds, 2).collect()}
    assert got == {"B <- r - A", "B - s -> C", "B - s -> C - t -> D"}
    assert graph.expand_paths(triples, seeds.limit(0), 2).count() == 0


def test_mutations(spark, triples):
    new = spark.createDataFrame([("A", "r", "B"), ("X", "r", "Y")], T)
    assert graph.upsert(triples, new).count() == 4
    left, nodes = graph.delete_with_orphans(triples, graph.entities(triples), triples.where("rel = 't'"))
    assert left.count() == 2 and {r.name for r in nodes.collect()} == {"A", "B", "C"}


def test_replacement_map_and_rename(spark):
    groups = spark.createDataFrame([(0, ["A", "B", "C"]), (1, ["D", "E"]), (2, ["Z"])], "group_ord int, members array<string>")
    assert {(r.dup, r.canonical) for r in redundancy.replacement_map(groups).collect()} == {("B", "A"), ("C", "A"), ("E", "D")}
    chain = spark.createDataFrame([(0, ["A", "B"]), (1, ["B", "C"])], "group_ord int, members array<string>")
    assert {(r.dup, r.canonical) for r in redundancy.replacement_map(chain).collect()} == {("B", "A"), ("C", "B")}
    scores = spark.createDataFrame([("A", "r", "X", 50.0), ("B", "r", "X", 80.0)], f"{T}, score double")
    mapping = spark.createDataFrame([("B", "A")], "dup string, canonical string")
    assert [tuple(r) for r in redundancy.rename_scores(scores, mapping).collect()] == [("A", "r", "X", 80.0)]


def test_no_member_or_character_is_cut(spark):
    large = spark.range(1).select(F.lit(0).alias("group_ord"), F.transform(F.sequence(F.lit(0), F.lit(1_000_005)), lambda i: F.lpad(i.cast("string"), 7, "0")).alias("members"))
    got = redundancy.replacement_map(large)
    assert got.count() == 1_000_005 and got.where("dup = '1000005' AND canonical = '0000000'").count() == 1
    long = spark.range(1).select(text.capitalise(F.repeat(F.lit("aB"), 600_000)).alias("t"))
    assert long.select(F.length("t")).first()[0] == 1_200_000


def test_fold_is_ordered_and_clamped(spark):
    scores = spark.createDataFrame([("A", "r", "B", 100.0), ("B", "r", "C", 198.0)], f"{T}, score double")
    deltas = spark.createDataFrame([("A", "r", "B", 2, -300.0), ("A", "r", "B", 0, 150.0), ("A", "r", "B", 1, 80.0), ("A", "r", "B", 3, 5.0)], f"{T}, ord int, delta double")
    assert feedback.fold(scores, deltas, ["ord"]).first().score == 25.0
    more = spark.createDataFrame([("B", "r", "C", 0, 5.0)], f"{T}, ord int, delta double")
    assert feedback.fold(scores, more, ["ord"], feedback.rejecting).first().score == 198.0
    after = feedback.next_iteration(scores, feedback.fold(scores, deltas, ["ord"]), 3).collect()
    assert {(r.head, r.score, r.iteration) for r in after} == {("A", 25.0, 3), ("B", 198.0, 3)}


def test_fold_in_parts_is_the_fold(spark):
    rng = random.Random(4)
    rows = [(f"T{rng.randrange(4)}", "r", "x", i, float(rng.randrange(-60, 60) * 5)) for i in range(400)]
    scores = {f"T{k}": 25.0 + 50 * k for k in range(5)}
    want = {k: v for k, v in scores.items() if k != "T4"}
    for head, _, _, _, d in rows:
        want[head] = max(20.0, min(200.0, want[head] + d))
    df = spark.createDataFrame(rows, f"{T}, ord int, delta double").repartition(3)
    sdf = spark.createDataFrame([(k, "r", "x", v) for k, v in scores.items()], f"{T}, score double")
    for span in (1, 7, 1000):
        assert {r.head: r.score for r in feedback.fold(sdf, df, ["ord"], span=span).collect()} == want


def test_noise(spark):
    q = spark.range(10).select(F.col("id").alias("q_id"))
    chosen = feedback.choose_noise(q, q.where("q_id = 3"), 0.1).collect()
    assert len(chosen) == 1 and chosen[0].q_id != 3
    assert feedback.choose_noise(q, q.limit(0), 0.0).count() == 0
    with pytest.raises(ValueError):
        feedback.choose_noise(q, q.where("q_id < 9"), 0.5)


def test_answers(spark):
    df = spark.createDataFrame([(1, "cat", [["cat", "CAT"]]), (2, "cat and mat", [["cat"], ["MAT", "mat"]]), (3, "dog", [["cat"], ["dog"]])], "q_id long, prediction string, answer array<array<string>>")
    assert [r.labels for r in evaluate.all_groups(df).orderBy("q_id").collect()] == [[1], [1, 1], [0, 1]]
    assert evaluate.partial(df).first().n_partial == 1
    combos = df.where("q_id = 2").select(evaluate.answer_combinations(F.col("answer")).alias("c")).first().c
    assert combos == ["cat, MAT", "cat, mat"]


def test_rouge_l(spark):
    df = spark.createDataFrame([(1, "a b c d", ["a c d e", "x"]), (2, "", ["a"])], "q_id long, prediction string, references array<string>")
    got = {r.q_id: (r.p, r.r, r.f) for r in evaluate.rouge_l(df).collect()}
    assert got == {1: (0.75, 0.75, 0.75), 2: (0.0, 0.0, 0.0)}


def test_standard_ranking_sums_to_one_and_equal_scores_are_a_half(spark):
    hops = spark.createDataFrame([(1, 0, 1, 0, "A", "r", "B"), (1, 0, 2, 0, "A", "r", "B"), (1, 0, 2, 1, "B", "s", "C")], f"q_id long, seed_ord int, path_ord int, hop_ord int, {T}")
    scores = spark.createDataFrame([("A", "r", "B", 100.0), ("B", "s", "C", 100.0)], f"{T}, score double")
    sims = spark.createDataFrame([(1, "A", "r", "B", 0.2), (1, "B", "s", "C", 0.6)], f"q_id long, {T}, sim double")
    p = ranking.triple_probability(hops, scores, sims, 0.5)
    assert {round(r.pt, 6) for r in p.collect()} == {0.55, 0.65} and all(r.score01 == 0.5 for r in p.collect())
    assert abs(sum(r.p for r in ranking.standard(hops, p).collect()) - 1) < 1e-9


def test_basic_rank_value(spark):
    hop = lambda s, r, d: (s, r, d, "->")
    paths = spark.createDataFrame([(1, 0, 1, [hop("A", "r", "B"), hop("B", "s", "C")], "p", 0.2), (1, 0, 2, [hop("A", "q", "B")], "u", 0.9)], "q_id long, seed_ord int, path_ord int, hops array<struct<src:string,rel:string,dst:string,dir:string>>, path string, sim double")
    scores = spark.createDataFrame([("A", "r", "B", 100.0), ("B", "s", "C", 80.0)], f"{T}, score double")
    got = ranking.basic(paths, scores, 0.0, 70.0, 5).collect()
    assert [(r.path_ord, r.value) for r in got] == [(1, 140.0)]  # the path with an unknown hop is dropped


def test_maximal_paths(spark):
    df = spark.createDataFrame([("s", "a - r -> b"), ("s", "a - r -> b - s -> c"), ("s", "a - r -> b")], "seed string, path string")
    assert [r.path for r in ranking.maximal_paths(df).collect()] == ["a - r -> b - s -> c"]


def test_store_path(spark):
    df = spark.createDataFrame([("James{name: James} -[relationship:{relationship: Joined}]-> Michael jordan{name: Michael jordan}",), ("broken{name: x}",)], "t string")
    got = [r.h for r in df.select(text.store_path(F.col("t")).alias("h")).collect()]
    assert [tuple(h) for h in got[0]] == [("James", "Joined", "Michael jordan", "->")] and got[1] is None


def test_replies(spark):
    df = spark.createDataFrame([(1, "Correct: 0:1 2:3 0:2\nError: 1:2 x 1:2:3"), (2, "No feedback\nCorrect: 1:1"), (3, None)], "q_id long, raw string")
    got = {r.q_id: r for r in text.text_feedback(df).collect()}
    assert got[1].correct == ["0:2", "2:3"] and got[1].error == ["1:2"] and got[2].no_feedback and got[2].correct == []
    j = spark.createDataFrame([('```{"Insufficient_information": false, "Path_score": {"Path 1": 2}}```',), ("{broken",), ('{"Path_score": {}}',)], "raw string")
    out = [r.f for r in j.select(text.json_feedback(F.col("raw")).alias("f")).collect()]
    assert (out[0].insufficient, out[0].path_score) == (False, {"Path 1": 2.0}) and out[1].insufficient and out[2].insufficient
    assert spark.range(1).select(text.verdict(F.lit("Partially Correct")).alias("v")).first().v == 2


def test_undecided_groups_stay(spark):
    groups = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c", "d"])], "q_id long, group_ord int, facts array<string>")
    keep = spark.createDataFrame([(1, 0)], "q_id long, id long")
    assert {(r.fact, r.decision) for r in redundancy.keep_delete(groups, keep).collect()} == {("a", "keep"), ("b", "delete"), ("c", "undecided"), ("d", "undecided")}


def brute_linkage(vectors, threshold):
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    distance = np.round(1 - unit @ unit.T, 9)
    groups = [[i] for i in range(len(vectors))]
    while len(groups) > 1:
        best = min((distance[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i]))
        if not best[0] < threshold:
            break
        groups[best[2]] += groups.pop(best[1])
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(6))
def test_average_linkage_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((6, 3))[rng.integers(0, 6, 25)] + 0.3 * rng.standard_normal((25, 3))
    for threshold in (0.02, 0.15, 0.5):
        got = redundancy.average_linkage(v, threshold)
        assert {frozenset(np.flatnonzero(got == k).tolist()) for k in set(got)} == brute_linkage(v, threshold)
    v = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99]])
    assert redundancy.average_linkage(v, 0.25).tolist() == [0, 0, 1, 1] and redundancy.average_linkage(v, 0.0).tolist() == [0, 1, 2, 3]


def test_clusters_of_each_question(spark):
    rng = np.random.default_rng(9)
    rows = []
    for q in range(3):
        v = rng.standard_normal((5, 4))[rng.integers(0, 5, 20)] + 0.2 * rng.standard_normal((20, 4))
        rows += [(q, f"n{q}{i:02}", v[i].tolist(), [0.05, 0.15, 0.3][q]) for i in range(20)]
    items = spark.createDataFrame(rows, "q_id long, name string, vec array<double>, threshold double").repartition(3)
    got = {}
    for r in redundancy.cluster(items, "threshold").collect():
        got.setdefault((r.q_id, r.cluster), set()).add(r.name)
    for q in range(3):
        mine = [r for r in rows if r[0] == q]
        want = {frozenset(mine[i][1] for i in g) for g in brute_linkage(np.array([r[2] for r in mine]), mine[0][3])}
        assert {frozenset(g) for (k, _), g in got.items() if k == q} == want and all(c == min(g) for (_, c), g in got.items())
    near = redundancy.close_pairs(redundancy.numbered_items(items.select("q_id", "name", "vec")), 0.15)
    few = redundancy.close_pairs(redundancy.numbered_items(items.select("q_id", "name", "vec")), 0.15, chunk_rows=6)
    assert near.count() == few.count() > 10
    chain = spark.createDataFrame([(0, c, [float(np.cos(a)), float(np.sin(a))]) for c, a in zip("abcdz", (0.0, 0.3, 0.6, 0.9, 2.5), strict=True)], "q_id long, name string, vec array<double>")
    assert {(r.name, r.cluster) for r in redundancy.dbscan(chain, 0.05).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("z", "z")}
    assert redundancy.cluster(items.limit(0)).count() == 0 and redundancy.dbscan(items.limit(0)).count() == 0


def test_adaptive_threshold_counts_different_numbers(spark):
    rows = [(1, f"Order {i} of {i % 3}") for i in range(26)] + [(2, f"Order {i % 5}") for i in range(60)] + [(3, "no number")]
    got = redundancy.adaptive_threshold(spark.createDataFrame(rows, "q_id long, name string")).select("q_id", "threshold").distinct().collect()
    assert {(r.q_id, r.threshold) for r in got} == {(1, 0.05), (2, 0.15), (3, 0.15)}


def test_numbered_is_dense_and_ordered(spark):
    rows = [(f"k{i % 7}", i) for i in range(500)]
    got = graph.numbered(spark.createDataFrame(rows, "a string, b int").repartition(5), ["a", "b"], "n").orderBy("n").collect()
    assert [(r.a, r.b) for r in got] == sorted(rows) and [r.n for r in got] == list(range(500))


def test_vector_store(spark, tmp_path):
    calls = []

    def encoder(names):
        calls.append(sorted(r.name for r in names.collect()))
        return names.select("name", F.array(F.length("name").cast("float")).alias("vec"))

    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    store = VectorStore(spark, str(tmp_path / "store"), encoder)
    assert store.load().count() == 0
    assert {(r.name, r.vec[0]) for r in store.build(names("a", "bb", "a", None)).collect()} == {("a", 1.0), ("bb", 2.0)}
    assert store.build(names("zzz")).count() == 2 and calls == [["a", "bb"]]  # what is there is loaded
    assert {r.name for r in store.add(names("bb", "ccc", "ccc")).collect()} == {"ccc"} and calls[1:] == [["ccc"]]
    store.remove(names("a", "none"))
    assert {r.name for r in store.load().collect()} == {"bb", "ccc"}
    store.add(names("a"))  # removed and back
    again = VectorStore(spark, str(tmp_path / "store"), encoder)
    assert {r.name for r in again.load().collect()} == {"a", "bb", "ccc"}
    assert {r.name for r in again.subset(names("a", "unknown")).collect()} == {"a"}
    assert again.snapshot(1).count() == 3
    again.remove(names("a", "bb"))
    assert again.snapshot(2).count() == 1 and again.snapshot(1).count() == 1


def test_top_k(spark):
    rng = random.Random(1)
    items = [(f"n{i:03}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    items += [("a-tie", items[5][1])]
    q = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(7)]
    idf, qdf = spark.createDataFrame(items, "name string, vec array<float>"), spark.createDataFrame(q, "q_id int, vec array<float>")
    m = np.array([v for _, v in items], np.float32).astype(float)
    m /= np.sqrt((m * m).sum(1, keepdims=True))
    got = vectors.top_k(qdf, idf, 5, block_rows=3).toPandas()
    for i, v in q:
        v = np.array(v, np.float32).astype(float)
        sim = np.round(m @ v / np.sqrt(v @ v), 6)
        best = sorted(range(len(items)), key=lambda k: (-sim[k], items[k][0]))[:5]
        assert [items[k][0] for k in best] == got[got.q_id == i].sort_values("rank").name.tolist()


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a|r|b\nbad|line\n c | s | d \n|x|y\na|r|b\n")
    assert [tuple(r) for r in readers.triples_pipe(spark, str(tmp_path / "t.txt")).collect()] == [("a", "r", "b"), ("c", "s", "d"), ("a", "r", "b")]
    (tmp_path / "t.json").write_text('{"head": "a", "relationship": "r", "tail": "b"}\n{"head": \n')
    good, bad = readers.triples_jsonl(spark, str(tmp_path / "t.json"))
    assert good.count() == 1 and bad.count() == 1
    (tmp_path / "q.json").write_text('{"query": "q", "answer": "x"}\n{"query": "r", "answer": ["x", "y"]}\n{"query": "s", "answer": [["x", "y"], ["z"]]}\n')
    assert [r.answer for r in readers.qa_jsonl(spark, str(tmp_path / "q.json")).collect()] == [[["x"]], [["x"], ["y"]], [["x", "y"], ["z"]]]
    (tmp_path / "s.json").write_text('{"a r b": {"triplet": ["a", "r", "b"], "score": 100}}')
    assert tuple(readers.scores_json(spark, str(tmp_path / "s.json")).first()) == ("a", "r", "b", 100.0, True)
    entry = '"{0} r b": {{"triplet": ["{0}", "r", "b"], "score": {1}}}'
    parts = [entry.format(c, i) for i, c in enumerate("ab}")]
    for name, body in (("m1", "{" + ", ".join(parts) + "}"), ("m2", "{\n" + ",\n".join(parts) + "\n}\n"), ("m3", "{" + ",\n".join(parts) + "}"), ("m4", "\n".join("{" + p + "}" for p in parts))):
        (tmp_path / f"{name}.json").write_text(body)
        assert {tuple(r) for r in readers.scores_json(spark, str(tmp_path / f"{name}.json")).collect()} == {(c, "r", "b", float(i), True) for i, c in enumerate("ab}")}, name
    (tmp_path / "m5.json").write_text(parts[0].join("{}").replace(": {", ":\n {"))
    assert readers.scores_json(spark, str(tmp_path / "m5.json"), multi_line=True).count() == 1
    asked = ['{"query": "q%d", "answer": "x]", "question_type": "%s"}' % (i, t) for i, t in enumerate(["inference_query", "other", "inference_query"])]
    for body, whole in (("[" + ",".join(asked) + "]", False), ("[\n" + ",\n".join(asked) + "\n]", False), ("\n".join(f"[{a}]" for a in asked), False), ("[" + ",\n".join(asked) + "]", False), ("[" + ",".join(asked).replace(", ", ",\n") + "]", True)):
        (tmp_path / "arr.json").write_text(body)
        assert {(r["query"], r.answer[0][0]) for r in readers.qa_array(spark, str(tmp_path / "arr.json"), multi_line=whole).collect()} == {("q0", "x]"), ("q2", "x]")}
    scores = spark.createDataFrame([("a", "r", "b", 5.0), ("", "r", "b", 50.0), ("c", "r", "d", 50.0)], f"{T}, score double")
    sinks.write_graph(sinks.loadable(scores, 10), str(tmp_path / "g"), 1)
    assert spark.read.parquet(str(tmp_path / "g")).select("head").first().head == "c"


def test_microbatches_replay_to_the_same_snapshot(spark, tmp_path):
    scores = spark.createDataFrame([("A", "r", "B", 100.0), ("B", "r", "C", 50.0)], f"{T}, score double")
    rows = [("A", "r", "B", i, 0, i, d) for i, d in enumerate([150.0, 80.0, -300.0, 5.0])]
    deltas = spark.createDataFrame(rows, feedback_loop.DELTAS)
    for i in range(4):
        deltas.where(f"q_ord = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = feedback_loop.run_microbatches(spark, scores, str(tmp_path / "in"), str(tmp_path / "snap"), str(tmp_path / "cp"))
    want = {("A", 25.0), ("B", 50.0)}
    assert {(r.head, r.score) for r in last.collect()} == want
    changed = spark.read.parquet(str(tmp_path / "snap" / "changes"))
    assert {r.head for r in changed.collect()} == {"A"}  # only what changes is written
    batch = changed.agg(F.max("batch")).first()[0]
    feedback_loop.apply_batch(spark, str(tmp_path / "snap"), deltas.where("q_ord = 3") if batch == 3 else deltas, batch)
    assert {(r.head, r.score) for r in feedback_loop.current(spark, str(tmp_path / "snap")).collect()} == want


def test_score_state_as_a_stream(spark, tmp_path):
    rows = [("A", "r", "B", i, 0, i, d, 100.0) for i, d in enumerate([150.0, 80.0, -300.0, 5.0])] + [("B", "r", "C", 1, 0, 9, 5.0, 198.0)]
    deltas = spark.createDataFrame(rows, f"{feedback_loop.DELTAS}, base double")
    for i in range(4):
        deltas.where(f"q_ord = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = feedback_loop.run_score_state(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 1)
    assert {(r.head, r.score) for r in got.collect()} == {("A", 25.0), ("B", 200.0)}


def test_score_state_logic():
    import pandas as pd

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    p = feedback_loop.ScoreState()
    p.score = Value()
    frame = pd.DataFrame({"q_ord": [1, 0], "idx": [0, 0], "event_id": [1, 0], "delta": [-300.0, 150.0], "base": [100.0, 100.0]})
    assert next(p.handleInputRows(("A", "r", "B"), iter([frame]), None)).score[0] == 20.0


def test_clean_up_deletes_what_was_written(spark):
    path = session.materialize(spark.range(3), "x")._graphtide_path
    there = lambda: spark._jvm.java.io.File(path.removeprefix("file://")).exists()
    assert there()
    session.clean_up(spark)
    assert not there()


def test_model_udf(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "t string").select(model_udf(hash_encoder, "array<float>")(F.col("t")).alias("v"))
    got = [r.v for r in df.collect()]
    assert got[0] == got[2] and len(got[1]) == 64
