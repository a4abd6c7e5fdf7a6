"""Reply parsers on malformed replies, prompts, encoders and the longest common subsequence."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from graphtide.functions import models, text
from graphtide.operators import evaluate, feedback, graph


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("reply", "want"), [
    ("The answer is numeric\nCorrect", (1, 1)), ("Answer is not numeric\n\nPartially Correct\n", (0, 2)), ("the ANSWER IS NUMERIC\nIncorrect", (1, 0)),
    ("Correct", (-1, -1)), ("The answer is numeric\nperhaps", (-1, -1)), ("who knows\nCorrect", (-1, -1)), ("not numeric\nCorrect\nmore", (-1, -1)), ("", (-1, -1)), ("INSUFFICIENT information\nCorrect", None),
])
def test_judgement(spark, reply, want):
    got = one(spark, text.judgement(F.lit(reply)))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("reply", "sizes", "want"), [
    ("0, 2\n1", [3, 2], [[0, 2], [4]]), ("0,3,x,-1, 1.5\n\n1\n0", [3, 2, 2], [[0], [6]]), ("9\n8", [3, 2], []), ("0\n0\n0", [1, 1], [[0], [1]]),
    (text.NO_GROUPS, [3], []), ("", [3], []), (" 1 , 2 ", [3], [[1, 2]]), ("99999999999999999999, 1", [3], [[1]]),
])
def test_id_groups(spark, reply, sizes, want):
    assert one(spark, text.id_groups(F.lit(reply), F.array(*map(F.lit, sizes)))) == want


@pytest.mark.parametrize(("reply", "want"), [
    ("Question: a?\nAnswer: b", [("a?", ["b"])]), ("1. Question:a\n Answer:  x ;;; y z;;;\nQuestion: b\nnone\nQuestion: c\nAnswer: d", [("a", ["x", "y z", ""]), ("c", ["d"])]),
    ("Answer: b\nQuestion: a", []), ("Question: a", []), ("", []),
])
def test_question_answers(spark, reply, want):
    assert [(r.question, r.answers) for r in one(spark, text.question_answers(F.lit(reply)))] == want


def test_extraction_of_one_map_or_a_list(spark):
    rows = [(1, '{"entities": {"city": ["rome", "ROME"]}, "triplets": [["a", "b", "c"]]}'), (2, 'x {"entities": [{"town": ["rome"]}, {"river": ["po"]}], "triplets": []} y'), (3, '{"entities": 5, "triplets": []}'), (4, '{"entities": {"a": ["b"]}}'), (5, "no"), (6, None)]
    parsed = spark.createDataFrame(rows, "ord int, raw string").select("ord", text.extraction(F.col("raw")).alias("parsed"))
    assert {r.ord for r in parsed.where("parsed IS NOT NULL").collect()} == {1, 2}
    assert {(r.name, r.label) for r in text.entity_labels(parsed).collect()} == {("Rome", "Town"), ("Po", "River")}


def test_a_field_is_not_filled_twice(spark):
    got = one(spark, text.filled("{a}-{b}{a} {c}", a=F.lit("{b}"), b=F.lit("x"), none=F.lit("y")))
    assert got == "{b}-x{b} {c}" and one(spark, text.filled("", a=F.lit("x"))) == ""


def table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randrange(0, 40)) for _ in "ab")
        assert evaluate._lcs(a, b) == table(a, b)
    a, b = ([f"w{rng.randrange(500)}" for _ in range(20_000)] for _ in "ab")
    began = time.time()
    assert evaluate._lcs(a, b) > 1000 and time.time() - began < 5


def test_equal_texts_are_encoded_once_by_one_model_a_process(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        made = f"{folder}/model-{os.getpid()}"
        assert not os.path.exists(made)  # another model in the same process would find it
        open(made, "w").close()

        def encode(texts):
            assert texts == sorted(texts, key=len)
            with open(f"{folder}/seen-{os.getpid()}", "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [[float(len(t))] for t in texts]

        return encode

    rows = spark.createDataFrame([(i, "x" * (i % 7 + 1)) for i in range(200)] + [(200, None)], "id int, t string").repartition(6)
    got = models.encoded(rows, "t", factory).collect()
    assert {(r.id, r.vec[0]) for r in got} == {(i, float(i % 7 + 1)) for i in range(200)} | {(200, 0.0)}
    seen = [line.strip() for p in tmp_path.glob("seen-*") for line in p.read_text().splitlines()]
    assert sorted(seen) == sorted({"x" * n for n in range(8)})


def test_sample_of_too_few(spark):
    triples = spark.createDataFrame([("a", "r", "b"), ("c", "r", "d")], "head string, rel string, tail string")
    assert graph.sample(triples, 2).count() == 2
    with pytest.raises(ValueError, match="3 of 2"):
        graph.sample(triples, 3)


def test_feedback_rules(spark):
    said = spark.createDataFrame([(1, 0, "error", 3, 5), (1, 0, "correct", 2, 1), (1, 1, "error", 1, 2), (2, 0, "correct", 4, 3), (3, 0, "correct", 0, 4)], "q_ord long, idx long, kind string, degree int, event_id long")
    flags = spark.createDataFrame([(2, True, False), (3, False, True)], "q_ord long, insufficient boolean, no_feedback boolean")
    assert {(r.q_ord, r.idx, r.kind, r.degree) for r in feedback.correct_first(said).collect()} >= {(1, 0, "correct", 2), (1, 1, "error", 1)}
    assert {r.q_ord for r in feedback.usable(said, flags, ["insufficient"]).collect()} == {1, 3}
    assert {r.q_ord for r in feedback.usable(said, flags, ["insufficient", "no_feedback"]).collect()} == {1}
    assert {r.degree for r in feedback.in_degree(said).collect()} == {1, 2, 3}
    chains = spark.createDataFrame([(c, n, v, i) for c in range(5) for n in (True, False) for v in range(3) for i in (0, 4)], "contribution int, numeric boolean, verdict int, idx int").withColumn("n_facts", F.lit(4))
    got = {(r.contribution, r.numeric, r.verdict): r.delta for r in feedback.contribution_deltas(chains).collect()}
    assert got == {(3, True, 0): -15.0, (3, True, 1): 15.0, (3, True, 2): 15.0, (2, False, 0): -10.0, (3, False, 0): -15.0, **{(c, False, v): 5.0 * c for c in (1, 2, 3) for v in (1, 2)}}
    steps = spark.createDataFrame([(1, 0.9, 0.1, -1.0), (1, 0.2, 0.6, 2.0), (2, 0.5, 0.5, 9.0)], "q_id int, sim01 double, score01 double, g double")
    moved = {r.q_id: (round(r.gradient, 6), round(r.weight, 6)) for r in feedback.weight_step(steps, 0.5, 10.0).collect()}
    assert moved == {1: (3.2, 0.468), 2: (0.0, 0.5)}


def test_each_text_is_encoded_once_and_results_are_not_shuffled(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("",)], "t string").repartition(3)
    got = models.encoded_texts(rows, "t", lambda: lambda texts: [[float(len(t))] for t in texts])
    assert sorted((r.t, r.vec[0]) for r in got.collect()) == [("", 0.0), ("a", 1.0), ("b", 1.0)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
