"""The pipeline's near-duplicate stage against brute force over shingle sets."""

import random

import corpus_pipeline
from graphtide.llm import shingles


def brute(rows):
    sets = {i: shingles.shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if b < a and top(a) != top(b) and (sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                low, high = sorted([top(a), top(b)])
                label[high] = low
    return {i: top(i) for i in sets}


def changed(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


def test_links_are_all_pairs_of_four_fifths(spark):
    rng = random.Random(5)
    line = [f"line{i}" for i in range(40)]
    rows = []
    for _ in range(25):  # groups about the threshold, of texts that share a line with all others
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([7, 30, 120, 600]))]
        rows += [" ".join(changed(rng, words + line, rng.choice([0, 0.005, 0.015, 0.025, 0.04]))) for _ in range(8)]
    rng.shuffle(rows)
    rows = list(enumerate([*rows, "", " \n", "one two", "One  TWO", "one"]))
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute(rows)
    assert got == want
    assert 40 < len(set(want.values())) < len(rows) - 40


def test_stage_keeps_one_of_each_and_rows_without_id(spark):
    words = [f"word{i}" for i in range(300)]
    other = [*words[:80], "new", *words[81:200], "more", *words[201:]]
    rows = [(1, " ".join(words), "x"), (2, " ".join(other), "y"), (None, " ".join(words), "z"), (3, None, "n"), (4, "", "e"), (1, " ".join(words), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.fp) for r in kept.collect()) == [(0, "z"), (1, "x"), (1, "x"), (3, "n")]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_a_large_group_about_the_threshold(spark):
    """Texts at growing distance from one: many are linked, many more pairs come near 0.8 without a link."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(changed(rng, words, rng.choice([0.005, 0.02, 0.035, 0.05])))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()} == want
    assert 20 < len(set(want.values())) < 380


def test_rows_that_repeat_a_doc_id_are_one_document(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(5, a), (5, b), (3, a), (9, b), (9, b), (7, "alone here"), (8, None), (2, "")]
    got = {(r.doc_id, r.component_id) for r in shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7), (8, 2), (2, 2)}
