"""The loop with retrieval: replays, seeds that are made anew only when touched, compaction, and a plain version in Python."""

import pytest
from pyspark.sql import functions as F

from graphtide.operators import graph
from graphtide.streaming.retrieval_loop import Loop

TRIPLES = [("A", "r", "B"), ("B", "r", "C"), ("A", "s", "C"), ("D", "r", "E"), ("E", "t_u", "F"), ("C", "s", "D"), ("G", "r", "H")]
SEEDS = ["A", "D", "G", "C"]
ASKED = [(0, 0, "A", 0), (0, 1, "A", 0), (0, 1, "D", 1), (1, 2, "A", 0), (1, 3, "G", 0), (2, 4, "D", 0), (2, 5, "C", 0), (3, 6, "G", 0), (3, 7, "A", 0)]
SAID = [(q, i, "correct" if (q + i) % 3 else "error", 1 + (q * i) % 3, 100 * q + i) for q in range(8) for i in range(4)]


def plain(paths, scores, sims, pruning=2, least=61.0):
    scores, ranked = dict(scores), []
    for batch in sorted({a[0] for a in ASKED}):
        folds = []
        for _, q, *_ in sorted({a[:2] for a in ASKED if a[0] == batch}):
            facts = {}
            for _, _, seed, order in sorted(a for a in ASKED if a[:2] == (batch, q)):
                valued = []
                for at, v, hops in paths[seed]:
                    kept = [h for h in hops if scores[h] >= least]
                    if kept and sims(q, v) > 0:
                        product = 1.0
                        for h in kept:
                            product *= scores[h]
                        valued.append((-round((sims(q, v) + 1) * 50 + product / 100 ** (len(kept) - 1), 6), at, kept))
                for rank, (value, at, kept) in enumerate(sorted(valued)[:pruning], 1):
                    ranked.append((batch, q, order, rank, at, -value))
                    for i, h in enumerate(kept):
                        facts.setdefault(f"{h[0]} {h[1].replace('_', ' ')} {h[2]}", (h[0], h[2], order, rank, i, h))
            for pos, fact in enumerate(sorted(facts.values())):
                folds += [(q, i, e, fact[5], (5.0 if kind == "correct" else -5.0) * degree) for x, i, kind, degree, e in SAID if (x, i) == (q, pos)]
        for *_, triple, delta in sorted(folds):
            scores[triple] = max(20.0, min(200.0, scores[triple] + delta))
    return scores, sorted(ranked)


@pytest.fixture
def made(spark, tmp_path):
    scores = {t: 60.0 + 9 * i for i, t in enumerate(TRIPLES)}
    base = spark.createDataFrame([(*t, s) for t, s in scores.items()], "head string, rel string, tail string, score double")
    found = graph.expand_paths(base, spark.createDataFrame([(s,) for s in SEEDS], "seed string"), 2, carry=("score",))
    rows = [r for s in SEEDS for r in enumerate(sorted((r for r in found.collect() if r.seed == s), key=lambda r: r.path), 1)]
    edge = lambda h: (h.src, h.rel, h.dst) if h.dir == "->" else (h.dst, h.rel, h.src)
    paths = {s: [(i, i % 5, [edge(h) for h in r.hops]) for i, r in rows if r.seed == s] for s in SEEDS}
    table = spark.createDataFrame([(r.seed, i, i % 5, r.hops) for i, r in rows], spark.createDataFrame([], "seed string, path_ord long, v long").schema.add("hops", found.schema["hops"].dataType))
    said = spark.createDataFrame(SAID, "q_ord long, idx long, kind string, degree int, event_id long")

    def loop(name, **more):
        one = Loop(spark, f"file://{tmp_path}/{name}", lambda facts: said, lambda pairs: pairs.withColumn("sim", ((F.col("q_id") * 7 + F.col("v") * 3) % 11 - 2) / F.lit(10.0)), pruning=2, parts=4, **more)
        one.prepare(table)
        return one

    return loop, base, plain(paths, scores, lambda q, v: ((q * 7 + v * 3) % 11 - 2) / 10), spark.createDataFrame(ASKED, "batch long, q_id long, seed string, seed_ord int"), f"file://{tmp_path}"


def close(rows):
    return {(r.head, r.rel, r.tail): round(r.score, 6) for r in rows.collect()}


def test_equals_the_plain_loop(spark, made):
    loop, base, (scores, ranked), asked, folder = made
    one = loop("stream", compact_every=2)
    one.run(asked, f"{folder}/checkpoint")
    assert close(one.scores(base)) == {t: round(s, 6) for t, s in scores.items()} and close(one.changed()).items() <= close(one.scores(base)).items()
    got = spark.read.parquet(f"{folder}/stream/ranked").collect()
    assert sorted((r.batch, r.q_id, r.seed_ord, r.rank, r.path_ord, r.value) for r in got) == ranked


def test_a_batch_run_again_changes_nothing_and_only_touched_seeds_are_made_anew(spark, made):
    loop, base, (scores, _), asked, folder = made
    one = loop("steps", compact_every=0)
    for batch in range(4):
        some = asked.where(F.col("batch") == batch).drop("batch")
        one.step(some, batch)
        if batch == 2:
            before = close(one.scores(base))
            one.step(some, batch)
            assert close(one.scores(base)) == before
    before = close(one.scores(base))
    assert before == {t: round(s, 6) for t, s in scores.items()}
    versions = {b: {r.seed for r in spark.read.parquet(f"{folder}/steps/versions/log={b}").collect()} for b in range(4)}
    touched = {b: {r.seed for r in spark.read.parquet(f"{folder}/steps/touched/log={b}").collect()} for b in range(4)}
    assert versions[0] == {"A", "D"} and "G" in versions[1] and ("A" in versions[1]) == ("A" in touched[0])
    assert ("G" in versions[3]) == ("G" in touched[1] | touched[2])
    one.compact(4)
    assert close(one.scores(base)) == before and close(one.scores(base, 0)) == close(base)
