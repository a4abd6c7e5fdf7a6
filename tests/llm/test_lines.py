"""Line dedup against brute force, whatever the batches, fan-out and share of hot lines."""

import random

import pytest
from pyspark.sql import functions as F

from graphtide.llm import lines


def brute(rows, chars=20, least=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(lower)

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= chars:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        found = (text or "").split("\n")
        stay = [x for x in found if doc is None or len(holders.get(key(x), ())) < least or doc == max(holders[key(x)])]
        out.append((str(doc), len(found), len(found) - len(stay), "\n".join(stay)))
    return sorted(out)


POOL = ["A line that many documents share", "  a line THAT many documents share\t\r", "another of twenty c.", "nineteen characters", "ÄÖÜ twelve äöüß étéé", "ääääääääääääääääääää", "äääääääääää", " not stripped here, it stays ", "", " ", "x\x1cy with a file separator inside"]


def got(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in df.collect())


@pytest.mark.parametrize(("batches", "fanout", "hot"), [(1, 2, 4096), (4, 2, 4), (7, 3, 1 << 40)])
def test_equals_brute_force(spark, batches, fanout, hot):
    rng = random.Random(batches)
    rows = [(i, "\n".join(rng.choice(POOL) if rng.random() < 0.4 else f"line of its own with number {rng.randrange(150)}" for _ in range(rng.randrange(6)))) for i in range(120)]
    rows += [(5, POOL[0]), (5, "\n".join(POOL)), (5, "\n".join(POOL)), (None, POOL[0]), (None, None), (200, None), (201, ""), (-9, POOL[0] + "\n" + POOL[0])]
    docs = spark.createDataFrame([(i, t, b"k", i) for i, t in rows], "doc_id long, text string, key binary, largest long").repartition(3)
    assert got(lines.dedup_lines(docs, batches=batches, fanout=fanout, hot=hot)) == brute(rows)


def test_rows_that_repeat_a_doc_id_are_one_document(spark):
    rows = [(1, "twenty characters and more"), (1, "twenty characters and more"), (2, "twenty characters and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(lines.dedup_lines(docs)) == brute(rows) and not any(r[2] for r in brute(rows))


def test_runs_are_compacted_and_leave_out_settled_lines(spark):
    def pairs(docs, keys):
        return spark.createDataFrame([(d, k.encode()) for d in docs for k in keys], "doc_id long, key binary")

    runs = lines.LineRuns(spark, least=3, fanout=2)
    runs.add(pairs(range(90, 95), ["common", "a"]))
    runs.add(pairs(range(80, 85), ["common", "b"]))
    assert [len(level) for level in runs.levels] == [0, 1]
    assert sorted((r.key.decode(), r.docs, r.largest) for r in spark.table(runs.levels[1][0]).collect()) == [("a", 5, 94), ("b", 5, 84), ("common", 5, 94)]
    runs.add(pairs([70], ["b", "c"]))
    runs.add(pairs([60, 61], ["c"]))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert sorted((bytes(r.key).decode(), r.largest) for r in runs.settled().collect()) == [("a", 94), ("b", 84), ("c", 70), ("common", 94)]
    with pytest.raises(ValueError, match="falling"):
        runs.add(pairs([65], ["d"]))
    runs.close()


def test_merging_runs_needs_no_shuffle(spark):
    runs = lines.LineRuns(spark, fanout=9)
    for first in (30, 20, 10):
        runs.add(spark.createDataFrame([(first + i, b"some key") for i in range(3)], "doc_id long, key binary"))
    plan = runs.settled()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert [(r.largest) for r in runs.settled().collect()] == [32]
    runs.close()


def test_a_long_text_and_nothing(spark):
    long = "\n".join(f"line of a very long text, number {i % 3000}" for i in range(60_000))
    rows = [(1, long), (2, long), (3, long)]
    assert got(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_keys_of_several_runs_are_one(spark):
    keys = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("key"))
    runs = lines.LineRuns(spark, least=3, fanout=2)
    for doc in (9, 8, 7):
        runs.add(keys.select(F.lit(doc).cast("long").alias("doc_id"), "key"))
    assert runs.settled().count() == 3000
    assert spark.table(runs.levels[1][0]).agg(F.count("*"), F.sum("docs")).first() == (3000, 6000)
    runs.close()
