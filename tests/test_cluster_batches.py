"""Clustering over many groups a task."""

from collections import Counter

import numpy as np

from graphtide.operators import redundancy


def test_clusters_of_many_questions_come_in_batches(spark):
    """Groups that run over Arrow batches stay whole, and what is no vector or near nothing is alone."""
    rng = np.random.default_rng(4)
    rows = [(q, f"n{i:02}", (np.eye(3)[i % 3] + 0.01 * rng.standard_normal(3)).tolist() if i else None) for q in range(40) for i in range(q % 11)]
    rows += [(99, "a", [1.0, 0.0, 0.0]), (99, "b", [0.0, 0.0, 0.0]), (99, "c", [1.0, 0.0]), (99, "d", [0.0, 1.0, 0.0]), (99, "e", [0.0, 1.0, 0.0])]
    items = spark.createDataFrame(rows, "q_id long, name string, vec array<double>").repartition(5)
    want = {(q, n, n if v is None else f"n{int(n[1:]) % 3 or 3:02}") for q, n, v in rows if q < 99} | {(99, n, "d" if n == "e" else n) for n in "abcde"}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(r) for r in redundancy.cluster(items, 0.1).collect()} == want == {tuple(r) for r in redundancy.dbscan(items, 0.1).collect()}
        sizes = Counter((q, c) for q, _, c in want)
        together = {tuple(r) for r in redundancy.cluster(items, 0.1, alone=False).collect()}
        assert together == {r for r in want if sizes[r[0], r[2]] > 1}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
