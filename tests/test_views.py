"""The derived views on Spark: the rows of the SQL twins, without a sort or a text shuffle of all triples."""

import duckdb

from graphtide.operators import feedback
from graphtide.plans.fixtures import Inputs, duck
from graphtide.streaming import feedback_loop

TINY = {
    "region": "(0, 'R0'), (1, 'R1')) t(r_regionkey, r_name)",
    "nation": "(0, 'N0', 0), (1, 'N1', 1), (2, 'N1', 1)) t(n_nationkey, n_name, n_regionkey)",
    "customer": "(1, 'same', 0), (2, 'C2', 1), (3, 'C2', 2)) t(c_custkey, c_name, c_nationkey)",
    "supplier": "(1, 'same', 0), (2, 'S2', 1), (3, 'S2', 1)) t(s_suppkey, s_name, s_nationkey)",
    "part": "(1, 'B1'), (1, 'B1'), (2, 'B2')) t(p_partkey, p_brand)",
    "orders": "(1, 2), (2, 3), (2, 2), (3, 9)) t(o_orderkey, o_custkey)",
    "lineitem": "(1, 1, 2), (1, 1, 3), (1, 1, 1), (2, 1, 2), (2, 2, 9), (3, 2, 1)) t(l_orderkey, l_partkey, l_suppkey)",
    "events": "(0, 1, 'click'), (1, 2, 'purchase'), (2, 3, 'error'), (3, 4, 'view'), (4, 0, 'click'), (5, 1, 'error')) t(event_id, user_id, event_type)",
    "conversations": "(1, 0, 'user', 'first question'), (1, 1, 'assistant', 'yes'), (2, 0, 'user', 'second'), (2, 1, 'assistant', 'no')) t(conv_id, turn, role, text)",
}


def test_views_equal_their_sql(spark, tmp_path):
    base = duckdb.connect()
    for name, rows in TINY.items():
        base.execute(f"COPY (SELECT * FROM (VALUES {rows}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    x = Inputs(spark, str(tmp_path))
    for view, columns in (("kg_triples", "head, rel, tail"), ("fb_triples", "q_ord, idx, kind, head, rel, tail, score"), ("fb_marks", "q_ord, idx, kind, head, rel, tail, score"), ("facts", "q_ord, head, rel, tail, score, pos")):
        want = base.execute(duck(view, f"SELECT {columns} FROM {view}").replace("AS STRING", "AS VARCHAR")).fetchall()
        got = getattr(x, view).selectExpr(*columns.split(", ")).collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want)), view
        assert want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slots_are_minima(spark, small):
    x = Inputs(spark, small)
    for view in ("fb_triples", "fb_marks"):
        assert "PARTITION BY slot" not in x.sql(view, f"SELECT * FROM {view}")._jdf.queryExecution().toString() and "windowspecdefinition(slot" not in _plan(getattr(x, view)), view


def test_a_few_changes_are_sent_to_the_scores(spark):
    scores = spark.createDataFrame([("a", "r", "b", 100.0), ("c", "r", "d", 50.0)], "head string, rel string, tail string, score double")
    deltas = spark.createDataFrame([("a", "r", "b", 5.0, 1)], "head string, rel string, tail string, delta double, q_ord long")
    for folded in (feedback.fold(scores, deltas, ["q_ord"]), feedback.fold(scores, deltas, ["q_ord"], feedback.contribution)):
        assert "SortMergeJoin" not in _plan(folded)
        assert [tuple(r) for r in folded.collect()] == [("a", "r", "b", 105.0)]
        after = feedback.next_iteration(scores, folded, 3)
        assert "SortMergeJoin" not in _plan(after)
        assert sorted(tuple(r) for r in after.collect()) == [("a", "r", "b", 105.0, 3), ("c", "r", "d", 50.0, 3)]


def test_entities_come_from_the_tables(spark, tmp_path):
    base = duckdb.connect()
    for name, rows in TINY.items():
        base.execute(f"COPY (SELECT * FROM (VALUES {rows}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    found = Inputs(spark, str(tmp_path)).kg_entities
    want = base.execute(duck("kg_entities", "SELECT name FROM kg_entities").replace("AS STRING", "AS VARCHAR")).fetchall()
    assert sorted(r.name for r in found.collect()) == sorted(n for (n,) in want) and len(want) > 10
    assert "contains" not in found._jdf.queryExecution().optimizedPlan().toString()  # no triple is made for it


def test_scores_that_cannot_change_are_not_sorted(spark, tmp_path):
    rows = [(f"h{i}", "r", "t", float(i)) for i in range(50)]
    spark.createDataFrame(rows, "head string, rel string, tail string, score double").write.parquet(f"{tmp_path}/base")
    few = spark.createDataFrame([("h3", "r", "t", 7.0, 0), ("h3", "r", "t", 9.0, 1), ("h4", "r", "t", 1.0, 1)], "head string, rel string, tail string, score double, batch long")
    few.write.partitionBy("batch").parquet(f"{tmp_path}/changes")
    want = {h: s for h, _, _, s in rows} | {"h3": 9.0, "h4": 1.0}
    now = feedback_loop.current(spark, str(tmp_path))
    assert "SortMergeJoin" not in _plan(now) and {r.head: r.score for r in now.collect()} == want and now.count() == 50
    keys = spark.createDataFrame([("h3", "r", "t"), ("h9", "r", "t"), ("none", "r", "t")], "head string, rel string, tail string")
    assert {r.head: r.score for r in feedback_loop.current(spark, str(tmp_path), 1, keys).collect()} == {"h3": 7.0, "h9": 9.0}
