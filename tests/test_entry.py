"""The driver contract: names, schemas, and a few queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_session_views_are_left_alone(spark, small):
    spark.range(3).createOrReplaceTempView("orders")
    assert entry.queries()["g_count_edges"](spark, small).count() == 1 and spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", [
    *["g_all_triples", "g_expand_paths", "sink_dictionary_encode", "sink_stage_rows", "src_qa_tsv_pipe", "src_corpus_evidence_join", "feedback_text_parse", "vec_topk_entities", "vec_store_add", "vec_store_incremental"],
    *["rd_rename_scores", "rd_cluster_dbscan", "flt_substring_suppress", "rk_standard", "rk_basic", "rk_basic_suppressed", "fb_leaderboard", "fb_next_iteration", "fb_path_gradient", "st_score_state", "ev_em_f1", "ev_rouge_l", "ev_iteration_diff"],
])
def test_against_sql(spark, small, tables, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    ours = sorted(str([r[c] for c in columns]) for r in df.collect())
    found = tables.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert ours == sorted(str([row[i] for i in at]) for row in found.fetchall())
