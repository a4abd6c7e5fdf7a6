"""Pages that share a url or have none are evidence of their own questions."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["j_evidence", "src_corpus_evidence_join"])
def test_repeated_and_null_urls(spark, small, tmp_path, name):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    url = F.when(F.col("page_id") % 3 == 0, "http://same.example/").when(F.col("page_id") % 3 == 1, F.col("url"))
    pages.withColumn("url", url).write.parquet(f"{tmp_path}/pages.parquet")
    os.symlink(f"{small}/conversations.parquet", f"{tmp_path}/conversations.parquet")
    ours = sorted((r.q_id, r.texts) for r in entry.queries()[name](spark, str(tmp_path)).select("q_id", "texts").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    found = con.execute(entry.oracle_sql()[name]).fetchall()
    assert len(ours) > 2 and ours == sorted(found)
