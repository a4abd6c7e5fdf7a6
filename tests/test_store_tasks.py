"""Tasks of the vector store."""

from pyspark.sql import functions as F

from graphtide.sources import vector_store
from graphtide.sources.vector_store import VectorStore


def test_the_store_takes_tasks_by_the_number_of_names(spark, tmp_path, monkeypatch):
    parts = {}
    write = vector_store.materialize
    monkeypatch.setattr(vector_store, "materialize", lambda df, name: parts.update({name: df.rdd.getNumPartitions()}) or write(df, name))
    monkeypatch.setattr(vector_store, "TASK_ROWS", 20)
    store = VectorStore(spark, str(tmp_path / "store"), lambda names: names.select("name", F.array(F.length("name").cast("float")).alias("vec")))
    names = spark.range(1000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    assert store.add(names.union(names)).count() == 1000 and parts["fresh"] == 100
    assert store.add(names).count() == 0 and store.load().distinct().count() == 1000
