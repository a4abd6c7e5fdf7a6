"""Writers of graph versions and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["head", "rel", "tail"]


def loadable(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Distinct triples with score above the threshold and no empty part, as strings."""
    texts = scores.where(F.col("score") > threshold).select(*(F.col(c).cast("string").alias(c) for c in KEY))
    return texts.where(" AND ".join(f"{c} <> ''" for c in KEY)).dropDuplicates()


def write_graph(scores: DataFrame, path: str, iteration: int, reuse: bool = False) -> None:
    """One partition of a graph table per iteration; without reuse the iteration is replaced."""
    out = scores.withColumn("iteration", F.lit(iteration)).write.partitionBy("iteration")
    out.mode("append" if reuse else "overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_stage_rows(rows: DataFrame, path: str, iteration: int) -> None:
    """The result rows of an iteration, one a question, as a partition of a table; writing an iteration again replaces it."""
    rows.withColumn("iteration", F.lit(iteration)).write.partitionBy("iteration").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def export_triples(triples: DataFrame, path: str) -> None:
    triples.select(*KEY).write.json(path)


def graph_view(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with a stable colour, edges) for display."""
    names = triples.select(F.explode(F.array("head", "tail")).alias("id")).distinct()
    colour = F.concat(F.lit("#"), F.substring(F.md5("id"), 1, 6))
    return names.select("id", colour.alias("colour")), triples.select(F.col("head").alias("source"), F.col("tail").alias("target"), F.col("rel").alias("label"))
