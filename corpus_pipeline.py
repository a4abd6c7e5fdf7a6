"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all that the stage before it kept;
`run` writes each stage's rows to the shared folder and reads them again for the next. All stages
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.llm import decontaminate, packing, pii, shingles, simhash, toxicity
from graphtide.llm.common import read
from graphtide.llm.queries import tokenizer_path
from graphtide.operators.components import components
from graphtide.session import discard, materialize, ready


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of these documents, doesn't reject.

    Null and empty texts score as texts without features and stay unless the labels are mostly toxic. Rows are
    judged one by one: repeated rows and null doc_ids like any other. Empty tables give an empty
    result; all columns stay, whatever their names.
    """
    return toxicity.reject(docs, toxicity.fit(docs, read(ready(spark), sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates: SimHashes within three bits, or a Jaccard similarity of 0.8 (five words).

    A group is everything that links of either kind lead to, so the second search adds what the fingerprints tell apart. Null and
    empty texts are copies of each other. Rows with a null doc_id stay; rows that repeat a doc_id stay or go together. An empty
    table gives an empty result; all columns stay.
    """
    ready(spark)
    named = docs.where(F.col("doc_id").isNotNull())
    found = [search.near_duplicates(named).select("doc_id", "component_id") for search in (simhash, shingles)]
    links = found[0].unionByName(found[1]).where("doc_id != component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).distinct()
    labels = components(links)
    copies = materialize(labels.where("node != label").select(F.col("node").alias("doc_id")), "copies")
    discard(*found, labels)
    return docs.join(copies.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none. All rows of a doc_id go if one of them has a passage; rows with a null
    doc_id stay. An empty table or benchmark removes nothing; all columns stay.
    """
    return decontaminate.clean(docs, read(ready(spark), sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what gives it away generalised or removed.

    Every row stays, null and repeated doc_ids too; a null text stays null. n_chars is counted anew;
    other columns stay as they are, whatever their names. An empty table gives an empty result.
    """
    ready(spark)
    return pii.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids.

    Null and empty texts are a piece of one id. Each row is a document of its own, repeated rows and null
    doc_ids too. An empty table gives no piece; further columns are not used.
    """
    ready(spark)
    return packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
