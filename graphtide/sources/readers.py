"""Readers of question sets, corpora and triples from files. Schemas are explicit; nothing is inferred.

A question set is (query, answer array of alias arrays): an AND of OR-groups, whatever shape
the file has. Where the order of the file counts, `in_file_order` numbers its lines first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.operators.graph import numbered
from graphtide.session import materialize


def in_file_order(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """value and number, from 0, of each line, in the order of file names and of lines in a file, however files are split.

    A line's order is its file, the block of it that a task reads, and its place there; places are counted by ranges, not by one task.
    """
    place = ["__file", "__block", "__row"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias(place[0]), F.col("_metadata.file_block_start").alias(place[1]), F.monotonically_increasing_id().alias(place[2]))
    return numbered(materialize(lines, "lines"), place, name).drop(*place)


def answer_groups(raw: Column) -> Column:
    """A raw JSON answer (string, array of strings, or array of arrays) as groups of aliases."""
    nested = F.from_json(raw, "array<array<string>>")
    flat = F.transform(F.from_json(raw, "array<string>"), lambda a: F.array(a))
    return F.when(F.startswith(F.trim(raw), F.lit("[[")), nested).when(F.startswith(F.trim(raw), F.lit("[")), flat).otherwise(F.array(F.array(F.regexp_replace(raw, '^"|"$', ""))))


def qa_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """query and answer of one JSON object per line."""
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.query").alias("query"), answer_groups(F.get_json_object("value", "$.answer")).alias("answer"))


def qa_array(spark: SparkSession, path: str, question_type: str = "inference_query", multi_line: bool = False) -> DataFrame:
    """JSON arrays of questions, only rows of the given type.

    A line is an array of its own, or a row of an array over many lines, so files can be split; rows over
    several lines need multi_line, which reads a file as a whole.
    """
    row = "struct<query:string,answer:string,question_type:string>"
    if multi_line:
        whole = spark.read.schema("query string, answer string, question_type string").option("multiLine", True).json(path)
        return whole.where(F.col("question_type") == question_type).select("query", F.array(F.array("answer")).alias("answer"))
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r",$", "").alias("value"))
    parts = F.when(F.startswith("value", F.lit("[")), F.from_json(F.concat("value", F.when(F.endswith("value", F.lit("]")), "").otherwise("]")), f"array<{row}>"))
    parts = parts.otherwise(F.array(F.from_json(F.regexp_replace("value", r"\]$", ""), row)))
    rows = lines.where(~F.col("value").isin("", "[", "]")).select(F.explode(parts).alias("r")).select("r.*")
    return rows.where(F.col("question_type") == question_type).select("query", F.array(F.array("answer")).alias("answer"))


def qa_hotpot(spark: SparkSession, path: str) -> DataFrame:
    """question, answer and the context's sentences run together."""
    rows = spark.read.schema("question string, answer string, context array<struct<title:string,sentences:array<string>>>").json(path)
    text = F.array_join(F.transform("context", lambda p: F.array_join(p["sentences"], "")), "")
    return rows.select(F.col("question").alias("query"), F.array(F.array("answer")).alias("answer"), text.alias("corpus"))


def qa_concurrent(spark: SparkSession, path: str) -> DataFrame:
    """question, answers and the texts of all positive, then all negative paragraphs."""
    rows = spark.read.schema("question string, answers array<string>, pos_paras array<struct<text:string>>, neg_paras array<struct<text:string>>").json(path)
    return rows.select(F.col("question").alias("query"), F.array("answers").alias("answer"), F.transform(F.concat("pos_paras", "neg_paras"), lambda p: p["text"]).alias("corpus"))


def qa_nested(spark: SparkSession, path: str, language: str = "en", query_type: str = "Summarization Question") -> DataFrame:
    rows = spark.read.schema("language string, query struct<query_type:string,content:string>, ground_truth struct<content:string>").json(path)
    kept = rows.where((F.col("language") == language) & (F.col("query.query_type") == query_type))
    return kept.select(F.col("query.content").alias("query"), F.array(F.array("ground_truth.content")).alias("answer"))


def _tsv(lines: DataFrame, *more: str | Column) -> DataFrame:
    parts = F.split("value", "\t", 2)
    answers = F.transform(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "\\|"), lambda a: F.trim(a))
    return lines.select(F.translate(parts[0], "[]", "").alias("query"), F.array(answers).alias("answer"), *more)


def qa_tsv(spark: SparkSession, path: str, hop: int) -> DataFrame:
    """`question<TAB>a1|a2` lines; brackets of the question go, answers are trimmed aliases."""
    return _tsv(spark.read.text(path).withColumn("hop", F.lit(hop)), "hop")


def qa_tsv_hops(spark: SparkSession, files: dict[int, str], first: int = 300) -> DataFrame:
    """q_id, query, answer, hop: the first lines of each hop's file, hop after hop, numbered in that order."""
    parts = [in_file_order(spark, path).where(F.col("line") < first).withColumn("hop", F.lit(hop)) for hop, path in sorted(files.items())]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return _tsv(numbered(rows, ["hop", "line"], "q_id"), "hop", F.col("q_id").cast("long").alias("q_id"))


def qa_alias_pairs(spark: SparkSession, path: str) -> DataFrame:
    """question, aliases with the canonical answer last, and paragraphs merged two by two, an odd last one kept."""
    rows = spark.read.schema("question string, answer string, answer_aliases array<string>, paragraphs array<struct<paragraph_text:string>>").json(path)
    texts = F.transform("paragraphs", lambda p: p["paragraph_text"])
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(texts) + 1) / 2).cast("int") - 1), lambda i: F.array_join(F.slice(texts, i * 2 + 1, 2), " "))
    return rows.select(F.col("question").alias("query"), F.array(F.concat("answer_aliases", F.array("answer"))).alias("answer"), F.when(F.size(texts) > 0, pairs).otherwise(F.array().cast("array<string>")).alias("corpus"))


def corpus_language(spark: SparkSession, path: str, language: str = "en") -> DataFrame:
    return spark.read.schema("language string, content string").json(path).where(F.col("language") == language).select("content")


def corpus_option(rows: DataFrame, option: str) -> DataFrame:
    """q_id, side, text of rows(q_id, positive, negative): `positive`, `negative` or `full` (positive, then negative)."""
    sides = [s for s in ("positive", "negative") if option in (s, "full")]
    parts = [rows.select("q_id", F.lit(i).alias("side"), F.posexplode(s).alias("ord", "text")) for i, s in enumerate(("positive", "negative")) if s in sides]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def evidence_corpus(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """q_id, texts: bodies of a question's evidence urls in order; unknown urls are dropped, of a repeated url the last body counts."""
    bodies = corpus.groupBy("url").agg(F.max_by("body", "ord").alias("body"))
    wanted = questions.select("q_id", F.posexplode("urls").alias("i", "url"))
    found = wanted.hint("merge").join(bodies.hint("merge"), "url")
    return found.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda e: e["body"]).alias("texts"))


def triples_pipe(spark: SparkSession, path: str) -> DataFrame:
    """`head|relation|tail` lines with three non-empty parts, trimmed; duplicates stay."""
    return _pipe_parts(spark, path).where("good").select("head", "rel", "tail")


def _pipe_parts(spark: SparkSession, path: str) -> DataFrame:
    """value, head, rel, tail and whether these are all of the line and none is empty; a line is split once."""
    lines = spark.read.text(path).select("value", F.explode(F.array(F.split("value", "\\|"))).alias("p"))
    parts = lines.select("value", F.size("p").alias("n"), *(F.trim(F.get("p", F.lit(i))).alias(c) for i, c in enumerate(("head", "rel", "tail"))))
    return parts.withColumn("good", (F.col("n") == 3) & (F.col("head") != "") & (F.col("rel") != "") & (F.col("tail") != ""))


def triples_pipe_counts(spark: SparkSession, path: str) -> DataFrame:
    """n_lines, n_skipped and n_distinct (of the lines that are triples) for a file of `head|relation|tail` lines."""
    lines = _pipe_parts(spark, path).select("value", F.coalesce("good", F.lit(False)).alias("good"))
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(~F.col("good")).alias("n_skipped"), F.countDistinct(F.when(F.col("good"), F.col("value"))).alias("n_distinct"))


def triples_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(triples, malformed lines) of {head, relationship, tail} objects."""
    parsed = spark.read.text(path).select("value", F.from_json("value", "struct<head:string,relationship:string,tail:string>").alias("t"))
    good = F.col("t.head").isNotNull() & F.col("t.relationship").isNotNull() & F.col("t.tail").isNotNull()
    return parsed.where(good).select("t.head", F.col("t.relationship").alias("rel"), "t.tail"), parsed.where(~F.coalesce(good, F.lit(False))).select("value")


def scores_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Rows of JSON maps from triple key to {triplet, score}; `matches` tells whether the key is that of its triplet.

    A line is a map of its own, or a part of a map over many lines with whole entries on each, so no file is
    one row; entries over several lines need multi_line, which reads a file as a whole.
    """
    line = F.trim("value")
    alone = F.startswith(line, F.lit("{")) & F.endswith(line, F.lit("}}"))  # a map of its own, as the lines of large files are: nothing to put right
    body = F.regexp_replace(F.regexp_replace(line, r",$", ""), r"^\{(?=\s*$)|^\}$", "")
    whole = F.when(F.startswith(body, F.lit("{")), body).otherwise(F.concat(F.lit("{"), body))
    whole = F.when(alone, line).otherwise(F.when(F.rlike(whole, F.lit(r"\}\s*\}\s*$")), whole).otherwise(F.concat(whole, F.lit("}"))))
    rows = spark.read.text(path, wholetext=True).withColumn("whole", F.col("value")) if multi_line else spark.read.text(path).where(alone | (F.trim(body) != "")).withColumn("whole", whole)
    lines = rows.select(F.explode(F.from_json("whole", "map<string,struct<triplet:array<string>,score:double>>")).alias("key", "v"))
    parts = [F.col("v.triplet")[i].alias(n) for i, n in enumerate(("head", "rel", "tail"))]
    return lines.select(*parts, F.col("v.score").alias("score"), (F.col("key") == F.array_join("v.triplet", " ")).alias("matches"))


def similar_questions(questions: DataFrame, paraphrases: DataFrame) -> DataFrame:
    """Question texts replaced by those of the same q_id; answers stay."""
    return questions.drop("query").join(paraphrases.select("q_id", "query"), "q_id")


def qa_concurrent_support(spark: SparkSession, path: str) -> DataFrame:
    """question and its support: all sentences, each after a space."""
    rows = spark.read.schema("question string, sp array<struct<title:string,sents:array<string>>>").json(path)
    text = F.array_join(F.transform("sp", lambda p: F.array_join(F.transform(p["sents"], lambda s: F.concat(F.lit(" "), s)), "")), "")
    return rows.select(F.col("question").alias("query"), text.alias("support"))


def corpus_sentences(spark: SparkSession, path: str) -> DataFrame:
    """One row per question with all sentences of its context."""
    rows = spark.read.schema("question string, context array<struct<title:string,sentences:array<string>>>").json(path)
    return rows.select(F.col("question").alias("query"), F.flatten(F.transform("context", lambda p: p["sentences"])).alias("sentences"))
