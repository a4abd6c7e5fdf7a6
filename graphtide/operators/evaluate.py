"""Judging answers: labels, accuracy, exact match, F1, Rouge-L and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 6


def group_labels(prediction: Column, answer: Column) -> Column:
    """One boolean for each group of aliases: is any of them in the prediction, case aside?"""
    return F.transform(answer, lambda g: F.exists(g, lambda a: F.contains(F.lower(prediction), F.lower(a))))


def all_groups(df: DataFrame) -> DataFrame:
    """q_id, labels, label for df(q_id, prediction, answer array of alias arrays)."""
    found = df.withColumn("labels", group_labels(F.col("prediction"), F.col("answer")))
    return found.select("q_id", F.transform("labels", lambda x: x.cast("int")).alias("labels"), F.forall("labels", lambda x: x).alias("label"))


def partial(df: DataFrame) -> DataFrame:
    """The number of questions with some but not all groups matched."""
    labels = group_labels(F.col("prediction"), F.col("answer"))
    return df.agg(F.count_if(F.exists(labels, lambda x: x) & ~F.forall(labels, lambda x: x)).alias("n_partial"))


def any_match(prediction: Column, aliases: Column) -> Column:
    return F.exists(aliases, lambda a: F.contains(F.lower(prediction), F.lower(a)))


def any_match_refusal(prediction: Column, aliases: Column) -> Column:
    return F.when(F.contains(prediction, F.lit("The context do not contain answer")), 2).otherwise(any_match(prediction, aliases).cast("int"))


def accuracy(labels: DataFrame, *by: str, metrics: tuple[str, ...] = ()) -> DataFrame:
    """Mean label per slice and, as the row of nulls, over all; and the means of further metrics times 100."""
    mean = F.round(F.avg(F.col("label").cast("int")), PLACES).alias("accuracy")
    more = [F.round(F.avg(m) * 100, 4).alias(m) for m in metrics]
    return labels.rollup(*by).agg(F.count("*").alias("n"), mean, *more) if by else labels.agg(mean, *more)


def answer_combinations(answer: Column) -> Column:
    """Every way to take one alias of each group, joined by a comma and a space."""
    joined = F.aggregate(
        answer,
        F.array(F.lit("")),
        lambda acc, g: F.flatten(F.transform(acc, lambda a: F.transform(g, lambda x: F.when(a == "", x).otherwise(F.concat(a, F.lit(", "), x))))),
    )
    return joined


def answer_tokens(text: Column) -> Column:
    """Lower-case tokens without ASCII punctuation and articles."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(plain, r"\s+"), lambda t: ~t.isin("", "a", "an", "the"))


def em_f1(df: DataFrame) -> DataFrame:
    """q_id, em, f1 (best over references) for df(q_id, prediction, references); tokens are matched as multisets."""
    pairs = df.select("q_id", answer_tokens(F.col("prediction")).alias("p"), F.explode("references").alias("r")).withColumn("g", answer_tokens(F.col("r")))
    pt, gt = F.col("p"), F.col("g")
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    common = F.aggregate(F.transform(F.array_distinct(gt), lambda t: F.least(count(pt, t), count(gt, t))), F.lit(0), lambda a, x: a + x)
    scored = pairs.select("q_id", (F.col("p") == F.col("g")).cast("int").alias("em"), common.alias("c"), F.size(pt).alias("np"), F.size(gt).alias("ng"))
    f1 = F.when((F.col("np") == 0) | (F.col("ng") == 0), (F.col("np") == F.col("ng")).cast("double")).when(F.col("c") == 0, 0.0).otherwise(2.0 * F.col("c") / (F.col("np") + F.col("ng")))
    return scored.groupBy("q_id").agg(F.max("em").alias("em"), F.round(F.max(f1), PLACES).alias("f1"))


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: the table's differences as bits, a whole row a step."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for word in b:
        if hits := row & places.get(word, 0):
            row = (row + hits | row - hits) & full
    return len(a) - row.bit_count()


def rouge_l(df: DataFrame) -> DataFrame:
    """q_id, p, r, f of Rouge-L on white-space tokens, best reference by f, for df(q_id, prediction, references)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for q, pred, refs in zip(frame.q_id, frame.prediction, frame.references, strict=True):
                a, best = (pred or "").split(), (0.0, 0.0, 0.0)
                for ref in refs if refs is not None else []:
                    b = (ref or "").split()
                    n = _lcs(a, b)
                    if n:
                        p, r = n / len(a), n / len(b)
                        best = max(best, (2 * p * r / (p + r), p, r))
                out.append((q, round(best[1], PLACES), round(best[2], PLACES), round(best[0], PLACES)))
            yield pd.DataFrame(out, columns=["q_id", "p", "r", "f"])

    return df.select("q_id", "prediction", "references").mapInPandas(work, "q_id long, p double, r double, f double")


def path_counts(paths: DataFrame) -> DataFrame:
    """Mean and median number of paths per seed and per question."""
    return count_stats(paths.groupBy("q_id", "seed_ord").agg(F.count("*").alias("n")))


def count_stats(per_seed: DataFrame) -> DataFrame:
    """path_counts of per_seed(q_id, seed_ord, n), paths already counted."""
    per_q = per_seed.groupBy("q_id").agg(F.sum("n").alias("nq"))
    a = per_seed.agg(F.round(F.avg("n"), 4).alias("seed_mean"), F.median("n").alias("seed_median"))
    return a.crossJoin(per_q.agg(F.round(F.avg("nq"), 4).alias("question_mean"), F.median("nq").alias("question_median")))


def sim_stats(scored: DataFrame) -> DataFrame:
    """Per question the max of maxes, min of mins, median of medians and mean of means over its seeds."""
    per = scored.groupBy("q_id", "seed_ord").agg(F.max("sim").alias("a"), F.min("sim").alias("b"), F.median("sim").alias("c"), F.avg("sim").alias("d"))
    return per.groupBy("q_id").agg(F.max("a").alias("max_sim"), F.min("b").alias("min_sim"), F.round(F.median("c"), 10).alias("median_sim"), F.round(F.avg("d"), 5).alias("mean_sim"))


def counted_sim_stats(scored: DataFrame) -> DataFrame:
    """sim_stats of scored(q_id, seed_ord, sim, n), where a row stands for n paths of that similarity."""
    n = F.col("n")
    per = scored.groupBy("q_id", "seed_ord").agg(F.max("sim").alias("a"), F.min("sim").alias("b"), F.percentile("sim", 0.5, n).alias("c"), (F.sum(F.col("sim") * n) / F.sum(n)).alias("d"))
    return per.groupBy("q_id").agg(F.max("a").alias("max_sim"), F.min("b").alias("min_sim"), F.round(F.median("c"), 10).alias("median_sim"), F.round(F.avg("d"), 5).alias("mean_sim"))


def score_stats(scores: DataFrame) -> DataFrame:
    """Per iteration the mean of positive scores, each capped at 200."""
    return scores.where(F.col("score") > 0).groupBy("iteration").agg(F.round(F.avg(F.least("score", F.lit(200.0))), PLACES).alias("mean_score"))


def iteration_diff(last: DataFrame, now: DataFrame) -> DataFrame:
    """Per question the facts of the last iteration, how many are gone now, and their share."""
    gone = last.join(now, ["q_id", "fact"], "left_anti").groupBy("q_id").agg(F.count("*").alias("n_gone"))
    return last.groupBy("q_id").agg(F.count("*").alias("n_last")).join(gone, "q_id", "left").select(
        "q_id", "n_last", F.coalesce("n_gone", F.lit(0)).alias("n_gone"), F.round(F.coalesce("n_gone", F.lit(0)) / F.col("n_last"), PLACES).alias("rate")
    )


def iteration_means(diff: DataFrame) -> DataFrame:
    """Mean facts and losses of iteration_diff, the mean of the questions' rates and the ratio of the sums; null without facts."""
    ratio = F.when(F.sum("n_last") > 0, F.sum("n_gone") / F.sum("n_last"))
    return diff.agg(*(F.round(x, PLACES).alias(n) for n, x in (("mean_last", F.avg("n_last")), ("mean_gone", F.avg("n_gone")), ("mean_rate", F.avg("rate")), ("ratio", ratio))))


def judge_rates(verdicts: DataFrame) -> DataFrame:
    """Shares of verdict 1 (correct), 2 (partly), 0 (wrong) and null (refused)."""
    share = lambda x: F.round(F.avg(x.cast("int")), PLACES)
    is_ = lambda v: F.coalesce(F.col("verdict") == v, F.lit(False))
    return verdicts.agg(share(is_(1)).alias("correct_rate"), share(is_(2)).alias("partial_rate"), share(is_(0)).alias("error_rate"), share(F.col("verdict").isNull()).alias("refused_rate"))


def cost_means(rows: DataFrame) -> DataFrame:
    """Mean prompt tokens and seconds per question of rows(batch, tokens, batch_seconds); a batch's time is shared by its rows."""
    size = F.count("*").over(Window.partitionBy("batch"))
    return rows.withColumn("seconds", F.col("batch_seconds") / size).agg(F.round(F.avg("tokens"), PLACES).alias("mean_tokens"), F.round(F.avg("seconds"), PLACES).alias("mean_seconds"))
