"""Turning judgements into score changes: ordered, clamped folds per triple."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtide.operators.graph import having_keys, send_or_sort
from graphtide.session import materialize

KEY = ["head", "rel", "tail"]
LOW, HIGH = 20.0, 200.0


def clamp(x: Column, low: float | Column = LOW, high: float | Column = HIGH) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def fold(scores: DataFrame, deltas: DataFrame, order: list[str], step=None, span: int = 1000) -> DataFrame:
    """scores(head, rel, tail, score) with all deltas(head, rel, tail, delta, *order) applied in order; only triples with deltas.

    step(score, delta) is one application; by default a clamped sum. Clamped sums in a row are one sum
    clamped to moved bounds, so they are first folded over each `span` values of the first order column
    (a whole number), and a triple with very many deltas is not one group. Another step needs all deltas
    of a triple together. What changes is written first: a few triples are sent to the scores, and only many are sorted with them.
    """
    one = F.struct(*order, F.col("delta").cast("double").alias("delta"))
    if step is not None:
        grouped = deltas.groupBy(*KEY).agg(F.array_sort(F.collect_list(one)).alias("steps"))
        changed = F.aggregate("steps", F.col("score").cast("double"), lambda a, x: step(a, x["delta"]))
        steps = materialize(grouped, "steps")
        return having_keys(scores, steps).join(send_or_sort(steps), KEY).select(*KEY, changed.alias("score"))
    parts = deltas.groupBy(*KEY, F.floor(F.col(order[0]) / span).alias("part")).agg(F.array_sort(F.collect_list(one)).alias("steps"))
    none = F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))

    def then(f: Column, add: Column, low: Column, high: Column) -> Column:
        """The function x -> clamp(x + add, low, high) after f of the same form."""
        return F.struct((f["add"] + add).alias("add"), clamp(f["low"] + add, low, high).alias("low"), clamp(f["high"] + add, low, high).alias("high"))

    folded = parts.select(*KEY, "part", F.aggregate("steps", none, lambda f, x: then(f, x["delta"], F.lit(LOW), F.lit(HIGH))).alias("f"))
    grouped = folded.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("part", "f"))).alias("parts"))
    whole = F.aggregate("parts", none, lambda f, x: then(f, x["f"]["add"], x["f"]["low"], x["f"]["high"]))
    written = materialize(grouped.select(*KEY, whole.alias("f")), "folds")
    joined = having_keys(scores, written).join(send_or_sort(written), KEY).select(*KEY, F.col("score").cast("double").alias("score"), "f")
    return joined.select(*KEY, F.greatest("f.low", F.least("f.high", F.col("score") + F.col("f.add"))).alias("score"))


def next_iteration(scores: DataFrame, folded: DataFrame, iteration: int) -> DataFrame:
    """The next generation of scores; triples without a change are carried over."""
    new = materialize(folded.select(*KEY, F.col("score").alias("new_score")), "folded")
    return scores.join(send_or_sort(new), KEY, "left").select(*KEY, F.coalesce("new_score", "score").alias("score"), F.lit(iteration).alias("iteration"))


def flip_labels(labels: DataFrame, noise: DataFrame) -> DataFrame:
    """labels(q_id, label) with the label of each q_id in noise negated."""
    noisy = noise.select("q_id", F.lit(True).alias("noisy")).distinct()
    return labels.join(noisy, "q_id", "left").select("q_id", (F.col("label") != F.coalesce("noisy", F.lit(False))).alias("label"))


def choose_noise(questions: DataFrame, last: DataFrame, rate: float, seed: str = "noise") -> DataFrame:
    """max(1, round(n rate)) questions that were not chosen last time, in a seeded order; none for rate 0; too few raise."""
    n = questions.count()
    wanted = max(1, round(n * rate)) if rate > 0 and n else 0
    rest = questions.select("q_id").join(last.select("q_id"), "q_id", "left_anti")
    if rest.count() < wanted:
        raise ValueError("too few questions are left to choose from")
    return rest.orderBy(F.md5(F.concat(F.lit(seed), F.col("q_id").cast("string"))), "q_id").limit(wanted)


def usable(feedback: DataFrame, flags: DataFrame, without: list[str]) -> DataFrame:
    """Feedback of the questions that have none of the flags in flags(q_ord, ...), such as insufficient or no_feedback."""
    gone = flags.where(F.greatest(F.lit(False), *(F.col(c) for c in without))).select("q_ord").distinct()
    return feedback.hint("merge").join(gone.hint("merge"), "q_ord", "left_anti")


def correct_first(feedback: DataFrame) -> DataFrame:
    """One row for each id of a question: what was said under correct, else what was said under error."""
    rest = [c for c in feedback.columns if c not in ("q_ord", "idx")]
    best = feedback.groupBy("q_ord", "idx").agg(F.min(F.struct((F.col("kind") != "correct").alias("second"), *rest)).alias("one"))
    return best.select("q_ord", "idx", *(F.col(f"one.{c}") for c in rest))


def in_degree(feedback: DataFrame) -> DataFrame:
    """Feedback of degree 1 to 3."""
    return feedback.where(F.col("degree").between(1, 3))


def leaderboard_deltas(feedback: DataFrame) -> DataFrame:
    """+5 degree for a correct id, else -5 degree for an error id."""
    return feedback.withColumn("delta", F.when(F.col("kind") == "correct", 5.0).otherwise(-5.0) * F.col("degree"))


def basic_deltas(feedback: DataFrame, labels: DataFrame) -> DataFrame:
    """10 times the path score, minus if the question's label is wrong."""
    sign = F.when(F.col("label"), 1.0).otherwise(-1.0)
    signed = F.when(F.col("kind") == "correct", 1.0).otherwise(-1.0) * F.col("degree")
    return feedback.join(labels, feedback.q_ord == labels.q_id).withColumn("delta", 10.0 * signed * sign).drop("q_id", "label")


def contribution_deltas(chains: DataFrame) -> DataFrame:
    """Deltas of chains(q_ord, idx, contribution, numeric, verdict, n_facts): 5 times the contribution, for `contribution` to apply.

    verdict: 0 wrong, 1 partly, 2 correct. Ids outside the question's facts and contributions other than 1 to 3 don't count. A
    numeric answer counts contributions of 3 only; a wrong answer in words those of 2 and 3.
    """
    c, wrong = F.col("contribution"), F.col("verdict") == 0
    valid = c.between(1, 3) & (F.col("idx") >= 0) & (F.col("idx") < F.col("n_facts")) & F.col("verdict").between(0, 2)
    counts = F.when(F.col("numeric"), c == 3).otherwise(~wrong | (c >= 2))
    return chains.where(valid & counts).withColumn("delta", F.when(wrong, -5.0).otherwise(5.0) * c)


def rejecting(a: Column, d: Column) -> Column:
    """An update that would leave the bounds on its own side is not applied."""
    return F.when((d > 0) & (a + d > HIGH) | (d < 0) & (a + d < LOW), a).otherwise(a + d)


def contribution(a: Column, d: Column) -> Column:
    """+d only up to a score of 175, -d only from 20 on."""
    return F.when((d > 0) & (a <= 175) | (d < 0) & (a >= 20), a + d).otherwise(a)


def unbounded(scores: DataFrame, deltas: DataFrame) -> DataFrame:
    total = deltas.where(F.col("degree").between(1, 3)).groupBy(*KEY).agg(F.sum(F.col("delta").cast("double")).alias("change"))
    return scores.join(total, KEY).select(*KEY, (F.col("score") + F.col("change")).alias("score"))


def leave_one(matches: DataFrame) -> DataFrame:
    """Per triple, +1 for each question that it answers alone and -1 for each other."""
    return matches.groupBy(*KEY).agg(F.sum(F.when(F.col("match"), 1).otherwise(-1)).alias("votes"))


def path_gradient(paths: DataFrame, hops: DataFrame, weight: float, rate: float, scale: float = 0.4, by_length: bool = True) -> DataFrame:
    """Deltas of the path-probability gradient, one for each hop occurrence in a scored path.

    paths(q_id, path_id, p, len, utility or null if not scored); hops(q_id, path_id, hop_ord, head,
    rel, tail, pt) with pt the triple's probability. A question with expected utility 0 gives none.
    """
    w = Window.partitionBy("q_id")
    u = F.coalesce("utility", F.lit(0.0)) * scale
    scored = paths.withColumn("u", u).withColumn("eul", F.sum((F.col("u") + 1) / 2 * F.col("p")).over(w)).withColumn("mean", F.sum(F.col("u") * F.col("p")).over(w))
    value = F.col("p") * (F.col("u") - F.col("mean"))
    scored = scored.withColumn("v", value / F.col("len") if by_length else value)
    each = hops.join(scored.select("q_id", "path_id", *(c for c in ("idx",) if c in paths.columns), "p", "v", "eul", F.col("utility").isNotNull().alias("is_scored")).hint("merge"), ["q_id", "path_id"])
    share = each.groupBy("q_id", *KEY).agg(F.sum(F.col("p") * F.col("v")).alias("s"), F.first("eul").alias("eul"), F.first("pt").alias("pt"))
    grad = share.where(F.col("eul") != 0).select("q_id", *KEY, (-(F.lit(weight) / (2 * F.col("eul"))) * F.col("s") / F.col("pt")).alias("g"))
    order = [c for c in ("idx",) if c in paths.columns]
    return each.where("is_scored").select("q_id", "path_id", "hop_ord", *order, *KEY).join(grad.hint("merge"), ["q_id", *KEY]).withColumn("delta", -F.lit(rate) * F.col("g"))


def weight_step(steps: DataFrame, weight: float, rate: float, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """q_id, gradient, weight of steps(q_id, sim01, score01, g), a row for each scored occurrence: the mixing weight after its own gradient step."""
    gradient = F.sum((F.col("sim01") - F.col("score01")) * -F.col("g") / weight)
    moved = steps.groupBy("q_id").agg(gradient.alias("gradient"))
    return moved.withColumn("weight", clamp(F.lit(weight) - F.col("gradient") * rate * 1e-3, low, high))
