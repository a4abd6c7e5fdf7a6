"""Queries of the streaming operators: the feedback of the event table, replayed as files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphtide.catalog import register
from graphtide.functions.models import encoded_texts, hash_encoder
from graphtide.operators import feedback
from graphtide.plans import retrieve
from graphtide.plans.fixtures import duck
from graphtide.plans.queries_graph import _BOARD, _duck_fold
from graphtide.session import materialize, own_dir
from graphtide.streaming import feedback_loop, retrieval_loop

KEY = feedback_loop.KEY


def _deltas(x, parts=4):
    """Delta files in feedback order: the files' order is that of q_ord."""
    path = f"{own_dir(x.spark)}/stream-{uuid.uuid4().hex}"
    rows = feedback.leaderboard_deltas(x.fb_triples).select(*KEY, *(F.col(c).cast("long").alias(c) for c in feedback_loop.ORDER), F.col("delta").cast("double").alias("delta"), F.col("score").alias("base"))
    rows = materialize(rows, "deltas")
    bounds = [r[0] for r in rows.agg(F.percentile_approx("q_ord", [i / parts for i in range(1, parts)])).collect()][0] or []
    part = sum([(F.col("q_ord") > b).cast("int") for b in bounds], F.lit(0))
    for i in range(parts):
        rows.where(part == i).repartition(4, *KEY).write.mode("append").parquet(path)  # a triple's deltas of a part in one file
    return path


@register("st_microbatch_loop", duck("fb_triples kg_scores", "SELECT s.head, s.rel, s.tail, coalesce(f.score, s.score) AS score FROM kg_scores s LEFT JOIN folded f ON s.head = f.head AND s.rel = f.rel AND s.tail = f.tail", folded=_duck_fold(_BOARD)))
def st_microbatch_loop(x):
    base = f"{own_dir(x.spark)}/loop-{uuid.uuid4().hex}"
    return feedback_loop.run_microbatches(x.spark, x.kg_scores, _deltas(x), f"{base}/snapshots", f"{base}/checkpoint").select(*KEY, "score")


@register("st_score_state", duck("fb_triples", _duck_fold(_BOARD)))
def st_score_state(x):
    base = f"{own_dir(x.spark)}/state-{uuid.uuid4().hex}"
    return feedback_loop.run_score_state(x.spark, _deltas(x), f"{base}/scores", f"{base}/checkpoint")


@register("embed_batch", duck("kg_entities", "SELECT name, sha256(name) AS key, 64 AS dims, true AS is_unit FROM kg_entities"))
def embed_batch(x):
    names = materialize(x.kg_entities, "names")
    made = encoded_texts(names.unionAll(names), "name", hash_encoder)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return made.select("name", F.sha2(F.col("name").cast("binary"), 256).alias("key"), F.size("vec").alias("dims"), (F.abs(norm - 1) < 1e-5).alias("is_unit"))


def _loop_sql(batch: int, scores: str, asked: str) -> dict[str, str]:
    """One batch of the loop as common table expressions: kept, ranked, facts, folded and the scores after it."""
    b = f"b{batch}"
    return {
        f"{b}_kept": f"SELECT h.*, score FROM seed_hops h JOIN {scores} s ON h.head = s.head AND h.rel = s.rel AND h.tail = s.tail WHERE score >= 61",
        f"{b}_ranked": f"""SELECT q_id, seed, seed_ord, path_ord, rank FROM (
 SELECT p.q_id, l.seed, p.seed_ord, p.path_ord, row_number() OVER (PARTITION BY p.q_id, p.seed_ord ORDER BY round((sim + 1) * 50 + prod / pow(100.0, n_kept - 1), 6) DESC, p.path_ord) AS rank
 FROM path_sims p JOIN links l ON l.q_id = p.q_id AND l.seed_ord = p.seed_ord JOIN (SELECT seed, path_ord, product(score) AS prod, count(*) AS n_kept FROM {b}_kept GROUP BY ALL) k ON k.seed = l.seed AND k.path_ord = p.path_ord
 CROSS JOIN q_count WHERE sim > 0 AND {asked}) r WHERE rank <= 5""",
        f"{b}_facts": f"""SELECT q_id, f.head AS head, f.rel AS rel, f.tail AS tail, row_number() OVER (PARTITION BY q_id ORDER BY f.head, f.tail, f.seed_ord, f.rank, f.hop_ord) - 1 AS pos FROM (
 SELECT q_id, min({{'seed_ord': seed_ord, 'rank': rank, 'hop_ord': hop_ord, 'head': head, 'rel': rel, 'tail': tail}}) AS f FROM {b}_ranked r JOIN {b}_kept k USING (seed, path_ord)
 GROUP BY q_id, concat_ws(' ', head, replace(rel, '_', ' '), tail)) g""",
        f"{b}_said": f"SELECT q_ord, idx, event_id, kind, degree, f.head, f.rel, f.tail, score FROM {b}_facts f JOIN fb_rows ON q_ord = q_id AND idx = pos JOIN {scores} s ON f.head = s.head AND f.rel = s.rel AND f.tail = s.tail",
        f"{b}_folded": _duck_fold(_BOARD).replace("FROM fb_triples", f"FROM {b}_said"),
        f"{b}_scores": f"SELECT s.head, s.rel, s.tail, coalesce(f.score, s.score) AS score FROM {scores} s LEFT JOIN {b}_folded f ON s.head = f.head AND s.rel = f.rel AND s.tail = f.tail",
    }


@register(
    "st_retrieval_loop",
    duck(
        "seed_hops kg_scores path_sims links q_count fb_rows",
        "SELECT s.head, s.rel, s.tail, s.score FROM b1_scores s JOIN (SELECT head, rel, tail FROM b0_folded UNION SELECT head, rel, tail FROM b1_folded) c ON s.head = c.head AND s.rel = c.rel AND s.tail = c.tail",
        **_loop_sql(0, "kg_scores", "p.q_id < (nq + 1) // 2"),
        **_loop_sql(1, "b0_scores", "p.q_id >= (nq + 1) // 2"),
    ),
)
def st_retrieval_loop(x):
    """Two batches, each half of the questions: the scores of all triples that feedback reached."""
    base = f"{own_dir(x.spark)}/retrieval-{uuid.uuid4().hex}"
    linked, paths = retrieve.candidates(x, columns=("hops",))
    said = x.fb_rows.select("q_ord", "idx", "kind", "degree", "event_id")
    loop = retrieval_loop.Loop(x.spark, f"{base}/loop", lambda facts: said, lambda pairs: retrieve.similarities(x, pairs))
    loop.prepare(paths)
    half = x.q_count.select(F.expr("(nq + 1) div 2").alias("half"))
    loop.run(linked.crossJoin(F.broadcast(half)).select((F.col("q_id") >= F.col("half")).cast("long").alias("batch"), "q_id", "seed", "seed_ord"), f"{base}/checkpoint")
    return loop.changed()
