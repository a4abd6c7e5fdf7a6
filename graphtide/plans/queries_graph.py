"""Queries of the graph, source, feedback and evaluation operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphtide.catalog import register
from graphtide.functions.models import model_udf, shortcut_answers
from graphtide.operators import evaluate, feedback, graph, ranking, redundancy
from graphtide.operators.vectors import vector_index
from graphtide.plans import retrieve
from graphtide.plans.fixtures import LABELS, duck, labels
from graphtide.session import materialize, own_dir
from graphtide.sources import sinks
from graphtide.sources.vector_store import VectorStore

KEY = graph.KEY
T = "kg_triples"


@register("g_all_triples", duck(T, "SELECT DISTINCT head, rel, tail FROM kg_triples"))
def g_all_triples(x):
    return graph.all_triples(x.kg_triples)


@register("g_entities", duck("kg_entities", "SELECT name FROM kg_entities"))
def g_entities(x):
    return graph.entities(x.kg_triples)


@register("g_relations", duck(T, "SELECT DISTINCT rel FROM kg_triples"))
def g_relations(x):
    return graph.relations(x.kg_triples)


@register("g_count_edges", duck(T, "SELECT count(*) AS n_edges FROM kg_triples"))
def g_count_edges(x):
    return graph.count_edges(x.kg_triples)


@register("g_show_edges", duck(T, "SELECT head, rel, tail FROM kg_triples ORDER BY head, rel, tail LIMIT 25"))
def g_show_edges(x):
    return graph.show_edges(x.kg_triples, 25)


@register("g_nodes_by_property", "SELECT c_name AS name, 'customer' AS label, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY name LIMIT 10")
def g_nodes_by_property(x):
    nodes = x.customer.select(F.col("c_name").alias("name"), F.lit("customer").alias("label"), F.col("c_mktsegment").alias("segment"))
    return graph.nodes_by_property(nodes, "customer", 10, segment="BUILDING")


@register("g_neighbors_1hop", duck(T, "SELECT head || '-' || rel || '->' || tail AS edge FROM (SELECT DISTINCT head, rel, tail FROM kg_triples WHERE head IN (SELECT n_name FROM nation) OR tail IN (SELECT n_name FROM nation) ORDER BY head, rel, tail LIMIT 30) e"))
def g_neighbors_1hop(x):
    return graph.neighbours_1hop(x.kg_triples, x.nation.select(F.col("n_name").alias("name")))


@register("g_neighbors_2hop", duck(T, "SELECT DISTINCT a.head AS n, a.rel AS r1, a.tail AS o1, b.rel AS r2, b.tail AS o2 FROM kg_triples a JOIN kg_triples b ON a.tail = b.head WHERE a.head IN (SELECT s_name FROM supplier) OR b.tail IN (SELECT s_name FROM supplier) ORDER BY n, r1, o1, r2, o2 LIMIT 30"))
def g_neighbors_2hop(x):
    return graph.neighbours_2hop(x.kg_triples, x.supplier.select(F.col("s_name").alias("name")))


@register("g_expand_paths", duck("und", "SELECT a.src AS seed, a.src || s1 AS path FROM (SELECT *, CASE WHEN dir = '->' THEN ' - ' || rel || ' -> ' || dst ELSE ' <- ' || rel || ' - ' || dst END AS s1 FROM und) a WHERE a.src IN (SELECT r_name FROM region) UNION ALL SELECT a.src, a.src || a.s1 || b.s1 FROM (SELECT *, CASE WHEN dir = '->' THEN ' - ' || rel || ' -> ' || dst ELSE ' <- ' || rel || ' - ' || dst END AS s1 FROM und) a JOIN (SELECT *, CASE WHEN dir = '->' THEN ' - ' || rel || ' -> ' || dst ELSE ' <- ' || rel || ' - ' || dst END AS s1 FROM und) b ON b.src = a.dst WHERE a.src IN (SELECT r_name FROM region) AND NOT (a.rel = b.rel AND a.src = b.dst AND a.dir <> b.dir)"))
def g_expand_paths(x):
    return graph.expand_paths(x.kg_triples, x.region.select(F.col("r_name").alias("seed")), 2).select("seed", "path")


_NEW = "SELECT c_name AS head, 'in_segment' AS rel, c_mktsegment AS tail FROM customer UNION ALL SELECT n_name, 'part_of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


def _new(x):
    seg = x.customer.select(F.col("c_name").alias("head"), F.lit("in_segment").alias("rel"), F.col("c_mktsegment").alias("tail"))
    part = x.nation.join(x.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("head"), F.lit("part_of").alias("rel"), F.col("r_name").alias("tail"))
    return seg.union(part)


@register("g_store_upsert", duck(T, f"SELECT head, rel, tail FROM kg_triples UNION SELECT * FROM ({_NEW}) n"))
def g_store_upsert(x):
    return graph.upsert(x.kg_triples, _new(x))


@register("g_store_delete", duck(T, "SELECT * FROM kg_triples WHERE rel <> 'has_brand'"))
def g_store_delete(x):
    return graph.delete(x.kg_triples, x.kg_triples.where("rel = 'has_brand'"))


@register("g_delete_orphans", duck("kg_triples kg_entities", "SELECT name FROM kg_entities WHERE name NOT IN (SELECT tail FROM kg_triples WHERE rel = 'has_brand') OR name IN (SELECT head FROM kg_triples WHERE rel <> 'has_brand' UNION SELECT tail FROM kg_triples WHERE rel <> 'has_brand')"))
def g_delete_orphans(x):
    return graph.delete_with_orphans(x.kg_triples, x.kg_entities, x.kg_triples.where("rel = 'has_brand'"))[1]


@register("g_delete_nodes", "SELECT c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def g_delete_nodes(x):
    nodes = x.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return graph.delete_nodes(nodes, nodes.where("segment = 'BUILDING'").select("segment").distinct()).select("name", "segment")


@register("score_init", duck(T, "SELECT head, rel, tail, CAST(100 AS DOUBLE) AS score FROM kg_triples"))
def score_init(x):
    return graph.all_triples(x.kg_triples).withColumn("score", F.lit(100.0))


@register("flt_score_gt", duck("kg_scores", "SELECT * FROM kg_scores WHERE score > 100"))
def flt_score_gt(x):
    return x.kg_scores.where(F.col("score") > 100)


@register("flt_nonempty_triple", duck(T, "SELECT head, rel, tail FROM (SELECT CASE WHEN length(head) % 7 = 0 THEN '' ELSE head END AS head, rel, tail FROM kg_triples) t WHERE head <> '' AND rel <> '' AND tail <> ''"))
def flt_nonempty_triple(x):
    holes = x.kg_triples.withColumn("head", F.when(F.length("head") % 7 == 0, "").otherwise(F.col("head")))
    return holes.where((F.col("head") != "") & (F.col("rel") != "") & (F.col("tail") != ""))


@register("entity_refresh", duck("kg_scores", "SELECT head AS name FROM kg_scores WHERE score > 150 UNION SELECT tail FROM kg_scores WHERE score > 150"))
def entity_refresh(x):
    return graph.entities(x.kg_scores.where(F.col("score") > 150))


@register("sink_dictionary_encode", duck("kg_triples kg_entities", "SELECT h.id AS head_id, r.id AS rel_id, t.id AS tail_id FROM kg_triples JOIN (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM kg_entities) h ON h.name = head JOIN (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM kg_entities) t ON t.name = tail JOIN (SELECT rel, row_number() OVER (ORDER BY rel) - 1 AS id FROM (SELECT DISTINCT rel FROM kg_triples) z) r USING (rel)"))
def sink_dictionary_encode(x):
    return graph.dictionary_encode(x.kg_triples)


def _store(x, name: str) -> VectorStore:
    """An empty store in the shared folder whose encoder looks vectors up by the digest of the name."""
    path = f"{own_dir(x.spark)}/store-{name}-{uuid.uuid4().hex}"
    return VectorStore(x.spark, path, lambda names: vector_index(x.embeddings, names, "name"))


def _customers(x):
    return x.customer.select(F.col("c_name").alias("name"))


def _segments(x):
    return x.customer.select(F.col("c_mktsegment").alias("name"))


def _first(rows):
    return rows.select("name", F.col("vec")[0].alias("v1"), F.size("vec").alias("dims"))


_V = "name, vec[1] AS v1, len(vec) AS dims"
_MORE = "SELECT name, embedding AS vec FROM (SELECT DISTINCT c_mktsegment AS name FROM customer) CROSS JOIN vec_count JOIN embeddings ON vec_id = ('0x' || substr(md5(name), 1, 6))::INT % n"


@register("vec_store_build", duck("entity_vectors", f"SELECT {_V} FROM entity_vectors"))
def vec_store_build(x):
    return _first(_store(x, "build").build(x.kg_entities))


@register("vec_store_subset", duck("entity_vectors", f"SELECT {_V} FROM entity_vectors WHERE name IN (SELECT c_name FROM customer)"))
def vec_store_subset(x):
    store = _store(x, "subset")
    store.build(x.kg_entities)
    return _first(store.subset(_customers(x).union(x.region.select(F.lit("no such name").alias("name")))))


@register("vec_store_remove", duck("entity_vectors", f"SELECT {_V} FROM entity_vectors WHERE name NOT IN (SELECT c_name FROM customer)"))
def vec_store_remove(x):
    store = _store(x, "remove")
    store.build(x.kg_entities)
    store.remove(_customers(x))
    return _first(store.load())


@register("vec_store_add", duck("entity_vectors vec_count", f"SELECT {_V} FROM (SELECT * FROM entity_vectors UNION ALL {_MORE}) a"))
def vec_store_add(x):
    store = _store(x, "add")
    store.build(x.kg_entities)
    store.add(_segments(x))
    return _first(store.load())


@register("vec_store_incremental", duck("entity_vectors vec_count", f"SELECT {_V} FROM (SELECT * FROM entity_vectors WHERE name IN (SELECT c_name FROM customer) UNION ALL {_MORE}) a"))
def vec_store_incremental(x):
    """Only what the store lacks is encoded and appended."""
    store = _store(x, "incremental")
    names = materialize(x.kg_entities, "names")
    store.build(names.join(_customers(x).hint("merge"), "name", "left_anti"))
    return _first(store.add(names.union(_segments(x)).union(names)))


@register("vec_store_snapshot", duck("entity_vectors", f"SELECT {_V}, 3 AS iteration FROM entity_vectors"))
def vec_store_snapshot(x):
    store = _store(x, "snapshot")
    store.build(x.kg_entities)
    store.snapshot(2)
    now = store.snapshot(3)
    return now.select("name", F.col("vec")[0].alias("v1"), F.size("vec").alias("dims"), "iteration")


@register("sink_stage_rows", duck("q_eval", "SELECT q_id, question, p1 AS response, contains(lower(prediction), lower(w1)) AS label, it AS iteration FROM q_eval CROSS JOIN (SELECT 1 AS it UNION ALL SELECT 2) i"))
def sink_stage_rows(x):
    path = f"{own_dir(x.spark)}/stages-{uuid.uuid4().hex}"
    rows = x.q_eval.select("q_id", "question", F.col("p1").alias("response"), evaluate.any_match(F.col("prediction"), F.array("w1")).alias("label"))
    for iteration in (1, 2, 2):
        sinks.write_stage_rows(rows, path, iteration)
    return x.spark.read.parquet(path)


@register("sample_n", duck(T, "SELECT head, rel, tail FROM kg_triples ORDER BY md5(concat_ws(' ', head, rel, tail)), head, rel, tail LIMIT 1200"))
def sample_n(x):
    return graph.sample(x.kg_triples, 1200)


@register("verbalise_hop", duck("und", "SELECT src, dst, dir, concat_ws(' ', h, rel, t) AS key, concat_ws(' ', h, replace(rel, '_', ' '), t) AS sentence FROM (SELECT *, CASE WHEN dir = '->' THEN src ELSE dst END AS h, CASE WHEN dir = '->' THEN dst ELSE src END AS t FROM und) u"))
def verbalise_hop(x):
    hop = graph.undirected(x.kg_triples).withColumn("e", graph.hop_edge(F.struct("src", "rel", "dst", "dir")))
    return hop.select("src", "dst", "dir", graph.triple_key("e.head", "e.rel", "e.tail").alias("key"), graph.sentence("e.head", "e.rel", "e.tail").alias("sentence"))


@register(
    "three_hop_shortcut",
    duck(
        T,
        """SELECT a AS head, r0 || '_' || r2 AS rel, d AS tail, min(via) AS via, count(*) AS n_chains, 1 AS iteration FROM chains WHERE substr(md5(via), 1, 1) = '0' AND (a, r0 || '_' || r2, d) NOT IN (SELECT (head, rel, tail) FROM kg_triples) GROUP BY a, r0 || '_' || r2, d""",
        chains="""SELECT *, a || ' -' || r0 || '-> ' || b || ' -' || r1 || '-> ' || c || ' -' || r2 || '-> ' || d AS via FROM (
 SELECT a.head AS a, a.rel AS r0, a.tail AS b, b.rel AS r1, b.tail AS c, c.rel AS r2, c.tail AS d FROM kg_triples a JOIN kg_triples b ON a.tail = b.head JOIN kg_triples c ON b.tail = c.head
 WHERE a.head <> b.tail AND a.head <> c.tail AND a.tail <> c.tail AND a.head <> a.tail AND b.head <> b.tail AND c.head <> c.tail) x""",
    ),
)
def three_hop_shortcut(x):
    """Chains of any relations, put to the model; accepted edges with where they come from."""
    chains = graph.three_hop_candidates(x.kg_triples).select(graph.chain_text().alias("via"))
    replies = chains.withColumn("raw", model_udf(shortcut_answers, "string")(F.col("via")))
    return graph.shortcuts(x.kg_triples, replies, 1)


_MAP = "SELECT name AS dup, first_name AS canonical FROM (SELECT c_name AS name, first_value(c_name) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_name) AS first_name, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_name) AS rn FROM customer) c WHERE rn > 1"


def _dup_groups(x):
    members = F.array_sort(F.collect_list("c_name"))
    return x.customer.groupBy("c_nationkey", "c_mktsegment").agg(members.alias("members")).select(F.struct("c_nationkey", "c_mktsegment").alias("group_ord"), "members")


def _mapping(x):
    return redundancy.replacement_map(_dup_groups(x))


@register("rd_replacement_map", _MAP)
def rd_replacement_map(x):
    return _mapping(x)


_RENAMED = "SELECT coalesce(h.canonical, head) AS head, rel, coalesce(t.canonical, tail) AS tail, score FROM kg_scores LEFT JOIN m h ON h.dup = head LEFT JOIN m t ON t.dup = tail"


@register("j_entity_rename", duck("kg_scores", _RENAMED, m=_MAP))
def j_entity_rename(x):
    return graph.rename(x.kg_scores, _mapping(x)).select(*KEY, "score")


@register("rd_rename_scores", duck("kg_scores", f"SELECT head, rel, tail, max(score) AS score FROM ({_RENAMED}) r GROUP BY ALL", m=_MAP))
def rd_rename_scores(x):
    return redundancy.rename_scores(x.kg_scores, _mapping(x))


@register("rd_merge_rewire", duck(T, "SELECT 'delete' AS action, head, rel, tail FROM touched UNION ALL SELECT 'insert', * FROM (SELECT DISTINCT coalesce(h.canonical, head), rel, coalesce(t.canonical, tail) FROM touched LEFT JOIN m h ON h.dup = head LEFT JOIN m t ON t.dup = tail EXCEPT SELECT head, rel, tail FROM kg_triples) n", m=_MAP, touched="SELECT head, rel, tail FROM kg_triples WHERE head IN (SELECT dup FROM m) OR tail IN (SELECT dup FROM m)"))
def rd_merge_rewire(x):
    return redundancy.merge_rewire(x.kg_triples, _mapping(x))


_MULTI = "SELECT l_suppkey AS q_id, s_name AS head, CASE WHEN l_linenumber % 2 = 0 THEN 'supplies' ELSE 'sources' END AS rel, concat('Part ', CAST(l_partkey AS STRING)) AS tail FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"


def _multi(x):
    rel = F.when(F.col("l_linenumber") % 2 == 0, "supplies").otherwise("sources")
    rows = x.lineitem.join(x.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("l_suppkey").cast("long").alias("q_id"), F.col("s_name").alias("head"), rel.alias("rel"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("tail")).distinct()


@register("rd_pair_groups", duck("", "SELECT q_id, a, b, string_agg(f, '|' ORDER BY f) AS facts FROM (SELECT q_id, least(head, tail) AS a, greatest(head, tail) AS b, concat_ws(' ', head, rel, tail) AS f FROM m) x GROUP BY q_id, a, b HAVING count(*) > 1", m=_MULTI.replace("SELECT", "SELECT DISTINCT", 1)))
def rd_pair_groups(x):
    return redundancy.pair_groups(_multi(x)).withColumn("facts", F.array_join("facts", "|"))


@register("rd_directed_groups", duck("", "SELECT q_id, head, tail, string_agg(rel, '|' ORDER BY rel) AS rels FROM m GROUP BY q_id, head, tail HAVING count(*) > 1", m=_MULTI.replace("SELECT", "SELECT DISTINCT", 1)))
def rd_directed_groups(x):
    return redundancy.directed_groups(_multi(x)).withColumn("rels", F.array_join("rels", "|"))


def _decisions(x):
    groups = redundancy.pair_groups(_multi(x)).withColumn("group_ord", F.row_number().over(Window.partitionBy("q_id").orderBy("a", "b")))
    keep = groups.where("group_ord % 3 <> 0").select("q_id", ((F.col("group_ord") - 1) * 2).alias("id"))
    return redundancy.keep_delete(groups.select("q_id", "group_ord", "facts"), keep)


_DECIDED = dict(
    m=_MULTI.replace("SELECT", "SELECT DISTINCT", 1),
    g="SELECT q_id, a, b, row_number() OVER (PARTITION BY q_id ORDER BY a, b) AS group_ord FROM (SELECT q_id, least(head, tail) AS a, greatest(head, tail) AS b FROM m) x GROUP BY q_id, a, b HAVING count(*) > 1",
    f="SELECT m.q_id, group_ord, concat_ws(' ', head, rel, tail) AS fact, row_number() OVER (PARTITION BY m.q_id, group_ord ORDER BY concat_ws(' ', head, rel, tail)) AS i FROM m JOIN g ON g.q_id = m.q_id AND g.a = least(head, tail) AND g.b = greatest(head, tail)",
    d="SELECT q_id, fact, CASE WHEN group_ord % 3 = 0 THEN 'undecided' WHEN i = 1 THEN 'keep' ELSE 'delete' END AS decision FROM f",
)


@register("rd_keep_delete", duck("", "SELECT * FROM d", **_DECIDED))
def rd_keep_delete(x):
    return _decisions(x)


@register("rd_rate", duck("", "SELECT q_id, round(count(*) FILTER (WHERE decision = 'delete') / count(*), 6) AS rate FROM d GROUP BY q_id", **_DECIDED))
def rd_rate(x):
    return redundancy.redundancy_rate(_decisions(x))


@register("rd_rate_mean", duck("", "SELECT round(avg(rate), 6) AS mean_rate FROM (SELECT q_id, count(*) FILTER (WHERE decision = 'delete') / count(*) AS rate FROM d GROUP BY q_id) r", **_DECIDED))
def rd_rate_mean(x):
    return redundancy.redundancy_rate(_decisions(x)).agg(F.round(F.avg("rate"), 6).alias("mean_rate"))


@register("rd_missing_deletes", duck("facts", "SELECT DISTINCT head, rel, tail || CASE WHEN pos % 3 = 0 THEN ' gone' ELSE '' END AS tail FROM facts WHERE pos % 3 = 0"))
def rd_missing_deletes(x):
    """Deletes that name no stored triple."""
    wanted = x.facts.select("head", "rel", F.concat("tail", F.when(F.col("pos") % 3 == 0, " gone").otherwise("")).alias("tail"))
    return redundancy.missing_deletes(x.kg_scores, wanted)


@register("rd_apply_deletes", duck("kg_scores", "SELECT head, rel, tail, score FROM kg_scores WHERE NOT (rel = 'contains' AND score < 60)"))
def rd_apply_deletes(x):
    return redundancy.apply_deletes(x.kg_scores, x.kg_scores.where("rel = 'contains' AND score < 60"))


def _fact_items(x):
    """Facts of each question by sentence, with the vector of the sentence."""
    return vector_index(x.embeddings, x.facts.select(F.col("q_ord").cast("long").alias("q_id"), *KEY, graph.sentence().alias("name")), "name")


@register("rd_cluster_triples")
def rd_cluster_triples(x):
    return redundancy.large_clusters(redundancy.cluster(_fact_items(x).select("q_id", "name", "vec"), 0.15, alone=False))


@register("rd_cluster_triples_average")
def rd_cluster_triples_average(x):
    """The form that takes the mean of head and tail vectors."""
    facts = _fact_items(x).select("q_id", "name", *KEY)
    ends = vector_index(x.embeddings, graph.entities(facts), "name")
    head, tail = (ends.select(F.col("name").alias(c), F.col("vec").alias(v)).hint("merge") for c, v in (("head", "hv"), ("tail", "tv")))
    both = facts.hint("merge").join(head, "head").hint("merge").join(tail, "tail")
    items = both.select("q_id", "name", F.zip_with("hv", "tv", lambda a, b: (a.cast("double") + b.cast("double")) / 2).alias("vec"))
    return redundancy.large_clusters(redundancy.cluster(items, 0.25, alone=False))


@register("rd_cluster_adaptive")
def rd_cluster_adaptive(x):
    renamed = graph.rename(x.facts, _mapping(x)).select(F.col("q_ord").cast("long").alias("q_id"), graph.sentence().alias("name")).distinct()
    items = redundancy.adaptive_threshold(vector_index(x.embeddings, renamed, "name"))
    return redundancy.large_clusters(redundancy.cluster(items.select("q_id", "name", "vec", "threshold"), "threshold", alone=False))


_DBSCAN = """WITH RECURSIVE __VIEWS__,
item AS MATERIALIZED (SELECT q_ord AS q_id, concat_ws(' ', head, replace(rel, '_', ' '), tail) AS name, embedding AS vec FROM facts CROSS JOIN vec_count JOIN embeddings ON vec_id = ('0x' || substr(md5(concat_ws(' ', head, replace(rel, '_', ' '), tail)), 1, 6))::INT % n),
near AS MATERIALIZED (SELECT a.q_id, a.name AS a, b.name AS b FROM item a JOIN item b ON a.q_id = b.q_id AND a.name <> b.name WHERE 1 - __COS__ < 0.05),
reach AS (SELECT q_id, a, b FROM near UNION SELECT r.q_id, r.a, n.b FROM reach r JOIN near n ON n.q_id = r.q_id AND n.a = r.b)
SELECT i.q_id, i.name, least(i.name, coalesce(min(r.b), i.name)) AS cluster FROM item i LEFT JOIN reach r ON r.q_id = i.q_id AND r.a = i.name GROUP BY i.q_id, i.name"""


@register("rd_cluster_dbscan", _DBSCAN.replace("__VIEWS__", duck("facts vec_count", "").removeprefix("WITH ").rstrip()).replace("__COS__", retrieve.COS.format("a.vec", "b.vec")))
def rd_cluster_dbscan(x):
    return redundancy.dbscan(_fact_items(x).select("q_id", "name", "vec"))


@register("rd_cluster_entities")
def rd_cluster_entities(x):
    """The entities of each question's facts."""
    facts = x.facts.select(F.col("q_ord").cast("long").alias("q_id"), F.explode(F.array("head", "tail")).alias("name")).distinct()
    return redundancy.large_clusters(redundancy.cluster(vector_index(x.embeddings, facts, "name").select("q_id", "name", "vec"), 0.25, alone=False))


_FT = "fb_triples"


def _folded(x, deltas, step=None):
    return feedback.fold(x.kg_scores, deltas, ["q_ord", "idx", "event_id"], step)


def _duck_fold(delta: str, step: str = "greatest(20.0, least(200.0, a + d))") -> str:
    return f"SELECT head, rel, tail, list_reduce(list_prepend(first(score), list({delta} ORDER BY q_ord, idx, event_id)), lambda a, d: {step}) AS score FROM fb_triples GROUP BY head, rel, tail"


_BOARD = "CAST(CASE WHEN kind = 'correct' THEN 5.0 ELSE -5.0 END * degree AS DOUBLE)"


def _folded_from(cte: str, delta: str = _BOARD, step: str = "greatest(20.0, least(200.0, a + d))") -> str:
    return _duck_fold(delta, step).replace("FROM fb_triples", f"FROM {cte}")


@register(
    "fb_leaderboard",
    duck("fb_marks fb_flags", _folded_from("kept"), kept="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_ord, idx ORDER BY kind) AS n FROM fb_marks JOIN fb_flags USING (q_ord) WHERE NOT insufficient AND NOT no_feedback) k WHERE n = 1"),
)
def fb_leaderboard(x):
    said = feedback.usable(x.fb_marks, x.fb_flags, ["insufficient", "no_feedback"])
    return _folded(x, feedback.leaderboard_deltas(feedback.correct_first(said)))


@register("fb_fold", duck(_FT, _duck_fold(f"{_BOARD} * 7")))
def fb_fold(x):
    return _folded(x, feedback.leaderboard_deltas(x.fb_triples).withColumn("delta", F.col("delta") * 7))


@register("fb_triplet_reject", duck(_FT, _folded_from("kept", step="CASE WHEN (d > 0 AND a + d > 200) OR (d < 0 AND a + d < 20) THEN a ELSE a + d END"), kept="SELECT * FROM (SELECT * REPLACE (event_id % 6 AS degree) FROM fb_triples) f WHERE degree BETWEEN 1 AND 3"))
def fb_triplet_reject(x):
    said = feedback.in_degree(x.fb_triples.withColumn("degree", F.col("event_id") % 6))
    return _folded(x, feedback.leaderboard_deltas(said), feedback.rejecting)


@register(
    "fb_contribution",
    duck(
        _FT,
        _folded_from("kept", "CAST(CASE WHEN verdict = 0 THEN -5.0 ELSE 5.0 END * contribution AS DOUBLE)", "CASE WHEN (d > 0 AND a <= 175) OR (d < 0 AND a >= 20) THEN a + d ELSE a END"),
        kept="""SELECT * FROM (SELECT *, event_id % 5 AS contribution, q_ord % 4 = 0 AS is_number, q_ord % 3 AS verdict, 5 + q_ord % 6 AS n_facts FROM fb_triples) f
 WHERE contribution BETWEEN 1 AND 3 AND idx < n_facts AND CASE WHEN is_number THEN contribution = 3 ELSE verdict > 0 OR contribution >= 2 END""",
    ),
)
def fb_contribution(x):
    chains = x.fb_triples.withColumns({"contribution": F.col("event_id") % 5, "numeric": F.col("q_ord") % 4 == 0, "verdict": F.col("q_ord") % 3, "n_facts": 5 + F.col("q_ord") % 6})
    return _folded(x, feedback.contribution_deltas(chains), feedback.contribution)


@register("fb_triplet_unbounded", duck(_FT, f"SELECT head, rel, tail, first(score) + sum({_BOARD}) AS score FROM fb_triples GROUP BY head, rel, tail"))
def fb_triplet_unbounded(x):
    return feedback.unbounded(x.kg_scores, feedback.leaderboard_deltas(x.fb_triples))


@register("fb_label_flip", duck("q_eval", f"SELECT q_id, label <> (q_id % 5 = 0) AS label FROM ({LABELS}) l"))
def fb_label_flip(x):
    return feedback.flip_labels(labels(x), x.q.where("q_id % 5 = 0").select("q_id"))


@register("fb_triplet_basic", duck("fb_triples q_eval", _duck_fold("10.0 * CASE WHEN kind = 'correct' THEN degree ELSE -degree END * CASE WHEN label THEN 1 ELSE -1 END").replace("FROM fb_triples", f"FROM (SELECT f.*, label FROM fb_triples f JOIN ({LABELS}) l ON l.q_id = q_ord WHERE q_ord % 11 <> 0) z")))
def fb_triplet_basic(x):
    return _folded(x, feedback.basic_deltas(feedback.usable(x.fb_triples, x.fb_flags, ["insufficient"]), labels(x)))


@register("fb_trace", duck(_FT, f"SELECT q_ord, idx, head, rel, tail, {_BOARD} AS delta FROM fb_triples"))
def fb_trace(x):
    return feedback.leaderboard_deltas(x.fb_triples).select("q_ord", "idx", *KEY, "delta")


@register("fb_next_iteration", duck("fb_triples kg_scores", "SELECT s.head, s.rel, s.tail, coalesce(f.score, s.score) AS score, 1 AS iteration FROM kg_scores s LEFT JOIN folded f ON s.head = f.head AND s.rel = f.rel AND s.tail = f.tail", folded=_duck_fold(_BOARD)))
def fb_next_iteration(x):
    return feedback.next_iteration(x.kg_scores, _folded(x, feedback.leaderboard_deltas(x.fb_triples)), 1)


@register("fb_noise_select", duck("q q_count", "SELECT q_id FROM (SELECT q_id, row_number() OVER (ORDER BY md5('noise' || CAST(q_id AS VARCHAR)), q_id) AS rn FROM q WHERE q_id % 10 <> 3) r CROSS JOIN q_count WHERE rn <= greatest(1, round_even(nq * 0.1, 0))"))
def fb_noise_select(x):
    return feedback.choose_noise(x.q.select("q_id"), x.q.where("q_id % 10 = 3").select("q_id"), 0.1)


@register("fb_leave_one", duck("fb_triples q_eval", f"SELECT head, rel, tail, CAST(sum(CASE WHEN label THEN 1 ELSE -1 END) AS BIGINT) AS votes FROM fb_triples JOIN ({LABELS}) l ON l.q_id = q_ord GROUP BY head, rel, tail"))
def fb_leave_one(x):
    return feedback.leave_one(x.fb_triples.join(labels(x), F.col("q_ord") == F.col("q_id")).withColumn("match", F.col("label")))


def _qa(x):
    return x.q_eval.select("q_id", "prediction", F.array(F.array("w1", "p1"), F.array("w2")).alias("answer"), F.array("w1", "p1", "w2").alias("aliases"))


_L1 = "(contains(lower(prediction), lower(w1)) OR contains(lower(prediction), lower(p1)))"
_L2 = "contains(lower(prediction), lower(w2))"


@register("ev_all_groups", duck("q_eval", f"SELECT q_id, [{_L1}::INT, {_L2}::INT] AS labels, {_L1} AND {_L2} AS label FROM q_eval"))
def ev_all_groups(x):
    return evaluate.all_groups(_qa(x))


@register("ev_partial", duck("q_eval", f"SELECT count(*) AS n_partial FROM q_eval WHERE {_L1} <> {_L2}"))
def ev_partial(x):
    return evaluate.partial(_qa(x))


@register("ev_any_match", duck("q_eval", f"SELECT q_id, {_L1} OR {_L2} AS label FROM q_eval"))
def ev_any_match(x):
    return _qa(x).select("q_id", evaluate.any_match(F.col("prediction"), F.col("aliases")).alias("label"))


@register("ev_any_match_refusal", duck("q_eval", f"SELECT q_id, CASE WHEN q_id % 4 = 0 THEN 2 ELSE ({_L1} OR {_L2})::INT END AS label FROM q_eval"))
def ev_any_match_refusal(x):
    said = F.when(F.col("q_id") % 4 == 0, "The context do not contain answer").otherwise(F.col("prediction"))
    return _qa(x).select("q_id", evaluate.any_match_refusal(said, F.col("aliases")).alias("label"))


@register("ev_accuracy", duck("q_eval", f"SELECT round(avg(label::INT), 6) AS accuracy FROM ({LABELS}) l"))
def ev_accuracy(x):
    return evaluate.accuracy(labels(x))


@register("ev_wrong_index", duck("q_eval", f"SELECT q_id FROM ({LABELS}) l WHERE NOT label"))
def ev_wrong_index(x):
    return labels(x).where(~F.col("label")).select("q_id")


@register("answer_combinations", duck("q_eval", "SELECT q_id, [w1 || ', ' || w2, p1 || ', ' || w2] AS combos FROM q_eval WHERE w1 <> '' AND p1 <> ''"))
def answer_combinations(x):
    return _qa(x).where("aliases[0] <> '' AND aliases[1] <> ''").select("q_id", evaluate.answer_combinations(F.col("answer")).alias("combos"))


_ROUGE = """SELECT q_id, p, r, CASE WHEN n = 0 THEN 0.0 ELSE round(2 * (n / np) * (n / ng) / (n / np + n / ng), 6) END AS f FROM (
 SELECT q_id, n, np, ng, CASE WHEN n = 0 THEN 0.0 ELSE round(n / np, 6) END AS p, CASE WHEN n = 0 THEN 0.0 ELSE round(n / ng, 6) END AS r FROM (
  SELECT q_id, len(a) AS np, len(b) AS ng, coalesce(list_max(list_reduce(list_prepend(list_transform(b, lambda y: 0), list_transform(a, lambda t: list_transform(b, lambda y: (y = t)::INT))),
    lambda row, m: list_transform(m, lambda u, j: list_max(list_transform(m[1:j], lambda v, i: CASE WHEN v = 1 THEN coalesce(row[i - 1], 0) + 1 ELSE row[i] END))))), 0) AS n FROM (
   SELECT q_id, list_filter(string_split_regex(prediction, '\\s+'), lambda w: w <> '') AS a, list_filter(string_split_regex(question, '\\s+'), lambda w: w <> '') AS b FROM q) s) l) z"""


@register("ev_rouge_l", duck("q", _ROUGE))
def ev_rouge_l(x):
    return evaluate.rouge_l(x.q.select("q_id", "prediction", F.array("question").alias("references")))


@register("ev_rouge_mean", duck("q", f"SELECT round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(f), 6) AS f FROM ({_ROUGE}) m"))
def ev_rouge_mean(x):
    return ev_rouge_l(x).agg(*(F.round(F.avg(c), 6).alias(c) for c in "prf"))


@register("ev_score_stats", duck("kg_scores", "SELECT iteration, round(avg(least(score, 200)), 6) AS mean_score FROM (SELECT score, 0 AS iteration FROM kg_scores UNION ALL SELECT score * 1.5, 1 FROM kg_scores) s WHERE score > 0 GROUP BY iteration"))
def ev_score_stats(x):
    s = x.kg_scores.select("score", F.lit(0).alias("iteration"))
    return evaluate.score_stats(s.union(s.select(F.col("score") * 1.5, F.lit(1))))


_FACTS = "SELECT q_ord AS q_id, concat_ws(' ', head, rel, tail) AS fact, score, pos FROM facts"


def _facts(x):
    return x.facts.select(F.col("q_ord").alias("q_id"), graph.triple_key().alias("fact"), "score", "pos")


@register("ev_iteration_diff", duck("facts", f"SELECT q_id, count(*) AS n_last, count(*) FILTER (WHERE score <= 60) AS n_gone, round(count(*) FILTER (WHERE score <= 60) / count(*), 6) AS rate FROM ({_FACTS}) f GROUP BY q_id"))
def ev_iteration_diff(x):
    return evaluate.iteration_diff(_facts(x), _facts(x).where("score > 60"))


@register("ev_iteration_diff_means", duck("facts", f"SELECT round(avg(n_last), 6) AS mean_last, round(avg(n_gone), 6) AS mean_gone, round(avg(round(n_gone / n_last, 6)), 6) AS mean_rate, round(sum(n_gone) / sum(n_last), 6) AS ratio FROM (SELECT count(*) AS n_last, count(*) FILTER (WHERE score <= 60) AS n_gone FROM ({_FACTS}) f GROUP BY q_id) d"))
def ev_iteration_diff_means(x):
    return evaluate.iteration_means(evaluate.iteration_diff(_facts(x), _facts(x).where("score > 60")))


@register("j_iteration_diff", duck("facts", f"SELECT q_id, fact FROM ({_FACTS}) f WHERE score <= 60"))
def j_iteration_diff(x):
    return _facts(x).select("q_id", "fact").join(_facts(x).where("score > 60").select("q_id", "fact"), ["q_id", "fact"], "left_anti")


@register("j_exclude_deleted", duck("facts", f"SELECT q_id, fact FROM ({_FACTS}) f WHERE fact NOT IN (SELECT fact FROM ({_FACTS}) g WHERE pos = 0)"))
def j_exclude_deleted(x):
    return _facts(x).select("q_id", "fact").join(_facts(x).where("pos = 0").select("fact").distinct(), "fact", "left_anti").select("q_id", "fact")


@register("j_error_redundant", duck("facts", f"SELECT fact, fact IN (SELECT fact FROM ({_FACTS}) g WHERE pos % 2 = 1) AS redundant FROM (SELECT DISTINCT fact FROM ({_FACTS}) f WHERE score < 80) e"))
def j_error_redundant(x):
    wrong, red = _facts(x).where("score < 80").select("fact").distinct(), _facts(x).where("pos % 2 = 1").select("fact").distinct()
    return wrong.join(red, "fact", "left_semi").withColumn("redundant", F.lit(True)).union(wrong.join(red, "fact", "left_anti").withColumn("redundant", F.lit(False)))


@register("j_error_redundant_rate", duck("facts", f"SELECT round(avg((fact IN (SELECT fact FROM ({_FACTS}) g WHERE pos % 2 = 1))::INT), 6) AS redundant_rate, count(*) AS n_wrong FROM (SELECT DISTINCT fact FROM ({_FACTS}) f WHERE score < 80) e"))
def j_error_redundant_rate(x):
    return j_error_redundant(x).agg(F.round(F.avg(F.col("redundant").cast("int")), 6).alias("redundant_rate"), F.count("*").alias("n_wrong"))


@register("ev_error_batches", duck("facts", f"SELECT q_id, fact, pos // 30 AS chunk, (pos // 30) * 30 + pos % 30 AS global_id FROM ({_FACTS}) f"))
def ev_error_batches(x):
    chunk = F.floor(F.col("pos") / 30)
    return _facts(x).select("q_id", "fact", chunk.alias("chunk"), (chunk * 30 + F.col("pos") % 30).alias("global_id"))


@register("sort_by_entity", duck("facts", "SELECT q_ord AS q_id, head, rel, tail, row_number() OVER (PARTITION BY q_ord ORDER BY head, pos) AS n FROM facts"))
def sort_by_entity(x):
    return x.facts.select(F.col("q_ord").alias("q_id"), *KEY, F.row_number().over(Window.partitionBy("q_ord").orderBy("head", "pos")).alias("n"))


@register("maximal_paths", duck("seed_paths", "SELECT DISTINCT seed, path FROM (SELECT seed, path, lead(path) OVER (PARTITION BY seed ORDER BY path) AS nxt FROM (SELECT DISTINCT seed, path FROM seed_paths) d) e WHERE nxt IS NULL OR NOT starts_with(nxt, path)"))
def maximal_paths(x):
    return ranking.maximal_paths(retrieve.plain_paths(x, retrieve.links(x)))
