"""Knowledge-graph inputs derived from the driver's tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtide.operators import evaluate
from graphtide.operators.graph import numbered
from graphtide.session import materialize

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _slotted(rows: str, md5long) -> str:
    return f"""SELECT q_ord, idx, kind, degree, event_id, head, rel, tail, score FROM (
 SELECT head, rel, tail, score, slot, row_number() OVER (PARTITION BY slot ORDER BY head, rel, tail) AS n FROM (
  SELECT head, rel, tail, score, {md5long("concat_ws(' ', head, rel, tail)")} % (3 * nq) AS slot FROM kg_scores CROSS JOIN q_count) h) s
 JOIN (SELECT q_ord, idx, kind, degree, event_id, (q_ord * 7 + idx) % (3 * nq) AS want FROM {rows} CROSS JOIN q_count) f ON slot = want WHERE n = 1"""


def _views(md5int, md5long) -> dict[str, tuple[list[str], str]]:
    """name -> (views it needs, SQL)."""
    return {
        "kg_triples": (
            [],
            """SELECT DISTINCT head, rel, tail FROM (
 SELECT c_name AS head, 'located_in' AS rel, n_name AS tail FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT s_name, 'located_in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT n_name, 'part_of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT concat('Order ', CAST(o_orderkey AS STRING)), 'placed_by', c_name FROM orders JOIN customer ON o_custkey = c_custkey
 UNION ALL SELECT concat('Part ', CAST(p_partkey AS STRING)), 'has_brand', p_brand FROM part
 UNION ALL SELECT concat('Order ', CAST(l_orderkey AS STRING)), 'contains', concat('Part ', CAST(l_partkey AS STRING)) FROM lineitem
 UNION ALL SELECT concat('Part ', CAST(l_partkey AS STRING)), 'supplied_by', s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) u""",
        ),
        "kg_scores": (["kg_triples"], f"SELECT head, rel, tail, CAST(20 + {md5int("concat_ws(' ', head, rel, tail)")} % 181 AS DOUBLE) AS score FROM kg_triples"),
        "kg_entities": (["kg_triples"], "SELECT head AS name FROM kg_triples UNION SELECT tail FROM kg_triples"),
        "vec_count": ([], "SELECT count(*) AS n FROM embeddings"),
        "entity_vectors": (["kg_entities", "vec_count"], f"SELECT name, embedding AS vec FROM kg_entities CROSS JOIN vec_count JOIN embeddings ON vec_id = {md5int('name')} % n"),
        "q": (
            [],
            """SELECT q_id, question, prediction FROM (
 SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS q_id, text AS question, nxt AS prediction FROM (
  SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) c
 WHERE role = 'user' AND nrole = 'assistant') x""",
        ),
        "q_count": (["q"], "SELECT count(*) AS nq FROM q"),
        "q_vectors": (["q", "vec_count"], f"SELECT q_id, embedding AS vec FROM q CROSS JOIN vec_count JOIN embeddings ON vec_id = {md5int('question')} % n"),
        "q_eval": (
            ["q"],
            """SELECT q_id, question, prediction, w1, w2, p1 FROM (
 SELECT q_id, question, prediction, split_part(question, ' ', 1) AS w1, split_part(question, ' ', 3) AS w2, split_part(prediction, ' ', 1) AS p1 FROM q) e""",
        ),
        "fb_rows": (
            ["q_count"],
            """SELECT q_ord, idx, kind, degree, event_id FROM (
 SELECT event_id % nq AS q_ord, user_id % 10 AS idx, CASE WHEN event_type IN ('purchase','click') THEN 'correct' ELSE 'error' END AS kind,
        1 + event_id % 3 AS degree, event_id,
        row_number() OVER (PARTITION BY event_id % nq, user_id % 10 ORDER BY event_id) AS rn
 FROM events CROSS JOIN q_count WHERE event_type IN ('purchase','click','error')) e WHERE rn = 1""",
        ),
        "ev_count": ([], "SELECT count(*) AS ne FROM events"),
        # each slot has one triple, the first of those that hash to it: slots, and so the triples, grow with questions and events
        "fb_triples": (
            ["kg_scores", "fb_rows", "q_count"],
            _slotted("fb_rows", md5long),
        ),
        # all that was said of an id: one row for each kind, the last one counts
        "fb_said": (
            ["q_count"],
            """SELECT q_ord, idx, kind, max_by(degree, event_id) AS degree, max(event_id) AS event_id FROM (
 SELECT event_id % nq AS q_ord, user_id % 10 AS idx, CASE WHEN event_type IN ('purchase','click') THEN 'correct' ELSE 'error' END AS kind, 1 + event_id % 3 AS degree, event_id
 FROM events CROSS JOIN q_count WHERE event_type IN ('purchase','click','error')) e GROUP BY q_ord, idx, kind""",
        ),
        "fb_flags": (["q_count", "fb_said"], "SELECT DISTINCT q_ord, q_ord % 11 = 0 AS insufficient, q_ord % 7 = 0 AS no_feedback FROM fb_said"),
        "fb_marks": (["kg_scores", "fb_said", "q_count"], _slotted("fb_said", md5long)),
        "facts": (
            ["kg_scores", "q_count", "ev_count"],
            f"""SELECT q_ord, head, rel, tail, score, row_number() OVER (PARTITION BY q_ord ORDER BY head, tail, rel) - 1 AS pos FROM (
 SELECT DISTINCT q_ord, head, rel, tail, score FROM (SELECT event_id % nq AS q_ord, (event_id % nq * 13 + user_id * 5 + event_id) % ne AS want FROM events CROSS JOIN q_count CROSS JOIN ev_count) w
 JOIN (SELECT head, rel, tail, score, slot, row_number() OVER (PARTITION BY slot ORDER BY head, rel, tail) AS n FROM (
  SELECT head, rel, tail, score, {md5long("concat_ws(' ', head, rel, tail)")} % ne AS slot FROM kg_scores CROSS JOIN ev_count) h) s ON slot = want WHERE n = 1) d""",
        ),
    }


SPARK = _views(lambda x: f"CAST(conv(substr(md5({x}), 1, 6), 16, 10) AS INT)", lambda x: f"CAST(conv(substr(md5({x}), 1, 8), 16, 10) AS BIGINT)")
DUCK = _views(lambda x: f"('0x' || substr(md5({x}), 1, 6))::INT", lambda x: f"('0x' || substr(md5({x}), 1, 8))::BIGINT")


def _first_of_slots(rows: str) -> str:
    """_slotted without a sort of all triples: the first triple of a slot is a minimum, taken before the shuffle too."""
    text = _slotted(rows, lambda x: f"CAST(conv(substr(md5({x}), 1, 8), 16, 10) AS BIGINT)")
    return text.replace(_ROWS_OF_SLOTS, _FIRST_OF_SLOTS).replace(" CROSS JOIN q_count) h) s\n", " CROSS JOIN q_count) h GROUP BY slot) g) s\n").replace(" WHERE n = 1", "")


_ROWS_OF_SLOTS = "SELECT head, rel, tail, score, slot, row_number() OVER (PARTITION BY slot ORDER BY head, rel, tail) AS n FROM ("
_FIRST_OF_SLOTS = "SELECT one.head, one.rel, one.tail, one.score, slot FROM (SELECT slot, min(struct(head, rel, tail, score)) AS one FROM ("

# The same rows for less: triples are made distinct by their keys before they get their text, relation by relation (each relation has one source but located_in, whose two are small).
SPARK |= {
    "kg_triples": (
        [],
        """SELECT DISTINCT head, rel, tail FROM (
 SELECT c_name AS head, 'located_in' AS rel, n_name AS tail FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT s_name, 'located_in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT n_name, 'part_of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey) u
 UNION ALL SELECT concat('Order ', CAST(o_orderkey AS STRING)), 'placed_by', c_name FROM (SELECT DISTINCT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey) o
 UNION ALL SELECT concat('Part ', CAST(p_partkey AS STRING)), 'has_brand', p_brand FROM (SELECT DISTINCT p_partkey, p_brand FROM part) p
 UNION ALL SELECT concat('Order ', CAST(l_orderkey AS STRING)), 'contains', concat('Part ', CAST(l_partkey AS STRING)) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) c
 UNION ALL SELECT concat('Part ', CAST(l_partkey AS STRING)), 'supplied_by', s_name FROM (SELECT DISTINCT l_partkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) s""",
    ),
    # names made distinct by their keys before they are texts, from the tables and not from all triples twice
    "kg_entities": (
        [],
        """SELECT c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION SELECT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION SELECT c_name FROM (SELECT DISTINCT o_custkey FROM orders) o JOIN customer ON o_custkey = c_custkey
 UNION SELECT s_name FROM (SELECT DISTINCT l_suppkey FROM lineitem) l JOIN supplier ON l_suppkey = s_suppkey
 UNION SELECT p_brand FROM part
 UNION SELECT concat('Order ', CAST(k AS STRING)) FROM (SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT l_orderkey FROM lineitem) o
 UNION SELECT concat('Part ', CAST(k AS STRING)) FROM (SELECT p_partkey AS k FROM part UNION SELECT l_partkey FROM lineitem) p""",
    ),
    **{name: (SPARK[name][0], _first_of_slots(rows)) for name, rows in (("fb_triples", "fb_rows"), ("fb_marks", "fb_said"))},
    "facts": (SPARK["facts"][0], SPARK["facts"][1].replace(_ROWS_OF_SLOTS, _FIRST_OF_SLOTS).replace(" CROSS JOIN ev_count) h) s ON slot = want WHERE n = 1)", " CROSS JOIN ev_count) h GROUP BY slot) g) s ON slot = want)")),
}


def _needed(names, views) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for need in views[name][0]:
            add(need)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def duck(names: str, select: str, **ctes: str) -> str:
    """An oracle query over the named views (space-separated) and further common table expressions."""
    parts = [f"{n} AS MATERIALIZED (\n{DUCK[n][1]})" for n in _needed(names.split(), DUCK)] + [f"{n} AS MATERIALIZED (\n{s})" for n, s in ctes.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


class Inputs:
    """The derived views of one data folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._numbered: str | None = None
        self.scored: DataFrame | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in SPARK:
            raise AttributeError(name)
        return self.sql(name, f"SELECT * FROM {name}")

    def sql(self, names: str, select: str) -> DataFrame:
        """select over the named views; tables and views are common table expressions, so the session's own views stay as they are."""
        needed = _needed(names.split(), SPARK)
        text = " ".join([select, *(SPARK[n][1] for n in needed)])
        ctes = [f"{t} AS (SELECT * FROM parquet.`{self.sf_dir}/{t}.parquet`)" for t in TABLES if re.search(rf"\b{t}\b", text)]
        ctes += [f"{n} AS (\n{self._q() if n == 'q' else SPARK[n][1]})" for n in needed]
        return self.spark.sql((f"WITH {',\n'.join(ctes)}\n" if ctes else "") + select)

    def _q(self) -> str:
        """The questions, numbered by ranges instead of by one task for all; written once."""
        if self._numbered is None:
            turns = Window.partitionBy("conv_id").orderBy("turn")
            said = self.conversations.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(turns).alias("nrole"), F.lead("text").over(turns).alias("prediction"))
            asked = said.where("role = 'user' AND nrole = 'assistant'")
            self._numbered = materialize(numbered(asked, ["conv_id", "turn"], "q_id").select("q_id", "question", "prediction"), "q")._graphtide_path
        return f"SELECT * FROM parquet.`{self._numbered}`"


#: Whether the answer to a question is right.
LABELS = "SELECT q_id, contains(lower(prediction), lower(w1)) AS label FROM q_eval"


def labels(x: Inputs) -> DataFrame:
    return x.q_eval.select("q_id", evaluate.any_match(F.col("prediction"), F.array("w1")).alias("label"))
