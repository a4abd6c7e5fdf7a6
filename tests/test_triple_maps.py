"""Maps of a question's triples are made without its paths, and are those of the paths."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from graphtide import catalog
from graphtide.operators import graph, ranking
from graphtide.plans import retrieve
from graphtide.plans.fixtures import TABLES, Inputs


def _rows(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.mark.parametrize("without", [0, 3])
def test_maps_are_those_of_all_paths(spark, small, tmp_path, without):
    """without: every so many vectors are null, and triples that have none do not bound the scores."""
    for name in TABLES:
        if name != "embeddings":
            (tmp_path / f"{name}.parquet").symlink_to(f"{small}/{name}.parquet")
    table = pq.read_table(f"{small}/embeddings.parquet")
    vectors = [None if without and i % without == 0 else v for i, v in enumerate(table.column("embedding").to_pylist())]
    at = table.column_names.index("embedding")
    pq.write_table(table.set_column(at, "embedding", pa.array(vectors, table.schema.field("embedding").type)), tmp_path / "embeddings.parquet")
    x = Inputs(spark, str(tmp_path))
    ranked, found = retrieve.standard(x)
    paths, hops = ranked()
    want = ranking.triple_probability(hops, x.kg_scores, retrieve.triple_similarity(x, hops), retrieve.WEIGHT)
    assert _rows(found.select(*want.columns)) == _rows(want)
    sums = paths.groupBy("q_id").sum("p").collect()
    assert sums and all(abs(r["sum(p)"] - 1) < 1e-9 for r in sums)
    assert without or paths.count() == hops.select(*ranking.PATH).distinct().count()


def test_maps_list_no_paths(spark, small, monkeypatch):
    def never(*a, **k):
        raise AssertionError("paths are listed")

    monkeypatch.setattr(graph, "expand_paths", never)
    assert catalog.QUERIES["rk_sim_score_maps"](spark, small).count() > 0
