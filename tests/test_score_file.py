"""The score file is written compressed and read back whole."""

import glob

from graphtide import catalog
from graphtide.session import own_dir


def test_score_file_is_compressed(spark, small):
    found = catalog.QUERIES["src_scores_json"](spark, small)
    files = {f.rpartition("/")[0] for f in glob.glob(f"{own_dir(spark).removeprefix('file://')}/scores-*/part-*")}
    assert files and all(f.endswith(".gz") for d in files for f in glob.glob(f"{d}/part-*"))
    assert found.where("NOT matches OR score IS NULL").count() == 0 and found.count() > 1000
