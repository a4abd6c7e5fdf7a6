"""The pipeline's near duplicates: links of SimHash and of exact similarity, and what both lead to together."""

import corpus_pipeline
from graphtide.llm import shingles, simhash


def distance(a, b):
    return (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count()


def alike(a, b):
    return shingles.alike(shingles.shingles(a), shingles.shingles(b))


def test_links_of_both_kinds_count(spark):
    words = [f"word{i}" for i in range(41)]
    base = " ".join(words * 60)
    # repeats weigh in a fingerprint and not in a set of shingles: b is near a by the first, c near b by the second alone
    rare = " ".join(f"rare{i}" for i in range(14))
    a, b = base, f"{base} {rare}"
    c = f"{' '.join(words)} {rare}"
    assert distance(a, b) <= simhash.RADIUS and not alike(a, b)
    assert alike(b, c) and distance(b, c) > simhash.RADIUS and distance(a, c) > simhash.RADIUS
    rows = [(1, a), (2, b), (3, c), (4, "another text that is like none of these"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4]
