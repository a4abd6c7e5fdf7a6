"""Store text read whole: symbols, hops, sentence, and why a text is no path."""

from pyspark.sql import functions as F

from graphtide.functions import text


def test_store_text_is_decoded_whole(spark):
    one = "James{name: James} -[relationship:{relationship: works_for}]-> Acme{name: Acme}"
    rows = [one, one + "<-[relationship:{relationship: owned by}]- Bob{name: Bob}", "broken{name: x}", one.replace("{name: Acme}", "{name:Acme}"), one.replace(" -[", "??["), one + "{name: James}", "A{name: A} -[relationship:{relationship:r}]-> B{name: B}", None]
    got = [r.d for r in spark.createDataFrame([(r,) for r in rows], "t string").coalesce(1).select(text.decoded_path(F.col("t")).alias("d")).collect()]
    assert (got[0].symbols, got[0].sentence, got[0].reject) == ("James - works for -> Acme", "James works for Acme.", None)
    assert got[1].symbols == "James - works for -> Acme<- owned by - Bob" and got[1].sentence == "James works for Acme, Bob owned by Acme."
    assert [tuple(h) for h in got[1].hops] == [("James", "works_for", "Acme", "->"), ("Acme", "owned by", "Bob", "<-")]
    assert [d.reject for d in got[2:]] == ["no relation", "a name cannot be read", "a direction cannot be read", "names and relations do not fit together", "a relation cannot be read", "no text"]
    assert all(d.reject and d.hops is None and d.symbols is None and d.sentence is None for d in got[2:])
    assert spark.createDataFrame([(rows[3],), (rows[4],)], "t string").where(text.store_path(F.col("t")).isNotNull()).count() == 0
