"""Items shorter than a q-gram stand as lines of their own, whatever white space is around them."""

from graphtide.llm import decontaminate


def test_white_space_of_any_length_at_the_ends(spark):
    wide = " " * 40
    texts = ["yes", f"{wide}yes", f"yes{wide}", f"a\n{wide}\t Yes \x0b{wide}\r\nb", "yes yes", "\xa0yes", f"a{wide}yes"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "  "), (3, "yes")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.matches(docs, items).collect())
    spans = {0: 0, 1: 40, 2: 0, 3: 2 + 40 + 2}
    assert got == sorted((d, i, a, a + 3, 0) for d, a in spans.items() for i in (1, 3))
