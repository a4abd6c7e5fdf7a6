"""Hosts and paths of great length against list entries of several label counts."""

import time

from graphtide.llm import urls


def test_long_hosts_take_linear_time(spark):
    deep = "a." * 100_000
    pages = [(1, f"http://{deep}net/x"), (2, f"http://{deep}example.com/de/y"), (3, "http://" + "." * 50_000 + "net/"), (4, "http://net/"), (5, f"http://x.{deep}b.c.d/q"), (6, "http://b.c.d/p/" + "r" * 100_000), (7, "http://c.d/p/")]
    rules = [("net", "/", "block"), ("example.com", "/de/", "block"), ("b.c.d", "/p/", "allow"), ("", "/z", "block")]
    df = urls.with_parts(spark.createDataFrame(pages, "page_id long, url string"))
    began = time.time()
    got = {r.page_id: r.hit for r in urls.match_entries(df, rules, "hit").collect()}
    assert got == {1: "net/", 2: "example.com/de/", 3: "net/", 4: "net/", 5: None, 6: "b.c.d/p/", 7: None}
    assert time.time() - began < 60
