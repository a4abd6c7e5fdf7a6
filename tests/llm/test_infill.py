"""Fill-in-the-middle against plain slicing, and the skip list against cumulative sums."""

import hashlib
import random
import re

import numpy as np
import pytest

from graphtide.llm import infill


def test_skip_list_places_every_rank():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        widths = rng.integers(1, 9, n)
        made, ends = infill.SkipList(widths), np.concatenate([[0], np.cumsum(widths)])
        assert [made.place(r) for r in range(n + 1)] == ends.tolist()
        for rank in (-1, n + 1):
            with pytest.raises(IndexError):
                made.place(rank)


def test_express_lanes_carry_both_widths():
    made = infill.SkipList(np.full(5000, 3))
    assert [sum(u) for u, _ in made.lanes] == [5000] * 4 and [sum(p) for _, p in made.lanes] == [15000] * 4
    assert [len(u) for u, _ in made.lanes] == [79, 10, 2, 1]


def test_units_of_a_pattern_tile_the_text():
    for text in ("", "a", " lead and trail ", "one two\nthree  𝒳é four", "\n\n"):
        widths = infill.unit_widths(text, re.compile(r"\S+", re.DOTALL))
        assert widths.sum() == len(text) and (widths > 0).all()


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


ODD = ["", "x", "<", "<P", "a<b>c<<S <M P> S>", "has <M> in it", "<P>", "é̄ßΣ 𝒳\n\x00  end", "<" * 50, " \n "]


def test_rows_equal_slicing_and_are_restored(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(ODD) * rng.randrange(4) + rng.choice(ODD), i, "x") for i in range(400)] + [(None, None, 1, "x"), (7, "twice", 1, "x"), (7, "twice", 1, "x"), (-3, "wörd " * 200_000, 1, "x")]
    made = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, n long, form string").repartition(3))
    got = made.withColumn("restored", infill.restored()).collect()
    assert sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.restored) for r in got) == sorted((str(i), n, form, str(p), str(m), out, t or "") for i, t, *_ in rows for n, form, p, m, out in [brute(i, t)])
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_cuts_fall_between_words(spark):
    docs = spark.createDataFrame([(i, "one two  three\nfour") for i in range(60)], "doc_id long, text string")
    got = infill.fill_in_middle(docs, unit=r"\S+\s*").withColumn("restored", infill.restored()).where("form <> 'plain'").collect()
    assert got and all(r.n == 4 and r.restored == "one two  three\nfour" and {r.prefix_chars, r.prefix_chars + r.middle_chars} <= {0, 4, 9, 15, 19} for r in got)


def test_nothing_gives_nothing(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
