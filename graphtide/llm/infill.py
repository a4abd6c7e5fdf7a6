"""Fill-in-the-middle: each text is cut at two places and its parts are put in another order.

A text is a row of units (code points, or what a pattern matches) in an indexable skip list: the
bottom lane holds up to LEAF units a node, each node of an express lane spans FAN nodes of the lane
below, and every node carries two widths, its units and its code points. Going down the lanes by
accumulated unit widths leads to a rank in a logarithmic number of steps, and the code points passed
on the way are the place in the text. Both cuts of a text are found in one list.

Ranks and form are drawn from SHA-256 over seed and doc_id, so they are the same in every run, and a
task that is lost gives the same rows again. A text that holds a control string stays plain.

Null texts are empty, and empty texts are plain. A null doc_id draws as an empty number. Each row is cut by
itself, repeated rows alike; an empty table gives an empty result; further columns aren't used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import column, slices, utf8

LEAF, FAN = 64, 8
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, CUT_PERCENT, SUFFIX_FIRST_PERCENT = 1, 90, 20
_SLICE_BYTES = 8_000_000


class SkipList:
    """The units of a text with their widths in code points."""

    def __init__(self, widths: np.ndarray):
        self.widths, self.n = widths, len(widths)
        heads = np.arange(0, self.n, LEAF)
        units, points = np.diff(heads, append=self.n), np.add.reduceat(widths, heads, dtype=np.int64) if self.n else heads
        self.lanes = [(units.tolist(), points.tolist())]
        while len(units) > 1:
            heads = np.arange(0, len(units), FAN)
            units, points = np.add.reduceat(units, heads), np.add.reduceat(points, heads)
            self.lanes.append((units.tolist(), points.tolist()))

    def place(self, rank: int) -> int:
        """The number of code points in the first `rank` units."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        node = passed = at = 0
        for lane, (units, points) in zip(reversed(range(len(self.lanes))), reversed(self.lanes), strict=True):
            while node < len(units) and passed + units[node] <= rank:
                passed, at, node = passed + units[node], at + points[node], node + 1
            if lane:
                node *= FAN
        return at + int(self.widths[passed:rank].sum(dtype=np.int64))


def unit_widths(text: str, unit: re.Pattern | None) -> np.ndarray:
    """Code points of each unit, left to right. A unit ends where its match ends; what follows the last match is one more. None: code points."""
    if unit is None:
        return np.ones(len(text), np.uint8)
    ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.diff(np.array(ends, np.int64), prepend=0)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def cut(doc_id: int | None, text: str, unit: re.Pattern | None = None, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output) of one text."""
    widths, h = unit_widths(text, unit), draws(doc_id, seed)
    n = len(widths)
    if not text or h[2] % 100 >= cut_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    units = SkipList(widths)
    a, b = (units.place(rank) for rank in sorted(x % (n + 1) for x in h[:2]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, unit: str | None = None, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs(doc_id, text); unit: a regular expression, or None for code points."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit, re.DOTALL) if unit else None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for first, last in slices(utf8(texts)[1], _SLICE_BYTES):
                some = ids.slice(first, last - first).to_pylist()
                rows = [(i, *cut(i, t or "", pattern, seed, cut_percent, suffix_first_percent)) for i, t in zip(some, texts.slice(first, last - first).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _split(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and behind the first mark."""
    before = F.substring_index(text, mark, 1)
    return before, F.substring(text, F.char_length(before) + len(mark) + 1, F.char_length(text))


def restored() -> Column:
    """The text that was cut, from the columns output and form alone."""
    body = F.substring(F.col("output"), F.lit(len(PREFIX) + 1), F.char_length("output"))
    prefix, rest = _split(body, SUFFIX)
    suffix, middle = _split(rest, MIDDLE)
    suffix_2, rest_2 = _split(body, PREFIX)
    prefix_2, middle_2 = _split(rest_2, MIDDLE)
    return F.when(F.col("form") == "psm", F.concat(prefix, middle, suffix)).when(F.col("form") == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(F.col("output"))
