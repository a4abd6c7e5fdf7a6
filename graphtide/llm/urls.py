"""URL filter: a sorted array of 64-bit digests, memory-mapped, probed by vectorised binary search.

A list entry is (host, path, action). It fits a url whose host is that host or a subdomain and
whose path starts with that path; the longest fitting entry wins (host plus path; a tie goes to
the longer host). Every key that a url can match (host suffix plus path prefix of a length that the
list has) is hashed with XXH64 in Spark and searched in the sorted digests; equal digests count
only if the stored host and path are equal, so a collision never decides.

A list is a table, or rows, of any length. Spark hashes and sorts it; it becomes one file in the
shared folder, which every executor maps, so that it costs address space and page cache, not heap.
Only its segments (an Arrow batch of entries) pass through the driver, one at a time, and the set of
its path lengths. There is one way for all lengths of list.

Null urls and urls without `://` have an empty host and path and match nothing but an entry with an
empty host. An empty table gives an empty result. Each row is judged by itself, so repeated urls are
judged alike and page_ids may repeat or be null; further columns of the input are not used. Of equal
entries with different actions the last action in alphabetical order counts; entries with a null are
left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.llm.common import column, ship, shipped

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The list consulted where no rule fits, unless another is given.
BLOCKLIST = os.path.join(os.path.dirname(os.path.abspath(__file__)), "blocklist.txt")

#: The rules of the published result: (host, path, action).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def with_parts(pages: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    base = pages.select(*keep, F.coalesce(F.col(url), F.lit("")).alias("__url"))
    rest = F.expr("CASE WHEN instr(__url, '://') > 0 THEN substring(__url, instr(__url, '://') + 3) ELSE '' END")
    return base.select(
        *keep,
        F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def own_blocklist(spark: SparkSession, path: str = BLOCKLIST) -> DataFrame:
    """The list of a file that only the driver can read, such as the one of this package."""
    with open(path, encoding="utf-8") as f:
        return blocklist(spark.createDataFrame([(line.rstrip("\n"),) for line in f], "value string"))


def blocklist(lines: DataFrame) -> DataFrame:
    """(host, path, action) of lines(value), as from spark.read.text: `host`, `host/path`, `0.0.0.0 host` or `||host^`; # and ! begin remarks."""
    line = F.trim(F.regexp_replace(F.regexp_replace("value", r"(^|\s)[#!].*$", ""), r"^(\d+\.\d+\.\d+\.\d+|::1?)\s+", ""))
    bare = F.regexp_replace(F.regexp_replace(line, r"^\|\|", ""), r"\^.*$", "")
    entries = lines.select(bare.alias("e")).where(F.col("e") != "")
    host = F.translate(F.regexp_extract("e", "^[^/]*", 0), UPPER, LOWER)
    rest = F.regexp_extract("e", "^[^/]*(/.*)?$", 1)
    return entries.select(host.alias("host"), F.when(rest == "", "/").otherwise(rest).alias("path"), F.lit("block").alias("action"))


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(F.concat(host, path))


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries as rows of (first digest, digests, string ends, strings)."""
    for batch in batches:
        digests = column(batch, "digest").to_numpy().view(np.uint64)
        strings = [f"{h}\0{p}\0{a}".encode() for h, p, a in zip(*(column(batch, c).to_pylist() for c in ("host", "path", "action")), strict=True)]
        ends = np.cumsum([len(s) for s in strings], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([digests.tobytes()]), pa.array([ends.tobytes()]), pa.array([b"".join(strings)])], names=["digests", "ends", "strings"])


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def digest_file(spark: SparkSession, entries: DataFrame) -> tuple[str, int, list[int], list[int]]:
    """(name of the shipped file, number of entries, path lengths, numbers of host labels) of a list.

    The file holds all digests in order, then the end of each entry's string, then the strings.
    """
    listed = entries.select(*(F.col(c).cast("string").alias(c) for c in ("host", "path", "action"))).dropna()
    listed = listed.groupBy("host", "path").agg(F.max("action").alias("action")).withColumn("digest", _key(F.col("host"), F.col("path")))
    unsigned = F.col("digest").bitwiseXOR(F.lit(-(1 << 63)))  # the order of the unsigned digests
    ranked = listed.orderBy(unsigned, "host", "path").cache()
    try:
        rows, lengths, labels = ranked.agg(F.count("*"), F.collect_set(F.length("path")), F.collect_set(_labels(F.col("host")))).first()
        parts = lambda c: (bytes(r[0]) for r in ranked.mapInArrow(_segment, "digests binary, ends binary, strings binary").select(c).toLocalIterator())

        def file() -> Iterator[bytes]:
            yield from parts("digests")
            before = 0
            for ends in parts("ends"):
                found = np.frombuffer(ends, np.int64) + before
                before = int(found[-1])
                yield found.tobytes()
            yield from parts("strings")

        return ship(spark, "urls", file()), rows, sorted(lengths), sorted(labels)
    finally:
        ranked.unpersist()


class DigestArray:
    """Sorted digests and the strings beside them, in one mapped file."""

    def __init__(self, data: memoryview, count: int):
        self.digests = np.frombuffer(data, np.uint64, count)
        self.ends = np.frombuffer(data, np.int64, count, 8 * count)
        self.strings = data[16 * count :]

    def entry(self, i: int) -> tuple[str, str, str]:
        start = int(self.ends[i - 1]) if i else 0
        return tuple(bytes(self.strings[start : int(self.ends[i])]).decode().split("\0"))

    def candidates(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions in digests whose digest is stored, first entry, entry behind the last) of each."""
        low = np.searchsorted(self.digests, digests, "left")
        at = np.flatnonzero(low < len(self.digests))
        at = at[self.digests[low[at]] == digests[at]]
        return at, low[at], np.searchsorted(self.digests, digests[at], "right")


def _probe(batches: Iterator[pa.RecordBatch], file: str, count: int, name: str) -> Iterator[pa.RecordBatch]:
    array = DigestArray(shipped(file), count)
    for batch in batches:
        lists = column(batch, "__keys")
        offsets, digests = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        digests = digests[offsets[0] : offsets[-1]] if len(offsets) else digests
        at, low, high = array.candidates(digests)
        owner = np.searchsorted(offsets - offsets[:1], at, side="right") - 1
        hosts, paths = column(batch, "host"), column(batch, "path")
        best: list[tuple[str, str, str] | None] = [None] * len(batch)
        for i, a, b in zip(owner.tolist(), low.tolist(), high.tolist(), strict=True):
            host, path = hosts[i].as_py(), paths[i].as_py()
            for k in range(a, b):
                entry = array.entry(k)
                if fits(entry, host, path) and (best[i] is None or _rank(entry) > _rank(best[i])):
                    best[i] = entry
        rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "__keys"]
        yield pa.RecordBatch.from_arrays(
            [*(c for _, c in rest), pa.array([e and e[0] + e[1] for e in best], pa.string()), pa.array([e and e[2] for e in best], pa.string())],
            names=[*(n for n, _ in rest), name, f"{name}_action"],
        )


def fits(entry: tuple[str, str, str], host: str, path: str) -> bool:
    return (host == entry[0] or host.endswith(f".{entry[0]}")) and path.startswith(entry[1])


def _rank(entry: tuple[str, str, str]) -> tuple[int, int]:
    return len(entry[0]) + len(entry[1]), len(entry[0])


def match_entries(pages: DataFrame, entries: DataFrame | Sequence[tuple[str, str, str]], name: str) -> DataFrame:
    """Adds `<name>` (host + path of the longest fitting entry, else null) and `<name>_action` to rows with host and path."""
    spark = pages.sparkSession
    if not isinstance(entries, DataFrame):
        entries = spark.createDataFrame([tuple(e) for e in entries], "host string, path string, action string")
    file, count, lengths, labels = digest_file(spark, entries)
    # only suffixes of as many labels as an entry has: a host of any length takes linear time
    suffixes = F.filter(F.array(*(F.when(_labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in labels)).cast("array<string>"), lambda h: h.isNotNull())
    known = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    prefixes = F.transform(F.filter(known, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _key(s, p))))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + f", `{name}` string, `{name}_action` string"
    return pages.withColumn("__keys", keys).mapInArrow(partial(_probe, file=file, count=count, name=name), out)


def filter_urls(pages: DataFrame, listed: DataFrame | Sequence[tuple[str, str, str]], rules: DataFrame | Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page; the rule decides, else the blocklist, else allow."""
    judged = match_entries(match_entries(with_parts(pages), rules, "rule"), listed, "listed")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_action", "listed_action", F.lit("allow")).alias("verdict"))
