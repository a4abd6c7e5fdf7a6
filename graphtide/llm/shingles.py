"""Near duplicates by exact Jaccard similarity of word shingles, with MinHash keys as candidates.

Texts are lower-cased (A-Z), cut into words and 5-word shingles (repeats don't count; a shorter text
is one shingle). Two texts are linked if the Jaccard similarity of their shingle sets is at least
`NUM / DEN`; a component is everything reachable, named by its smallest doc_id.

Search: texts with the same set (by a 128-bit digest) are one. The minima of BANDS * ROWS hash
functions give BANDS keys for each set; sets that share a key are candidates (at a similarity of
0.8 a pair is missed with probability (1 - 0.8^5)^32, 3 in a million; above it with less). A pair
whose minima, kept as four bits each, agree in fewer than AGREE places is no candidate: at 0.8 that
is six standard deviations below what is expected. All other candidates are compared on their texts, in three searches:

1. each member of a key with the key's smallest doc_id;
2. in keys that still hold several components, each member with the next two in an order of its own for each key, so
   that a large group of near copies becomes one component at the price of a few comparisons a member;
3. in keys that even then hold several components, the members outside the key's largest one with all members of other components.
   These get a finer sketch of FINE minima first, and a pair is taken in the first key that it shares.

So no link among the candidates is lost, and what the last search compares on texts are pairs near 0.8 that no chain of links joins.

Empty and null texts are alike. Rows with a null doc_id stay. Rows that repeat a doc_id stand for one document: it is in
the components of all its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtide.llm.common import column, trimmed
from graphtide.operators.components import components
from graphtide.session import discard, materialize

WORDS, NUM, DEN = 5, 4, 5  # five words, 4/5
BANDS, ROWS, AGREE, SEED = 32, 5, 100, 42
FINE, FINE_AGREE, NEIGHBOURS, ORDERED = 1024, 757, 2, 256  # 757: six standard deviations below what 0.8 gives
_BLOCK = 1024  # shingles whose minima are taken at once
_draw = np.random.default_rng(SEED)
_MULTIPLY = _draw.integers(1 << 31, size=FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _draw.integers(1 << 32, size=FINE, dtype=np.uint32)


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    found = (text or "").encode().lower().split()
    if not found:
        return set()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def alike(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return a == b or DEN * both >= NUM * (len(a) + len(b) - both)


def _hashed(found: set[bytes]) -> np.ndarray:
    return np.sort(np.array([xxhash.xxh64_intdigest(s, SEED) for s in found], np.uint64))


def minima(full: np.ndarray, n: int) -> np.ndarray:
    """The least values of n hash functions over the hashes of a set."""
    short = (full >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), _BLOCK):
        np.minimum(least, (short[at : at + _BLOCK] * _MULTIPLY[:n] + _ADD[:n]).min(0), out=least)
    return least


def nibbles(least: np.ndarray) -> list[int]:
    """Four bits of each minimum, 16 to a long."""
    low = (least & np.uint32(15)).astype(np.uint8)
    return (low[0::2] | low[1::2] << 4).view("<i8").tolist()


def sketch(found: set[bytes]) -> tuple[bytes, int, list[int], list[int]]:
    """Digest of the set, its size, a key for each band, and all minima as four bits each."""
    if not found:
        return b"", 0, [], []
    full = _hashed(found)
    least = minima(full, BANDS * ROWS)
    keys = np.array([xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64)
    return xxhash.xxh3_128_digest(full.tobytes()), len(found), keys.view(np.int64).tolist(), nibbles(least)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, set_id, n, keys, sig) for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            found = [sketch(shingles(t)) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text_id"), *(pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds))], names=["doc_id", "text_id", "set_id", "n", "keys", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_id"))
    return rows.mapInArrow(trimmed(work), "doc_id long, text_id long, set_id binary, n long, keys array<long>, sig array<long>")


def _fine(texts: DataFrame) -> DataFrame:
    """(id, fine) of texts(id, text): the finer sketches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [nibbles(minima(_hashed(shingles(t)), FINE)) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(made, pa.list_(pa.int64()))], names=["id", "fine"])

    return texts.select("id", "text").mapInArrow(trimmed(work), "id long, fine array<long>")


def _agree(a: Column, b: Column, n: int, least: int) -> Column:
    """Whether at least `least` of n minima are alike."""
    ones, differ = F.lit(0x1111111111111111), F.lit(0)
    for i in range(n // 16):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(ones))
    return differ <= n - least


def _likely(a: str, b: str) -> Column:
    """Neither sizes nor minima rule the pair out."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (DEN * F.least(na, nb) >= NUM * F.greatest(na, nb)) & _agree(F.col(f"{a}.sig"), F.col(f"{b}.sig"), BANDS * ROWS, AGREE)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            a, b, keep = column(batch, "a").to_pylist(), column(batch, "b").to_pylist(), []
            for i in range(len(a)):
                if b[i] != last:
                    last, held = b[i], shingles(column(batch, "tb")[i].as_py())
                keep.append(alike(shingles(column(batch, "ta")[i].as_py()), held))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return materialize(pairs.hint("merge").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(trimmed(work), "a long, b long"), "links")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, a, label, many) of the keys whose members are of several components; many: members of the key."""
    placed = materialize(members.select("key", "a").hint("merge").join(labels.hint("merge"), F.col("a") == F.col("node"), "left").select("key", "a", F.coalesce("label", "a").alias("label")), "placed")
    keys = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("many")).where("low < high").select("key", "many")
    out = materialize(placed.hint("merge").join(keys.hint("merge"), "key"), "mixed")
    discard(placed)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of docs(doc_id, text) that has a doc_id."""
    found = materialize(sketches(docs.where(F.col("doc_id").isNotNull())), "sketches")
    first = F.min(F.struct("doc_id", "text_id"))
    sets = found.groupBy("set_id").agg(first.alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))  # equal sets have equal sketches; ids are fixed by writing them
    sets = materialize(sets.select("set_id", F.monotonically_increasing_id().alias("id"), F.col("first.doc_id").alias("doc"), F.col("first.text_id").alias("text_id"), "n", "keys", "sig"), "sets")
    keyed = sets.select(F.explode("keys").alias("key"), "id", "doc")
    shared = keyed.groupBy("key").agg(F.min(F.struct("doc", "id"))["id"].alias("b"), F.count("*").alias("members")).where("members > 1").select("key", "b")
    members = materialize(keyed.hint("merge").join(shared.hint("merge"), "key").select("key", F.col("id").alias("a"), "b"), "members")
    wanted = sets.select("id", F.col("doc").alias("doc_id"), "text_id").hint("merge").join(members.select(F.col("a").alias("id")).distinct().hint("merge"), "id", "left_semi")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_id"))
    texts = materialize(rows.hint("merge").join(wanted.hint("merge"), ["doc_id", "text_id"]).groupBy("id").agg(F.min("text").alias("text")), "texts")

    sigs = sets.select("id", "n", "sig")
    x, y = sigs.alias("x"), sigs.alias("y")

    def search(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pairs that are candidates, links among them)."""
        tried = materialize(pairs.hint("merge").join(x.hint("merge"), F.col("a") == F.col("x.id")).join(y.hint("merge"), F.col("b") == F.col("y.id")).where(_likely("x", "y")).select("a", "b"), "tried")
        return tried, _confirmed(tried, texts)

    tried, links = search(members.where("a != b").select("a", "b").distinct())
    labels = components(links)

    mixed = _mixed(members, labels)
    order = Window.partitionBy("key", F.pmod(F.xxhash64("a"), F.ceil(F.col("many") / ORDERED))).orderBy(F.xxhash64("key", "a"), "a")
    following = F.array(*(F.struct(F.lead("a", i).over(order).alias("b"), F.lead("label", i).over(order).alias("other")) for i in range(1, NEIGHBOURS + 1)))
    close = mixed.select("a", "label", following.alias("following")).select("a", "label", F.explode("following").alias("next")).where("next.b IS NOT NULL AND next.other != label")
    close = close.select(F.greatest("a", "next.b").alias("a"), F.least("a", "next.b").alias("b")).distinct().join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).hint("merge"), ["a", "b"], "left_anti")
    more, added = search(close)
    discard(labels, mixed, tried, more)
    links = links.unionByName(added)
    labels = components(links)

    mixed = _mixed(members, labels)
    largest = mixed.groupBy("key", "label").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("largest"))
    fine = materialize(_fine(texts.hint("merge").join(mixed.select(F.col("a").alias("id")).distinct().hint("merge"), "id", "left_semi")), "fine")
    full = sets.select("id", "n", "sig", "keys").hint("merge").join(fine.hint("merge"), "id")
    rest = materialize(mixed.select("key", "a", "label").hint("merge").join(largest.hint("merge"), "key").hint("merge").join(full.hint("merge"), F.col("a") == F.col("id")).drop("id"), "rest")
    u, v = rest.where("label != largest").alias("u"), rest.alias("v")
    once = (F.col("v.label") == F.col("v.largest")) | (F.col("u.a") > F.col("v.a"))
    apart = (F.col("u.key") == F.col("v.key")) & (F.col("u.label") != F.col("v.label")) & once & _likely("u", "v") & _agree(F.col("u.fine"), F.col("v.fine"), FINE, FINE_AGREE)
    shares = F.zip_with("u.keys", "v.keys", lambda p, q: F.when(p == q, p))
    others = u.hint("merge").join(v.hint("merge"), apart & (F.element_at(F.filter(shares, lambda k: k.isNotNull()), 1) == F.col("u.key")))
    others = materialize(others.select(F.greatest("u.a", "v.a").alias("a"), F.least("u.a", "v.a").alias("b")), "others")
    named = components(links.unionByName(_confirmed(others, texts)).unionByName(_same_document(found, sets)))
    discard(texts, members, mixed, fine, rest, others, labels)

    of = sets.select(F.col("set_id").alias("of"), "id", "doc").hint("merge").join(named.hint("merge"), F.col("id") == F.col("node"), "left").select("of", "doc", F.coalesce("label", "id").alias("label"))
    of = materialize(of, "labels")
    names = of.groupBy("label").agg(F.min("doc").alias("component_id"))
    of = materialize(of.hint("merge").join(names.hint("merge"), "label").select("of", "component_id"), "components")
    out = materialize(found.select("doc_id", "set_id").hint("merge").join(of.hint("merge"), F.col("set_id") == F.col("of")).select("doc_id", "component_id"), "components")
    discard(found, sets, links, named, of)
    return out


def _same_document(found: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the different texts under one doc_id, each with the first."""
    several = found.select("doc_id", "set_id").distinct().groupBy("doc_id").agg(F.min("set_id").alias("low"), F.count("*").alias("many")).where("many > 1")
    pairs = found.select("doc_id", "set_id").distinct().hint("merge").join(several.hint("merge"), "doc_id").where("set_id != low").select("set_id", "low")
    a, b = sets.select("set_id", F.col("id").alias("a")), sets.select(F.col("set_id").alias("low"), F.col("id").alias("b"))
    return pairs.hint("merge").join(a.hint("merge"), "set_id").hint("merge").join(b.hint("merge"), "low").select("a", "b")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that are not the first of their component; all columns stay."""
    copies = near_duplicates(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(materialize(copies, "copies").hint("merge"), "doc_id", "left_anti")
