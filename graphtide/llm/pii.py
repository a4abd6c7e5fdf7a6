"""Personal data: pattern spans, and terms that give a protected entity away.

Patterns find email addresses, IPv4 addresses, card numbers and phone numbers, each kind leftmost
and non-overlapping; a match that fails its check is dropped and not retried. Each distinct value is
a protected entity.

Information-theoretic step: co-occurrence is counted over whole documents and the whole corpus. With
n documents, n_c of them with entity c, n_t with term t (a lower-cased word of two characters or
more) and n_ct with both, the smoothed chance of c given t is p = (n_ct + n_c / n) / (n_t + 1). What
t leaves unsaid about c is -log2 p bits; what it tells is log2(n / n_c) bits less that, their
pointwise mutual information. A term is disclosing if it tells at least `gain` bits and leaves at
most `word_bits` unsaid; a name (always written with a capital, and not only where a sentence
begins) may leave `name_bits`, so that a name which stands in one document only, the one with the
entity, counts, while any other word needs three documents. Both are independent of the corpus'
size. An entity in over one document in 2^gain is public and protects nothing. A disclosing term is
marked, as kind `term`, in every document in which it occurs.

Sanitising has two levels: a term that leaves at most `remove_bits` is removed, another is generalised
to its class, as pattern spans are.

At scale: entities with the same documents are one class, so that a list of many entities costs a
document as much as one; words too frequent to disclose anything are dropped before pairs are made;
pairs are counted with a partial aggregate before their shuffle. Places are found by a Bloom filter
of the disclosing terms (at most FILTER_WORDS * 8 bytes are broadcast) whose hits are then joined
to the terms, so a false hit never shows. Everything is keyed by row, never by doc_id.

Positions are code points, ends exclusive. Null and empty texts have no spans and a null text stays
null. Every row counts as a document, repeated rows too; null and repeated doc_ids are carried
along. An empty table gives an empty result; further columns, whatever their names, are kept by
`sanitise` and not used by `find`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from graphtide.llm.common import column, utf8
from graphtide.session import discard, materialize

KINDS = ["email", "ip", "card", "phone", "term"]
GAIN, WORD_BITS, NAME_BITS, REMOVE_BITS = 4.0, 0.42, 1.0, 0.2
MAX_BROADCAST, FILTER_WORDS = 100_000, 1 << 21

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]{2,}")
_STOP = re.compile(r"[.!?:;\n]\s*[^\w\s]*\s*\Z")
_NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from their @ signs in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            last = match.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, entity) by start, then kind."""
    out = [(s, 0, e, "email:" + text[s:e].lower()) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), 1, m.end(), "ip:" + m[0]))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() >= 12 else ""
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end(), "card:" + digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 9 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), "phone:" + digits))
    return sorted(out)


def word_places(text: str, wanted, spans) -> dict[str, list[tuple[int, int]]]:
    """Where the wanted words stand outside the spans (sorted by start)."""
    places: dict[str, list[tuple[int, int]]] = {}
    covered, k = [(s[0], s[2]) for s in spans], 0
    reach = np.maximum.accumulate([e for _, e in covered]).tolist() if covered else []
    for m in _WORD.finditer(text):
        word = m[0].lower()
        if word in wanted:
            while k < len(covered) and covered[k][0] < m.end():
                k += 1
            if not (k and reach[k - 1] > m.start()):
                places.setdefault(word, []).append((m.start(), m.end()))
    return places


class _Every:
    """Contains all words but those given."""

    def __init__(self, but: frozenset):
        self.but = but

    def __contains__(self, word: str) -> bool:
        return word not in self.but


def terms(text: str, spans, common: frozenset) -> list[dict]:
    """The words of a text outside its spans that are not common, and whether each is written as a name."""
    out = []
    for word, places in word_places(text, _Every(common), spans).items():
        name = all(text[a].isupper() for a, _ in places) and any(a and not _STOP.search(text, max(0, a - 8), a) for a, _ in places)
        out.append({"term": word, "name": name})
    return out


def _words(text: str | None) -> set[str]:
    return set(map(str.lower, _WORD.findall(text))) if text else set()


def _candidates(batch: pa.RecordBatch) -> np.ndarray:
    """Which texts hold an @ or a digit at all, from their bytes."""
    data, offsets = utf8(column(batch, "text"))
    hit = np.concatenate([[0], np.cumsum((data == 64) | ((data >= 48) & (data <= 57)))])
    return np.diff(hit[offsets]) > 0


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("entity", pa.string())])
_PLACE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_TERM = pa.struct([("term", pa.string()), ("name", pa.bool_())])
_HIT = pa.struct([("term", pa.string()), ("places", pa.list_(_PLACE))])
_SPANS = "array<struct<start:int,kind:int,end:int,entity:string>>"
_HITS = "array<struct<term:string,places:array<struct<start:int,end:int>>>>"


def _span_array(spans: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(("start", "kind", "end", "entity"), s, strict=True)) for s in one] for one in spans], pa.list_(_SPAN))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): in how many documents each word occurs; the row with a null term has the number of documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str | None, int] = {None: 0}
        for batch in batches:
            counts[None] += len(batch)
            for text in column(batch, "text").to_pylist():
                for w in _words(text):
                    counts[w] = counts.get(w, 0) + 1
            if len(counts) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
                counts = {None: 0}
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def detect(docs: DataFrame, common: frozenset = frozenset()) -> DataFrame:
    """Of each text with pattern spans: row (a number), entities, terms."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").filter(pa.array(_candidates(batch))).to_pylist()
            found = [(t, s) for t in texts for s in [base_spans(t)] if s]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted({s[3] for s in spans}) for _, spans in found], pa.list_(pa.string())), pa.array([terms(t, spans, shared.value) for t, spans in found], pa.list_(_TERM))],
                names=["entities", "terms"],
            )

    out = docs.select("text").mapInArrow(work, "entities array<string>, terms array<struct<term:string,name:boolean>>")
    return out.withColumn("row", F.monotonically_increasing_id())


def revealing(docs: DataFrame, gain: float = GAIN, word_bits: float = WORD_BITS, name_bits: float = NAME_BITS, most: int = MAX_BROADCAST) -> DataFrame:
    """(term, unsaid, name) of all disclosing terms of docs(text): the bits that the term leaves unsaid about the entity it tells most of."""
    counts = materialize(term_counts(docs), "counts")
    n = float((counts.where("term IS NULL").agg(F.sum("n")).first()[0]) or 0)
    least = 2.0 ** -max(word_bits, name_bits)
    public = n / 2.0**gain
    rare = F.col("n") + 1 <= (public + 1) / least
    listed = counts.where(F.col("term").isNotNull() & ~rare).select("term").limit(most + 1).collect()  # about 2^gain words of a mean document at most
    common = frozenset(r[0] for r in listed) if len(listed) <= most else frozenset()
    found = materialize(detect(docs, common), "found")

    entities = materialize(found.select("row", F.explode("entities").alias("entity")), "entities")
    of = entities.groupBy("entity").agg(F.count("*").alias("n_c"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).cast("string").alias("s"))
    of = materialize(of.select("entity", "n_c", F.xxhash64("n_c", "x", "s").alias("class")), "classes")
    open_ = of.where(F.col("n_c") > public).select("entity")  # as many as 2^gain mean documents have at most
    known = entities.join(F.broadcast(open_) if open_.count() <= most else open_.hint("merge"), "entity", "left_anti")
    classes = known.hint("merge").join(of.where(F.col("n_c") <= public).hint("merge"), "entity").select("row", "class", "n_c").distinct()
    words = found.select("row", F.explode("terms").alias("t")).select("row", "t.term", "t.name")
    words = words.hint("merge").join(counts.where(rare).withColumnRenamed("n", "n_t").hint("merge"), "term")
    pairs = classes.hint("merge").join(words.hint("merge"), "row").where(F.col("n_t") + 1 <= (F.col("n_c") + 1) / least)
    pairs = pairs.groupBy("term", "class").agg(F.count("*").alias("n_ct"), F.min("name").alias("name"), F.first("n_t").alias("n_t"), F.first("n_c").alias("n_c"))
    unsaid = -F.log2((F.col("n_ct") + F.col("n_c") / n) / (F.col("n_t") + 1)) if n else F.lit(0.0)
    told = (F.log2(n / F.col("n_c")) - F.col("unsaid") >= gain) if n else F.lit(False)
    allowed = F.when(F.col("name"), name_bits).otherwise(word_bits)
    kept = pairs.withColumn("unsaid", F.round(unsaid, 9)).where(told & (F.col("unsaid") <= allowed))
    out = materialize(kept.groupBy("term").agg(F.min("unsaid").alias("unsaid"), F.min("name").alias("name")), "revealing")
    discard(counts, found, entities, of)
    return out


def _filter_places(digest: Column, words: int) -> list[Column]:
    """Two (word, bit) places of a digest in a filter of so many 64-bit words (a power of two)."""
    mask = F.lit(words - 1).cast("long")
    return [F.struct(F.shiftrightunsigned(digest, a).bitwiseAND(mask).alias("at"), F.shiftrightunsigned(digest, b).bitwiseAND(F.lit(63).cast("long")).cast("int").alias("bit")) for a, b in ((0, 21), (32, 53))]


def term_filter(known: DataFrame) -> np.ndarray:
    """A Bloom filter of known(term): 16 bits a term, FILTER_WORDS 64-bit words at most."""
    words = 64
    count = known.count()
    while words < min(FILTER_WORDS, count // 4):
        words *= 2
    places = known.select(F.explode(F.array(*_filter_places(F.xxhash64("term"), words))).alias("p"))
    rows = places.groupBy("p.at").agg(F.bit_or(F.expr("shiftleft(1L, p.bit)")).alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


class _Filter:
    """The words that pass the filter; those known not to are remembered."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.no = bits, set()

    def passing(self, words: set[str]) -> set[str]:
        fresh = list(words - self.no)
        if not fresh:
            return set()
        digest = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in fresh], np.uint64)
        mask, ok = np.uint64(len(self.bits) - 1), np.ones(len(fresh), bool)
        for a, b in ((0, 21), (32, 53)):
            ok &= (self.bits[(digest >> np.uint64(a)) & mask] >> ((digest >> np.uint64(b)) & np.uint64(63)) & np.uint64(1)) > 0
        if len(self.no) > 300_000:
            self.no.clear()
        self.no.update(w for w, k in zip(fresh, ok.tolist(), strict=True) if not k)
        return {w for w, k in zip(fresh, ok.tolist(), strict=True) if k}


def _marked(texts: pa.Array, worth: np.ndarray, filters: _Filter) -> tuple[pa.Array, pa.Array]:
    """Pattern spans, and places of words that pass the filter, of each text."""
    spans, hits = [], []
    for i, text in enumerate(texts.to_pylist()):
        found = base_spans(text) if worth[i] else []
        passing = filters.passing(_words(text)) if filters.bits.any() else ()
        spans.append(found)
        hits.append([{"term": w, "places": [{"start": a, "end": b} for a, b in p]} for w, p in word_places(text, passing, found).items()] if passing else [])
    return _span_array(spans), pa.array(hits, pa.list_(_HIT))


def _resolved(marked: DataFrame, known: DataFrame) -> DataFrame:
    """(of, terms) of each row of marked(row, hits) with disclosing terms: term, places, unsaid, name."""
    hits = marked.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.term", "h.places")
    joined = hits.hint("merge").join(known.hint("merge"), "term")
    return joined.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("term", "places", "unsaid", "name")).alias("terms"))


def find(docs: DataFrame, gain: float = GAIN, word_bits: float = WORD_BITS, name_bits: float = NAME_BITS, most: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, spans (array of start, kind, end, entity; sorted) for every row, disclosing terms included."""
    known = revealing(docs, gain, word_bits, name_bits, most)
    shared = docs.sparkSession.sparkContext.broadcast(term_filter(known))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = _Filter(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *_marked(column(batch, "text"), _candidates(batch), filters)], names=["doc_id", "spans", "hits"])

    marked = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, f"doc_id long, spans {_SPANS}, hits {_HITS}")
    marked = materialize(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    span = lambda t: F.transform(t.places, lambda p: F.struct(p.start.alias("start"), F.lit(4).alias("kind"), p.end.alias("end"), F.concat(F.lit("term:"), t.term).alias("entity")))
    extra = _resolved(marked, known).select("of", F.flatten(F.transform("terms", span)).alias("extra"))
    joined = marked.hint("merge").join(materialize(extra, "extra").hint("merge"), F.col("row") == F.col("of"), "left")
    out = materialize(joined.select("doc_id", F.array_sort(F.concat("spans", F.coalesce("extra", F.array().cast(_SPANS)))).alias("spans")), "spans")
    discard(marked, known)
    return out


def sanitise(docs: DataFrame, gain: float = GAIN, word_bits: float = WORD_BITS, name_bits: float = NAME_BITS, remove_bits: float = REMOVE_BITS, most: int = MAX_BROADCAST) -> DataFrame:
    """docs with every pattern span and disclosing term of its text generalised to its class, as in `[EMAIL]`, or removed; n_chars, if there, is counted anew."""
    known = revealing(docs, gain, word_bits, name_bits, most)
    shared = docs.sparkSession.sparkContext.broadcast(term_filter(known))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    one = StructType([StructField("doc", whole.schema["doc"].dataType)])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = _Filter(shared.value)
        for batch in batches:
            texts = batch.column(0).field("text")
            worth = _candidates(pa.RecordBatch.from_arrays([texts], names=["text"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_marked(texts, worth, filters)], names=["doc", "spans", "hits"])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, all_spans = column(batch, "doc"), column(batch, "spans").to_pylist()
            found = column(batch, "terms").to_pylist()
            texts = rows.field("text").to_pylist()
            new = [replaced(t, s, f or [], remove_bits) if t and (s or f) else t for t, s, f in zip(texts, all_spans, found, strict=True)]
            fields = [rows.type.field(i) for i in range(rows.type.num_fields)]
            parts = [pa.array(new, f.type) if f.name == "text" else rows.field(i) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(parts, fields=fields)], names=["doc"])

    marked = whole.mapInArrow(mark, StructType([*one, *StructType.fromDDL(f"spans {_SPANS}, hits {_HITS}")]))
    marked = materialize(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    types = "array<struct<term:string,places:array<struct<start:int,end:int>>,unsaid:double,name:boolean>>"
    plain = marked.where(F.size("hits") == 0).select("doc", "spans", F.lit(None).cast(types).alias("terms"))
    told = materialize(_resolved(marked, known), "told")
    other = marked.where(F.size("hits") > 0).hint("merge").join(told.hint("merge"), F.col("row") == F.col("of"), "left").select("doc", "spans", "terms")
    out = plain.unionByName(other).mapInArrow(replace, one).select("doc.*")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def replaced(text: str, spans: list[dict], found: list[dict], remove_bits: float) -> str:
    """The text with its spans and the places of its disclosing terms replaced."""
    cuts = [(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in spans]
    for t in found:
        kind = "NAME" if t["name"] else "NUMBER" if t["term"].isdigit() else "TERM"
        cuts += [(p["start"], p["end"], "" if t["unsaid"] <= remove_bits else f"[{kind}]") for p in t["places"]]
    out, at = [], 0
    for start, end, name in sorted(cuts):
        if start >= at:
            out += [text[at:start], name]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the pattern spans and all spans as text."""
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] < 4)
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"))
