"""Parsing and rendering of store text, model replies and prompts, all in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capitalise(c: Column) -> Column:
    """First character upper, the rest lower (one word or many)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def keywords(line: Column) -> Column:
    """Keywords of a reply line; the sentinel `No keywords to add.` gives none."""
    plain = F.regexp_replace(line, r"^\s*KEYWORDS:\s*", "")
    parts = F.transform(F.split(plain, ","), lambda k: capitalise(F.replace(F.lower(F.trim(k)), F.lit("'"), F.lit(""))))
    return F.when(F.contains(line, F.lit("No keywords to add.")), F.array().cast("array<string>")).otherwise(F.filter(parts, lambda k: k != ""))


#: Store text as it is written; other text is looked at part by part.
_STORED = r"^[^{]*\{name: [^{}]*\}(?:(?: -|<-)\[relationship:\{relationship: [^{}]*\}\][^{]*\{name: [^{}]*\})+$"


def _store_parts(text: Column) -> Column:
    return F.struct(
        F.regexp_extract_all(text, F.lit(r"\{name: ([^}]*)\}"), F.lit(1)).alias("names"),
        F.regexp_extract_all(text, F.lit(r"\{relationship: ([^}]*)\}"), F.lit(1)).alias("rels"),
        F.regexp_extract_all(text, F.lit(r"(..)\[relationship:\{"), F.lit(1)).alias("arrows"),
        text.alias("text"),
    )


def _store_fault(p: Column) -> Column:
    """Why the parts of a text are no path; null if they are one."""
    n, begun = F.size(p["rels"]), lambda head: (F.length(p["text"]) - F.length(F.replace(p["text"], F.lit(head), F.lit("")))) / len(head)
    return (
        F.when(F.rlike(p["text"], F.lit(_STORED)), None)
        .when(p["text"].isNull(), "no text")
        .when(F.size(p["names"]) != begun("{name:"), "a name cannot be read")
        .when(n != begun("{relationship:"), "a relation cannot be read")
        .when(n == 0, "no relation")
        .when(F.size(p["names"]) != n + 1, "names and relations do not fit together")
        .when((F.size(p["arrows"]) != n) | F.exists(p["arrows"], lambda a: ~a.isin(" -", "<-")), "a direction cannot be read")
    )


def _store_hops(p: Column) -> Column:
    hop = lambda r, i: F.struct(
        F.get(p["names"], i).alias("src"), r.alias("rel"), F.get(p["names"], i + 1).alias("dst"),
        F.when(F.get(p["arrows"], i) == "<-", "<-").otherwise("->").alias("dir"),
    )
    return F.transform(p["rels"], hop)


def store_path(text: Column) -> Column:
    """Hops of `A{name: A} -[relationship:{relationship: r}]-> B{name: B}`; null where the parts do not fit together."""
    return once(_store_parts(text), lambda p: F.when(_store_fault(p).isNull(), _store_hops(p)))


def decoded_path(text: Column) -> Column:
    """Store text read whole: hops, symbols `A - r -> B` (relations in words), sentence, and reject: of a text that is no path only this, the reason, is not null."""

    def symbols(t: Column) -> Column:
        words = F.regexp_replace(t, r"_(?=[^{}]*\}\])", " ")  # underscores of relations only
        return F.regexp_replace(F.regexp_replace(words, r"\{name: [^}]*\}", ""), r"\[relationship:\{relationship: ([^}]*)\}\]", " $1 ")

    def read(p: Column) -> Column:
        return once(F.struct(_store_fault(p).alias("reject"), p.alias("p")), lambda f: F.struct(f["reject"].alias("reject"), F.when(f["reject"].isNull(), _store_hops(f["p"])).alias("hops"), F.when(f["reject"].isNull(), symbols(f["p"]["text"])).alias("symbols")))

    return once(once(_store_parts(text), read), lambda d: F.struct(d["hops"].alias("hops"), d["symbols"].alias("symbols"), path_sentence(d["hops"]).alias("sentence"), d["reject"].alias("reject")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often use reads it, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def path_sentence(hops: Column) -> Column:
    """Canonical triples joined by `, ` and a full stop."""
    one = lambda h: F.when(h["dir"] == "->", F.concat_ws(" ", h["src"], F.translate(h["rel"], "_", " "), h["dst"])).otherwise(F.concat_ws(" ", h["dst"], F.translate(h["rel"], "_", " "), h["src"]))
    return F.concat(F.array_join(F.transform(hops, one), ", "), F.lit("."))


def path_render(hops: Column, most: int | None = None) -> Column:
    """Readable path of an array of hops; a hop that does not start at the current end opens a segment after a comma.

    With `most`, the greatest number of hops, it is one compiled expression instead of a loop over the array.
    """
    piece = lambda h: F.when(h["dir"] == "->", F.concat(F.lit(" - "), h["rel"], F.lit(" -> "), h["dst"])).otherwise(F.concat(F.lit(" <- "), h["rel"], F.lit(" - "), h["dst"]))
    if most is not None:
        each = [F.get(hops, i) for i in range(most)]
        opens = [each[0]["src"], *(F.when(a["dst"].isNull(), b["src"]).when(a["dst"] == b["src"], F.lit("")).otherwise(F.concat(F.lit(", "), b["src"])) for a, b in zip(each, each[1:], strict=False))]
        return F.concat(*(F.when(F.size(hops) > i, F.concat(o, piece(h))).otherwise(F.lit("")) for i, (o, h) in enumerate(zip(opens, each, strict=True))))
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("last"))
    step = lambda a, h: F.struct(
        F.concat(a["text"], F.when(a["last"].isNull(), h["src"]).when(a["last"] == h["src"], F.lit("")).otherwise(F.concat(F.lit(", "), h["src"])), piece(h)).alias("text"), h["dst"].alias("last")
    )
    return F.aggregate(hops, start, step, lambda a: a["text"])


def split_hops(path: Column) -> Column:
    """Canonical hop strings `h -r-> t` of a symbol path `A - r -> B <- r2 - C`."""
    nodes = F.split(path, r" - (?:[^<>]*?) -> | <- (?:[^<>]*?) - ").alias("nodes")
    marks = F.regexp_extract_all(path, F.lit(r"( - (?:[^<>]*?) -> | <- (?:[^<>]*?) - )"), F.lit(1)).alias("marks")
    rel = lambda m: F.regexp_extract(m, r"^ (?:-|<-) (.*?) (?:->|-) $", 1)

    def hops(p: Column) -> Column:
        at = lambda i: F.get(p["nodes"], i)
        hop = lambda m, i: F.when(F.startswith(m, F.lit(" - ")), F.concat(at(i), F.lit(" -"), rel(m), F.lit("-> "), at(i + 1))).otherwise(F.concat(at(i + 1), F.lit(" -"), rel(m), F.lit("-> "), at(i)))
        return F.transform(p["marks"], hop)

    return once(F.struct(nodes, marks), hops)


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+\.?\d*)"), F.lit(1)))


def id_list(reply: Column, n: Column) -> Column:
    """Integers of a comma-separated reply that are digits and below n."""
    plain = F.filter(F.transform(F.split(reply, ","), lambda p: F.trim(p)), lambda p: F.rlike(p, F.lit(r"^\d{1,9}$")))
    return F.filter(F.transform(plain, lambda p: p.cast("int")), lambda i: i < n)


SCORES = "struct<Insufficient_information:boolean,Path_score:map<string,double>>"


def json_feedback(raw: Column) -> Column:
    """Insufficient_information and Path_score of a reply; a reply that lacks either, or is no JSON, counts as insufficient without scores."""
    parsed = F.from_json(F.regexp_replace(raw, "[`\\n]", ""), SCORES)
    good = parsed["Insufficient_information"].isNotNull() & parsed["Path_score"].isNotNull()
    empty = F.create_map().cast("map<string,double>")
    return F.struct(F.when(good, parsed["Insufficient_information"]).otherwise(True).alias("insufficient"), F.when(good, parsed["Path_score"]).otherwise(empty).alias("path_score"))


def text_feedback(replies: DataFrame) -> DataFrame:
    """q_id, insufficient, no_feedback, and per index the last degree of each side, of replies(q_id, raw).

    Lines are read up to the first that holds `Insufficient information` or `No feedback`.
    """
    lines = F.split("raw", "\n")
    flag = lambda l: F.contains(l, F.lit("Insufficient information")) | F.contains(l, F.lit("No feedback"))
    stop = F.array_position(F.transform(lines, flag), True)
    read = F.when(stop > 0, F.slice(lines, 1, stop.cast("int"))).otherwise(lines)
    pair = F.lit(r"^[+-]?\d{1,9}:[+-]?\d{1,9}$")
    side = lambda head: F.flatten(F.transform(F.filter("read", lambda l: F.startswith(F.trim(l), F.lit(head))), lambda l: F.filter(F.split(F.trim(F.substring_index(F.trim(l), head, -1)), r"\s+"), lambda t: F.rlike(t, pair))))
    base = replies.select("q_id", read.alias("read"))
    found = base.select("q_id", F.exists("read", lambda l: F.contains(l, F.lit("Insufficient information"))).alias("insufficient"), F.exists("read", lambda l: F.contains(l, F.lit("No feedback"))).alias("no_feedback"), side("Correct:").alias("correct"), side("Error:").alias("error"))
    return found.select("q_id", "insufficient", "no_feedback", _last("correct").alias("correct"), _last("error").alias("error"))


def _last(name: str) -> Column:
    """`index:degree` tokens as sorted `index:degree` texts, the last per index."""
    split = F.transform(F.col(name), lambda t, i: F.struct(F.split(t, ":")[0].cast("int").alias("k"), i.alias("at"), F.split(t, ":")[1].cast("int").alias("d")))
    kept = F.filter(split, lambda e: ~F.exists(split, lambda o: (o["k"] == e["k"]) & (o["at"] > e["at"])))
    return F.transform(F.array_sort(kept), lambda e: F.concat_ws(":", e["k"].cast("string"), e["d"].cast("string")))


def contributions(line: Column) -> Column:
    """(id, contribution) pairs of a line; empty unless both lists have one length and the result is not empty."""
    ids = F.regexp_extract_all(line, F.lit(r"Path-based Evidence (\d+)"), F.lit(1))
    got = F.regexp_extract_all(line, F.lit(r"Contribution\[(\d+)\]"), F.lit(1))
    fine = (F.size(ids) == F.size(got)) & (F.trim(F.regexp_extract(line, r"Result\(([^)]*)\)", 1)) != "")
    return F.when(fine, F.arrays_zip(ids.alias("id"), got.alias("c"))).otherwise(F.array().cast("array<struct<id:string,c:string>>"))


def verdict(line: Column) -> Column:
    """2 partially correct, 1 correct, 0 otherwise; null for insufficient information."""
    return F.when(F.contains(F.lower(line), F.lit("insufficient information")), None).when(F.contains(line, F.lit("Partially Correct")), 2).when(F.contains(line, F.lit("Correct")), 1).otherwise(0)


def text_class(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("Insufficient information error")), "refused").when(F.contains(text, F.lit("True")), "correct").when(F.contains(text, F.lit("Error")), "error").otherwise("unknown")


def prompt_context(rows: DataFrame, text: str, order: str, label: str = "Path {i}:\t", first: int = 0) -> DataFrame:
    """q_id, context: one numbered line per row, in order."""
    head, tail = label.split("{i}")
    lines = F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t"))))
    grouped = rows.groupBy("q_id").agg(lines.alias("l"))
    return grouped.select("q_id", F.array_join(F.transform("l", lambda e, i: F.concat(F.lit(head), (i + first).cast("string"), F.lit(tail), e["t"], F.lit("\n"))), "").alias("context"))


def json_slice(text: Column) -> Column:
    """From the first brace to the last."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


EXTRACTION = "struct<entities:{},triplets:array<array<string>>>"
_LABELS = "map<string,array<string>>"


def extraction(text: Column) -> Column:
    """The parsed reply of a triple extraction, or null if it is no JSON or lacks a key. entities is a list of maps, whether the reply has one map or a list."""

    def read(both: Column) -> Column:
        one, many = both["one"], both["many"]
        entities = F.coalesce(many["entities"], F.when(one["entities"].isNotNull(), F.array(one["entities"])))
        triplets = F.coalesce(one["triplets"], many["triplets"])
        return F.when(entities.isNotNull() & triplets.isNotNull(), F.struct(entities.alias("entities"), triplets.alias("triplets")))

    # lambdas of one element each, so that a reply is cut out once and read once in each form
    parsed = F.transform(F.array(json_slice(text)), lambda body: F.struct(F.from_json(body, EXTRACTION.format(_LABELS)).alias("one"), F.from_json(body, EXTRACTION.format(f"array<{_LABELS}>")).alias("many")))
    return F.transform(parsed, read)[0]


def entity_labels(replies: DataFrame) -> DataFrame:
    """name, label of replies(ord, parsed): names and labels capitalised, a later entry overwrites."""
    maps = replies.select("ord", F.posexplode("parsed.entities").alias("at", "m"))
    pairs = maps.select("ord", "at", F.explode("m").alias("label", "names")).select("ord", "at", "label", F.posexplode("names").alias("i", "name"))
    return pairs.groupBy(capitalise(F.col("name")).alias("name")).agg(F.max_by(capitalise(F.col("label")), F.struct("ord", "at", "label", "i")).alias("label"))


def extracted_triples(replies: DataFrame) -> DataFrame:
    """head, rel, tail of all triplets of length three, capitalised."""
    triples = replies.select(F.explode("parsed.triplets").alias("t")).where(F.size("t") == 3)
    return triples.select(*(capitalise(F.col("t")[i]).alias(n) for i, n in enumerate(("head", "rel", "tail"))))


def question_lines(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, "\n"), lambda l: F.startswith(l, F.lit("Question:"))), lambda l: F.trim(F.regexp_replace(l, "^Question:", "")))


def question_answers(text: Column) -> Column:
    """(question, answers) of alternating `Question:` and `Answer:` lines, answers separated by `;;;`; pairs of lines that don't fit are skipped."""
    start = F.struct(F.lit(None).cast("string").alias("line"), F.array().cast("array<struct<question:string,answers:array<string>>>").alias("found"))

    def step(state: Column, line: Column) -> Column:
        """The first line of a pair waits for the second."""
        question, answer = F.regexp_extract(state["line"], r"Question:\s*(.*)", 1), F.regexp_extract(line, r"Answer:\s*(.*)", 1)
        fits = F.contains(state["line"], F.lit("Question:")) & F.contains(line, F.lit("Answer:"))
        pair = F.struct(F.trim(question).alias("question"), F.transform(F.split(F.trim(answer), ";;;"), lambda x: F.trim(x)).alias("answers"))
        return F.struct(
            F.when(state["line"].isNull(), line).alias("line"),
            F.when(state["line"].isNotNull() & fits, F.concat(state["found"], F.array(pair))).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(F.split(F.trim(text), "\n"), start, step, lambda s: s["found"])


NO_GROUPS = "No results matching your criteria."


def id_groups(reply: Column, sizes: Column) -> Column:
    """Id lists of a reply with a line for each group: integers below the group's size, shifted by the sizes of the groups before.

    Lines without such an id give no list, those beyond the groups are not read; the sentinel NO_GROUPS gives none.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("before"), F.array().cast("array<array<long>>").alias("groups"))

    def step(state: Column, line: Column) -> Column:
        size = F.coalesce(F.get(sizes, state["at"]), F.lit(0))
        ids = F.transform(id_list(line, size), lambda i: i + state["before"])
        return F.struct(
            (state["at"] + 1).alias("at"), (state["before"] + size).cast("long").alias("before"), F.when(F.size(ids) > 0, F.concat(state["groups"], F.array(ids))).otherwise(state["groups"]).alias("groups")
        )

    none = F.contains(reply, F.lit(NO_GROUPS))
    return F.when(none, F.array().cast("array<array<long>>")).otherwise(F.aggregate(F.split(F.trim(reply), "\n"), start, step, lambda s: s["groups"]))


def judgement(reply: Column) -> Column:
    """(numeric, verdict) of a two-line judgement; null for insufficient information, (-1, -1) where a line is missing, left over or unknown."""
    lines = F.filter(F.split(F.trim(reply), "\n"), lambda l: l != "")
    first, second = F.lower(F.get(lines, F.lit(0))), F.get(lines, F.lit(1))
    numeric = F.when(F.contains(first, F.lit("answer is numeric")), 1).when(F.contains(first, F.lit("not numeric")), 0)
    said = F.when(F.contains(second, F.lit("Partially Correct")), 2).when(F.contains(second, F.lit("Correct")), 1).when(F.contains(second, F.lit("Incorrect")), 0)
    good = (F.size(lines) == 2) & numeric.isNotNull() & said.isNotNull()
    made = F.struct(F.when(good, numeric).otherwise(-1).alias("numeric"), F.when(good, said).otherwise(-1).alias("verdict"))
    return F.when(~F.contains(F.lower(reply), F.lit("insufficient information")), made)


def filled(template: str, **fields: Column) -> Column:
    """A prompt: the template with {name} replaced by the fields, in one pass, so what a field holds is never replaced again."""
    out, rest = [], template
    while rest:
        found = min(((rest.index("{" + name + "}"), name) for name in fields if "{" + name + "}" in rest), default=None)
        if found is None:
            out.append(F.lit(rest))
            break
        out += [F.lit(rest[: found[0]]), F.coalesce(fields[found[1]], F.lit(""))]
        rest = rest[found[0] + len(found[1]) + 2 :]
    return F.concat(*out) if out else F.lit("")


def global_ids(groups: DataFrame) -> DataFrame:
    """groups(q_id, group_ord, ids, size) with ids shifted by the sizes of the groups before."""
    before = F.coalesce(F.sum("size").over(Window.partitionBy("q_id").orderBy("group_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = groups.withColumn("before", before)
    return shifted.select("q_id", "group_ord", F.transform("ids", lambda i: (i + F.col("before")).cast("long")).alias("ids"))


REASONING = "struct<Insufficient_information:boolean,Path_score:map<string,double>,Reasoning_path:string>"


def reasoning_path(raw: Column) -> Column:
    """Steps (src, rel, dst) and an error text of a reasoning reply: steps are split at runs of three or more hyphens."""
    step = lambda c: F.when(
        F.contains(c, F.lit(" -> ")),
        F.struct(F.trim(F.regexp_extract(c, r"^(.*?) - ", 1)).alias("src"), F.trim(F.regexp_extract(c, r" - (.*) -> ", 1)).alias("rel"), F.trim(F.regexp_extract(c, r" -> (.*)$", 1)).alias("dst")),
    ).otherwise(F.struct(F.trim(F.regexp_extract(c, r" - (.*)$", 1)).alias("src"), F.trim(F.regexp_extract(c, r" <- (.*?) - ", 1)).alias("rel"), F.trim(F.regexp_extract(c, r"^(.*?) <- ", 1)).alias("dst")))

    def steps(parsed: Column) -> Column:
        chunks = F.filter(F.transform(F.split(parsed["Reasoning_path"], "-{3,}"), lambda c: F.trim(c)), lambda c: c != "")
        error = (
            F.when(parsed["Insufficient_information"].isNull() | parsed["Path_score"].isNull() | parsed["Reasoning_path"].isNull(), "missing key")
            .when(F.exists(F.map_values(parsed["Path_score"]), lambda v: (v < -1) | (v > 1)), "score out of range")
            .when(parsed["Insufficient_information"] & (F.trim(parsed["Reasoning_path"]) != ""), "path despite insufficient information")
        )
        return once(error, lambda e: F.struct(F.when(e.isNull(), F.transform(chunks, step)).alias("steps"), e.alias("error")))

    return once(F.from_json(raw, REASONING), steps)
