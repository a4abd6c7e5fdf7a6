"""Chat formatting from an event log.

The log has one row per event (conv_id, turn, message, seq, kind, role, payload). Kinds: `start`
opens a message and gives its role, `delta` appends its payload, `edit` replaces all text so far by
its payload, `regenerate` drops all text so far and begins again with its payload. A message's
events are folded in order of seq; ties of seq go by kind and payload, so the result does not
depend on row order. Messages of a conversation are ordered by turn, ties by their rendered segment.

Rendering: `<|im_start|>role`, line feed, text, `<|im_end|>`, line feed. A control string inside a
text or role gets a backslash after its first character (one more, if it has some), which `unescape`
takes away; so no text can open or close a turn and every text can be read back. The loss mask is
the span of each assistant text.

Null texts, roles and payloads are empty; rows with a null conv_id form one conversation. Repeated
rows are messages of their own. An empty log gives an empty result; further columns are not used.
A message is folded in one group; a conversation is only ever streamed, in order, never collected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import column

#: Strings that steer chat templates.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
DELTA_CHARS = 512
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = rf"([<\[])(\\*)({_TAILS})"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ROLE = re.compile(r"\\(.)", re.S)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def unescape_role(text: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def turns_to_events(turns: DataFrame, delta_chars: int = DELTA_CHARS, revisions: bool = False) -> DataFrame:
    """The log that streaming each row of turns(conv_id, turn, role, text) would have left.

    With revisions, a quarter of the messages are regenerated after half a draft and a quarter are edited
    into their text, chosen by hash.
    """
    text = F.coalesce("text", F.lit(""))
    start = F.array(F.struct(F.lit("start").alias("kind"), F.lit("").alias("payload")))
    deltas = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0)), lambda p: F.struct(F.lit("delta").alias("kind"), p.alias("payload")))
    if revisions:
        event = lambda kind, payload: F.struct(F.lit(kind).alias("kind"), payload.alias("payload"))
        half, which = F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
        redone = F.concat(F.array(event("delta", half), event("regenerate", F.lit(""))), deltas)
        deltas = F.when(which == 1, redone).when(which == 2, F.array(event("delta", half), event("edit", text))).otherwise(deltas)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.monotonically_increasing_id().alias("message"), F.concat(start, deltas).alias("events"))
    return rows.select("conv_id", "turn", "message", "role", F.posexplode("events").alias("seq", "event")).select("conv_id", "turn", "message", "seq", "event.kind", "role", "event.payload")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, message, role, text)."""
    event = F.struct("seq", "kind", F.coalesce("payload", F.lit("")).alias("payload"))
    resets = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq")))
    found = events.groupBy("conv_id", "message").agg(
        F.min("turn").alias("turn"),
        F.coalesce(F.max(F.when(F.col("kind") == "start", F.col("role"))), F.max("role"), F.lit("")).alias("role"),
        F.array_sort(F.collect_list(event)).alias("log"),
        resets.alias("reset"),
    )
    kept = F.filter("log", lambda e: F.col("reset").isNull() | (e.seq >= F.col("reset")))
    return found.select("conv_id", "turn", "message", "role", F.array_join(F.transform(kept, lambda e: e.payload), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One rendered segment per message with its loss span (in characters of the segment; length 0 if it has none).

    The concatenation of a conversation's segments, in order of turn and then segment, is its rendering.
    """
    role = F.coalesce("role", F.lit(""))
    name = escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))
    body = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), name, F.lit("\n"))
    return messages.select(
        "conv_id", "turn", "message",
        F.concat(head, body, F.lit(CLOSE)).alias("segment"),
        F.length(head).alias("loss_start"),
        F.when(role == "assistant", F.length(body)).otherwise(0).alias("loss_length"),
    )


def format_conversations(events: DataFrame) -> DataFrame:
    return render(fold(events))


class _Reader:
    """Reads a conversation back from its segments as they come."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, length: int) -> None:
        for role, text in _TURN.findall(segment):
            self.turns += 1
            self.all.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
        masked = unescape(segment[start : start + length])
        self.chars += len(segment)
        self.loss_chars += len(masked)
        self.loss.update(masked.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(segments: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, taken from the rendering alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv, *rest in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_length")), strict=True):
                if now is None or now.conv_id != conv:
                    if now:
                        done.append(now.row())
                    now = _Reader(conv)
                now.add(*rest)
            if len(done) >= 5_000:
                yield table(done)
                done = []
        if now:
            yield table([*done, now.row()])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment", "message")
    return ordered.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
