"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Successive prefixes of a conversation are
rendered; the text that a turn adds to the output before it is the turn's span. A template whose longer output does not
start with the shorter one rewrites history; such a conversation is marked and has no spans, so no loss mask. The loss
mask too comes from renderings alone: an assistant turn is rendered with two other texts, and what those have in common
is the template's. A template that strips a text gives the mask of what is left of it.

The template here marks turns with control strings and escapes those strings inside texts reversibly. A NULL text is
empty, a NULL role is the empty role, turns with equal numbers are ordered by role and text, repeated rows are turns of
their own, and a table without rows gives no conversations. A conversation is one output string, so its turns meet in one row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]


def escape(text: str) -> str:
    r"""No `<|` stays in the result: a backslash doubles, and one goes between `<` and `|`."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    out, at = [], 0
    while (i := text.find("\\", at)) >= 0:
        out.append(text[at:i])
        if text[i + 1 : i + 2] == "\\":
            out.append("\\")
        elif text[i + 1 : i + 2] == "|":
            out.append("|")
        else:
            raise ValueError(f"escape at {i}")
        at = i + 2
    return "".join([*out, text[at:]])


def chat_template(turns: Turns) -> str:
    return "".join(f"{OPEN}{escape(role)}\n{escape(text)}{CLOSE}\n" for role, text in turns)


def read_back(formatted: str) -> Turns:
    """The turns of an output of `chat_template`."""
    turns = []
    for part in formatted.split(OPEN)[1:]:
        body = part[: part.index(CLOSE)]
        role, _, text = body.partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


def turn_spans(turns: Turns, template: Template = chat_template) -> tuple[str, list[tuple[int, int]] | None]:
    """The whole output and each turn's (begin, end) in it; None for spans if the template rewrites history."""
    done, spans = "", []
    for n in range(1, len(turns) + 1):
        now = template(turns[:n])
        if not now.startswith(done):
            return template(turns), None
        spans.append((len(done), len(now)))
        done = now
    return done, spans


# Two texts that share no character, so what two renderings with them have in common is the template's own.
MARKERS = ("\ue000", "\ue001")


def _common(a: str, b: str, backwards: bool = False) -> int:
    """Length of the common beginning (or end) of two strings."""
    if backwards:
        a, b = a[::-1], b[::-1]
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def loss_spans(turns: Turns, spans: list[tuple[int, int]], template: Template = chat_template) -> list[tuple[int, int]] | None:
    """Inside each assistant turn, the part that its text became, found by rendering the turn with other texts.

    What stays when the text changes is the template's: the part before the text and the part behind it. None if the turn
    does not begin and end with them, so that the text's place cannot be told."""
    out = []
    for n, ((role, _), (begin, end)) in enumerate(zip(turns, spans)):
        if role != "assistant":
            continue
        one, two = (template([*turns[:n], (role, m)]) for m in MARKERS)
        now = template(turns[: n + 1])
        head = _common(one, two)
        tail = _common(one[head:], two[head:], backwards=True)
        if not (begin <= head and head + tail <= len(now) == end and now[:head] == one[:head] and now.endswith(one[len(one) - tail :])):
            return None
        out.append((head, end - tail))
    return out


def format_conversations(rows: DataFrame, template: Template = chat_template) -> DataFrame:
    """(conv_id, formatted, spans, loss_spans, rewrites) from rows of (conv_id, turn, role, text).

    loss_spans is NULL where the template hides the place of an assistant text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pair = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans, losses, rewrites = [], [], [], [], []
            for conv, turns in zip(batch.column(0), batch.column(1)):
                pairs = [(t["role"], t["text"]) for t in turns.as_py()]
                formatted, found = turn_spans(pairs, template)
                ids.append(conv.as_py())
                texts.append(formatted)
                rewrites.append(found is None)
                spans.append([{"begin": a, "end": b} for a, b in found or []])
                places = loss_spans(pairs, found, template) if found else []
                losses.append(None if places is None else [{"begin": a, "end": b} for a, b in places])
            yield pa.record_batch(
                [pa.array(ids, type=pa.int64()), pa.array(texts, type=pa.string()), pa.array(spans, type=pair), pa.array(losses, type=pair), pa.array(rewrites, type=pa.bool_())],
                names=["conv_id", "formatted", "spans", "loss_spans", "rewrites"],
            )

    places = "array<struct<begin:long,end:long>>"
    return talks.select(F.col("conv_id").cast("long"), "turns").mapInArrow(render, f"conv_id long, formatted string, spans {places}, loss_spans {places}, rewrites boolean")


def digests(formatted: DataFrame) -> DataFrame:
    """What the output and its loss mask hold, read back from the output alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, losses in zip(*(batch.column(i).to_pylist() for i in range(3))):
                turns = read_back(text)
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in losses or [])
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append(
                    {
                        "conv_id": conv,
                        "n_turns": len(turns),
                        "turns_sha256": hashlib.sha256(said.encode()).hexdigest(),
                        "loss_chars": len(loss),
                        "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                        "formatted_chars": len(text),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(read, kinds)
