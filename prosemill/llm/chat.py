"""Chat formatting whose output reads back to the turns it was made from.

The grammar of a formatted conversation:

    conversation = { turn }
    turn         = "<|im_start|>" role newline text "<|im_end|>" newline

``parse`` is its deterministic reader: a role ends at the first newline, a text at the first end mark, and one level of
escaping is undone in each. ``render`` formats a turn plainly, parses it, and compares. Only if the turn does not come
back identical is a level of escaping added, until it does. A backslash is put into each of a text's "<|", behind those
already there; in a role, newlines and "<" become escapes too. So texts without control strings stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
OPENING, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
ROLE_ESCAPES = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
ROLE_PLAIN = {v: k for k, v in ROLE_ESCAPES.items()}


def escape_text(text: str) -> str:
    return OPENING.sub(r"<\\\1|", text)


def unescape_text(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\\n<]", lambda m: ROLE_ESCAPES[m[0]], role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\[\\nl]", lambda m: ROLE_PLAIN[m[0]], role)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns as (role, text, first, end): first and end of the text as it stands. ValueError if the grammar is broken."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line, end = formatted.find("\n", at), -1
        if line >= 0:
            end = formatted.find(END, line + 1)
        if end < 0 or not formatted.startswith("\n", end + len(END)):
            raise ValueError(f"the turn at {at} has no end")
        turns.append((unescape_role(formatted[at + len(START) : line]), unescape_text(formatted[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """One formatted turn, and where its text begins and ends in it."""
    for role_form, text_form in ((role, text), (role, escape_text(text)), (escape_role(role), text), (escape_role(role), escape_text(text))):
        formatted = f"{START}{role_form}\n{text_form}{END}\n"
        try:
            turns = parse(formatted)
        except ValueError:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return formatted, *turns[0][2:]
    raise AssertionError("a turn escaped in full reads back")


def render_all(loss_role: str, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, masks = [], []
            for turns in batch.column("turns").to_pylist():
                parts, mask, at = [], [], 0
                for turn in turns:
                    role = turn["role"] or ""
                    formatted, first, end = render(role, turn["text"] or "")
                    if role == loss_role:
                        mask.append({"start": at + first, "end": at + end})
                    parts.append(formatted)
                    at += len(formatted)
                texts.append("".join(parts))
                masks.append(mask)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(texts, pa.string()), pa.array(masks, pa.list_(span))], names=["conv", "formatted", "loss_spans"])

    return run


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """A row for each conversation: id_col, formatted, and loss_spans: where in it, by code point, the loss counts.

    Turns stand in the order of turn_col, then role, then text (nulls first), so ties have an order; a row that the table
    holds twice is two turns. A null role or text is empty. Rows with a null id are one conversation. The loss covers the
    texts of loss_role, without their marks. Other columns are left out, so no name can clash; no rows give no rows.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    grouped = turns.groupBy(F.col(id_col).alias("conv")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    kind = turns.schema[id_col].dataType
    done = grouped.mapInArrow(render_all(loss_role, None), f"conv {kind.simpleString()}, formatted string, loss_spans array<struct<start: long, end: long>>")
    return done.withColumnRenamed("conv", id_col)


def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    for batch in batches:
        turns, losses = [], []
        for formatted, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            turns.append([{"role": role, "text": text} for role, text, _, _ in parse(formatted)])
            losses.append([unescape_text(formatted[s["start"] : s["end"]]) for s in mask])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("formatted"), pa.array(turns, pa.list_(turn)), pa.array(losses, pa.list_(pa.string()))], names=["conv", "formatted", "turns", "loss_texts"])


def read_conversations(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What format_conversations wrote, read back: id_col, formatted, turns (role, text) and loss_texts."""
    kind = formatted.schema[id_col].dataType.simpleString()
    return (
        formatted.select(F.col(id_col).alias("conv"), "formatted", "loss_spans")
        .mapInArrow(read_all, f"conv {kind}, formatted string, turns array<struct<role: string, text: string>>, loss_texts array<string>")
        .withColumnRenamed("conv", id_col)
    )
