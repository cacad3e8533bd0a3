"""Chat formatting with a black-box template, rendered turn by turn to locate each turn."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]

#: Control strings of the default template; inside texts their first character is escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_FIRST = {"<": r"\l", "[": r"\b"}
_BACK = {r"\\": "\\", r"\l": "<", r"\b": "["}
_ESCAPED = re.compile(r"\\[\\lb]")
#: Probe for a text's place: a private-use character that stands in for it.
PROBE = "\ue000"


def escape(text: str) -> str:
    """Backslashes are doubled, and a control string's first character becomes a backslash and a letter."""
    return _CONTROL.sub(lambda m: _FIRST[m[0][0]] + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[0]], text)


def render(turns: list[Turn]) -> str:
    """The default template: one mark pair for each kind of turn; texts and other roles' names are escaped."""
    out = []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"<s>[INST]{body}[/INST]")
        elif role == "assistant":
            out.append(f" {body}</s>")
        elif role == "system":
            out.append(f"<<SYS>>{body}<</SYS>>")
        else:
            out.append(f"<<ROLE>>{escape(role)}<</ROLE>>{body}<</TURN>>")
    return "".join(out)


def parse(span: str) -> Turn:
    """Role and text of one rendered turn of the default template."""
    if span.startswith("<s>[INST]"):
        return "user", unescape(span[9:-7])
    if span.startswith("<<SYS>>"):
        return "system", unescape(span[7:-8])
    if span.startswith("<<ROLE>>"):
        role, _, text = span[8:-9].partition("<</ROLE>>")
        return unescape(role), unescape(text)
    return "assistant", unescape(span[1:-4])


@dataclass
class Rendered:
    output: str
    spans: list[tuple[int, int]]  # of each turn in the output
    rewrites: list[int]  # turns that changed what was rendered before them


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def incremental(template: Render, turns: list[Turn]) -> Rendered:
    """Render every prefix of the turns; what a turn adds to the output before it is its span.

    A template rewrites history where a prefix's output does not begin with the one before; spans from there on
    start at the first difference, and the turn is named in ``rewrites``.
    """
    before = template([])
    spans, rewrites = [], []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if now.startswith(before):
            spans.append((len(before), len(now)))
        else:
            rewrites.append(k - 1)
            spans.append((_common(before, now), len(now)))
        before = now
    return Rendered(before, spans, rewrites)


def text_span(template: Render, turns: list[Turn], k: int, span: tuple[int, int]) -> tuple[int, int]:
    """Where turn k's text stands in the output, from renderings with a probe and with nothing in its place."""
    role = turns[k][0]
    probed, empty = template([*turns[:k], (role, PROBE)]), template([*turns[:k], (role, "")])
    start = probed.index(PROBE, span[0])
    return start, span[1] - (len(empty) - start)


SCHEMA = "conv_id long, n_turns long, output string, turns array<struct<role:string,text:string,start:long,end:long>>, loss array<struct<start:long,end:long>>, rewrites array<long>"


def format_chats(conversations: DataFrame, template: Render = render, read: Callable[[str], Turn] = parse, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: the formatted output, its turns read back from it, loss spans, rewriting turns.

    Rows of a conversation are ordered by turn, then role, then text (nulls first); repeated rows are turns of their
    own. A null text or role is empty. Rows with a null conv_id form one conversation. Spans are in code points. Text
    spans are checked against the turn; a template that rewrites history has its turns listed in ``rewrites``, and no
    loss spans. A conversation is rendered in one task: its own turns bound it. Extra columns are ignored; an empty
    table gives an empty table.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("rows"))
    schema = T.StructType.fromDDL(SCHEMA)
    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = (pa.int64(), pa.int64(), pa.string(), turn_type, span_type, pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for conv_id, rows in zip(batch.column("conv_id").to_pylist(), batch.column("rows"), strict=True):
                turns = [(r["role"], r["text"]) for r in rows.as_py()]
                got = incremental(template, turns)
                back, loss = [], []
                for k, (start, end) in enumerate(got.spans if not got.rewrites else ()):
                    role, text = read(got.output[start:end])
                    back.append({"role": role, "text": text, "start": start, "end": end})
                    if role in loss_roles:
                        a, b = text_span(template, turns, k, (start, end))
                        loss.append({"start": a, "end": b})
                for column, value in zip(out, (conv_id, len(turns), got.output, back, loss, got.rewrites), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=schema.names)

    return grouped.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, from the output's own spans."""
    schema = T.StructType.fromDDL("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, output, turns, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "output", "turns", "loss")), strict=True):
                told = "".join(f"{t['role']}\n{t['text']}\n" for t in turns)
                learnt = "".join(unescape(output[x["start"] : x["end"]]) for x in loss)
                sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (told, learnt)]
                rows.append((conv_id, len(turns), sha[0], len(learnt), sha[1], len(output)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return formatted.select("conv_id", "output", "turns", "loss").mapInArrow(run, schema)
