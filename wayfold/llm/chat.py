"""Chat formatting with any template, treated as a black box from turns to text.

Successive prefixes of a conversation are rendered and consecutive outputs compared: what a prefix adds is the
span of its last turn, and an output that does not begin with the one before shows a template that rewrites
history. Where in its span a turn's own text stands is found by rendering it with two probe texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]


def escape(text: str) -> str:
    """No `<` of a text can begin a control string, and it can be undone exactly."""
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def _escape_role(role: str) -> str:
    return escape(role).replace(">", "\\>").replace("\n", "\\n")


def turn_template(turns: list[Turn]) -> str:
    """The default template: each turn between `<turn role>` and `</turn>` on lines of their own."""
    return "".join([f"<turn {_escape_role(role)}>\n{escape(text)}\n</turn>\n" for role, text in turns])


_TURN = re.compile(r"<turn ((?:\\.|[^\\<>])*)>\n((?:\\.|[^\\<])*)\n</turn>\n", re.S)


def parse_turns(formatted: str) -> list[Turn]:
    """Roles and texts of what `turn_template` wrote; anything else is refused."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@dataclass
class Formatted:
    text: str
    #: [start, end) of each turn; None if the template rewrites history.
    turns: list[tuple[int, int]] | None
    #: [start, end) of the texts under the loss mask, in order.
    loss: list[tuple[int, int]]


def _same_start(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def locate(render: Render, turns: list[Turn], learned: str = "assistant") -> Formatted:
    """Render prefix after prefix; spans of turns, and of the texts of role `learned`."""
    spans: list[tuple[int, int]] = []
    loss: list[tuple[int, int]] = []
    before = render([])
    for k, (role, _) in enumerate(turns):
        now = render(turns[: k + 1])
        if not now.startswith(before):
            return Formatted(render(turns), None, [])
        spans.append((len(before), len(now)))
        if role == learned:
            one, other = (render([*turns[:k], (role, probe)]) for probe in ("a", "b"))
            start = _same_start(one, other)
            loss.append((start, len(now) - (len(one) - start - 1)))
        before = now
    return Formatted(before, spans, loss)


def format_conversations(rows: DataFrame, render: Render = turn_template, learned: str = "assistant") -> DataFrame:
    """conv_id, formatted (text), spans and loss (arrays of [start, end) in code points), rewrites_history.

    Rows are (conv_id, turn, role, text); a conversation's rows are taken by turn, then role and text, nulls
    first, and repeated rows are turns of their own. A null role or text is empty; rows of a null conv_id are
    one conversation. An empty table gives no rows; other columns are ignored. The rows are dealt by conv_id
    and sorted, and stream through; a worker holds one conversation, which is also one value of the result.
    """
    schema = "conv_id long, formatted string, spans array<struct<start:int,end:int>>, loss array<struct<start:int,end:int>>, rewrites_history boolean"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kind = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", span), ("loss", span), ("rewrites_history", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lambda spans: [{"start": a, "end": b} for a, b in spans or []]

        def done(conv: int | None, turns: list[Turn]) -> dict:
            f = locate(render, turns, learned)
            return {"conv_id": conv, "formatted": f.text, "spans": at(f.turns), "loss": at(f.loss), "rewrites_history": f.turns is None}

        out, conv, turns, size = [], None, [], 0
        for batch in batches:
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and key != conv:
                    out.append(done(conv, turns))
                    size += len(out[-1]["formatted"])
                    turns = []
                conv = key
                turns.append((role or "", text or ""))
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out, size = [], 0
        if turns:
            out.append(done(conv, turns))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    dealt = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the default template's output says, from that output and its loss mask alone."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text = row["formatted"]
                turns = parse_turns(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in row["loss"])
                rows.append((row["conv_id"], len(turns), _sha(said), len(learned), _sha(learned), len(text), row["rewrites_history"]))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return formatted.mapInArrow(run, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
