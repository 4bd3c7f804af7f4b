"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole: for each turn ``<turn ROLE>TEXT</turn>`` and a line
end. In texts (and roles) every backslash, and every ``<`` that begins ``<turn`` or
``</turn``, gets a backslash before it (in roles ``>`` as well), so no text can be read
as a control string and ``unescape`` gives back what was there.

The rendered string is encoded once; as byte-level ids stand for bytes, their lengths added
up are the offsets. The spans of the assistant's texts and the spans of tokens are both
sorted; binary search finds for each turn the tokens that meet it. These are under the loss
mask, and ``loss_spans`` keeps the part of each that lies within the turn, in code points, so
a token across a border never brings in the template.

Turns are ordered by ``turn`` (null first; ties by role, then text); equal rows are
separate turns. Null text or role: empty. A null conversation id is one conversation.
Conversations are streamed in order through each task, one in memory at a time: a
conversation is one sequence. Only the four columns named are read, so others may be called
anything. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm import tokens

ASSISTANT = "assistant"
_ESCAPE, _ESCAPE_ROLE = re.compile(r"\\|<(?=/?turn)"), re.compile(r"[\\>]|<(?=/?turn)")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:\\.|[^\\>])*)>((?:\\.|(?!</turn>)[^\\])*)</turn>\n", re.S)


def escape(text: str, role: bool = False) -> str:
    return (_ESCAPE_ROLE if role else _ESCAPE).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {escape(role, True)}>", escape(text)
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        piece = f"{head}{body}</turn>\n"
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a formatted conversation at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def align(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The mask over tokens, and the parts of the string under it, in order."""
    mask = np.zeros(len(offsets), bool)
    under: list[tuple[int, int]] = []
    if not len(offsets):
        return mask, under
    start, end = offsets[:, 0], offsets[:, 1]
    for s, e in spans:
        lo, hi = int(np.searchsorted(end, s, "right")), int(np.searchsorted(start, e, "left"))
        if s == e or lo >= hi:
            continue
        mask[lo:hi] = True
        a, b = np.maximum(start[lo:hi], s), np.minimum(end[lo:hi], e)
        gap = np.flatnonzero(a[1:] > np.maximum.accumulate(b)[:-1])  # tokens of parts of a character overlap
        for i, j in zip([0, *(gap + 1).tolist()], [*(gap + 1).tolist(), len(a)], strict=True):
            under.append((int(a[i]), int(b[i:j].max())))
    return mask, under


def loss_text(formatted: str, under: list[tuple[int, int]]) -> str:
    return "".join(unescape(formatted[s:e]) for s, e in under)


def format_conversations(turns: DataFrame, path: str, *, id: str = "conv_id") -> DataFrame:
    """``conv_id, formatted, input_ids, loss_mask, loss_spans``, a row for each conversation."""
    rows = turns.select(F.col(f"`{id}`").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def rendered(groups: list[tuple[int | None, list[tuple[str, str]]]]) -> pa.RecordBatch:
        texts, spans = zip(*(render(g) for _, g in groups), strict=True)
        coded = tokens.encode(path, list(texts))
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum()))
        lengths, at = tokens.byte_lengths(path)[ids], np.concatenate([[0], np.cumsum(sizes)])
        masks, parts = np.zeros(len(ids), bool), []
        for i, (text, s) in enumerate(zip(texts, spans, strict=True)):
            raw = np.frombuffer(text.encode(), np.uint8)
            # where each code point begins, and which one a byte belongs to
            begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            end = np.cumsum(lengths[at[i] : at[i + 1]])
            mask, under = align(np.stack([end - lengths[at[i] : at[i + 1]], end], 1), [(int(begins[a]), int(begins[b])) for a, b in s])
            masks[at[i] : at[i + 1]] = mask
            parts.append([{"start": int(a), "end": int(b)} for a, b in np.searchsorted(begins, np.array(under, np.int64).reshape(-1, 2))])
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (ids, masks)]
        return pa.record_batch([pa.array([g[0] for g in groups], pa.int64()), pa.array(texts), *lists, pa.array(parts, span)], ["conv_id", "formatted", "input_ids", "loss_mask", "loss_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[int | None, list[tuple[str, str]]]] = []
        size, now, begun = 0, None, False
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not begun or conv != now:
                    if ready and size > 1 << 20:
                        yield rendered(ready)
                        ready, size = [], 0
                    ready.append((conv, []))
                    now, begun = conv, True
                ready[-1][1].append((role, text))
                size += len(text)
        if ready:
            yield rendered(ready)

    return rows.mapInArrow(run, "conv_id long, formatted string, input_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start: int, end: int>>")
