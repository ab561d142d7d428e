"""Chat formatting in budgeted windows.

A conversation becomes one or more training texts.  Prefix sums of its turns' tokens choose
spans of whole turns that fit the budget; each later window begins with the system turn
and as many of the turns just before its span as the history limit allows.  Those repeats are
context only: the loss mask covers each assistant text once, where it is new.  A turn that is over the budget
alone gets a window of its own, whole.

Template: ``<|im_start|>role`` newline text ``<|im_end|>`` newline.  In texts and roles a backslash
doubles and ``<|`` becomes ``<\\|`` (a line break in a role: backslash n), so no text can
hold a control string, and ``read_windows`` restores every turn.

Defined results: a null text or role is empty; turns stand in order of (turn, role, text), null
turns first; a null conv_id is a conversation of its own; repeated rows are turns of
their own; empty tables give empty results; extra columns are ignored.  Rows are dealt by conversation
and streamed in order; one conversation at a time is in memory.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
#: Tokens of the marks around a turn.
MARKS = 4


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def format_conversation(turns: list[tuple[str, str]], budget: int, history: int):
    """Windows (text, repeated turns, loss starts, loss ends) of one conversation."""
    sizes = np.array([len(t.split()) + MARKS for _, t in turns], dtype=np.int64)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    blocks = []
    for role, text in turns:
        head = START + escape(role).replace("\n", "\\n") + "\n"
        body = escape(text)
        blocks.append((head + body + END + "\n", len(head), len(head) + len(body)))
    system = turns and turns[0][0] == "system"
    at = 0
    while at < len(turns):
        repeats: list[int] = []
        if at:
            if system:
                repeats.append(0)
            room = min(history, budget - int(sums[len(repeats)]) - int(sizes[at]))
            first = max(int(np.searchsorted(sums, sums[at] - max(room, 0))), len(repeats))
            repeats += range(first, at)
        used = sum(int(sizes[i]) for i in repeats)
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + budget - used, side="right")) - 1)
        text, starts, ends, size = [], [], [], 0
        for i in [*repeats, *range(at, end)]:
            block, a, b = blocks[i]
            if i >= at and turns[i][0] == "assistant":
                starts.append(size + a)
                ends.append(size + b)
            text.append(block)
            size += len(block)
        yield "".join(text), len(repeats), starts, ends
        at = end


def _by_conversation(batches, columns: list[str]):
    """(conv_id, rows) of consecutive rows with one conv_id, over batch borders."""
    now, rows, any_ = None, [], False
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", *columns)]
        for conv, *row in zip(*cols, strict=True):
            if not any_ or conv != now:
                if any_:
                    yield now, rows
                now, rows, any_ = conv, [], True
            rows.append(tuple(row))
    if any_:
        yield now, rows


WINDOWS = "conv_id long, window int, text string, repeated int, loss_starts array<int>, loss_ends array<int>"


def _record(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _batched(rows, names: list[str], types: list[pa.DataType], weight=lambda r: 1, most: int = 1 << 22):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weight(r)
        if len(held) >= 5000 or size >= most:
            yield _record(held, names, types)
            held, size = [], 0
    if held:
        yield _record(held, names, types)


def _format(batches, budget: int, history: int):
    def rows():
        for conv, turns in _by_conversation(batches, ["role", "text"]):
            for k, (text, repeated, a, b) in enumerate(format_conversation(turns, budget, history)):
                yield conv, k, text, repeated, a, b

    ints = pa.list_(pa.int32())
    yield from _batched(rows(), ["conv_id", "window", "text", "repeated", "loss_starts", "loss_ends"], [pa.int64(), pa.int32(), pa.string(), pa.int32(), ints, ints], lambda r: len(r[2]))


def format_conversations(turns: DataFrame, *, budget: int = 512, history: int = 128) -> DataFrame:
    """Windows of all conversations: conv_id, window, text, repeated (leading turns that are context only), loss spans."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(partial(_format, budget=budget, history=history), WINDOWS)


def read_windows(windows: list[tuple[str, int, list[int], list[int]]]):
    """Turns (role, text) and loss texts of a conversation from its windows, in order."""
    for text, repeated, starts, ends in windows:
        for k, m in enumerate(TURN.finditer(text)):
            if k >= repeated:
                yield "turn", unescape(m[1]), unescape(m[2])
        for a, b in zip(starts, ends, strict=True):
            yield "loss", "", unescape(text[a:b])


def _digest(batches):
    def rows():
        for conv, windows in _by_conversation(batches, ["text", "repeated", "loss_starts", "loss_ends"]):
            turns, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
            for kind, role, text in read_windows(windows):
                if kind == "turn":
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                else:
                    chars += len(text)
                    loss.update(text.encode())
            yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), sum(len(w[0]) for w in windows), len(windows)

    yield from _batched(rows(), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])


def conversation_digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from the rows of ``format_conversations`` (in their order)."""
    return windows.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
