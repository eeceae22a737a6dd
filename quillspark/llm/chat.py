r"""Chat formatting: conversations as turn-aligned windows within a token budget, with loss masks.

A turn is written as "### <role>: <text> </turn>\n"; in roles and texts the characters \, # and < are escaped by a
backslash, so no text can hold a turn's marks and unescaping restores every text exactly.

Windows: running sums of turn tokens tell how many further turns fit. The first turn, if its role is system, is repeated at
the head of every window; after the first window up to two turns of history are repeated before the new ones while at
least one new turn still fits. Repeated turns are masked: only an assistant text's first appearance is a target.
A turn that alone exceeds the budget has a window of its own (never cut), marked by over_budget.

Rows are partitioned by conversation and sorted by turn, and each partition is streamed, so that one conversation with a
third of all rows needs only the memory of a window. Defined results: a null text or role is empty; rows with a null
conv_id form one conversation; equal turns are ordered by role, then text, all kept; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

BUDGET, HISTORY = 512, 2
ESCAPE, UNESCAPE = re.compile(r"[\\#<]"), re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:[^\\#<:]|\\.|:(?! ))*): ((?:[^\\#<]|\\.)*) </turn>\n", re.S)


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def written(role: str, text: str) -> tuple[str, int, int]:
    """The turn as it is written, and where its text begins and ends in it."""
    head = f"### {escape(role).replace(': ', ':\\ ')}: "
    body = escape(text)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end of the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), *m.span(2)))
        at = m.end()
    return out


def tokens(role: str, text: str) -> int:
    """The words of a turn and its marks."""
    return len(text.encode("utf-8", "surrogatepass").split()) + len(role.split()) + 3


@dataclass
class Windower:
    """Forms the windows of one conversation as its turns arrive; holds no more turns than a window and its history."""

    budget: int = BUDGET
    history: int = HISTORY
    system: tuple | None = None
    past: list[tuple] = field(default_factory=list)  # the last turns that were given out, for repetition
    new: list[tuple] = field(default_factory=list)
    seen: int = 0
    windows: int = 0

    def add(self, turn: tuple) -> Iterator[dict]:
        """turn: (number, role, text, tokens)."""
        if self.seen == 0 and turn[1] == "system":
            self.system = turn
        self.seen += 1
        self.new.append(turn)
        if sum(t[3] for t in self.new) > self.budget:
            yield from self.close(final=False)

    def close(self, final: bool = True) -> Iterator[dict]:
        """Windows over the waiting turns; unless final, the last turns wait on, as more may fit."""
        while self.new:
            head = [self.system] if self.windows and self.system else []
            room = self.budget - sum(t[3] for t in head)
            sums = np.cumsum([t[3] for t in self.new])
            past = self.past[-self.history :] if self.history else []
            while past and sum(t[3] for t in past) + sums[0] > room:
                past = past[1:]
            room -= sum(t[3] for t in past)
            fit = max(1, int(np.searchsorted(sums, room, "right")))
            if fit == len(self.new) and not final and sums[-1] <= room:
                return
            yield self.window(head + past, self.new[:fit], bool(sums[fit - 1] > room))
            self.past = [t for t in [*self.past, *self.new[:fit]] if t is not self.system][-max(self.history, 1) :]
            self.new = self.new[fit:]

    def window(self, old: list[tuple], new: list[tuple], over: bool) -> dict:
        parts, mask, at = [], [], 0
        for i, (_, role, text, _) in enumerate([*old, *new]):
            part, start, end = written(role, text)
            if i >= len(old) and role == "assistant":
                mask.append({"start": at + start, "end": at + end})
            parts.append(part)
            at += len(part)
        self.windows += 1
        return {"window": self.windows - 1, "formatted": "".join(parts), "loss_spans": mask, "repeated_turns": len(old), "first_turn": new[0][0], "new_turns": len(new), "n_tokens": sum(t[3] for t in [*old, *new]), "over_budget": over}


WINDOW_FIELDS = [("window", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("repeated_turns", pa.int64()), ("first_turn", pa.int64()), ("new_turns", pa.int64()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_())]
SCHEMA = pa.schema([("conv_id", pa.int64()), *WINDOW_FIELDS])
DDL = "conv_id long, window long, formatted string, loss_spans array<struct<start: long, end: long>>, repeated_turns long, first_turn long, new_turns long, n_tokens long, over_budget boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def format_batches(batches: Iterator[pa.RecordBatch], budget: int, history: int) -> Iterator[pa.RecordBatch]:
    turns = ((c, r or "", t or "") for b in batches for c, r, t in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True))
    rows: list[dict] = []
    for conv_id, own in groupby(turns, key=lambda t: t[0]):
        windower = Windower(budget, history)
        for number, (_, role, text) in enumerate(own):
            rows += [{"conv_id": conv_id} | w for w in windower.add((number, role, text, tokens(role, text)))]
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                rows = []
        rows += [{"conv_id": conv_id} | w for w in windower.close()]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, SCHEMA)


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The windows of all conversations, by conversation in order within each partition: conv_id, window, formatted,
    loss_spans (code points of formatted under the loss), repeated_turns, first_turn, new_turns, n_tokens, over_budget."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.drop("turn").mapInArrow(lambda it: format_batches(it, budget, history), DDL)


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the windows hold, read back from them: a row for each conversation."""
    windows = ((c, f, m or [], n) for b in batches for c, f, m, n in zip(*(b.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_spans", "repeated_turns")), strict=True))
    rows = []
    for conv_id, own in groupby(windows, key=lambda w: w[0]):
        turns, loss, n_turns, loss_chars, chars, n = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
        for _, formatted, mask, repeated in own:
            n += 1
            chars += len(formatted)
            for role, text, _, _ in read_back(formatted)[repeated:]:
                turns.update(f"{role}\n{text}\n".encode())
                n_turns += 1
            for span in mask:
                target = unescape(formatted[span["start"] : span["end"]])
                loss.update(target.encode())
                loss_chars += len(target)
        rows.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n))
    if rows:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in k else pa.int64()) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names)


CONTROL = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = store.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return format_conversations(turns.unionByName(more)).mapInArrow(digest_batches, DIGESTS)


