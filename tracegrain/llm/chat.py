"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of whole turns. Prefix sums of turn
tokens choose the spans: a window ends before the turn that would exceed the
budget. Later windows start with the system turn and a limited stretch of the
turns before them; repeated turns are masked, so every assistant text is a
target exactly once.

Turns are written as ``### role: text</turn>``. A backslash before ``\\``, ``#``
and ``<`` (and ``:`` in roles) keeps control strings inside texts apart from the
template, reversibly.

Rows stream through each task in order of conversation and turn; a task holds
no more than one window and its history.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a window, of repeated history, and of a turn's marks.
BUDGET, HISTORY, MARKS = 1024, 256, 4
#: A token is a word or a mark; a word counts once for every ``WORD_CHARS`` characters it begins, as vocabularies split longer ones.
WORD_CHARS, TOKEN = 6, re.compile(r"\w+|[^\w\s]")
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)
WINDOW = "conv_id long, window long, n_repeated int, tokens long, text string, loss array<struct<start:int,stop:int>>"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def escape(text: str, role: bool = False) -> str:
    return re.sub(r"[\\#<:]" if role else r"[\\#<]", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def tokens(role: str, text: str) -> int:
    return MARKS + sum(-(-(m.end() - m.start()) // WORD_CHARS) for part in (role, text) for m in TOKEN.finditer(part))


class Windows:
    """The windows of one conversation, turn by turn."""

    def __init__(self, conv_id, budget: int = BUDGET, history: int = HISTORY):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system = None
        self.before: deque = deque()  # history of the current window
        self.now: list = []
        self.prefix = [0]  # sums over the turns of the current window
        self.used, self.n = 0, 0  # tokens of repeated turns; windows so far

    def add(self, role: str, text: str):
        """Take a turn; returns the window that it closes, if any."""
        cost, closed = tokens(role, text), None
        if self.now and self.used + self.prefix[-1] + cost > self.budget:
            closed = self.close()
            past = [*self.before, *self.now]
            system = self.system[2] if self.system else 0
            room = min(self.history, self.budget - system - cost)
            self.before.clear()
            held = 0
            for turn in reversed(past):
                if turn is self.system or held + turn[2] > room:
                    break
                held += turn[2]
                self.before.appendleft(turn)
            self.now, self.prefix, self.used = [], [0], system + held
        turn = (role, text, cost)
        if role == "system" and self.n == 0 and not self.now and self.system is None:
            self.system = turn
        self.now.append(turn)
        self.prefix.append(self.prefix[-1] + cost)
        return closed

    def close(self) -> dict:
        repeated = [*([self.system] if self.n and self.system else []), *self.before]
        out, loss, at = [], [], 0
        for i, (role, text, _) in enumerate([*repeated, *self.now]):
            head, body = f"### {escape(role, True)}: ", escape(text)
            if role == "assistant" and i >= len(repeated):
                loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
            out.append(f"{head}{body}</turn>\n")
            at += len(out[-1])
        row = {"conv_id": self.conv_id, "window": self.n, "n_repeated": len(repeated), "tokens": self.used + self.prefix[-1], "text": "".join(out), "loss": loss}
        self.n += 1
        return row


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "window": pa.int64(), "n_repeated": pa.int32(), "tokens": pa.int64(), "text": pa.string(), "loss": _LOSS}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], names=list(kinds))


def format_windows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a window: conv_id, window, n_repeated, tokens, text and loss (character spans).

    Null texts and roles are empty. Rows without a conversation id are one
    conversation; turns are ordered by turn (null first), role, text, and a
    repeated row is a turn of its own. A turn above the budget has a window to
    itself and stays whole. An empty table gives no windows.
    """

    def run(batches):
        current, key, rows, held = None, None, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for conv, role, text in zip(*(part.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                    if current is None or conv != key:
                        if current is not None:
                            rows.append(current.close())
                        current, key = Windows(conv, budget, history), conv
                    if closed := current.add(role, text):
                        rows.append(closed)
                    held += len(text)
                    if held > 1_000_000 and rows:
                        yield _batch(rows)
                        rows, held = [], 0
        if current is not None:
            rows.append(current.close())
        if rows:
            yield _batch(rows)

    turns = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, WINDOW)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    found, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


def digests(windows: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its windows, which stream by in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        key, state, rows = None, None, []

        def close():
            rows.append((key, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]))

        def pack():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if "sha" in c else pa.int64()) for i, c in enumerate(names)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                for conv, repeated, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n_repeated", "text", "loss")), strict=True):
                    if state is None or conv != key:
                        if state is not None:
                            close()
                        key, state = conv, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                    for role, said in parse(text)[repeated:]:
                        state["n"] += 1
                        state["turns"].update(f"{role}\n{said}\n".encode("utf-8"))
                    for span in loss:
                        target = unescape(text[span["start"] : span["stop"]])
                        state["chars"] += len(target)
                        state["loss"].update(target.encode("utf-8"))
                    state["size"] += len(text)
            if rows:
                yield pack()
                rows.clear()
        if state is not None:
            close()
            yield pack()

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
