"""Undo and redo of a session's changes: a stack of what was before, STEPS deep, and one of what was undone, which a new change clears.

Commands are (session, seq, command, value): a `change` to a value, an `undo` or a `redo`; others change nothing. Every command gives a row: the session's value after it,
how deep both stacks are, and whether it did anything. The batch form streams over partitions sorted by session and keeps two stacks, whatever a
session's length; the stream keeps the same in state. Rows of a null session or seq are no commands; of one seq the first by (command, value) counts, so a replayed row changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STEPS = 30
OUTPUT = "session string, seq long, value string, undo int, redo int, done boolean"
_STATE = "undo array<string>, redo array<string>, value string, last long"


@dataclass
class Stacks:
    undo: list = field(default_factory=list)
    redo: list = field(default_factory=list)
    value: str | None = None
    last: int | None = None

    def take(self, command: str | None, value: str | None, steps: int = STEPS) -> bool:
        if command == "change":
            self.undo, self.redo, self.value = [*self.undo, self.value][-steps:], [], value
            return True
        source, target = (self.undo, self.redo) if command == "undo" else (self.redo, self.undo)
        if command not in ("undo", "redo") or not source:
            return False
        target.append(self.value)
        self.value = source.pop()
        return True


def _none(x: object) -> object:
    return None if x is None or x is pd.NA or x != x else x


def _run(stacks: Stacks, session: str, rows: pd.DataFrame, out: list) -> None:
    for seq, command, value in zip(rows["seq"], rows["command"], rows["value"]):
        if stacks.last is None or seq > stacks.last:
            done = stacks.take(_none(command), _none(value))
            stacks.last = int(seq)
            out.append((session, stacks.last, stacks.value, len(stacks.undo), len(stacks.redo), done))


_NAMES = [c.split(" ")[0] for c in OUTPUT.split(", ")]


def history(commands: DataFrame) -> DataFrame:
    """Batch form: session, seq, value, undo, redo, done."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, stacks = None, Stacks()
        for f in frames:
            out: list = []
            for s, rows in f.groupby("session", sort=False):
                if s != session:
                    session, stacks = s, Stacks()
                _run(stacks, s, rows, out)
            yield pd.DataFrame(out, columns=_NAMES)

    order = ["session", "seq", "command", "value"]
    c = commands.selectExpr("cast(session as string) session", "cast(seq as long) seq", "command", "cast(value as string) value").where("session is not null and seq is not null")
    return c.repartition("session").sortWithinPartitions(*order).mapInPandas(fold, OUTPUT)


class _History(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stacks", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stacks = Stacks()
        if self.state.exists():
            undo, redo, value, last = self.state.get()
            stacks = Stacks(list(undo), list(redo), value, last)
        every = pd.concat(list(rows)).sort_values(["seq", "command", "value"], na_position="first")
        out: list = []
        _run(stacks, key[0], every, out)
        self.state.update((stacks.undo, stacks.redo, stacks.value, stacks.last))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def history_stream(commands: DataFrame) -> DataFrame:
    """The same over a stream, whose micro-batches come in the order of seq; needs a state store with several columns (RocksDB)."""
    c = commands.selectExpr("cast(session as string) session", "cast(seq as long) seq", "command", "cast(value as string) value").where("session is not null and seq is not null")
    return c.groupBy("session").transformWithStateInPandas(_History(), OUTPUT, "Update", "None")
