"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A template declares the states, the text before and after a turn of each role, and
which roles are learnt. Turns of a conversation stream through one task in order, so
a conversation of any length needs the memory of one turn. Control strings inside
texts are broken by a backslash after their first character, and backslashes are
doubled; reading back undoes exactly that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of turns, learnt roles and allowed turn order.

    ``marks``: the text before a turn by role; other roles get ``other`` with the escaped role.
    ``moves``: state -> role -> state; the machine begins in ``start`` and may end in ``ends``.
    """

    marks: dict = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: tuple = ("### Role ", " says: ")
    after: str = " </turn>\n"
    controls: tuple = ("### ", "</turn>", " says: ")
    learnt: frozenset = frozenset({"assistant"})
    start: str = "begin"
    ends: frozenset = frozenset({"answered"})
    moves: dict = field(default_factory=lambda: {"begin": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})

    def _hide(self):
        broken = re.compile(r"\\|" + "|".join(re.escape(c) for c in sorted(self.controls, key=len, reverse=True)))
        return lambda text: broken.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)

    def writer(self):
        """role, text -> the text before, the escaped text, the text after."""
        hide = self._hide()

        def write(role: str, text: str) -> tuple[str, str, str]:
            before = self.marks.get(role) or self.other[0] + hide(role) + self.other[1]
            return before, hide(text), self.after

        return write

    def reader(self):
        """A formatted turn -> role, text; raises ValueError where it is no turn of this template."""
        show = lambda text: re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)
        named = {v: k for k, v in self.marks.items()}
        opening = re.compile("|".join([*(f"({re.escape(m)})" for m in named), f"{re.escape(self.other[0])}(?P<role>.*?){re.escape(self.other[1])}"]), re.DOTALL)

        def read(turn: str) -> tuple[str, str]:
            m = opening.match(turn)
            if m is None or not turn.endswith(self.after) or m.end() + len(self.after) > len(turn):
                raise ValueError("not a turn of this template")
            role = named[m[0]] if m[0] in named else show(m["role"])
            return role, show(turn[m.end() : len(turn) - len(self.after)])

        return read


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = template.writer()
        conv, state, at = object(), None, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for c, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != conv:
                    conv, state, at = c, template.start, 0
                state = template.moves.get(state, {}).get(role)  # None: out of order, and stays so
                before, body, after = write(role, text)
                for k, (part, loss) in enumerate(((before, False), (body, role in template.learnt), (after, False))):
                    for column, v in zip(out, (c, at, k, turn, role, part, loss, state)):
                        column.append(v)
                at += 1
                if len(out[0]) >= 3000:
                    yield _batch(out)
                    out = [[] for _ in range(8)]
            yield _batch(out)

    return run


_SEGMENTS = "conv_id long, position long, part int, turn int, role string, segment string, loss boolean, state string"


def _batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=[x.split()[0] for x in _SEGMENTS.split(", ")])


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of every turn: conv_id, position (of the turn, from 0), part (0 before, 1 text, 2 after),
    turn, role, segment, loss, state (after the turn; null once the order of roles was broken).

    A conversation's segments joined in order are its formatted text; conversations out of order are formatted
    too, flagged by their state. Null roles and texts count as empty, null turns come first, turns
    of equal number are ordered by role, then text, repeated rows stay. Null ids are one conversation.
    Other columns are ignored. Each partition of the result holds whole conversations in order.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("int"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.mapInArrow(_format(template or Template()), _SEGMENTS)


def _digest(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = template.reader()
        conv, done = None, []
        turns, loss, n, n_loss, n_all, state, turn = None, None, 0, 0, 0, None, ""

        def end():
            done.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), n_all, state in template.ends))

        for batch in batches:
            for c, part, segment, learnt, now in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if turns is None or c != conv:
                    if turns is not None:
                        end()
                    conv, turns, loss, n, n_loss, n_all = c, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                turn = segment if part == 0 else turn + segment
                n_all += len(segment)
                if part == 2:
                    role, text = read(turn)
                    turns.update(f"{role}\n{text}\n".encode())
                    n, state = n + 1, now
                elif learnt:
                    text = re.sub(r"\\(.)", r"\1", segment, flags=re.DOTALL)
                    loss.update(text.encode())
                    n_loss += len(text)
            if len(done) >= 1000:
                yield _summary(done)
                done = []
        if turns is not None:
            end()
        yield _summary(done)

    return run


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, complete boolean"


def _summary(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _READ.split(", ")])


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, parsed from the formatted segments alone: n_turns, turns_sha256 (role, newline,
    text, newline of each turn), loss_chars and loss_sha256 (the unescaped text under the loss flags),
    formatted_chars, complete (turns in order, and the last may end a conversation).

    ``segments`` is what format_chats returned, its partitions unchanged.
    """
    return segments.select("conv_id", "part", "segment", "loss", "state").mapInArrow(_digest(template or Template()), _READ)
