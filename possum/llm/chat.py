"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation is a sequence of turns. The machine checks the turn order and,
for every turn, emits text segments with a loss flag. Control strings inside a
text are escaped, so the formatted text reads back to exactly the same turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from possum.llm.common import ship


@dataclass(frozen=True)
class Template:
    """What stands around a turn of each role, which roles carry loss, and the allowed order.

    ``turns[role]`` is (opening, closing). Roles without an entry use
    ``other``: opening mark, the escaped role, a middle mark, and a closing.
    Openings and closings must be told apart by their first control string.
    """

    turns: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    # state -> {role: next state}; a role that a state lacks makes the conversation invalid
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: frozenset[str] = frozenset({"answered"})

    @property
    def marks(self) -> list[str]:
        return [m for pair in self.turns.values() for m in pair] + list(self.other)


def _overlap(a: str, b: str) -> bool:
    """Whether text that ends in a part of ``a`` followed by ``b`` could be read as ``a`` first."""
    return (a != b and b in a) or any(b.startswith(a[i:]) for i in range(1, len(a)))


class Machine:
    """The template compiled: escape, format one turn, read one turn back, step the order."""

    def __init__(self, template: Template):
        self.t = template
        marks = sorted(template.marks, key=len, reverse=True)
        if len(set(marks)) != len(marks) or any(len(m) < 2 or "\\" in m for m in marks):
            raise ValueError("marks must differ, have two characters or more and no backslash")
        if any(_overlap(a, b) for a in marks for b in marks):
            raise ValueError("a mark must not hold another, and no end of a mark may be the beginning of one")
        self._special = re.compile(r"\\|" + "|".join(map(re.escape, marks)))
        self._mark = re.compile(r"\\.|(" + "|".join(map(re.escape, marks)) + ")", re.S)
        self._opens = {pair[0]: role for role, pair in template.turns.items()}

    def escape(self, text: str) -> str:
        # a backslash is doubled; a control string gets one after its first character
        return self._special.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of one turn; only the body of a loss role is under the mask."""
        if role in self.t.turns:
            before, after = self.t.turns[role]
        else:
            before, after = self.t.other[0] + self.escape(role) + self.t.other[1], self.t.other[2]
        return [(before, False), (self.escape(text), role in self.t.loss_roles), (after, False)]

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of every turn of a formatted text; raises ValueError if it isn't one."""
        marks = [m for m in self._mark.finditer(formatted) if m[1]]
        at, end = 0, 0
        while at < len(marks):
            first = marks[at]
            if first.start() != end:
                raise ValueError(f"text outside a turn at {end}")
            if first[1] in self._opens:
                role, body, close = self._opens[first[1]], first.end(), at + 1
                want = self.t.turns[role][1]
            elif first[1] == self.t.other[0] and at + 2 < len(marks) and marks[at + 1][1] == self.t.other[1]:
                role, body, close = self.unescape(formatted[first.end() : marks[at + 1].start()]), marks[at + 1].end(), at + 2
                want = self.t.other[2]
            else:
                raise ValueError(f"no turn opens at {first.start()}")
            if close >= len(marks) or marks[close][1] != want:
                raise ValueError(f"turn at {first.start()} isn't closed")
            yield role, self.unescape(formatted[body : marks[close].start()])
            end, at = marks[close].end(), close + 1
        if end != len(formatted):
            raise ValueError("text after the last turn")

    def step(self, state: str | None, role: str) -> str | None:
        """The next state; None once the order is broken."""
        return None if state is None else self.t.order.get(state, {}).get(role)


SEGMENTS = "array<struct<text:string,loss:boolean>>"


def format_turns(df: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq, role, segments, state) for every turn, in order inside each partition.

    ``segments`` joined over the turns of a conversation is its formatted
    text; ``state`` is the machine's state after the turn, null from the first
    turn that breaks the order on. Turns are ordered by turn, role, text
    (nulls first; repeated rows are turns of their own); a null text or role
    is empty; a null conv_id is a conversation of its own; an empty table
    gives an empty result; other columns are ignored. Rows are streamed after
    one shuffle by conversation, so a task's memory holds a batch, however
    long a conversation is.
    """
    ship(df.sparkSession)
    machine = Machine(template or Template())
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), ("state", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seq, state = object(), 0, "start"
        for b in batches:
            out = []
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if c != conv:
                    conv, seq, state = c, 0, "start"
                state = machine.step(state, role)
                out.append({"conv_id": c, "seq": seq, "role": role, "segments": [{"text": s, "loss": f} for s, f in machine.segments(role, text)], "state": state})
                seq += 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, f"conv_id long, seq long, role string, segments {SEGMENTS}, state string")


def conversation_digests(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation, read back from the formatted text of ``format_turns``.

    Works on that result as it lies (conversations whole and in order inside a
    partition) without another shuffle, holding one turn at a time.
    """
    machine = Machine(template or Template())
    final = machine.t.final
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_ = None, False
        n = loss_n = chars = 0
        sha = loss = state = None
        done: list[tuple] = []
        row = lambda: (conv, n, sha.hexdigest(), loss_n, loss.hexdigest(), chars, state in final)
        for b in batches:
            for c, segments, s in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if not open_ or c != conv:
                    if open_:
                        done.append(row())
                    conv, open_, n, loss_n, chars, sha, loss = c, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                formatted = "".join(x["text"] for x in segments)
                for role, text in machine.read(formatted):
                    n += 1
                    sha.update(f"{role}\n{text}\n".encode())
                for x in segments:
                    if x["loss"]:
                        plain = machine.unescape(x["text"])
                        loss_n += len(plain)
                        loss.update(plain.encode())
                chars += len(formatted)
                state = s
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=schema)
                done = []
        if open_:
            done.append(row())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=schema)

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
