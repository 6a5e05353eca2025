"""Chat formatting by incremental black-box rendering.

A template is only a function from turns to text. Successive prefixes of a
conversation are rendered and each output is compared with the one before: what
it adds is the new turn's span. Two probe renderings of the same turn tell
which part of the span is the turn's own text. A template that changes earlier
output is found by the same comparison; such a turn carries ``keep``, the number
of characters of the output so far that stay, so that applying the rows in
order (``out = out[:keep] + added``) gives the full rendering of any template.

Conversations are streamed in order within a partition, one turn at a time, so
memory does not grow with a conversation if the template says on how many
earlier turns the rendering of a turn depends (``context``). Without that, every
prefix is rendered in full. With it, the first ``VERIFY`` prefixes of each
conversation still are, and after them those at each power of two and at the end; a template that
breaks its promise raises there. Of a conversation of more than ``KEPT`` turns, such a check
renders the last ``KEPT``.

Cases: null text or role is empty; null conversation ids form one conversation;
turns are ordered by (turn, role, text), null turns first, so ties have one
order; repeated rows are turns of their own; an empty table gives no rows, and other columns are
ignored and may have any name.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from os.path import commonprefix
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import arrow

Turn = tuple[str, str]  # role, text
VERIFY = 12
KEPT = 4096
PROBES = ("a", "b")


@dataclass(frozen=True)
class Template:
    """``render`` gives the text of a list of turns, ``escape`` the form in which a turn's text appears in it."""

    render: Callable[[list[Turn]], str]
    escape: Callable[[str], str] = str
    context: int | None = None


# -- the template of the registered query ---------------------------------------------

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE:", "[/ROLE]"]
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Double every backslash, then break each control string by one after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def _mark(role: str, text: str) -> str:
    if role == "user":
        return f"[INST]{escape(text)}[/INST]"
    if role == "assistant":
        return f"{escape(text)}</s>"
    if role == "system":
        return f"<<SYS>>{escape(text)}<</SYS>>"
    return f"[ROLE:{quote(role, safe='')}]{escape(text)}[/ROLE]"


def instruct(turns: list[Turn]) -> str:
    """``<s>`` opens the conversation and each turn after an assistant's."""
    return "".join(("<s>" if not i or turns[i - 1][0] == "assistant" else "") + _mark(*t) for i, t in enumerate(turns))


INSTRUCT = Template(instruct, escape, context=1)

_TURN = re.compile(
    r"(?:<s>)?(?:\[INST\](?P<user>.*?)\[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>"
    r"|\[ROLE:(?P<role>[^\]]*)\](?P<other>.*?)\[/ROLE\]|(?P<assistant>.*?)</s>)",
    re.S,
)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted conversation, or of some of its turns."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        kind = m.lastgroup
        yield (unquote(m["role"]) if kind == "other" else kind), unescape(m[kind])
        at = m.end()


# -- the operator -----------------------------------------------------------------------

FORMAT_DDL = (
    "conv_id bigint, position bigint, role string, keep bigint, added string, start bigint, end bigint,"
    " text_start bigint, text_end bigint, rewrites boolean"
)


class _Conversation:
    """The rendering so far: its length, and the turns later ones depend on."""

    def __init__(self, template: Template, probed: dict):
        self.t, self.probed = template, probed
        self.turns: list[Turn] = []
        self.n = self.length = 0
        self.whole = ""  # the output, as long as prefixes are rendered in full
        self.last: deque[tuple[Turn, str]] = deque(maxlen=KEPT)  # turns and what they added

    def header(self, before: list[Turn], role: str) -> tuple[int, int]:
        """Characters that a turn adds in front of and behind its text."""
        key = (tuple(r for r, _ in before), role, self.n == 0) if self.t.context is not None else None
        if key in self.probed and key is not None:
            return self.probed[key]
        base = self.t.render(before) if before else ""
        a, b = (self.t.render([*before, (role, p)]) for p in PROBES)
        head = len(commonprefix([a, b]))
        found = (head - len(commonprefix([base, a])), len(a) - head - len(self.t.escape(PROBES[0])))
        if key is not None and len(self.probed) < 4096:
            self.probed[key] = found
        return found

    def check(self) -> None:
        """Render the turns that are kept at once: it must give what was put together turn by turn."""
        turns, c = [t for t, _ in self.last], self.t.context
        if self.t.render(turns) != self.t.render(turns[:c]) + "".join([a for _, a in self.last][c:]):
            raise ValueError(f"the template depends on more than {c} earlier turns")

    def finish(self) -> None:
        if self.t.context is not None and self.n > VERIFY:
            self.check()

    def add(self, role: str, text: str) -> tuple:
        full = self.t.context is None or self.n < VERIFY
        before = self.turns if self.t.context is None else self.turns[max(0, len(self.turns) - self.t.context):]
        if full:
            old, new = self.whole, self.t.render([*self.turns, (role, text)])
        else:
            old, new = self.t.render(before), self.t.render([*before, (role, text)])
        keep = len(old) if new.startswith(old) else len(commonprefix([old, new]))
        added, rewrites = new[keep:], keep < len(old)
        if self.t.context is not None:
            part = self.t.render(before) if before else ""
            if rewrites or full and self.t.render([*before, (role, text)]) != part + added:
                raise ValueError(f"the template depends on more than {self.t.context} earlier turns")
        start = self.length - (len(old) - keep)
        head, tail = self.header(before, role)
        # What the probes do not explain (a rewriting template) leaves the span of the turn as the text's.
        fits = added[head : len(added) - tail] == self.t.escape(text)
        own = (start + head, start + len(added) - tail) if fits else (start, start + len(added))
        row = (self.n, role, start, added, start, start + len(added), *own, rewrites)
        self.length, self.n = start + len(added), self.n + 1
        self.turns.append((role, text))
        if self.t.context is not None:
            self.last.append(((role, text), added))
            if self.n > VERIFY and not self.n & (self.n - 1):
                self.check()
        if self.t.context is None or self.n < VERIFY:
            self.whole = new
        elif len(self.turns) > self.t.context:
            self.turns, self.whole = self.turns[-self.t.context :] if self.t.context else [], ""
        return row


def ordered(conversations: DataFrame) -> DataFrame:
    """One shuffle by conversation; the sort spills, so a conversation of any length streams."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame, template: Template = INSTRUCT, rows_per_batch: int = 512) -> DataFrame:
    """One row per turn: what it adds to the output, its span, the span of its text. Order within a partition is kept."""
    out = arrow(FORMAT_DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probed: dict = {}
        current, state, rows = object(), None, []
        for batch in batches:
            for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != current:
                    if state is not None:
                        state.finish()
                    current, state = conv, _Conversation(template, probed)
                rows.append((conv, *state.add(role, text)))
                if len(rows) >= rows_per_batch:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                    rows = []
        if state is not None:
            state.finish()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return ordered(conversations).mapInArrow(run, FORMAT_DDL)
