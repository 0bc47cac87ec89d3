"""Chat formatting by a finite-state machine over roles and a declarative template.

The template names the marks around a turn, the legal steps between roles, and the roles whose text is
learnt.  Each conversation is read in turn order, streamed, holding one turn at a time however long the
conversation; every turn gives three segments (opening mark, escaped text, closing mark) with a
loss flag each and the machine's finding.  Texts and roles are escaped, so no text can open
or close a turn and ``read_back`` recovers exactly what went in.

A conversation lies in one task, as its digest is sequential by nature; that task holds only
its current turn and sorts on disk where it must.

Defined results: null roles and texts are empty; null conversation ids form one conversation; turns go by (turn, role,
text), nulls first; unknown roles and illegal steps are formatted and marked invalid, never
dropped; repeated rows are turns of their own; a very long text is escaped and read back whole; an empty table gives no rows; other columns are never read."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreplane.llm.common import batched, null_safe_key


@dataclass(frozen=True)
class Template:
    """What a formatted conversation looks like and which role may follow which."""

    open: str = "### "
    after_role: str = ": "
    close: str = " </turn>\n"
    escape: str = "\\"
    learnt: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    steps: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "start": frozenset({"system", "user"}), "system": frozenset({"user"}),
        "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    ends: frozenset[str] = frozenset({"assistant"})

    @property
    def controls(self) -> list[str]:
        """Strings that have a meaning in formatted text."""
        return sorted({self.escape, self.open.strip(), self.after_role.strip(), self.close.strip()}, key=lambda c: -len(c))

    def guard(self, text: str, role: bool = False) -> str:
        """The text with the escape sign before every control string; the mark after a role counts in roles only."""
        inner = [c for c in self.controls if role or c != self.after_role.strip()]
        return re.sub("|".join(map(re.escape, inner)), lambda m: self.escape + m[0], text)

    def bare(self, text: str) -> str:
        """The inverse of ``guard``."""
        inner = "|".join(map(re.escape, self.controls))
        return re.sub(f"{re.escape(self.escape)}({inner})", r"\1", text, flags=re.S)

    def step(self, state: str, role: str) -> str | None:
        """The state after a turn of this role, or None where the turn may not come."""
        return role if role in self.steps.get(state, ()) else None


TEMPLATE = Template()
SEGMENTS = "conv_id bigint, known boolean, turn_no bigint, part string, text string, loss boolean, valid boolean"
COLUMNS = ["conv_id", "known", "turn_no", "part", "text", "loss", "valid"]


def segments(conversations: DataFrame, template: Template = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn",
             role: str = "role", text: str = "text") -> DataFrame:
    """Segments in order: conversation, turn number, part (open, text, close), text, loss flag, validity so far.

    The parts of a conversation lie together and in order in their partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out():
            current, number, state = None, 0, template.start
            for batch in batches:
                for key, conv, r, t in zip(batch["key"], batch["conv"], batch["role"], batch["text"]):
                    if key != current:
                        current, number, state = key, 0, template.start
                    state = template.step(state, r) or "broken"
                    valid, known = state != "broken", key != "n"
                    learnt = r in template.learnt
                    yield conv, known, number, "open", template.open + template.guard(r, role=True) + template.after_role, False, valid
                    yield conv, known, number, "text", template.guard(t), learnt, valid
                    yield conv, known, number, "close", template.close, False, valid
                    number += 1

        yield from batched(out(), COLUMNS)

    rows = conversations.select(
        F.expr(null_safe_key(conv_id)).alias("key"), F.expr(f"COALESCE(CAST(`{conv_id}` AS BIGINT), 0)").alias("conv"),
        F.col(f"`{turn}`").alias("turn"), F.expr(f"COALESCE(`{role}`, '')").alias("role"),
        F.expr(f"COALESCE(`{text}`, '')").alias("text"))
    rows = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    return rows.select("key", "conv", "role", "text").mapInPandas(run, SEGMENTS)


class Reader:
    """Reads formatted text piece by piece and gives back (role, text) of each turn, in linear time."""

    def __init__(self, template: Template = TEMPLATE):
        self.template = template
        escaped = f"{re.escape(template.escape)}(?:{'|'.join(map(re.escape, template.controls))})"
        self.role_end = re.compile(f"{escaped}|({re.escape(template.after_role)})", re.S)
        self.text_end = re.compile(f"{escaped}|({re.escape(template.close)})", re.S)
        self.rest = ""

    def _until(self, mark: re.Pattern, at: int) -> re.Match | None:
        while m := mark.search(self.rest, at):
            if m[1] is not None:
                return m
            at = m.end()  # an escaped control string
        return None

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.rest += piece
        if not piece.endswith(self.template.close):
            return
        at = 0
        while self.rest.startswith(self.template.open, at):
            role = self._until(self.role_end, at + len(self.template.open))
            text = role and self._until(self.text_end, role.end())
            if not text:
                break
            yield (self.template.bare(self.rest[at + len(self.template.open) : role.start()]),
                   self.template.bare(self.rest[role.end() : text.start()]))
            at = text.end()
        self.rest = self.rest[at:]


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row per conversation, from its segments: turns and digests as read back from the formatted text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out():
            current, valid, role = None, True, ""
            n = chars = loss_chars = 0
            turns = loss = reader = None

            def finished():
                ok = valid and role in template.ends and not reader.rest
                return (*current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, bool(ok))

            for batch in batches:
                for conv, known, text, learnt, fits in zip(*(batch[c] for c in ("conv_id", "known", "text", "loss", "valid"))):
                    if (conv, known) != current:
                        if current:
                            yield finished()
                        current, valid, role, reader = (conv, known), True, "", Reader(template)
                        n = chars = loss_chars = 0
                        turns, loss = hashlib.sha256(), hashlib.sha256()
                    chars += len(text)
                    valid = valid and fits
                    if learnt:
                        plain = template.bare(text)
                        loss_chars += len(plain)
                        loss.update(plain.encode("utf-8", "surrogatepass"))
                    for role, said in reader.feed(text):
                        n += 1
                        turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            if current:
                yield finished()

        yield from batched(out(), ["conv", "known", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                   "formatted_chars", "valid"])

    return formatted.mapInPandas(
        run, "conv bigint, known boolean, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
             " formatted_chars bigint, valid boolean").selectExpr(
        "IF(known, conv, NULL) AS conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")
