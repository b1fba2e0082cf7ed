"""Chat formatting with a grammar round trip.

Each turn is rendered between marks that carry its role, reparsed by a deterministic parser and compared with its
source. The grammar allows no control string inside a role or text as it stands, so a turn that says one does not come
back: it is escaped and reparsed until it is identical. Escaping parts every control string after its first sign by a
mark and doubles the mark itself, so it is reversible; the loss mask holds the spans of assistant texts as they stand.

    conversation := turn*
    turn         := "<s>" [flag] "[ROLE]" role "[/ROLE]" text "</s>"
    flag         := "[ESC]"   (role and text are escaped)

As a turn's form depends on nothing else, turns are formatted and parsed where they lie, however long a conversation
is; only the digests over whole conversations read a conversation's turns in order, as a stream of sorted rows of which
a task holds one batch. (Such a digest is a chain over the whole text, so one conversation's is one task's work.)

Defined results: null roles and texts are empty; rows with equal turn are ordered by role and text; a null turn comes
first; conversations with a null id are one conversation; repeated rows are turns each; an empty table gives none;
texts of any length are formatted whole; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The strings that have a meaning in the output.
OPEN, FLAG, ROLE, END_ROLE, CLOSE = "<s>", "[ESC]", "[ROLE]", "[/ROLE]", "</s>"
CONTROL = (OPEN, FLAG, ROLE, END_ROLE, CLOSE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>")
MARK = "\\"
LEARNED = "assistant"
SAYS_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
FORMATTED = "formatted string, start long, end long, learned boolean, escaped boolean"

Turn = tuple[str, str]


def escape(text: str) -> str:
    """Doubles every mark and parts the control strings by one."""
    text = text.replace(MARK, MARK + MARK)
    for c in CONTROL:
        text = text.replace(c, c[0] + MARK + c[1:])
    return text


def unescape(text: str) -> str:
    """Undoes `escape`: a doubled mark is one, a single mark nothing."""
    return MARK.join(x.replace(MARK, "") for x in text.split(MARK + MARK))


def render_turn(role: str, text: str, escaped: bool) -> tuple[str, int]:
    """The turn and the place where its text starts."""
    head = OPEN + (FLAG + ROLE + escape(role) if escaped else ROLE + role) + END_ROLE
    return head + (escape(text) if escaped else text) + CLOSE, len(head)


def parse(formatted: str) -> list[tuple[Turn, tuple[int, int]]] | None:
    """The turns, each with the span of its text as it stands; None if the grammar does not hold."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            return None
        at += len(OPEN)
        escaped = formatted.startswith(FLAG, at)
        at += len(FLAG) * escaped
        if not formatted.startswith(ROLE, at):
            return None
        at += len(ROLE)
        role_end = formatted.find(END_ROLE, at)
        start = role_end + len(END_ROLE)
        end = formatted.find(CLOSE, start)
        if role_end < 0 or end < 0 or SAYS_CONTROL.search(formatted, at, role_end) or SAYS_CONTROL.search(formatted, start, end):
            return None
        role, text = formatted[at:role_end], formatted[start:end]
        out.append(((unescape(role), unescape(text)) if escaped else (role, text), (start, end)))
        at = end + len(CLOSE)
    return out


def format_turn(role: str, text: str) -> tuple[str, int, int, bool]:
    """(formatted turn, start and end of its text, whether it is escaped): the first form whose parse is the turn."""
    for escaped in (False, True):
        rendered, start = render_turn(role, text, escaped)
        if parse(rendered) == [((role, text), (start, len(rendered) - len(CLOSE)))]:
            return rendered, start, len(rendered) - len(CLOSE), escaped
    raise AssertionError("an escaped turn does not parse back")


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, formatted, start, end, learned, escaped): a row a turn, with the span of its text in code points
    and whether the loss mask holds it. One narrow pass."""
    clean = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                roles = batch.column(2).to_pylist()
                done = [format_turn(r, t) for r, t in zip(roles, batch.column(3).to_pylist(), strict=True)]
                texts, starts, ends, escaped = zip(*done, strict=True)
                columns = [pa.array(texts, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array([r == LEARNED for r in roles]), pa.array(escaped)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["conv_id", "turn", "formatted", "start", "end", "learned", "escaped"])

    return clean.mapInArrow(run, f"conv_id long, turn long, {FORMATTED}")


def turns_of(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, learned, chars): the turns read back from the output. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [parse(t)[0] for t in batch.column(2).to_pylist()]
            masked = [span == (a, b) and on for (_, span), a, b, on in zip(back, *(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)]
            columns = [pa.array([t[0] for t, _ in back], pa.string()), pa.array([t[1] for t, _ in back], pa.string()), pa.array(masked, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(map(len, batch.column(2).to_pylist()), pa.int64())], ["conv_id", "turn", "role", "text", "learned", "chars"])

    return formatted.select("conv_id", "turn", "formatted", "start", "end", "learned").mapInArrow(run, "conv_id long, turn long, role string, text string, learned boolean, chars long")


def transcripts(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations as one text each, for those that a row can hold; turns in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "formatted")))
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["formatted"]), "").alias("formatted"))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Digest:
    """The digests of one conversation while its turns go by."""

    def __init__(self, conv: int | None):
        self.conv, self.n, self.chars, self.loss_chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, learned: bool, chars: int) -> None:
        self.n, self.chars = self.n + 1, self.chars + chars
        self.turns.update(f"{role}\n{text}\n".encode())
        if learned:
            self.loss.update(text.encode())
            self.loss_chars += len(text)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output and mask."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Digest | None = None
        out: list[tuple] = []
        for batch in batches:
            for conv, role, text, learned, chars in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = Digest(conv)
                now.add(role, text, learned, chars)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(now.row(), kinds, strict=True)], names)

    ordered = turns_of(formatted).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, T._parse_datatype_string(DIGESTS))


#: The conversation that says control strings only.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(rows: DataFrame) -> DataFrame:
    """`rows` and conversation -7: a user and an assistant row that say control strings."""
    probe = rows.sparkSession.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


def _oracle() -> str:
    """The same in DuckDB: a turn is escaped if its text says a control string (roles here say none)."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    text = f"replace(text, {quoted(MARK)}, {quoted(MARK * 2)})"
    for c in CONTROL:
        text = f"replace({text}, {quoted(c)}, {quoted(c[0] + MARK + c[1:])})"
    says = " OR ".join(f"contains(text, {quoted(c)})" for c in CONTROL)
    marks = len(OPEN + ROLE + END_ROLE + CLOSE)
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', {quoted(PROBE)}), (-7, 1, 'assistant', {quoted(PROBE)})),
t AS (SELECT *, {marks} + length(role) + CASE WHEN {says} THEN {len(FLAG)} + length({text}) ELSE length(text) END AS chars FROM r)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = {quoted(LEARNED)}), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = {quoted(LEARNED)}), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars FROM t GROUP BY conv_id
"""


ORACLE = _oracle()
