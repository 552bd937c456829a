"""Chat formatting: a state machine over roles checks the order of turns and emits text segments with loss flags.

A template is declared as data: the marks around a turn, the control strings that mean something to the model, the roles
whose text is trained on, and the transitions of the state machine. Control strings inside a text (or role) are escaped by
one backslash behind their first character, one more if there are some already, so that reading back is exact.

Conversations that break the order are formatted all the same, with the first fault in the column `fault`. Null texts and
roles count as empty; turns that tie are ordered by role, then text. Columns beside the four read are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role + says + text + close is a turn. trained: roles whose text bears loss. moves: state -> role -> next state."""

    open: str = "<|turn|>"
    says: str = "<|says|>"
    close: str = "<|end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<|turn|>", "<|says|>", "<|end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        words = self.control
        for mark in (self.open.strip(), self.says.strip(), self.close.strip()):
            if mark not in words:
                raise ValueError(f"mark {mark!r} isn't among the control strings")
        for a in words:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"control string {a!r} must be two characters at least, without a backslash")
            for b in words:
                if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))) and a != b or any(a[-k:] == a[:k] for k in range(1, len(a))):
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")
                if a != b and a in b and not b.startswith(a[0] * 2):
                    raise ValueError(f"control string {a!r} lies inside {b!r}")

    @cached_property
    def pattern(self) -> re.Pattern:
        """Matches each control string with any number of backslashes behind its first character."""
        return re.compile("|".join(f"{re.escape(x[0])}\\\\*{re.escape(x[1:])}" for x in sorted(self.control, key=lambda x: (-len(x), x))))

    @cached_property
    def turn(self) -> re.Pattern:
        """Matches a turn; its groups are role and text."""
        return re.compile(re.escape(self.open) + "(.*?)" + re.escape(self.says) + "(.*?)" + re.escape(self.close), re.S)

    def escape(self, text: str) -> str:
        return self.pattern.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self.pattern.sub(lambda m: m[0][0] + m[0][1:].removeprefix("\\"), text) if "\\" in text else text


SEGMENTS = "conv_id bigint, turn bigint, seq bigint, segments array<struct<text:string,loss:boolean>>, state string, fault string"


def format_conversations(df: DataFrame, template: Template | None = None) -> DataFrame:
    """A row per turn, in order: its segments with loss flags, the state reached, and the conversation's first fault so far.

    Rows are dealt by conversation and sorted within tasks; the state machine then reads them as a stream, so that a
    conversation of any length needs constant memory. Repeated rows are turns of their own.
    """
    template = template or Template()
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unset = object()
        conv, state, fault, seq = unset, "start", None, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, state, fault, seq = row["conv_id"], "start", None, 0
                role, text = row["role"], row["text"]
                nxt = template.moves.get(state, {}).get(role)
                if nxt is None:
                    fault = fault or f"turn {seq}: {role or 'no role'} after {state}"
                    nxt = next((m[role] for m in template.moves.values() if role in m), state)
                state = nxt
                loss = role in template.trained
                segments = [{"text": template.open + template.escape(role) + template.says, "loss": False}, {"text": template.escape(text), "loss": loss}, {"text": template.close, "loss": False}]
                out.append({"conv_id": conv, "turn": row["turn"], "seq": seq, "segments": segments, "state": state, "fault": fault})
                seq += 1
            yield pa.RecordBatch.from_pylist(out, schema=_SEGMENT_SCHEMA)

    return rows.mapInArrow(run, SEGMENTS)


_SEGMENT_SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), ("state", pa.string()), ("fault", pa.string())])


class ReadBack:
    """One formatted conversation, read as its text comes; what isn't yet a whole turn waits."""

    def __init__(self, conv_id: int | None, template: Template):
        self.conv_id, self.template, self.valid = conv_id, template, False
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.rest = ""

    def add(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            plain = self.template.unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.rest += text
        if not text.endswith(self.template.close[-1]):
            return
        at = 0
        while m := self.template.turn.match(self.rest, at):
            self.turns.update(f"{self.template.unescape(m[1])}\n{self.template.unescape(m[2])}\n".encode())
            self.n_turns += 1
            at = m.end()
        self.rest = self.rest[at:]

    def closed(self) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {self.conv_id}: text after the last turn isn't a turn")
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def digest(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads formatted conversations back: per conversation the count and hash of its turns, and what bears loss.

    Takes the rows as format_conversations() deals and orders them; hashes run on as rows stream by. Turns are parsed from the joined text of a
    conversation, wherever rows begin and end; only the loss flags are taken from its segments.
    """
    template = template or Template()
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        unset, now = True, ReadBack(None, template)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if unset or row["conv_id"] != now.conv_id:
                    if not unset:
                        out.append(now.closed())
                    now, unset = ReadBack(row["conv_id"], template), False
                for s in row["segments"]:
                    now.add(s["text"], s["loss"])
                now.valid = row["fault"] is None and row["state"] in template.final
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        if not unset:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.closed(), kinds)], names=names)

    return formatted.mapInArrow(run, schema)


def query(conversations: DataFrame) -> DataFrame:
    """The digest columns of op1 for a table of conversations and the two added turns of conversation -7."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(more)
    return digest(format_conversations(rows))


#: Characters of the marks around a turn: <|turn|> <|says|> <|end|>\n.
ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, len(regexp_extract_all(role || chr(1) || text,
    '<\\*<SYS>>|<\\*</SYS>>|<\\*\|turn\|>|<\\*\|says\|>|<\\*\|end\|>|<\\*\|endoftext\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]')) AS n_escapes,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + 8 + length(text) + n_escapes + 8) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE false END)
    AND bool_or(from_end = 1 AND role = 'assistant') AS valid
FROM marked GROUP BY conv_id
"""
