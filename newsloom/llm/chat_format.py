"""Canonical turns as training texts with turn marks, escaped control strings and a loss mask, and back.

A conversation is `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Inside texts and roles one backslash goes between `<` and `|`
(behind the backslashes that are there), so `<|` is found in control strings only and every text can be restored. The loss mask
lists code-point spans of the formatted text: the assistant's texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
#: A row of the output ends after the turn that reaches this many code points, so a conversation of any length has rows of bounded size.
PART_CHARS = 1 << 20
FORMATTED_SCHEMA = "range int, part long, conv_id long, whole boolean, formatted string, loss array<struct<start: int, stop: int>>"
DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    turns, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            break
        turns.append((unescape_role(found[1]), unescape(found[2])))
        at = found.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


class _Parts:
    """Formatted rows of a sorted partition. The first and the last conversation may go on in a neighbouring partition."""

    def __init__(self, number: int, part_chars: int):
        self.number, self.part_chars, self.part = number, part_chars, 0
        self.key: object = self  # no conversation yet
        self.first, self.cut = True, False
        self.rows: list[tuple] = []
        self._open()

    def _open(self) -> None:
        self.pieces, self.loss, self.chars = [], [], 0

    def _close(self, whole: bool) -> None:
        if self.pieces:
            self.rows.append((self.number, self.part, self.key, whole, "".join(self.pieces), self.loss))
            self.part += 1
        self._open()

    def add(self, key: int | None, role: str, text: str) -> None:
        if self.key is self or key != self.key:
            if self.key is not self:
                self._close(not self.first and not self.cut)
                self.first = False
            self.key, self.cut = key, False
        elif self.chars >= self.part_chars:
            self.cut = True
            self._close(False)
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        self.pieces += (head, body, END)
        self.chars += len(head)
        if role == ASSISTANT and body:
            self.loss.append({"start": self.chars, "stop": self.chars + len(body)})
        self.chars += len(body) + len(END)

    def take(self) -> pa.RecordBatch:
        names = ["range", "part", "conv_id", "whole", "formatted", "loss"]
        types = [
            pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        ]
        columns = list(zip(*self.rows)) if self.rows else [[]] * 6
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def format_conversations(turns: DataFrame, path: str, part_chars: int = PART_CHARS) -> None:
    """Write the formatted conversations of `turns` (conv_id, turn, position, role, text) under `path`, as Parquet.

    Turns are sorted by conversation, turn and position, equal ones by role and text; null turns come first, null ids are one
    conversation, a null role or text is empty. Ranges of turns, not of conversations, are dealt out, so a conversation of any
    number of turns is cut across tasks and rows. `whole` rows hold a whole conversation; other conversations are the rows of one conv_id
    in the order of range and part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(TaskContext.get().partitionId(), part_chars)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                parts.add(*row)
            yield parts.take()
        parts._close(False)
        yield parts.take()

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "position", "role", "text")]
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "position",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartitionByRange(*order[:3]).sortWithinPartitions(*order)
    dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED_SCHEMA).write.parquet(path)


def read_formatted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORMATTED_SCHEMA).parquet(path)


class _Digests:
    """Running digests of one conversation's rows."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, text in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in loss:
            text = unescape(formatted[span["start"] : span["stop"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of rows that are sorted by conversation."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    current, digests = None, None
    for batch in batches:
        rows = []
        for conv_id, formatted, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if digests is None or conv_id != current:
                if digests is not None:
                    rows.append(digests.row(current))
                current, digests = conv_id, _Digests()
            digests.add(formatted, loss)
        yield table(rows)
    yield table([digests.row(current)] if digests is not None else [])


def conversation_digests(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, from the files.

    Whole rows need no shuffle. The rows of other conversations are brought together in order and hashed one after the other, since
    a SHA-256 has no parts; a task streams them and holds one batch.
    """
    rows = read_formatted(spark, path)
    columns = ("conv_id", "formatted", "loss")
    whole = rows.where("whole").select(*columns).mapInArrow(_digest_rows, DIGEST_SCHEMA)
    cut = rows.where("not whole").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "range", "part")
    return whole.unionByName(cut.select(*columns).mapInArrow(_digest_rows, DIGEST_SCHEMA))
