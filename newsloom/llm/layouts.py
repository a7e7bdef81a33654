"""Conversation layouts: nested field paths, their fingerprint, and declarative mappings to canonical turns.

A record is a JSON object. Its fingerprint is a hash of the set of its nested field paths (`messages[].role`), so all records of one
layout share it; a record's mapping is looked up by fingerprint, and mappings are compared with paths only once for each
fingerprint. A mapping says, by paths, which fields are turns; there is no code for a single layout.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

TURN_SCHEMA = (
    "record long, fingerprint string, layout string, conv_id long, turn long, position int, role string, text string"
)
#: Fingerprints remembered per worker; only speed depends on it.
REMEMBERED = 10_000


@dataclass(frozen=True)
class Turns:
    """Turns of a record: one for each element of the list at `each`, or one altogether.

    Paths below are inside the element. The role is a constant, roles in alternation, or found at `role_at` and renamed by `names`; texts at
    several paths are joined by empty lines, empty ones left out. An optional rule may find nothing: then it gives no turn.
    """

    text_at: tuple[str, ...]
    each: str = ""
    role: tuple[str, ...] = ()
    role_at: str = ""
    names: tuple[tuple[str, str], ...] = ()
    optional: bool = False

    def paths(self) -> list[str]:
        inside = [*self.text_at, *filter(None, [self.role_at])]
        return [f"{self.each}[].{p}".removesuffix(".") for p in inside] if self.each else inside


@dataclass(frozen=True)
class Layout:
    name: str
    turns: tuple[Turns, ...]
    conv_at: str = ""
    turn_at: str = ""
    #: Text fields that may be missing.
    optional: tuple[str, ...] = ()
    required: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        found = [p for rule in self.turns if not rule.optional for p in rule.paths()] + [p for p in (self.turn_at,) if p]
        object.__setattr__(self, "required", tuple(dict.fromkeys(p for p in found if p not in self.optional)))


NAMES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("chatgpt", "assistant"))
SYSTEM = Turns(("system",), role=("system",), optional=True)
LAYOUTS = (
    Layout("turn rows", (Turns(("text",), role_at="role"),), conv_at="conv_id", turn_at="turn"),
    Layout("messages", (SYSTEM, Turns(("content",), each="messages", role_at="role", names=NAMES)), conv_at="conv_id"),
    Layout("message parts", (SYSTEM, Turns(("content[].text",), each="messages", role_at="role", names=NAMES)), conv_at="conv_id"),
    Layout("from and value", (SYSTEM, Turns(("value",), each="conversations", role_at="from", names=NAMES)), conv_at="conv_id"),
    Layout(
        "instruction",
        (SYSTEM, Turns(("instruction", "input"), role=("user",)), Turns(("output",), role=("assistant",))),
        conv_at="conv_id", optional=("input",),
    ),
    Layout("prompt and completion", (SYSTEM, Turns(("prompt",), role=("user",)), Turns(("completion",), role=("assistant",))), conv_at="conv_id"),
    Layout("prompt and response", (SYSTEM, Turns(("prompt",), role=("user",)), Turns(("response",), role=("assistant",))), conv_at="conv_id"),
    Layout("question and answer", (SYSTEM, Turns(("context", "question"), role=("user",)), Turns(("answer",), role=("assistant",))), conv_at="conv_id", optional=("context",)),
    Layout("dialog", (Turns(("",), each="dialog", role=("user", "assistant")),), conv_at="conv_id"),
)


def field_paths(record: object, at: str = "") -> set[str]:
    """Paths of all leaves. `a.b` is a field, `a[]` any element of a list; what is null or empty ends in `?`."""
    if isinstance(record, dict) and record:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in record.items()))
    if isinstance(record, list) and record:
        return set().union(*(field_paths(v, f"{at}[]") for v in record))
    return {f"{at}?" if record is None or record == {} or record == [] else at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _covered(path: str, paths: set[str]) -> bool:
    """Whether a path is there, or nothing can be there because it or a field around it is null or empty."""
    ends = [i for i in range(1, len(path) + 1) if i == len(path) or path[i] in ".["]
    return path in paths or any(f"{path[:i]}?" in paths for i in ends)


def choose_layout(paths: set[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The layout whose required paths are all there; of several the one with most paths there, then the first listed."""
    fitting = [(sum(p in paths for p in l.required), l) for l in layouts if all(_covered(p, paths) for p in l.required)]
    best = max((n for n, _ in fitting), default=0)
    return next((l for n, l in fitting if n == best), None)


def _at(record: object, path: str) -> object:
    """What is at a path; a list on the way gives its elements' values, joined if they are texts."""
    for i, step in enumerate(path.split(".") if path else ()):
        listed = step.endswith("[]")
        record = record.get(step.removesuffix("[]")) if isinstance(record, dict) else None
        if listed:
            rest = ".".join(path.split(".")[i + 1 :])
            return "".join(_text(_at(v, rest)) for v in record) if isinstance(record, list) else None
    return record


def _text(value: object) -> str:
    """A leaf as text: null is empty, what is not a string is written as JSON."""
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical(record: dict, layout: Layout) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a record."""
    for rule in layout.turns:
        elements = _at(record, rule.each) if rule.each else [record]
        for i, element in enumerate(elements if isinstance(elements, list) else []):
            values = [_at(element, path) for path in rule.text_at]
            if rule.optional and all(v in (None, "") for v in values):
                continue
            texts = [_text(v) for v in values]
            role = rule.role[i % len(rule.role)] if rule.role else _text(_at(element, rule.role_at))
            role = dict(rule.names).get(role.lower(), role) if rule.names else role
            yield role, texts[0] if len(texts) == 1 else "\n\n".join(t for t in texts if t)


def _whole(value: object) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63 else None


def canonical_turns(records: DataFrame, record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The turns of each record (a JSON object as a string): record (a number of its own), fingerprint, layout, conv_id, turn, position
    (within the record), role and text.

    Rows that are null, no JSON object or of no known layout give one row without layout, role and text, so nothing gets lost; a
    record whose list of turns is null or empty gives one row of its layout without role and text. Null texts are empty. A conv_id or
    turn that is no 64-bit integer is null. Repeated records are all converted; an empty table gives an empty table. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Layout | None] = {}
        for batch in batches:
            rows = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    value = json.loads((text.as_py() or b"null").decode("utf-8", "replace"))
                except (ValueError, RecursionError):
                    value = None
                if not isinstance(value, dict):
                    rows.append((number, None, None, None, None, None, None, None))
                    continue
                paths = field_paths(value)
                mark = fingerprint(paths)
                if mark not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[mark] = choose_layout(paths, layouts)
                layout = known[mark]
                name = layout.name if layout else None
                turns = list(canonical(value, layout)) if layout else []
                conv = _whole(_at(value, layout.conv_at)) if layout and layout.conv_at else None
                turn = _whole(_at(value, layout.turn_at)) if layout and layout.turn_at else None
                rows += [(number, mark, name, conv, turn, i, *t) for i, t in enumerate(turns)] or [(number, mark, name, conv, turn, None, None, None)]
            columns = list(zip(*rows)) if rows else [[]] * 8
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            arrays = [pa.array([_clean(v) for v in c] if t == pa.string() else c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, ["record", "fingerprint", "layout", "conv_id", "turn", "position", "role", "text"])

    return records.select(
        F.monotonically_increasing_id().alias("record"), record.cast("string").cast("binary").alias("json")
    ).mapInArrow(run, TURN_SCHEMA)


def _clean(value: str | None) -> str | None:
    """Half surrogate pairs, which JSON can write and UTF-8 cannot, become U+FFFD."""
    if value is None or value.isascii():
        return value
    return value.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def layout_report(turns: DataFrame) -> DataFrame:
    """fingerprint, layout, n_records, n_turns of canonical turns: what came in which layout, unknown ones included."""
    return turns.groupBy("fingerprint", "layout").agg(
        F.count_distinct("record").alias("n_records"), F.count("role").alias("n_turns")
    )
