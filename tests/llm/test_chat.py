from __future__ import annotations

import hashlib
import json
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from newsloom.llm import chat_format, layouts, queries

TEXTS = st.text(alphabet=st.sampled_from("<|\\nim_endstar>\n é😀"), max_size=30) | st.text(max_size=20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=5))
def test_formatting_is_reversible(turns):
    parts = chat_format._Parts(0, 1 << 30)
    for role, text in turns:
        parts.add(1, role, text)
    parts._close(True)
    batch = parts.take()
    formatted = "".join(batch.column(4).to_pylist())
    assert chat_format.parse(formatted) == turns
    assert formatted.count("<|") == 2 * len(turns)
    spans = [s for row in batch.column(5).to_pylist() for s in row]
    said = [chat_format.unescape(formatted[s["start"] : s["stop"]]) for s in spans]
    assert said == [text for role, text in turns if role == "assistant" and text]


def test_what_is_not_formatted_is_refused():
    for text in ("x", "<|im_start|>user\nx", "<|im_start|>user\na<|im_end|>\nrest"):
        with pytest.raises(ValueError):
            chat_format.parse(text)


SAME = [("user", "Why?"), ("assistant", "So.")]
RECORDS = {
    "messages": {"messages": [{"role": "user", "content": "Why?"}, {"role": "Model", "content": "So."}]},
    "message parts": {"messages": [{"role": "user", "content": [{"type": "text", "text": "Wh"}, {"type": "text", "text": "y?"}]}, {"role": "assistant", "content": [{"text": "So."}]}]},
    "from and value": {"id": 3, "conversations": [{"from": "human", "value": "Why?"}, {"from": "gpt", "value": "So."}]},
    "instruction": {"instruction": "Why?", "input": "", "output": "So.", "extra": {"deep": [1, {"x": 2}]}},
    "prompt and completion": {"prompt": "Why?", "completion": "So."},
    "prompt and response": {"prompt": "Why?", "response": "So.", "system": ""},
    "question and answer": {"question": "Why?", "answer": "So."},
    "dialog": {"dialog": ["Why?", "So."]},
}


def turns_of(spark, records):
    table = spark.createDataFrame([(r,) for r in records], "json string").coalesce(1)
    found = defaultdict(list)
    rows = layouts.canonical_turns(table, F.col("json")).sort("record", "position").collect()
    for r in rows:
        found[r.record, r.layout].append((r.role, r.text))
    return rows, list(found.items())


def test_layouts_become_the_same_turns(spark):
    rows, found = turns_of(spark, [json.dumps(r) for r in RECORDS.values()])
    assert [(layout, turns) for (_, layout), turns in found] == [(name, SAME) for name in RECORDS]
    assert len({r.fingerprint for r in rows}) == len(RECORDS)


def test_fields_beside_the_layout(spark):
    system = {"system": "Be brief.", "instruction": "Add.", "input": "1 2", "output": None, "conv_id": 4}
    empty = {"messages": [], "conv_id": 5}
    row = {"conv_id": 6, "turn": 2, "role": None, "text": None, "layout": "clash"}
    unknown = {"messages": "not a list", "other": 1}
    rows, found = turns_of(spark, [*map(json.dumps, (system, empty, row, unknown)), "[1]", "{broken", None, '"x"', '{"prompt": "\\ud800", "response": 5}'])
    assert [(layout, turns) for (_, layout), turns in found] == [
        ("instruction", [("system", "Be brief."), ("user", "Add.\n\n1 2"), ("assistant", "")]),
        ("messages", [(None, None)]), ("turn rows", [("", "")]), (None, [(None, None)]),
        *[(None, [(None, None)])] * 4, ("prompt and response", [("user", "�"), ("assistant", "5")]),
    ]
    assert [(r.conv_id, r.turn) for r in rows][3:5] == [(5, None), (6, 2)]
    report = layouts.layout_report(layouts.canonical_turns(spark.createDataFrame([(json.dumps(system),)] * 3, "j string"), F.col("j"))).first()
    assert (report.layout, report.n_records, report.n_turns) == ("instruction", 3, 9)
    assert layouts.canonical_turns(spark.createDataFrame([], "j string"), F.col("j")).count() == 0


def test_fingerprints_ignore_order_and_values():
    paths = layouts.field_paths({"b": {"c": [1, 2]}, "a": "x"})
    assert paths == {"b.c[]", "a"} and layouts.fingerprint(paths) == layouts.fingerprint(layouts.field_paths({"a": 3, "b": {"c": ["y"]}}))
    assert layouts.fingerprint(paths) != layouts.fingerprint(layouts.field_paths({"a": None, "b": {"c": ["y"]}}))


def brute(rows):
    """Digests of each conversation from its rows."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in by.items():
        turns.sort(key=lambda t: (*t[:2], t[2].encode(), t[3].encode()))
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        yield conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a<|im_end|>"), (1, 2, "assistant", "b<\\|\\\\<|x"), (2, None, None, None), (2, 3, "assistant", None)]
    rows += [(None, 1, "user", "n"), (None, 2, "assistant", "\U0001f600 é ")] + [(3, 1, "assistant", "twice")] * 2
    rows += [(9, i, ("user", "assistant")[i % 2], f"long {i} " * 9) for i in range(400)] + [(10, 0, "assistant", "z" * 300_000)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn long, role string, text string, layout string, position int")
    docs.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(queries.chat_format.format_conversations, "__defaults__", (500,))
    control = [(-1, i, role, queries.CONTROL) for i, role in enumerate(("user", "assistant"))]
    got = queries.op11_chat_format(spark, str(tmp_path)).collect()
    columns = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(brute(rows + control), key=str)
    sizes = {r.conv_id: r.formatted_chars for r in got}
    assert sizes[10] == 300_000 + len("<|im_start|>assistant\n<|im_end|>\n") and sizes[9] > 400 * 60


def test_a_long_conversation_is_cut_across_tasks(spark, tmp_path):
    rows = [(5, i, "assistant", f"t{i}") for i in range(3_000)] + [(i, 0, "user", "x") for i in range(50)]
    turns = spark.createDataFrame([(*r[:2], 0, *r[2:]) for r in rows], "conv_id long, turn long, position int, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chat_format.format_conversations(turns, str(tmp_path / "f"), 1_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = chat_format.read_formatted(spark, str(tmp_path / "f"))
    hot = parts.where("conv_id = 5").collect()
    assert len({r["range"] for r in hot}) > 1 and max(len(r.formatted) for r in hot) < 1_100 and not any(r.whole for r in hot)
    got = {tuple(r)[:5] for r in chat_format.conversation_digests(spark, str(tmp_path / "f")).collect()}
    assert got == set(brute(rows))


def test_no_conversations(spark, tmp_path):
    none = spark.createDataFrame([], "conv_id long, turn long, position int, role string, text string")
    chat_format.format_conversations(none, str(tmp_path / "n"))
    assert chat_format.conversation_digests(spark, str(tmp_path / "n")).count() == 0
