from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm.common import AWKWARD, documents
from newsloom.llm import spelling


def brute_words(texts, ids):
    found = Counter()
    for i, text in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    """One edit by the plain table."""
    rows = list(range(len(b) + 1))
    for i, x in enumerate(a):
        rows, last = [i + 1], rows
        for j, y in enumerate(b):
            rows.append(min(last[j] + (x != y), last[j + 1] + 1, rows[j] + 1))
    return rows[-1] == 1


def brute(texts, ids):
    words = brute_words(texts, ids)
    out, form = {}, {}
    for w, n in words.items():
        close = [v for v in words if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(close, key=lambda v: (-words[v], v.encode()), default=None)
        if best is not None and words[best] >= 5 * n:
            form[w] = best
        out[w] = (form.get(w), n, len(close), words[best] if w in form else None)
    for w in words:
        root = w
        while root in form:
            root = form[root]
        yield (w, out[w][0], root, *out[w][1:])


def corpus(seed, n_words, n_texts):
    """Words with variants by one edit, frequent and rare ones, and chains of variants."""
    rng = np.random.default_rng(seed)
    letters = list("abé÷")
    base = ["".join(rng.choice(letters, rng.integers(5, 11))) for _ in range(n_words)]
    for word in list(base):
        for _ in range(3):
            at, kind = rng.integers(len(word)), rng.integers(3)
            new = str(rng.choice(letters))
            word = word[:at] + (new if kind < 2 else "") + word[at + (kind != 1) :]
            base.append(word)
    weights = rng.integers(1, 60, len(base)).astype(float) ** 2
    texts = [" ".join(rng.choice(base, 60, p=weights / weights.sum())) for _ in range(n_texts)]
    return texts + ["chains chainsx chains-chainsxy! CHAINS"] * 6 + ["chains chainsx"] * 40 + ["chains"] * 300


@pytest.mark.parametrize("cell,tile", [(8_192, (1_024, 2_048)), (7, (3, 5))])
def test_forms_equal_brute_force(spark, monkeypatch, cell, tile):
    monkeypatch.setattr(spelling, "CELL_WORDS", cell)
    monkeypatch.setattr(spelling, "TILE", tile)
    texts = AWKWARD + corpus(3, 60, 150)
    ids = [None, None, 7, 7, *range(100, 100 + len(texts) - 4)]
    got = spelling.spelling_forms(documents(spark, texts, ids=ids)).select("word", "form", "root", "n", "n_near", "form_n")
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = sorted(brute(texts, ids))
    assert sorted(map(tuple, got.collect())) == want
    assert sum(row[1] is not None and row[2] != row[1] for row in want) >= 1 and any(row[4] > 2 for row in want)


def test_damage_of_frequent_words(spark):
    """Enough documents that the hash removes letters, at either end too."""
    texts, ids = ["Muster-word MUSTER größtes"] * 4_000, list(range(4_000))
    got = {r.word: r.n for r in spelling.word_counts(documents(spark, texts, ids=ids)).collect()}
    assert got == brute_words(texts, ids) and len(got) >= 2


def test_one_edit_equals_the_table():
    rng = np.random.default_rng(4)
    for _ in range(3_000):
        a, b = ("".join(rng.choice(list("abé"), rng.integers(0, 6))) for _ in range(2))
        assert spelling.one_edit(a, b) == near(a, b)


def test_letter_counts_never_lose_a_near_pair():
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("aábÿ÷zß"), rng.integers(6, 9))) for _ in range(400)})
    got = {(words[i], words[j]) for i, j in spelling.near_pairs(words, None)}
    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}
    half = len(words) // 2
    got = {(words[i], words[half + j]) for i, j in spelling.near_pairs(words[:half], words[half:])}
    assert got == {(a, b) for a in words[:half] for b in words[half:] if near(a, b)}


def test_no_words(spark):
    assert spelling.spelling_forms(documents(spark, ["x"]).where("false")).count() == 0
    assert spelling.spelling_forms(documents(spark, [None, "", "12 34", "short words only"])).count() == 0
    long = spelling.spelling_forms(documents(spark, ["a" * 200_000] * 5)).collect()
    assert [(len(r.word), r.n, r.form, r.n_near) for r in long] == [(200_000, 5, None, 0)]
