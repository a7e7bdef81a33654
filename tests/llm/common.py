"""Inputs with the awkward cases that every operator must take, and names that clash with the operators' own."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, rows int, copies int, fp string, row string, "
    "words array<string>, tokens int, bucket int, host string, rank int"
)


def documents(spark, texts, sources=None, ids=None):
    rows = []
    for i, text in enumerate(texts):
        source = sources[i] if sources else f"src{i % 3}"
        rows.append((i if ids is None else ids[i], text, "en", source, 0, "k", 1, 2, "fp", "r", ["w"], 3, 4, "h", 5))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(seed: int, n: int, size: int = 60) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, size))) for _ in range(n)]


AWKWARD = [None, "", " \t\n", "x", "x", "one two", "ONE two", "a\u00a0b \u2003c", "\n\n  two  spaces\n x", "ñandú 日本語 😀 e\u0301", "it's <|endoftext|> 12 !!"]
