"""Spelling variants: words that differ by one edit, found by products of letter counts.

A word is a vector of letter counts. One edit changes the squared distance of two such vectors by at most two (a letter
replaced) or by one (a letter more or less), so the Gram matrix of two blocks of words, a NumPy product, tells which pairs can be near;
those are verified letter by letter. Blocks hold words of one length and, within it, of one count of letters in each of three
classes of letters, which an edit changes by at most one as well; only adjacent blocks meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.llm.rows import drop_folder
from newsloom.session import scratch_dir

RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 6
MIN_COUNT = 5
#: One of so many (document, run) hashes has a letter removed.
DAMAGED = 199
#: How many times as frequent as the word its form has to be.
FORM_TIMES = 5
#: Words of a block that meet in one task, about; larger blocks are cut into cells by a hash of the word.
CELL_WORDS = 8_192
#: Blocks (five numbers each) that may be sent to every task.
SHARED_BLOCKS = 1 << 16
#: Letter counts are kept modulo this many letters: letters that share a place can only lower a distance.
PLACES = 32
#: Classes of letters whose counts name a block.
CLASSES = ("eEéèêëÉÈÊËnN", "aAáàâãäåÁÀÂÃÄÅtT", "iIíìîïÍÌÎÏrR")
#: Rows and columns of a product that are compared at once.
TILE = (1_024, 2_048)
CELL_SCHEMA = "word string, n_near long, near_n long, near_word string"


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, run: the maximal runs of letters of at least MIN_CHARS code points, one row for each occurrence."""
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{RUN}{{{MIN_CHARS},}}"), F.lit(0))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(found).alias("run"))


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, with one letter removed if the hash of document and run asks for it."""
    h = F.crc32(F.concat(F.coalesce(doc_id, F.lit("")), F.lit(":"), run).cast("binary"))
    place = F.pmod(h, F.char_length(run).cast("long")).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.char_length(run)))
    return F.when(h % DAMAGED == 0, shorter).otherwise(run)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the words of at least MIN_CHARS code points that occur at least MIN_COUNT times in all documents."""
    lowered = runs(docs).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = lowered.select(damaged(F.col("doc_id"), F.col("run")).alias("word"))
    words = words.where(F.char_length("word") >= MIN_CHARS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def _class_count(word: Column, letters: str) -> Column:
    return F.char_length(word) - F.char_length(F.translate(word, letters, ""))


BLOCK = ["length", *(f"c{i}" for i in range(len(CLASSES)))]


def _cells(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """word, n, its block (length and class counts) and its cell, one of as many as the block needs; and the blocks' numbers of cells."""
    spark = words.sparkSession
    keyed = words.select(
        "word", "n", F.char_length("word").alias("length"),
        *(_class_count(F.col("word"), letters).alias(f"c{i}") for i, letters in enumerate(CLASSES)),
    )
    path = scratch_dir(spark, "blocks")
    keyed.groupBy(BLOCK).agg(F.ceil(F.count(F.lit(1)) / CELL_WORDS).cast("int").alias("cells")).write.parquet(path)
    blocks = spark.read.parquet(path)
    # Few enough blocks go to every task, so that words are not dealt by block, of which one may hold many.
    known = F.broadcast(blocks) if blocks.count() <= SHARED_BLOCKS else blocks
    return keyed.join(known, BLOCK).withColumn("cell", F.pmod(F.xxhash64("word"), F.col("cells")).cast("int")).drop("cells"), blocks


def _meetings(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each word once for each pair of cells it takes part in: pair, side (0 or 1; 2: the cell meets itself), word, n.

    Blocks are adjacent if one edit can lead from one to the other: the same length and class counts that differ by a letter moved
    at most, or a length more by one and one class count more at most. Pairs of blocks come from the small table of blocks.
    """
    names = [*BLOCK, "cells"]
    classes = len(CLASSES)
    steps = [(0, *[0] * classes)]
    for more in range(classes + 1):  # the last stands for all other letters
        gain = [int(c == more) for c in range(classes)]
        steps.append((1, *gain))
        steps += [(0, *(g - int(c == less) for c, g in enumerate(gain))) for less in range(classes + 1) if less != more]
    # Each unordered pair of blocks once.
    steps = [s for s in steps if s >= (0, *[0] * classes)]
    moved = blocks.select("*", F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{i}") for i, v in enumerate(s))) for s in steps))).alias("d"))
    other = moved.select(
        *(F.col(n).alias(f"{n}_") for n in names), *((F.col(n) + F.col(f"d.d{i}")).alias(n) for i, n in enumerate(names[:-1]))
    )
    met = other.join(blocks, names[:-1])
    one, two = [F.col(f"{n}_") for n in names[:-1]], [F.col(n) for n in names[:-1]]
    same = F.lit(True)
    for a, b in zip(one, two):
        same = same & (a == b)
    pairs = met.select(
        *(F.col(c) for n in names for c in (n, f"{n}_")), same.alias("same"),
        F.explode(F.sequence(F.lit(0), F.col("cells_") - 1)).alias("cell_"),
    ).select("*", F.explode(F.sequence(F.when(F.col("same"), F.col("cell_")).otherwise(0), F.col("cells") - 1)).alias("cell"))
    key = F.concat_ws("/", *one, "cell_", *two, "cell")
    self_ = F.col("same") & (F.col("cell") == F.col("cell_"))
    left = pairs.select(key.alias("pair"), F.when(self_, 2).otherwise(0).alias("side"), *(a.alias(n) for a, n in zip(one, names)), F.col("cell_").alias("cell"))
    right = pairs.where(~self_).select(key.alias("pair"), F.lit(1).alias("side"), *names[:-1], "cell")
    return cells.join(left.unionByName(right), [*BLOCK, "cell"]).select("pair", "side", "word", "n")


def letter_counts(words: list[str]) -> np.ndarray:
    """Counts of letters (by place) of each word."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    # a-z take places of their own, the letters beyond ASCII share the rest.
    place = np.where(flat < 128, flat % PLACES, (flat // 2) % 5 + 27)
    return np.bincount(owner * PLACES + place, minlength=len(words) * PLACES).reshape(-1, PLACES).astype(np.float32)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def near_pairs(one: list[str], two: list[str] | None) -> Iterator[tuple[int, int]]:
    """Places of the near words of two lists, or within one list (each pair once)."""
    a = letter_counts(one)
    b = a if two is None else letter_counts(two)
    # The row of a times the column of b is minus half of the squared distance.
    half_a, half_b = -0.5 * (a * a).sum(1), -0.5 * (b * b).sum(1)
    a = np.concatenate((a, half_a[:, None], np.ones((len(a), 1), np.float32)), 1)
    b = np.concatenate((b, np.ones((len(b), 1), np.float32), half_b[:, None]), 1).T.copy()
    names = one if two is None else two
    for i in range(0, a.shape[0], TILE[0]):
        rows = a[i : i + TILE[0]]
        for j in range(0, b.shape[1], TILE[1]):
            if two is None and j + TILE[1] <= i:
                continue
            close = np.flatnonzero(rows @ b[:, j : j + TILE[1]] >= -1.0)
            width = min(TILE[1], b.shape[1] - j)
            for x, y in zip((close // width + i).tolist(), (close % width + j).tolist()):
                if (two is not None or x < y) and one_edit(one[x], names[y]):
                    yield x, y


def _near_in_cells(table: pa.Table) -> pa.Table:
    """For each word of two cells that has near words in the other: how many, and the most frequent (the smallest of equals)."""
    side = table.column("side").to_numpy()
    words, n = table.column("word").to_pylist(), table.column("n").to_pylist()
    left = [i for i, s in enumerate(side.tolist()) if s != 1]
    right = [i for i, s in enumerate(side.tolist()) if s == 1]
    own = bool(len(side)) and bool((side == 2).any())
    found: dict[int, tuple[int, int, str]] = {}

    def add(i: int, j: int) -> None:
        count, best_n, best = found.get(i, (0, 0, ""))
        if n[j] > best_n or (n[j] == best_n and words[j] < best):
            best_n, best = n[j], words[j]
        found[i] = (count + 1, best_n, best)

    if left and (own or right):
        others = left if own else right
        for x, y in near_pairs([words[i] for i in left], None if own else [words[i] for i in right]):
            add(left[x], others[y])
            add(others[y], left[x])
    rows = [(words[i], *v) for i, v in found.items()]
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["word", "n_near", "near_n", "near_word"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near_n, near_word: number of words at one edit, and the most frequent of them (the smallest of equals).

    `words` (word, n; different words) is read several times, so it is a stored table. A task gets two cells of about CELL_WORDS
    words; a pair of near words is in exactly one such task, and a task lets out one row for each word.
    """
    parts = _meetings(*_cells(words)).groupBy("pair").applyInArrow(_near_in_cells, CELL_SCHEMA)
    top = F.min_by("near_word", F.struct(-F.col("near_n"), F.col("near_word")))
    return parts.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.max("near_n").alias("near_n"), top.alias("near_word")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root for each row of `forms` (word, form): the last of the forms that follow each other.

    Each round doubles the number of forms that are followed. A form is FORM_TIMES as frequent as its word, so a chain is as
    long as a logarithm of the largest count and a few rounds do. A round is a stored table.
    """
    spark = forms.sparkSession

    def store(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_dir(spark, "roots")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    current, path = store(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not current.where("moved").isEmpty():
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = current.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        following, next_path = store(moved)
        drop_folder(spark, path)
        current, path = following, next_path
    return current.select("word", "root")


def spelling_forms(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of all texts (see word_counts).

    form is the most frequent near word (the smallest in code-point order of equals) if it is at least FORM_TIMES as frequent as
    the word, otherwise null; root follows forms to the last and is the word itself without one.

    Null and empty texts have no words; a null doc_id counts as the empty string in the hash; repeated rows count each; other
    columns are not looked at; an empty table gives an empty table. Whole texts are read; a run of letters of any length is a word.
    """
    spark: SparkSession = docs.sparkSession
    path = scratch_dir(spark, "words")
    word_counts(docs).write.parquet(path)
    words = spark.read.schema("word string, n long").parquet(path)
    path = scratch_dir(spark, "forms")
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("near_n") >= FORM_TIMES * F.col("n")
    near.select(
        "word", F.when(is_form, F.col("near_word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near_n")).alias("form_n"),
    ).write.parquet(path)
    formed = spark.read.schema("word string, form string, n long, n_near long, form_n long").parquet(path)
    last = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
