"""Alignment of the tokens that two tokenizers make of the same text, by divide and conquer at shared cuts.

A cut is a byte offset at which a token of either tokenizer ends. The cut that is nearest to the middle of an interval is found
by bisecting the other tokenizer's ends; the interval is halved there and both halves are treated alike; an interval without a
cut inside is a group of tokens that belong together. All intervals of one depth, of all documents of a batch, are bisected together
in NumPy.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.token_files import byte_letters
from newsloom.session import scratch_dir

ALIGNED_SCHEMA = "key long, doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"
DIGEST_SCHEMA = (
    "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
)
#: Code points of text that are encoded and aligned together; a longer text makes a batch of its own.
BATCH_CHARS = 1 << 19
#: Tokens whose digests are made together; a longer document makes a batch of its own.
BATCH_TOKENS = 1 << 20


class ByteLevelTokens:
    """Ids and token lengths of a byte-level BPE file of the tokenizers library; names of special tokens are plain text.

    If the file's ids follow the order of its merges, ids are ranks and the ranks are applied by tiktoken, which makes the same
    tokens faster; otherwise the library itself encodes.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as lines:
            file = json.load(lines)
        own = {chr(letter): byte for byte, letter in byte_letters().items()}
        special = {token["content"] for token in file["added_tokens"]}
        vocabulary = {t: i for t, i in file["model"]["vocab"].items() if t not in special}
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(own[letter] for letter in token)
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"]]
        made = [vocabulary.get(token) for token in merged]
        self.library, self.ranked = None, None
        if None not in made and made == sorted(made) and len(vocabulary) == 256 + len(set(made)) == len(self.bytes):
            import tiktoken

            ranks = {token: i for i, token in enumerate(self.bytes)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.encode_special_tokens = True

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is not None:
            return self.ranked.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)


class PieceTokens:
    """Ids and token lengths of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i)
            else self.model.id_to_piece(i).replace("▁", " ").encode("utf-8")
            for i in range(self.model.vocab_size())
        ]
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int32)


#: The tokenizers of this Python worker, which serves many tasks.
_TOKENIZERS: dict[tuple, tuple[ByteLevelTokens, PieceTokens]] = {}


def worker_tokenizers(a_path: str, a_pattern: str, b_path: str) -> tuple[ByteLevelTokens, PieceTokens]:
    key = (a_path, a_pattern, b_path)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = ByteLevelTokens(a_path, a_pattern), PieceTokens(b_path)
    return _TOKENIZERS[key]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges first..last (inclusive, maybe empty), one after the other, and the range each comes from."""
    sizes = np.maximum(last - first + 1, 0)
    owner = np.repeat(np.arange(len(first)), sizes)
    before = np.cumsum(sizes) - sizes
    return np.arange(len(owner)) - before[owner] + first[owner], owner


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Indices into `ends_a` of all ends that `ends_b` has too, in order.

    Both are increasing. Tokens starts[i]..stops[i]-1 of A are an interval whose last end is a cut.
    """
    found = [stops - 1]
    low, high = starts, stops - 2  # candidates inside an interval
    middle, near = (low + high) // 2, np.full(len(low), -1)  # ends up to the distance `near` were no cuts
    while True:
        open_ = high >= low
        low, high, middle, near = low[open_], high[open_], middle[open_], near[open_]
        if not len(low):
            return np.sort(np.concatenate(found))
        # A ring around the middle: distances near+1..far, on either side. The next ring is twice as wide.
        far = 2 * near + 2
        left, left_of = _spread(np.maximum(low, middle - far), np.minimum(middle - near - 1, middle - 1))
        right, right_of = _spread(np.maximum(middle, middle + near + 1), np.minimum(high, middle + far))
        tried, owner = np.concatenate((left, right)), np.concatenate((left_of, right_of))
        place = np.searchsorted(ends_b, ends_a[tried])
        hit = ends_b[np.minimum(place, len(ends_b) - 1)] == ends_a[tried]
        tried, owner = tried[hit], owner[hit]
        order = np.lexsort((np.abs(tried - middle[owner]), owner))
        tried, owner = tried[order], owner[order]
        nearest = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
        cut, at = tried[nearest], owner[nearest]
        found.append(cut)
        whole = (middle - far <= low) & (middle + far >= high)  # nothing left to try: a group
        whole[at] = True
        rest = ~whole
        lows = np.concatenate((low[at], cut + 1, low[rest]))
        highs = np.concatenate((cut - 1, high[at], high[rest]))
        middle = np.concatenate(((low[at] + cut - 1) // 2, (cut + 1 + high[at]) // 2, middle[rest]))
        near = np.concatenate((np.full(2 * len(at), -1), far[rest]))
        low, high = lows, highs


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int32()))


def _align(texts: list[str], a: ByteLevelTokens, b: PieceTokens) -> list[pa.Array]:
    """a_ids, b_ids, a_cuts and b_cuts of the texts."""
    none = np.zeros(0, np.int32)
    ids_a, ids_b = [], []
    for text in texts:
        one, other = none, none
        if text:
            spaced = " " + text
            one, other, want = a.encode(spaced), b.encode(text), spaced.encode("utf-8")
            # Tokens of A are consecutive pieces of the text's own bytes, so their length tells whether they are all of it.
            if int(a.lengths[one].sum()) != len(want) or b"".join(map(b.bytes.__getitem__, other.tolist())) != want:
                one = other = none
        ids_a.append(one)
        ids_b.append(other)
    n_a, n_b = np.array([len(i) for i in ids_a], np.int64), np.array([len(i) for i in ids_b], np.int64)
    flat_a, flat_b = np.concatenate([none, *ids_a]), np.concatenate([none, *ids_b])
    # Documents follow each other, so their ends increase through the batch; a document's last tokens end together.
    ends_a, ends_b = np.cumsum(a.lengths[flat_a]), np.cumsum(b.lengths[flat_b])
    if len(ends_a) and ends_a[-1] < 1 << 31:
        ends_a, ends_b = ends_a.astype(np.int32), ends_b.astype(np.int32)
    stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
    with_tokens = n_a > 0
    cuts_a = shared_cuts(ends_a, ends_b, (stop_a - n_a)[with_tokens], stop_a[with_tokens])
    cuts_b = np.searchsorted(ends_b, ends_a[cuts_a])
    document = np.searchsorted(stop_a, cuts_a, side="right")
    n_cuts = np.bincount(document, minlength=len(texts))
    return [
        _lists(flat_a, n_a), _lists(flat_b, n_b), _lists(cuts_a + 1 - (stop_a - n_a)[document], n_cuts),
        _lists(cuts_b + 1 - (stop_b - n_b)[document], n_cuts),
    ]


def align_documents(docs: DataFrame, a_path: str, a_pattern: str, b_path: str) -> DataFrame:
    """The aligned tokens of each document: ids of A (byte-level BPE of a space and the text) and of B (pieces of the text), and
    the group ends: group g holds tokens a_cuts[g-1]..a_cuts[g]-1 of A and b_cuts[g-1]..b_cuts[g]-1 of B. key is unique.

    Null and empty texts, and texts whose tokens of A or of B do not join to the bytes of a space and the text (such as a text with
    U+2581, or with bytes that are not UTF-8), have no tokens. Null ids and repeated rows are kept as they are; other columns are not
    looked at; an empty table gives an empty table. Texts of any length are aligned whole. No shuffle; a worker holds an Arrow batch and
    the tokens of BATCH_CHARS code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = worker_tokenizers(a_path, a_pattern, b_path)
        for batch in batches:
            start, chars, texts = 0, 0, []
            for row, value in enumerate(batch.column(2)):
                texts.append((value.as_py() or b"").decode("utf-8", "replace"))
                chars += len(texts[-1])
                if chars >= BATCH_CHARS or row == batch.num_rows - 1:
                    ids = batch.slice(start, len(texts))
                    columns = [ids.column(0), ids.column(1), *_align(texts, a, b)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])
                    start, chars, texts = row + 1, 0, []

    rows = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, ALIGNED_SCHEMA)


def _digest(batch: pa.RecordBatch, names: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Counts, groups_sha256 and the linked id pairs (how often each) of aligned documents."""
    flat, offsets = {}, {}
    for name in ("a_ids", "b_ids", "a_cuts", "b_cuts"):
        lists = batch.column(batch.schema.get_field_index(name))
        flat[name] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        offsets[name] = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    n_groups = np.diff(offsets["a_cuts"])
    document = np.repeat(np.arange(batch.num_rows), n_groups)
    # Last token of each group, as a place among all tokens of the batch.
    last_a = flat["a_cuts"] - 1 + offsets["a_ids"][document]
    last_b = flat["b_cuts"] - 1 + offsets["b_ids"][document]
    # The tokens in the order of the written form: those of A, then those of B, group after group.
    size = len(flat["a_ids"]) + len(flat["b_ids"])
    written = np.empty(size, object)
    for name, last, other in (("a", last_a, np.concatenate(([0], last_b[:-1] + 1)) if len(last_b) else last_b), ("b", last_b, last_a + 1)):
        ids = flat[f"{name}_ids"]
        ends = np.zeros(len(ids), np.int64)
        ends[last] = 1
        group = np.cumsum(ends) - ends
        written[np.arange(len(ids)) + other[group]] = names[name][2 * ids + ends]
    linked = flat["a_ids"][last_a] << 32 | flat["b_ids"][last_b]
    sums, pairs, times = [], [], []
    for row in range(batch.num_rows):
        first, stop = (offsets["a_ids"][r] + offsets["b_ids"][r] for r in (row, row + 1))
        text = "".join(written[first:stop].tolist())
        sums.append(hashlib.sha256(text[:-1].encode()).hexdigest() if text else "")
        different, often = np.unique(linked[offsets["a_cuts"][row] : offsets["a_cuts"][row + 1]], return_counts=True)
        pairs.append(different)
        times.append(often)
    columns = [
        batch.column(0), batch.column(1), pa.array(np.diff(offsets["a_ids"])), pa.array(np.diff(offsets["b_ids"])),
        pa.array(n_groups), pa.array(n_groups), pa.array(sums, pa.string()),
        pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(
        columns, ["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    )


def _names(size: int, end: str) -> np.ndarray:
    """The written form of token i inside a group (2i) and as the last of its tokenizer in a group (2i + 1)."""
    return np.array([text for i in range(size) for text in (f"{i},", f"{i}{end}")], object)


def digest_groups(aligned: DataFrame) -> DataFrame:
    """Counts and digests of the groups of `align_documents`, and the id pairs that each document links.

    A link is a token of A and one of B that end together; tokens are not empty, so there is one at the end of each group. A
    pair is the A id times 2^32 plus the B id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"a": _names(1, "|"), "b": _names(1, ";")}
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in ("a_ids", "b_ids")}
            for name, end in (("a", "|"), ("b", ";")):
                flat = columns[f"{name}_ids"].flatten()
                top = int(flat.to_numpy(zero_copy_only=False).max()) + 1 if len(flat) else 1
                if 2 * top > len(names[name]):
                    names[name] = _names(1 << top.bit_length(), end)
            tokens = np.cumsum(sum(np.diff(c.offsets.to_numpy().astype(np.int64)) for c in columns.values()))
            start = 0
            while start < batch.num_rows:
                done = tokens[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(tokens, done + BATCH_TOKENS, side="right")))
                yield _digest(batch.slice(start, stop - start), names)
                start = stop

    return aligned.mapInArrow(run, DIGEST_SCHEMA)


def alignment_counts(docs: DataFrame, a_path: str, a_pattern: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of `docs`.

    The count of an id pair is the number of links that hold it in all documents. n_best counts links whose pair has the highest
    count of all pairs with its B id, count_sum adds the counts of a document's links. Documents without tokens have zeros and an
    empty digest; see align_documents for nulls, repeated rows and empty tables.

    Documents are tokenised once; their digests and different pairs are stored. There are at most as many different pairs as pairs
    of vocabulary entries, in practice far fewer: Spark broadcasts their counts if they are small and shuffles pairs otherwise.
    """
    spark = docs.sparkSession
    path = scratch_dir(spark, "aligned")
    digest_groups(align_documents(docs, a_path, a_pattern, b_path)).write.parquet(path)
    stored = spark.read.schema(DIGEST_SCHEMA).parquet(path)
    links = stored.select("key", F.inline(F.arrays_zip("pairs", "times"))).withColumnsRenamed({"pairs": "pair", "times": "own"})
    path = scratch_dir(spark, "pair-counts")
    links.groupBy("pair").agg(F.sum("own").alias("count")).write.parquet(path)
    counts = spark.read.schema("pair long, count long").parquet(path).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    known = counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    sums = links.join(known, "pair").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("own")).otherwise(0)).alias("n_best"), F.sum(F.col("own") * F.col("count")).alias("count_sum")
    )
    return stored.drop("pairs", "times").join(sums, "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256",
    )
