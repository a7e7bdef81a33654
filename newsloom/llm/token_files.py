"""Token ids in ORC files: one row per document in ascending doc_id order.

Integer run-length encoding packs the ids, row indexes and a Bloom filter on doc_id let readers skip stripes and row
groups, and stripes can be read in parallel. A file row holds part (number of the range of documents), doc_id, offset (ids of the
part's documents before it), n_tokens and ids.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsloom.llm.pieces import PieceEncoder

FILE_SCHEMA = "part int, doc_id long, offset long, n_tokens long, ids array<int>"
#: Rows per row-index entry and per Bloom filter; bytes of a stripe before compression.
INDEX_ROWS = 1_000
STRIPE_BYTES = 64 << 20
BLOOM_FPP = 0.01
#: Pieces remembered per Python worker; fewer than without a sort in the same task, which needs memory too.
REMEMBERED = 1_200_000


def byte_letters() -> dict[int, int]:
    """The character by which byte-level vocabularies write each byte: its own if that is printable, otherwise the next
    one from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(others)}


class LibraryEncoder:
    """Encodes whole texts by a tokenizer of the tokenizers library with a byte-level pre-tokenizer of that pattern.

    Its pre-tokens are encoded independently of each other, so the library's model encodes each different one once and its
    ids are remembered. Names of added tokens inside a text are ordinary text, or with `added_tokens` what the library makes
    of them: it then encodes the texts that hold one.
    """

    def __init__(self, path: str, pattern: str, remembered: int, splits_at_space: bool, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        tokenize, letters = self.library.model.tokenize, byte_letters()
        added = self.library.get_added_tokens_decoder().values() if added_tokens else ()
        self.names = [token.content for token in added]

        space, number = chr(letters[ord(" ")]), attrgetter("id")
        pack = {i: struct.pack("<I", i) for i in self.library.get_vocab().values()}

        def encode_piece(piece: str) -> bytes:
            if piece.isascii() and piece.isprintable():  # of these characters only the space has another letter
                written = piece.replace(" ", space)
            else:
                written = piece.encode("utf-8").decode("latin-1").translate(letters)
            return b"".join(map(pack.__getitem__, map(number, tokenize(written))))

        self.pieces = PieceEncoder(pattern, encode_piece, remembered, splits_at_space)

    def encode(self, text: str) -> bytes:
        if any(name in text for name in self.names):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.pieces.encode(text)


#: The encoder of this Python worker, which serves many tasks and keeps what it remembers between them.
_ENCODERS: dict[tuple, LibraryEncoder] = {}


def worker_encoder(*options) -> LibraryEncoder:
    if options not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[options] = LibraryEncoder(*options)
    return _ENCODERS[options]


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int = 0, remembered: int = REMEMBERED,
    splits_at_space: bool = False, added_tokens: bool = False,
) -> None:
    """Encode every whole text, append `end_id` and write the ids under `path`. With `added_tokens` the names of the
    tokenizer's added tokens are those tokens, as in the library's `encode`; without, they are ordinary text.

    Documents are dealt out by ranges of doc_id (rows of one id by their text, so that a frequent id makes no large
    range) and sorted within; null ids come first, equal ids follow their texts. A null text is empty: it has the end id
    alone. Repeated rows are all written; other columns are not looked at; an empty table makes files without rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path, pattern, remembered, splits_at_space, added_tokens)
        end = np.array([end_id], "<u4").tobytes()
        part, written = TaskContext.get().partitionId(), 0
        for batch in batches:
            encoded = [encoder.encode((t.as_py() or b"").decode("utf-8", "replace")) + end for t in batch.column(1)]
            counts = np.array([len(e) // 4 for e in encoded], np.int64)
            ends = np.cumsum(counts)
            ids = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4"))
            )
            columns = [
                pa.array(np.full(len(counts), part, np.int32)), batch.column(0), pa.array(written + ends - counts),
                pa.array(counts), ids,
            ]
            written += int(counts.sum())
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "offset", "n_tokens", "ids"])

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(cast(text as string) as binary) as text")
    (
        rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
        .mapInArrow(run, FILE_SCHEMA)
        .write.option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """The rows of the files; with `wanted` only those documents, found through Bloom filters and row indexes."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if wanted is None else rows.where(F.col("doc_id").isin(wanted))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            ends = ends - ends[0]
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            columns = [batch.column(i) for i in range(4)] + [pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "offset", "n_tokens", "ids_crc32"])

    rows = read_token_files(spark, path)
    # One row per range of documents, that is per writing task; its running sum is a window over that small table.
    before = (
        rows.groupBy("part")
        .agg(F.sum("n_tokens").alias("tokens"))
        .select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base"))
    )
    digests = rows.mapInArrow(run, "part int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return digests.join(before, "part").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
