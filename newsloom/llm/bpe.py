"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The vocabulary is a rank file (base64 token, rank per line) whose path is a parameter; it is read on the driver with
plain Python (vocabularies ship with the installation) and sent to the executors once, as a broadcast of a few MB whose size is checked.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm.pieces import REMEMBERED, PieceEncoder

#: Largest vocabulary that is sent to every executor.
MAX_VOCABULARY_BYTES = 64 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    if sum(len(t) + 8 for t in ranks) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to be sent to every executor")
    return ranks


class Encoder:
    """Ids of a text, as little-endian unsigned 32-bit integers, and the bytes of ids."""

    def __init__(
        self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED, splits_at_space: bool = False
    ):
        self.ranks = ranks
        self.pair_rank = {token: rank for token, rank in ranks.items() if len(token) > 1}
        self.longest = max(map(len, ranks), default=1)
        size = max(ranks.values(), default=0) + 1
        self.shift = (size.bit_length() + 1) // 2
        self.words = [0] * ((size >> self.shift) + 1)
        self.pack = {rank: rank.to_bytes(4, "little") for rank in ranks.values()}
        self.token = {rank: token for token, rank in ranks.items()}
        self.encode = PieceEncoder(pattern, self.encode_piece, remembered, splits_at_space).encode

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def encode_piece(self, text: str) -> bytes:
        piece = text.encode("utf-8")
        whole = self.ranks.get(piece)
        if whole is not None:
            return self.pack[whole]
        get, pack = self.ranks.get, self.pack
        return b"".join([pack[get(part)] for part in self.merge(piece)])

    def merge(self, piece: bytes) -> list[bytes]:
        """The tokens of one pre-token: merge the leftmost pair of the smallest rank until no pair has a rank.

        The queue: a bucket of positions per rank, and a bitmap of two levels that tells which ranks have one (a bit per
        rank in words of about the square root of the number of ranks, and in `top` a bit per word), so that the
        smallest rank is one find-first-set in either level. A bucket is opened as a whole, from left to right.
        Symbols form a linked list over their first byte. A queued position is stale if no symbol begins there any
        more or the pair there now has another rank; it is skipped. Work is in proportion to the pre-token's length, so
        one of millions of bytes is no problem.
        """
        n, ranks, longest = len(piece), self.pair_rank.get, self.longest
        words, shift, top, buckets = self.words, self.shift, 0, {}
        low_bits = (1 << shift) - 1
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        # Rank of the pair that begins at a byte; -1: it has none, or no symbol begins there.
        pair = [ranks(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        fresh = [(rank, i) for i, rank in enumerate(pair) if rank >= 0]
        while True:
            for rank, i in fresh:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    words[rank >> shift] |= 1 << (rank & low_bits)
                    top |= 1 << (rank >> shift)
            if not top:
                break
            at = (top & -top).bit_length() - 1
            word = words[at]
            rest = words[at] = word & (word - 1)
            if not rest:
                top &= top - 1
            rank = at << shift | (word ^ rest).bit_length() - 1
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()
            fresh = []
            for done, i in enumerate(positions):
                if pair[i] != rank:
                    continue
                least = rank
                j = after[i]
                after[i] = k = after[j]
                pair[j] = pair[i] = -1
                if k < n:
                    before[k] = i
                    end = after[k]
                    if end - i <= longest and (found := ranks(piece[i:end], -1)) >= 0:
                        pair[i] = found
                        fresh.append((found, i))
                        if found < least:
                            least = found
                h = before[i]
                if h >= 0:
                    found = pair[h] = ranks(piece[h:k], -1) if k - h <= longest else -1
                    if found >= 0:
                        fresh.append((found, h))
                        if found < least:
                            least = found
                if least < rank:  # a vocabulary whose longer token has a smaller rank: that one goes first
                    fresh += [(rank, later) for later in positions[done + 1 :]]
                    break
        out, i = [], 0
        while i < n:
            out.append(piece[i : after[i]])
            i = after[i]
        return out


#: Encoders of this Python worker, which serves many tasks and keeps what it remembers between them.
_ENCODERS: dict[tuple, Encoder] = {}


def worker_encoder(ranks: dict[bytes, int], key: str, *options) -> Encoder:
    full = (key, *options)
    if full not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[full] = Encoder(ranks, *options)
    return _ENCODERS[full]


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False, remembered: int = REMEMBERED,
    splits_at_space: bool = False,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of `docs`; with `keep_ids` also ids (array of long).

    A null text is the empty text: no ids, and the digests of no bytes. Repeated rows and null ids are kept as they
    are; other columns are not looked at; an empty table gives an empty table. Texts of any length are encoded whole.
    Bytes that are not UTF-8 count as U+FFFD. There is no shuffle, and a worker holds one Arrow batch, its vocabulary and at most `remembered` pre-tokens. `splits_at_space`: see PieceEncoder.
    """
    spark = docs.sparkSession
    ranks = load_ranks(ranks_path)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value, key, pattern, remembered, splits_at_space)
        for batch in batches:
            counts, digests, decoded, arrays = [], [], [], []
            for value in batch.column(1):
                text = (value.as_py() or b"").decode("utf-8", "replace")
                ids = encoder.encode(text)
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                if keep_ids:
                    arrays.append(np.frombuffer(ids, "<u4").astype(np.int64))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(arrays, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = SCHEMA + (", ids array<long>" if keep_ids else "")
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(cast(text as string) as binary) as text").mapInArrow(run, schema)
