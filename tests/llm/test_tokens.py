from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from llm.common import AWKWARD, documents, prose
from newsloom.llm import bpe, pieces, queries, token_files

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODERS = [bpe.Encoder(RANKS, P.PATTERN, 100, splits) for splits in (False, True)]


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def test_rank_file():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        token, rank = next(lines).split()
    assert RANKS[base64.b64decode(token)] == int(rank) and len(RANKS) == 50_256


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'st \t\n\u00a0é日😀1!<|"), max_size=40) | st.text(max_size=40))
def test_ids_equal_the_library_and_decode(text):
    for encoder in ENCODERS:
        packed = encoder.encode(text)
        assert ids(packed) == TIKTOKEN.encode_ordinary(text)
        assert encoder.decode(packed) == text.encode("utf-8")


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, "\n" * 9_000, " x" * 5_000, "é日" * 4_000])
def test_very_long_pre_tokens(text):
    assert all(ids(e.encode(text)) == TIKTOKEN.encode_ordinary(text) for e in ENCODERS)


def test_merges_by_rank_when_a_longer_token_ranks_first():
    """By brute force on a small vocabulary whose longer tokens do not follow their parts."""
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {b"abc": 256, b"bc": 257, b"ab": 258, b"aa": 259, b"abca": 260, b"ca": 261}
    encoder = bpe.Encoder(ranks, r"\S+|\s+")

    def brute(piece: bytes) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return parts
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = np.random.default_rng(1)
    for _ in range(300):
        piece = bytes(rng.choice(list(b"abc"), size=rng.integers(1, 14)).tolist())
        assert encoder.merge(piece) == brute(piece)


def test_documents_round_trip(spark):
    texts = AWKWARD + prose(1, 20)
    got = bpe.encode_documents(documents(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True, splits_at_space=True)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = TIKTOKEN.encode_ordinary(text or "")
        assert rows[i].ids == want and rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_no_documents(spark, tmp_path):
    none = documents(spark, ["x"]).where("doc_id < 0")
    assert bpe.encode_documents(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    token_files.write_token_files(none, str(tmp_path / "t"), P.path("byte_bpe_50k.json"), P.PATTERN)
    assert token_files.token_digests(spark, str(tmp_path / "t")).count() == 0


def test_token_files_read_back(spark, tmp_path):
    texts = AWKWARD + prose(2, 40)
    order = [None, None, 7, 7, *range(100, 100 + len(texts) - 4)]
    path = str(tmp_path / "t")
    docs = documents(spark, texts, ids=order)
    token_files.write_token_files(docs, path, P.path("byte_bpe_50k.json"), P.PATTERN, splits_at_space=True)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    encoded = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    rows = sorted(token_files.token_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(order, key=lambda i: -1 if i is None else i)
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    want = sorted((-1 if i is None else i, len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for i, e in zip(order, encoded))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    found = token_files.read_token_files(spark, path, [105, 999])
    assert [list(r.ids) for r in found.collect()] == [encoded[order.index(105)]]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def test_query_equals_the_unmodified_library(spark, tmp_path):
    names = ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext| >", "<|ENDOFTEXT|>"]
    texts = [*names, *AWKWARD, *prose(3, 10)]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    library, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    rows = sorted(queries.op3_token_files(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert 50_256 in library.encode(names[0], add_special_tokens=False).ids


def test_words_with_marks_are_encoded_without_the_pattern():
    texts = ["a new word, (odd) ones. Élan über\nlines and more!?\n 'tis it's don't' x' 12 a1 b_c d-e ...", *filter(None, AWKWARD), *prose(4, 20)]
    whole, cut = (pieces.PieceEncoder(P.PATTERN, lambda piece: f"[{piece}]".encode(), 1000, splits) for splits in (False, True))
    assert [cut.encode(t) for t in texts] == [whole.encode(t) for t in texts]
    matched, find = [], cut.find
    cut.find = lambda text: matched.append(text) or find(text)
    assert cut.encode("the zyxa zyxb, zyxc.\nZyxd öäü?! zyxe") == whole.encode("the zyxa zyxb, zyxc.\nZyxd öäü?! zyxe")
    assert matched == ["the"]


def test_letters_and_marks_are_those_of_the_pattern():
    import regex

    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    assert regex.fullmatch(r"\p{L}+", "".join(letters))
    assert regex.fullmatch(r"[^\s\p{L}\p{N}]+", pieces.MARKS)
