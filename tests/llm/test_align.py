from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm.common import AWKWARD, documents, prose
from newsloom.llm import align
from newsloom.llm.token_files import byte_letters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(A)
LIBRARY.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
OWN = {chr(letter): byte for byte, letter in byte_letters().items()}


def tokens(text):
    """Ids and bytes of both tokenizers by the libraries, without tokens where the bytes differ."""
    if not text:
        return [], [], [], []
    a = LIBRARY.encode(" " + text, add_special_tokens=False).ids
    b = PIECES.encode(text)
    a_bytes = [bytes(OWN[c] for c in LIBRARY.id_to_token(i)) for i in a]
    b_bytes = [
        bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in b
    ]
    want = (" " + text).encode()
    return (a, b, a_bytes, b_bytes) if b"".join(a_bytes) == want == b"".join(b_bytes) else ([], [], [], [])


def brute(texts):
    """Groups by the set of shared ends, and link counts over all texts."""
    groups, links = [], []
    for text in texts:
        a, b, a_bytes, b_bytes = tokens(text)
        a_ends, b_ends = np.cumsum([len(t) for t in a_bytes]), np.cumsum([len(t) for t in b_bytes])
        cuts = sorted(set(a_ends.tolist()) & set(b_ends.tolist()))
        at, made = 0, []
        for cut in cuts:
            made.append(([i for i, e in zip(a, a_ends) if at < e <= cut], [i for i, e in zip(b, b_ends) if at < e <= cut]))
            at = cut
        groups.append((len(a), len(b), made))
        links.append([(x, y) for x, e in zip(a, a_ends) for y, f in zip(b, b_ends) if e == f])
    count = Counter(pair for l in links for pair in l)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    for (n_a, n_b, made), linked in zip(groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in made)
        best = sum(count[p] == top[p[1]] for p in linked)
        yield (
            n_a, n_b, len(made), len(linked), best, sum(count[p] for p in linked), hashlib.sha256(text.encode()).hexdigest() if n_a else "",
        )


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
HARD = ["a▁b", "▁", "  two  spaces ", "x" * 3_000, "ab " * 400, "\n\n\n", "日本語テキスト", "é é", "<s> </s> <unk> <0x41>", "\x00\x01", "-" * 500 + "=" * 300]


def test_documents_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(align, "BATCH_CHARS", 700)
    monkeypatch.setattr(align, "BATCH_TOKENS", 300)
    texts = AWKWARD + HARD + prose(51, 60, 90) + ["one two"] * 3
    order = [None, None, 5, 5, *range(10, 10 + len(texts) - 4)]
    rows = align.alignment_counts(documents(spark, texts, ids=order), A, P.PATTERN, B).collect()
    want = Counter((i, *row) for i, row in zip(order, brute(texts)))
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in rows) == want
    assert any(r.n_a == 0 for r in rows) and any(r.n_best < r.n_links for r in rows)


def test_no_documents(spark):
    none = documents(spark, ["x"]).where("false")
    assert align.alignment_counts(none, A, P.PATTERN, B).count() == 0
    empty = align.alignment_counts(documents(spark, [None, ""]), A, P.PATTERN, B).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in empty] == [(0, 0, 0, 0, 0, 0, "")] * 2


@pytest.mark.parametrize("share", [0.0, 0.02, 0.3, 0.9, 1.0])
def test_cuts_equal_the_intersection(share):
    """Several documents at once, with few and with many shared ends, long stretches without one among them."""
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 17, 400, 5_000):
        ends_a, ends_b, starts, stops, at = [], [], [], [], 0
        for _ in range(3):
            own = np.sort(rng.choice(4 * size, size, replace=False)) * 2 + at
            shared = rng.random(size) < share
            shared[-1] = True
            if size > 100:
                shared[size // 3 : size // 2] = False
            other = np.unique(np.where(shared, own, np.maximum(own - 1, at)))
            starts.append(sum(map(len, ends_a)))
            ends_a.append(own + 2)
            ends_b.append(other + 2)
            stops.append(starts[-1] + size)
            at = int(own[-1]) + 4
        a, b = np.concatenate(ends_a), np.concatenate(ends_b)
        got = align.shared_cuts(a, b, np.array(starts), np.array(stops))
        assert a[got].tolist() == np.intersect1d(a, b).tolist()


def test_a_long_text_without_cuts_takes_few_rounds(monkeypatch):
    rounds = []
    spread = align._spread
    monkeypatch.setattr(align, "_spread", lambda *a: rounds.append(1) or spread(*a))
    n = 200_000
    a, b = np.arange(1, n + 1) * 2, np.append(np.arange(1, n) * 2 + 1, 2 * n)
    assert align.shared_cuts(a, b, np.array([0]), np.array([n])).tolist() == [n - 1]
    assert len(rounds) < 60


def test_ranks_of_the_file_make_the_library_s_tokens():
    fast = align.ByteLevelTokens(A, P.PATTERN)
    assert fast.ranked is not None
    for token, i in LIBRARY.get_vocab().items():  # each token is reached by merges, as the library needs it
        if i < len(fast.bytes):
            assert [t.id for t in LIBRARY.model.tokenize(token)] == [i]
    for text in [*filter(None, AWKWARD), *HARD, *prose(52, 30)]:
        assert fast.encode(" " + text).tolist() == LIBRARY.encode(" " + text, add_special_tokens=False).ids
    fast.library, fast.ranked = LIBRARY, None
    assert fast.encode(" it's").tolist() == LIBRARY.encode(" it's").ids


@pytest.mark.parametrize("text", ["a" * 1_000_000, " " * 300_000, "\n" * 300_000, "ab cd " * 100_000])
def test_very_long_texts(text):
    a, b = align.worker_tokenizers(A, P.PATTERN, B)
    a_ids, b_ids, a_cuts, b_cuts = align._align([text, "x"], a, b)
    assert len(a_cuts[0]) == len(b_cuts[0]) and len(a_ids[1]) >= 1
    if len(a_ids[0]):
        assert a_cuts[0][-1].as_py() == len(a_ids[0]) and b_cuts[0][-1].as_py() == len(b_ids[0])
