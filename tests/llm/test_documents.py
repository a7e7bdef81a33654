from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from llm.common import AWKWARD, documents, prose
from newsloom.llm import components, licenses, mixing, simhash, winnow

# --- SimHash ---------------------------------------------------------------------------------


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def fingerprint(text, k=4):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, k)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components_of(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def copies(seed, base, n, edits):
    """Near copies: a few words of a long text replaced."""
    rng = np.random.default_rng(seed)
    words = base.split()
    out = []
    for _ in range(n):
        w = list(words)
        for at in rng.integers(0, len(w), edits):
            w[at] = f"w{rng.integers(1000)}"
        out.append(" ".join(w))
    return out


def test_hash_and_pieces(monkeypatch):
    text = " ".join(prose(3, 30))
    whole = np.concatenate(list(simhash.shingle_hashes(text.encode(), 4)))
    assert whole.tolist() == [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 4)]
    monkeypatch.setattr(simhash, "TEXT_BYTES", 7)
    assert np.concatenate(list(simhash.shingle_hashes(text.encode(), 4))).tolist() == whole.tolist()
    for short in ("", " ", "a", "a b", "a b c", "A b c d"):
        got = [h for part in simhash.shingle_hashes(short.encode(), 4) for h in part.tolist()]
        assert got == [xxhash.xxh64_intdigest(s, 42) for s in shingles(short, 4)]


@pytest.mark.parametrize("matches,together", [(4, 2), (4, 3), (4, 4), (3, 2), (2, 2), (1, 2), (5, 2)])
def test_any_guaranteed_matches_meet_in_a_list(matches, together):
    sets = [set(p) for p in simhash.covering_positions(8, matches, together)]
    assert all(any(s <= set(c) for s in sets) for c in itertools.combinations(range(8), matches))


@pytest.mark.parametrize("list_rows,short", [(4096, 24), (5, 3)])
def test_components_equal_brute_force(spark, monkeypatch, list_rows, short):
    monkeypatch.setattr(simhash, "SHORT_LIST", short)
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 63, 6)
    fps = [int(c) for c in centre] + [0, (1 << 64) - 1]
    for _ in range(150):  # dense groups and chains
        fps.append(fps[rng.integers(len(fps))] ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(bytearray(f.to_bytes(8, "big")),) for f in fps], "fp binary").repartition(4)
    links = simhash.fingerprint_links(df, 8, simhash.covering_positions(8, 4, 3), 4, 4, list_rows)
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in components.components(links).collect()}
    want = components_of(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = {}
    for f, c in zip(fps, want):
        least[c] = min(f, least.get(c, f))
    assert all(got.get(f, f) == least[c] for f, c in zip(fps, want))


def test_near_duplicates_equal_brute_force(spark):
    base = prose(11, 3, 200)
    texts = AWKWARD + [b for b in base for _ in range(3)] + copies(1, base[0] * 3, 12, 2) + prose(12, 30)
    order = [None if i == 3 else 1000 - i for i in range(len(texts))]
    got = simhash.near_duplicates(documents(spark, texts, ids=order))
    fps = [fingerprint(t) for t in texts]
    comp = components_of(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = defaultdict(lambda: 10**9)
    for i, c in zip(order, comp):
        least[c] = min(least[c], 10**9 if i is None else i)
    want = Counter((i, f"{f:016x}", None if least[c] == 10**9 else least[c]) for i, f, c in zip(order, fps, comp))
    assert Counter(map(tuple, got.collect())) == want
    assert simhash.near_duplicates(documents(spark, ["x"]).where("false")).count() == 0


def test_keep_one_of_each_group(spark):
    base = prose(13, 6, 900)
    groups = [copies(i, b, 5, 2) for i, b in enumerate(base) if len(b.split()) > 150]
    texts = AWKWARD + [t for g in groups for t in g] + prose(14, 30)
    docs = documents(spark, texts, ids=[*range(100, 100 + len(texts))])
    docs = docs.union(docs.where("doc_id in (104, 130)"))  # rows that are alike
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    got = Counter(r.doc_id for r in kept.collect())
    assert max(got.values()) == 1
    sets = [set(shingles(t, 5)) for t in texts]
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    first = {}
    for i, s in enumerate(sets):
        first[i] = next((j for j in range(i) if similar(s, sets[j])), None)
    assert set(got) == {100 + i for i, j in first.items() if j is None}
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_a_shared_repeated_line_makes_no_near_copies(spark, monkeypatch):
    """Only different shingles count, and each link is checked on them: own words stay, whatever repeats beside them."""
    monkeypatch.setattr(simhash, "SET_ROWS", 2)
    own = [" ".join(f"w{i}x{j}" for j in range(254)) for i in range(6)]
    line = " ".join(f"line{j}" for j in range(12))
    texts = [f"{o} " + " ".join([line] * 30) for o in own]
    other_counts = [f"{own[i]} " + " ".join([line] * 3) for i in range(2)]  # copies but for the repeats
    half = " ".join(own[0].split()[:180]) + " " + " ".join(f"new{j}" for j in range(40))
    kept = simhash.keep_one(documents(spark, texts + other_counts + [half]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8]


def test_set_links_equal_brute_force():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 40)).astype(np.uint64)) for _ in range(80)]
    plain = [set(s.tolist()) for s in sets]
    pairs = [
        (a, b) for a in range(80) for b in range(a)
        if plain[a] and plain[b] and 10 * len(plain[a] & plain[b]) >= 7 * len(plain[a] | plain[b])
    ]
    links = simhash.set_links([s for s in sets], 0.7)
    want, got = components_of(80, pairs), components_of(80, [l for l in links if plain[l[0]]])
    assert all((want[a] == want[b]) == (got[a] == got[b]) for a in range(80) for b in range(a))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- mixing ----------------------------------------------------------------------------------


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = [s for s in names if s not in capped]
        per = (total - sum(most * sizes[s] for s in capped)) / max(1e-300, sum(weight[s] for s in left))
        over = {s for s in left if per * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else per * weight[s] for s in names}
        capped |= over


def test_mix_reaches_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 40)  # several levels
    texts = prose(21, 400, 300) + AWKWARD
    names = ["b", "a", "é", "Z", "tiny", None]
    sources = [names[min(i % 9, 5)] if i % 97 else "tiny" for i in range(len(texts))]
    sources = [("a" if s == "tiny" and i > 100 else s) for i, s in enumerate(sources)]
    docs = documents(spark, texts, sources)
    docs = docs.union(docs.where("doc_id < 5"))
    rows = mixing.mix(docs, seed=3).collect()
    by_id = dict(enumerate(sources))
    sizes = Counter()
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode().split()) and r.taken <= 3 * r.size and r.taken == r.size * r.copies
        sizes[by_id[r.doc_id]] += r.size
    want, taken = targets(sizes), Counter()
    for r in rows:
        assert r.source_size == sizes[by_id[r.doc_id]] and abs(r.target - want[by_id[r.doc_id]]) < 1e-6 * max(1, r.target)
        taken[by_id[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 5 for s in sizes), (taken, want)
    again = mixing.mix(docs.repartition(7), seed=3).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mix(docs.where("false")).count() == 0


def test_flight_keeps_words_and_documents():
    import random

    rng = np.random.default_rng(2)
    words, p = rng.integers(1, 500, 300).astype(float).tolist(), rng.random(300).tolist()
    for seed in range(5):
        q = mixing.flight(words, p, random.Random(seed))
        assert sum(0 < x < 1 for x in q) <= 2
        assert abs(sum(q) - sum(p)) < 1e-6 and abs(np.dot(q, words) - np.dot(p, words)) < 1e-4
    mean = np.mean([mixing.flight(words[:9], p[:9], random.Random(s)) for s in range(4000)], axis=0)
    assert np.abs(mean - p[:9]).max() < 0.04  # each keeps its expectation


def test_mixed_documents_are_the_rows_of_the_mix(spark):
    texts = prose(22, 60, 80) + AWKWARD
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id in (1, 2)"))
    mixed = mixing.mixed_documents(docs)
    assert mixed.schema == docs.schema
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +want


# --- winnowing -------------------------------------------------------------------------------


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def grams(text, k):
    tokens = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in re.findall(r"[^\x20\x09-\x0D]{1,16}", text.lower())]
    out = []
    for i in range(max(1, len(tokens) - k + 1)) if tokens else ():
        seed = 42
        for v in tokens[i : i + k]:
            seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
        out.append(seed & 0xFFFFFFFF)
    return out


def kept(text, k, window):
    g, out = grams(text, k), {}
    for i in range(max(1, len(g) - window + 1)) if g else ():
        part = g[i : i + window]
        out[max(j for j in range(len(part)) if part[j] == min(part)) + i, min(part)] = None
    return [(h, at) for at, h in out]


@pytest.mark.parametrize("k,window,cells", [(5, 16, 1024), (2, 3, 4)])
def test_winnowing_equals_brute_force(spark, monkeypatch, k, window, cells):
    monkeypatch.setattr(winnow, "BUCKET_ROWS", 3)
    monkeypatch.setattr(winnow, "RING_ROWS", 5)
    texts = AWKWARD + prose(31, 40, 120) + ["z" * 5_000, "a a a a a a a a a a a a"]
    order = [None, -(1 << 40), 1 << 60, *range(5, 5 + len(texts) - 3)]
    docs = documents(spark, texts, ids=order)
    got = sorted(map(tuple, winnow.compare_edits(docs, k, window).collect()), key=str)
    rows = sorted(((-(1 << 62) if i is None else i, t or "", i) for i, t in zip(order, texts)))
    want = []
    for at, (_, text, i) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        a, b, c = (kept(t, k, window) for t in (text, edited, after))
        sets = [{h for h, _ in x} for x in (a, b, c)]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        show = lambda x: " ".join(f"{h:08x}:{p}" for h, p in x)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), *near))
    want.sort(key=str)
    assert [w[:5] for w in want] == [g[:5] for g in got]
    assert np.allclose([w[5:] for w in want], [g[5:] for g in got])
    plan = winnow.compare_edits(docs, k, window)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_only_texts_are_dealt_out(spark):
    """Kept hashes are made after the exchange by bucket, not sent through it."""
    plan = winnow.with_next(documents(spark, prose(33, 20)))._jdf.queryExecution().sparkPlan().toString()
    executed = winnow.with_next(documents(spark, prose(33, 20)))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "regexp_extract_all" in plan
    lines, depth = executed.split("\n"), lambda line: len(line) - len(line.lstrip(" :+-*"))
    found = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(bucket" in line]
    assert found
    for i in found:
        below = itertools.takewhile(lambda line: depth(line) > depth(lines[i]), lines[i + 1 :])
        assert not any("regexp_extract_all" in line for line in below)


def test_one_row_and_none(spark):
    one = winnow.compare_edits(documents(spark, ["a b c d e f g h"])).first()
    assert one.near_next == 1.0
    assert winnow.compare_edits(documents(spark, ["x"]).where("false")).count() == 0


def test_a_shared_run_of_tokens_is_always_found(spark):
    rng = np.random.default_rng(9)
    run = " ".join(f"r{i}" for i in range(winnow.K + winnow.WINDOW - 1))
    texts = []
    for _ in range(10):
        before, after = (" ".join(f"x{v}" for v in rng.integers(0, 10**6, rng.integers(0, 40))) for _ in range(2))
        texts.append(f"{before} {run} {after}")
    sets = [{h for h, _ in kept(t, winnow.K, winnow.WINDOW)} for t in texts]
    assert all(a & b for a, b in itertools.combinations(sets, 2))
    found = winnow.fingerprints(documents(spark, texts)).collect()
    assert all({v >> 31 for v in r.kept} == sets[r.doc_id] for r in found)


def test_edits_of_short_texts_share_hashes(spark):
    """A text of some words that loses its last quarter is still like itself, at the operator's own parameters."""
    texts = [" ".join(f"w{i:02d}{j:02d}" for j in range(n)) for i, n in enumerate([*range(5, 21)] * 3)]
    rows = winnow.compare_edits(documents(spark, texts)).collect()
    assert len(rows) == len(texts) and all(r.near_edited >= 0.2 and r.near_next == 0 for r in rows)


def test_the_order_of_words_counts(spark):
    """The same words the other way round are another text, at the operator's own parameters; the text itself is still found."""
    words = [f"w{i:02d}" for i in range(60)]
    rows = winnow.compare_edits(documents(spark, [" ".join(words), " ".join(reversed(words))])).collect()
    assert all(r.near_next == 0 and r.near_edited > 0.4 for r in rows)


# --- licenses --------------------------------------------------------------------------------


def test_licenses_are_found_with_their_spans(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    body = licenses.TEMPLATES["MIT-text"]
    near = body.replace("free of charge", "free of any cost").replace("a copy", "one copy").upper()
    texts = [f"é 日 {mit}\nmore text", f"{apache} x {mit} y {mit}", near, "MIT License", "Released under some other License", *AWKWARD]
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id = 0"))
    rows = licenses.scan_licenses(docs).collect()
    found = Counter((r.doc_id, r.license) for r in rows)
    assert found == {(0, "MIT"): 2, (1, "Apache-2.0"): 1, (1, "MIT"): 2, (2, "MIT-text"): 1}
    for r in rows:
        assert r.coverage >= licenses.COVERAGE
        if r.license in ("MIT", "Apache-2.0"):
            assert texts[r.doc_id][r.start : r.end] == licenses.TEMPLATES[r.license].rstrip(".") and r.coverage == 1
    assert licenses.scan_licenses(docs.where("false")).count() == 0
    assert licenses.scan_licenses(docs, {}).count() == 0 == licenses.scan_licenses(docs, {"none": " .. "}).count()


def test_several_passes_find_the_same(spark, monkeypatch):
    docs = documents(spark, [f"a {t} b" for t in licenses.TEMPLATES.values()])
    want = Counter(map(tuple, licenses.scan_licenses(docs).collect()))
    monkeypatch.setattr(licenses, "PASS_TEMPLATES", 2)
    assert Counter(map(tuple, licenses.scan_licenses(docs).collect())) == want and len(want) >= len(licenses.TEMPLATES)


def test_alignment_equals_a_full_one():
    """Within a wide band the matched tokens are the longest common subsequence."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        x, y = (rng.integers(1, 5, rng.integers(1, 15)).astype(np.uint64) for _ in range(2))
        best = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1, j + 1] = best[i, j] + 1 if x[i] == y[j] else max(best[i, j + 1], best[i + 1, j])
        matched = licenses.align(x, y, 0, 0, 60)
        assert len(matched) == best[-1, -1] and matched == sorted(set(matched))
