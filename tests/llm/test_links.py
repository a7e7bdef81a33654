from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from llm.test_documents import components_of
from newsloom.llm import simhash


def parts(n: int, links) -> list[int]:
    """The first member of each one's component."""
    found = components_of(n, links)
    return [found.index(c) for c in found]


def near_fingerprints(n: int) -> list[bytes]:
    """A dense group around one fingerprint of 512 bits, and strangers."""
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 256, 64).astype(np.uint8)
    out = []
    for _ in range(n):
        bits = np.unpackbits(centre)
        bits[rng.choice(512, 20, replace=False)] ^= 1
        out.append(np.packbits(bits).tobytes())
    return out + [rng.integers(0, 256, 64).astype(np.uint8).tobytes() for _ in range(20)]


def test_passes_find_the_same_components_with_few_links(spark, monkeypatch):
    seen = []
    plain = simhash.components
    monkeypatch.setattr(simhash, "components", lambda links: (seen.append(links.distinct().count()), plain(links))[1])
    fps = spark.createDataFrame([(bytearray(f),) for f in near_fingerprints(300)], "fp binary").repartition(3)
    positions = [(p, (p + 1) % 64) for p in range(64)]
    at_once = simhash.fingerprint_components(fps, 64, positions, 10, 80).collect()
    passes = simhash.fingerprint_components(fps, 64, positions, 10, 80, (4, 16)).collect()
    assert sorted(map(tuple, at_once)) == sorted(map(tuple, passes)) and len({r.root for r in passes}) == 21
    assert sum(seen[1:]) < 8 * 300 < seen[0] / 4


def test_known_groups_get_no_links_among_them():
    rows = np.frombuffer(b"".join(near_fingerprints(60)[:60]), np.uint8).reshape(-1, 64)
    for lists in (np.zeros(60, np.int64), np.arange(60) // 6):  # long and short lists
        same = np.full(60, 7)
        assert simhash.list_links(lists, rows, 10, 80, same) == []
        half = np.where(np.arange(60) % 6 < 3, 7, 0)
        links = simhash.list_links(lists, rows, 10, 80, half)
        assert all(not (half[a] and half[b]) for a, b in links)
        whole = links + [(a, b) for a in range(60) for b in range(a) if half[a] and half[b] and lists[a] == lists[b]]
        assert parts(60, whole) == parts(60, simhash.list_links(lists, rows, 10, 80))


def test_links_across_two_blocks():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint64)) for _ in range(70)]
    inside = simhash.set_links(sets[:30], 0.7) + [(i + 30, j + 30) for i, j in simhash.set_links(sets[30:], 0.7)]
    across = simhash.links_across(sets, 30, 0.7)
    assert all(i < 30 <= j for i, j in across)
    assert parts(70, inside + across) == parts(70, simhash.set_links(sets, 0.7))
    dense = [np.append(np.arange(100, dtype=np.uint64), np.uint64(200 + i)) for i in range(90)]
    assert len(simhash.links_across(dense, 40, 0.8)) == 1


def test_a_large_group_of_similar_sets_has_few_links(spark, monkeypatch):
    """Blocks of two rows: a link for each row and one for each pair of blocks, and all are connected."""
    n, words = 24, [f"w{i}" for i in range(120)]
    texts = [" ".join(words + [f"end{i}"]) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    nodes = simhash.set_fingerprints(docs, 5, 1)
    members = nodes.select(F.lit(b"r").alias("root"), "node", "key", "doc_id", F.lit(1).alias("rows"), F.lit(4).alias("blocks"))
    links = simhash.verified_links(docs, members, 5, 0.8).distinct().collect()
    assert len(links) <= n + 6 and len({x for link in links for x in link}) == n
    names = {x: i for i, x in enumerate(sorted({bytes(x) for link in links for x in link}))}
    assert len(set(parts(n, [(names[bytes(a)], names[bytes(b)]) for a, b in links]))) == 1
