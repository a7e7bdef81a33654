"""SimHash near-duplicates with a byte-position inverted index and count filtering.

A fingerprint has a bit for the majority of a document's shingle hashes. Two fingerprints of n bytes that differ in d bits share
at least n - d bytes at equal positions: the guaranteed minimum of matches. The index has posting lists of fingerprints by the values at
certain byte positions; pairs that meet in a list are tallied, those that share enough bytes are verified by their
differing bits. A single byte would make lists of 1/256 of all fingerprints, so a list is keyed by several positions
together, chosen so that any pair with the guaranteed matches still meets in some list.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.components import components
from newsloom.llm.rows import row_key, take_rows
from newsloom.session import scratch_dir

SEED = 42
#: Bytes of text whose words are held at once, and shingles and documents that are counted together.
TEXT_BYTES = 1 << 20
SHINGLES = 1 << 18
DOCUMENTS = 128
#: Fingerprints of a posting list that one task compares; longer lists are cut into blocks that meet in pairs.
LIST_ROWS = 4_096
#: Lists up to this length are compared all at once, in vectors over the whole batch.
SHORT_LIST = 24
#: Positions after which the lists of `keep_one` are linked, before the others are.
PASSES = (4, 16)
#: Shingle sets of a group that one task compares exactly; larger groups are cut into blocks that meet in pairs.
SET_ROWS = 128

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of `words` words each, repeats included, in arrays; A-Z count as a-z.

    Fewer words make one shingle of all of them, no words none. A long text is taken in pieces that overlap by words - 1 words.
    """
    from xxhash import xxh64_intdigest as digest

    low, at, carried, some = text.lower(), 0, [], False
    while at < len(low):
        end = at + TEXT_BYTES
        if end < len(low):
            found = _SPACE.search(low, end)
            end = found.start() if found else len(low)
        found = carried + low[at:end].split()
        at = end
        if len(found) < words:
            carried = found
            continue
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
        some = True
        yield np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)
        carried = found[len(found) - words + 1 :] if words > 1 else []
    if carried and not some:
        yield np.array([digest(b" ".join(carried), SEED)], np.uint64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    parts = [np.unique(h) for h in shingle_hashes(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _derived(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th 64-bit number of a hash; the first is the hash itself."""
    if not j:
        return h
    h = h + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _bit_counts(h: np.ndarray, doc: np.ndarray, docs: int, numbers: int) -> np.ndarray:
    """How many hashes of each document set each bit; a row of 64 * numbers counts per document."""
    out = np.empty((docs, numbers * 64), np.float32)
    base = doc * 256
    for j in range(numbers):
        octets = _derived(h, j).astype(">u8").view(np.uint8).reshape(-1, 8)
        for b in range(8):
            tally = np.bincount(base + octets[:, b], minlength=docs * 256).reshape(docs, 256)
            out[:, j * 64 + b * 8 : j * 64 + b * 8 + 8] = tally.astype(np.float32) @ _BITS
    return out


def fingerprint_batch(texts: Iterator[bytes], words: int, numbers: int) -> list[bytes]:
    """Fingerprints of 64 * numbers bits: a bit is 1 if more than half of the document's shingle hashes set it."""
    return majority_bits((shingle_hashes(text, words) for text in texts), numbers)


def majority_bits(hashes: Iterator[Iterable[np.ndarray]], numbers: int) -> list[bytes]:
    """Fingerprints of documents that are given by their shingle hashes, in arrays."""
    done: list[bytes] = []
    pending: list[np.ndarray] = []
    owner: list[int] = []
    docs, size = 0, 0
    counts, totals = np.zeros((DOCUMENTS, 64 * numbers)), np.zeros(DOCUMENTS)

    def tally() -> None:
        nonlocal size
        if pending:
            doc = np.repeat(np.array(owner), [len(h) for h in pending])
            counts[:docs] += _bit_counts(np.concatenate(pending), doc, docs, numbers)
            np.add.at(totals, owner, [len(h) for h in pending])
            pending.clear()
            owner.clear()
            size = 0

    def finish() -> None:
        nonlocal docs
        tally()
        packed = np.packbits(counts[:docs] * 2 > totals[:docs, None], axis=1)
        done.extend(row.tobytes() for row in packed)
        counts[:], totals[:], docs = 0, 0, 0

    for parts in hashes:
        docs += 1
        for h in parts:
            pending.append(h)
            owner.append(docs - 1)
            size += len(h)
            if size >= SHINGLES:
                tally()
        if docs == DOCUMENTS:
            finish()
    if docs:
        finish()
    return done


def fingerprints(docs: DataFrame, words: int = 4, numbers: int = 1, key: Column | None = None) -> DataFrame:
    """doc_id, key and fp (binary, 8 * numbers bytes) of each row; a text without words (or null) has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fingerprint_batch((t.as_py() or b"" for t in batch.column(2)), words, numbers)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["doc_id", "key", "fp"])

    key = F.lit(0).cast("long") if key is None else key
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text").cast("string").cast("binary").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, key long, fp binary")


def covering_positions(size: int, matches: int, together: int) -> list[tuple[int, ...]]:
    """Sets of `together` byte positions such that any `matches` of `size` positions contain one of the sets.

    For two or three together the positions are dealt into groups: among `matches` positions, some group holds two, and for
    three also a group with the next one. Otherwise all sets of that size.
    """
    groups = [list(range(g, size, matches - 1)) for g in range(matches - 1)] if matches > 1 else []
    if together == 2 and matches > 2:
        return [pair for group in groups for pair in itertools.combinations(group, 2)]
    if together == 3 and matches == 4:
        inside = [triple for group in groups for triple in itertools.combinations(group, 3)]
        mixed = [(*pair, other) for g in range(3) for pair in itertools.combinations(groups[g], 2) for other in groups[(g + 1) % 3]]
        return inside + mixed
    return list(itertools.combinations(range(size), min(together, matches)))


def _linked(a: np.ndarray, b: np.ndarray, matches: int, bits: int) -> np.ndarray:
    """Which rows of a and b (octets) share enough positional bytes and differ in few enough bits."""
    different = a ^ b
    out = (different == 0).sum(axis=-1) >= matches
    at = np.flatnonzero(out) if out.ndim == 1 else np.nonzero(out)
    out[at] = np.bitwise_count(different[at]).sum(axis=-1) <= bits
    return out


def _list_links(rows: np.ndarray, groups: np.ndarray, matches: int, bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within one list; each row is compared with the rows not reached yet.

    Rows of one group (not zero) are connected already: a link reaches all of them.
    """
    links, left = [], np.arange(len(rows))
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        if groups[reached[0]]:
            same = groups[left] == groups[reached[0]]
            reached, left = reached + left[same].tolist(), left[~same]
        while reached and len(left):
            i = reached.pop()
            near = _linked(rows[left], rows[i], matches, bits)
            if not near.any():
                continue
            found, left = left[near], left[~near]
            own, first = np.unique(groups[found], return_index=True)
            one = groups[found] == 0
            one[first] = True
            links += [(i, j) for j in found[one].tolist()]
            same = np.isin(groups[left], own[own != 0])
            reached += found.tolist() + left[same].tolist()
            left = left[~same]
    return links


def list_links(
    lists: np.ndarray, rows: np.ndarray, matches: int, bits: int, groups: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links within posting lists; `lists` has the list number of each row, ascending. No link joins two rows of one group (0: none)."""
    groups = np.zeros(len(rows), np.int64) if groups is None else groups
    starts = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(lists)])))
    links: list[tuple[int, int]] = []
    for start, size in zip(starts[sizes > SHORT_LIST].tolist(), sizes[sizes > SHORT_LIST].tolist()):
        found = _list_links(rows[start : start + size], groups[start : start + size], matches, bits)
        links += [(start + i, start + j) for i, j in found]
    short = np.flatnonzero(np.repeat((sizes <= SHORT_LIST) & (sizes > 1), sizes))
    number, part, group = lists[short], rows[short], groups[short]
    for step in range(1, SHORT_LIST):
        same = np.flatnonzero(number[step:] == number[:-step])
        if not len(same):
            break
        near = same[(group[same] == 0) | (group[same] != group[same + step])]
        near = near[_linked(part[near], part[near + step], matches, bits)]
        links += zip(short[near].tolist(), short[near + step].tolist())
    return links


def fingerprint_links(
    fps: DataFrame, size: int, positions: list[tuple[int, ...]], matches: int, bits: int, list_rows: int = LIST_ROWS
) -> DataFrame:
    """a, b: pairs of distinct fingerprints of `fps` (fp) that connect all that differ in at most `bits` bits, share at
    least `matches` positional bytes and meet in a posting list. Not all pairs of a dense group: links that connect it.
    With a column `known` (long, not null) fingerprints of one number other than 0 count as connected and get no links among them.
    """
    fps = fps if "known" in fps.columns else fps.withColumn("known", F.lit(0).cast("long"))
    octet = [F.conv(F.hex(F.substring("fp", p + 1, 1)), 16, 10).cast("long") for p in range(size)]
    keys = []
    for number, chosen in enumerate(positions):
        value = F.lit(number).cast("long")
        for p in chosen:
            value = F.shiftleft(value, 8).bitwiseOR(F.element_at("octets", p + 1))
        keys.append(value)
    postings = fps.select("fp", "known", F.array(*octet).alias("octets")).select("fp", "known", F.explode(F.array(*keys)).alias("list"))
    # Long lists are cut into blocks of fingerprints, and each pair of blocks is a cell of its own.
    long = postings.groupBy("list").count().where(F.col("count") > list_rows).select(
        F.col("list").alias("long"), F.ceil(F.col("count") / list_rows).cast("int").alias("blocks")
    )
    blocks = F.coalesce("blocks", F.lit(1))
    block = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    placed = postings.join(long, F.col("list") == F.col("long"), "left").select(
        "fp", "known", "list", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    )
    cell = F.when(F.col("block") < F.col("other"), F.struct(F.col("block").alias("x"), F.col("other").alias("y"))).otherwise(
        F.struct(F.col("other").alias("x"), F.col("block").alias("y"))
    )
    dealt = placed.select("fp", "known", "list", cell.alias("cell")).repartition("list", "cell").sortWithinPartitions("list", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, rows, groups in whole_lists(batches, size):
            links = list_links(numbers, rows, matches, bits, groups)
            if links:
                at = np.array(links)
                ends = [pa.array([r.tobytes() for r in rows[at[:, i]]], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    flat = dealt.select("fp", "list", F.shiftleft(F.col("cell.x").cast("long"), 32).bitwiseOR(F.col("cell.y")).alias("cell"), "known")
    return flat.mapInArrow(run, "a binary, b binary")


def whole_lists(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """List numbers, fingerprints (octets) and known groups, cut only between lists. Input is sorted by list and cell."""
    keep_key, keep = np.empty((0, 3), np.int64), np.empty((0, size), np.uint8)
    for batch in batches:
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], axis=1)
        rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, size)
        key, rows = np.concatenate((keep_key, key)), np.concatenate((keep, rows))
        if not len(key):
            continue
        changes = np.flatnonzero((key[1:, :2] != key[:-1, :2]).any(axis=1)) + 1
        cut = int(changes[-1]) if len(changes) else 0
        if cut:
            yield np.searchsorted(changes, np.arange(cut), "right"), rows[:cut], key[:cut, 2]
        keep_key, keep = key[cut:], rows[cut:]
    if len(keep):
        yield np.zeros(len(keep), np.int64), keep, keep_key[:, 2]


def fingerprint_components(
    fps: DataFrame, size: int, positions: list[tuple[int, ...]], matches: int, bits: int, passes: tuple[int, ...] = ()
) -> DataFrame:
    """fp, root: each distinct fingerprint and its component's smallest one.

    Each list that a group of near copies shares links it anew. With `passes` the positions are taken in several passes that end at
    these numbers of positions (and at the last): a pass links what earlier ones have not connected, so a large group adds few links
    for each further list. The components are the same. Connected groups are known by a hash of 64 bits.
    """
    distinct = fps.select("fp").distinct()
    ends = [n for n in passes if n < len(positions)] + [len(positions)]
    first, *others = [positions[start:end] for start, end in zip([0, *ends], ends)]
    roots = components(fingerprint_links(distinct, size, first, matches, bits))
    for chosen in others:
        known = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
            "fp", F.when(F.col("root").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("root")).alias("known")
        )
        new = fingerprint_links(known, size, chosen, matches, bits)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, together: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable over links of at most `bits` bits).

    One row per row of `docs`; null texts and texts without words have fingerprint zero and are linked like any other. Rows with
    a null doc_id take part, and a component of such rows only has a null id. Repeated rows get equal results. Other columns are
    not looked at; an empty table gives an empty result. `bits` is at most 7: one of 8 bytes must be equal at least.
    """
    matches = 8 - bits
    if matches < 1:
        raise ValueError("a pair must share one of its 8 bytes at least")
    spark = docs.sparkSession
    path = scratch_dir(spark, "fingerprints")
    fingerprints(docs, words).drop("key").write.parquet(path)
    rows = spark.read.schema("doc_id long, fp binary").parquet(path)
    roots = fingerprint_components(rows, 8, covering_positions(8, matches, together), matches, bits)
    smallest = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    heads = smallest.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = smallest.join(heads, "root").select(F.col("fp").alias("known"), "component_id")
    return rows.join(of_fp, F.col("fp") == F.col("known")).select(
        "doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id"
    )


def set_fingerprints(docs: DataFrame, words: int, numbers: int) -> DataFrame:
    """doc_id, key, fp and node of each row: the fingerprint of its distinct shingles, and a digest that tells sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes: list[bytes] = []

            def sets() -> Iterator[list[np.ndarray]]:
                for t in batch.column(2):
                    found = shingle_set(t.as_py() or b"", words)
                    nodes.append(blake2b(found.tobytes(), digest_size=16).digest())
                    yield np.split(found, range(SHINGLES, len(found), SHINGLES))

            fps = majority_bits(sets(), numbers)
            columns = [batch.column(0), batch.column(1), pa.array(fps, pa.binary()), pa.array(nodes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "fp", "node"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("key"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, key long, fp binary, node binary")


def sets_alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the exact Jaccard similarity of two ascending sets is at least `similarity`."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    place = np.searchsorted(a, b)
    both = int((a[np.minimum(place, max(0, len(a) - 1))] == b).sum()) if len(a) and len(b) else 0
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def set_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect what is connected by pairs with an exact Jaccard similarity of at least `similarity`.

    Each set is compared with all that are not reached yet and whose size allows the similarity.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    links, left = [], np.arange(len(sets))
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            i = reached.pop()
            fits = np.minimum(sizes[left], sizes[i]) >= similarity * np.maximum(sizes[left], sizes[i]) - 1e-9
            near = np.zeros(len(left), bool)
            for at in np.flatnonzero(fits).tolist():
                near[at] = sets_alike(sets[i], sets[left[at]], similarity)
            links += [(i, j) for j in left[near].tolist()]
            reached += left[near].tolist()
            left = left[~near]
    return links


def links_across(sets: list[np.ndarray], second: int, similarity: float) -> list[tuple[int, int]]:
    """As `set_links`, for two blocks (the other one begins at `second`) whose own links are let out elsewhere: only the links from
    block to block that connect something more.
    """
    part, links = np.arange(len(sets)), []
    for start, end in ((0, second), (second, len(sets))):
        for i, j in set_links(sets[start:end], similarity):
            part[part == part[start + j]] = part[start + i]
    sizes = np.array([len(s) for s in sets], np.int64)
    for i in range(second):
        others = np.arange(second, len(sets))[part[second:] != part[i]]
        fits = np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i]) - 1e-9
        for j in others[fits].tolist():
            if part[j] != part[i] and sets_alike(sets[i], sets[j], similarity):
                links.append((i, j))
                part[part == part[j]] = part[i]
    return links


def verified_links(docs: DataFrame, members: DataFrame, words: int, similarity: float, set_rows: int = SET_ROWS) -> DataFrame:
    """a, b: nodes of one group of `members` (root, node, key, doc_id, rows, blocks) whose shingle sets are similar, as many as
    connect all that are. `members` is a stored table with one row of `docs` for each node.

    All pairs of a group are compared: its nodes are dealt into `blocks` blocks, and each pair of blocks is a cell. Links within a block
    are let out by its own cell only; two blocks that are each connected get one link.
    """
    known = members.select(
        F.col("key").alias("known"), F.col("doc_id").alias("own"), "rows", "node", F.xxhash64("root").alias("list"), "blocks"
    )
    own = docs.select(
        row_key(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    joined = own.join(known, F.col("key") == F.col("known")).where(F.col("own").eqNullSafe(F.col("doc_id")))
    taken = joined.where("rows = 1").unionByName(joined.where("rows > 1").dropDuplicates(["known", "own"]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t.as_py() or b"", words).tobytes() for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), sets], ["node", "list", "blocks", "shingles"])

    sets = taken.select("node", "list", "blocks", "text").mapInArrow(encode, "node binary, list long, blocks int, shingles binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")
    placed = sets.select("node", "list", "shingles", block.alias("block"), "blocks").select("node", "list", "shingles", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("block", F.col("other").cast("long")), F.greatest("block", F.col("other").cast("long"))
    dealt = placed.select("node", "list", F.shiftleft(low, 32).bitwiseOR(high).alias("cell"), "shingles", "block")
    dealt = dealt.repartition("list", "cell").sortWithinPartitions("list", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                numbers = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                for cell, node, found, block in zip(numbers, batch.column(0), batch.column(3), batch.column(4).to_pylist()):
                    yield cell, node.as_py(), np.frombuffer(found.as_py(), np.uint64), block

        for _, group in itertools.groupby(rows(), lambda r: r[0]):
            _, nodes, found, own = zip(*sorted(group, key=lambda r: r[3]))
            second = own.count(own[0])
            links = links_across(list(found), second, similarity) if second < len(own) else set_links(list(found), similarity)
            if links:
                ends = [pa.array([nodes[link[i]] for link in links], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, numbers: int = 8) -> DataFrame:
    """The rows of `docs` without near copies: of each component of similar documents the one with the smallest doc_id.

    Similar: the sets of different shingles of `words` words have a Jaccard similarity of `similarity` or more; every link is
    checked on the whole sets. Which pairs are checked is nominated by fingerprints of 64 * numbers bits over the different
    shingles: the angle between two documents at the threshold gives the share of differing bits to expect, and pairs up to
    four standard errors above are nominated if they meet in a posting list, of which there is one for each two neighbouring bytes
    (8 * numbers of them, in a ring). With independent bits 98 % of pairs at exactly 0.8 meet in one. Documents that nominations
    connect form a group, and all pairs of a group are checked. The tally asks for the equal bytes that pairs at the threshold
    have but for one in thousands.

    Null texts and texts without words are copies of each other. Null ids count as larger than any id. Of rows that are alike
    one stays. All columns are kept as they are.
    """
    spark = docs.sparkSession
    size = 8 * numbers
    cosine = 2 * similarity / (1 + similarity)
    share = float(np.arccos(cosine) / np.pi)
    bits = int(size * 8 * share + 4 * (size * 8 * share * (1 - share)) ** 0.5)
    equal = (1 - share) ** 8
    matches = max(1, int(size * equal - 3.5 * (size * equal * (1 - equal)) ** 0.5))
    positions = [(p, (p + 1) % size) for p in range(size)]
    path, plan = scratch_dir(spark, "fingerprints"), scratch_dir(spark, "kept-rows")
    set_fingerprints(docs, words, numbers).write.parquet(path)
    rows = spark.read.schema("doc_id long, key long, fp binary, node binary").parquet(path)
    roots = fingerprint_components(rows, size, positions, matches, bits, PASSES)
    alike = rows.groupBy("fp", "node", "doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "rows")).alias("first")
    per_node = alike.groupBy("fp", "node").agg(first).join(roots, "fp").select("node", "root", "first")
    nodes_path, members_path = scratch_dir(spark, "set-nodes"), scratch_dir(spark, "set-members")
    per_node.write.parquet(nodes_path)
    nodes = spark.read.schema(per_node.schema).parquet(nodes_path)
    groups = nodes.groupBy("root").count().where("count > 1").select(
        F.col("root").alias("group"), F.ceil(F.col("count") / SET_ROWS).cast("int").alias("blocks")
    )
    members = nodes.join(groups, F.col("root") == F.col("group")).select("root", "node", "first.key", "first.doc_id", "first.rows", "blocks")
    members.write.parquet(members_path)
    stored = spark.read.schema(members.schema).parquet(members_path)
    linked = components(verified_links(docs, stored, words, similarity)).select(F.col("node").alias("linked"), F.col("root").alias("head"))
    of_node = nodes.join(linked, F.col("node") == F.col("linked"), "left").select(F.coalesce("head", "node").alias("head"), "first")
    of_node.groupBy("head").agg(F.min("first").alias("first")).select(
        "first.key", "first.doc_id", "first.rows", F.lit(1).alias("copies")
    ).write.parquet(plan)
    return take_rows(docs, spark.read.parquet(plan))
