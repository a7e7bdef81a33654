"""Block scoring of users against candidate articles for the ensemble feed.

All unseen candidates of a user take part: component ranges are exact and nothing is pre-selected.
Scores are matrix products inside tasks; only the rows a feed can use leave a block: the best n per
user and the best few per (user, topic).

A chunk of users meets the candidates tile by tile, in one product of rows that hold all signals, scaled and weighted; pairs
below a user's limit so far are dropped at once, and the few that are left are scored again with the rounding of each part.

Few candidates (at most ARTICLE_BLOCK rows and BROADCAST_BYTES bytes, which is checked) go to every task and users are
only streamed past them. More candidates form a grid of (user block, article block) groups of bounded
size; a first pass over the grid finds the component ranges per user, a second one scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from newsloom.functions.topk import first_k, to_ids
from newsloom.schemas import TOPICS

#: Rows of a block of the grid at most, and the rows from which on it may be cut.
ARTICLE_BLOCK = 65536
USER_BLOCK_MOST = 65536
USER_BLOCK = 2048
#: Blocks of a side, and of the grid, that are formed for the sake of parallel work. More are formed only as full blocks, since each
#: side is sent once for every block of the other one.
SIDE_BLOCKS = 8
GRID_BLOCKS = 64
#: Rows of a tile, which stays in a core's cache, and pairs that are held before they are scored for good.
USERS_AT_ONCE = 256
ARTICLES_AT_ONCE = 2048
PAIRS_HELD = 1 << 21
BROADCAST_BYTES = 64 << 20
#: Of a candidate, besides its numbers.
ROW_BYTES = 64
PLACES = 6
PARTS = ("content", "collab", "topic_fit")
SCORED = (
    "user_id bigint, article_id bigint, topic string, content double, collab double, topic_fit double, "
    "popularity double, score double"
)
RANGES = "user_id bigint, " + ", ".join(f"{p}_low double, {p}_high double" for p in PARTS)
NAMES = np.array([TOPICS[t] for t in sorted(TOPICS)] + [None], dtype=object)


def _lists(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """List column to (matrix, row has a value); null rows are zeros, null items are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    has = np.asarray(column.is_valid())
    matrix = np.zeros((len(column), width))
    if has.any():
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(flat):
            matrix[has] = flat.reshape(has.sum(), -1)
    return matrix, has


def _width(column: pa.ChunkedArray) -> int:
    valid = column.drop_null()
    return len(valid[0]) if len(valid) else 0


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


class Candidates:
    """One block of candidate articles, sorted by topic and id."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("topic_index", "ascending"), ("article_id", "ascending")])
        self.ids = to_ids(table["article_id"])
        self.by_id = np.argsort(self.ids, kind="stable")
        self.vectors, self.has_vector = _finite(_unit(_lists(table["vector"], _width(table["vector"]))[0]))
        self.factors, finite = _finite(_lists(table["factor"], _width(table["factor"]))[0])
        self.has_factor = finite & _lists(table["factor"], self.factors.shape[1])[1]
        self.topic = to_ids(table["topic_index"]).astype(int)
        self.popularity = to_ids(table["popularity"]).astype(float)
        self.unusable = np.flatnonzero(~np.isfinite(self.popularity))
        self.per_topic = np.bincount(self.topic, minlength=len(NAMES))
        #: (first, end, topic) of the pieces that a chunk of users is scored against; a piece has one topic.
        ends = np.cumsum(self.per_topic)
        self.tiles = [
            (at, min(at + ARTICLES_AT_ONCE, int(end)), t)
            for t, end in enumerate(ends)
            for at in range(int(end - self.per_topic[t]), int(end), ARTICLES_AT_ONCE)
        ]
        #: The score of a user is the product of its row of `Users.sides` and these rows.
        self.sides = np.hstack([
            self.vectors, self.has_vector[:, None], np.where(self.has_factor[:, None], self.factors, 0.0), self.has_factor[:, None],
            np.eye(len(NAMES))[self.topic], np.nan_to_num(self.popularity, nan=0.0, posinf=0.0, neginf=0.0)[:, None],
        ])


def _finite(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix with zeros for rows that hold a value that is none, and which rows hold none of these."""
    good = np.isfinite(m).all(axis=1)
    return np.where(good[:, None], m, 0.0), good


def _list_column(column: pa.ChunkedArray) -> pa.ListArray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def _places(column: pa.ChunkedArray, cand: Candidates, field: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and candidates of the ids in a list column, and which of the flattened ids are candidates."""
    lists = _list_column(column)
    counts = np.asarray(lists.value_lengths().fill_null(0))
    rows, flat = np.repeat(np.arange(len(lists)), counts), lists.flatten()
    flat = (flat.field(field) if field else flat).to_numpy(zero_copy_only=False)
    if not len(cand.ids) or not len(flat):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(len(flat), bool)
    cols = cand.by_id[np.minimum(np.searchsorted(cand.ids, flat, sorter=cand.by_id), len(cand.ids) - 1)]
    hit = cand.ids[cols] == flat
    return rows[hit], cols[hit], hit


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.zeros((len(m), width))


def _dots(a: np.ndarray, rows: np.ndarray, b: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Rounded products of single pairs of rows, some pairs at a time."""
    out = np.zeros(len(rows))
    for at in range(0, len(rows), 1 << 16):
        some = slice(at, at + (1 << 16))
        out[some] = np.einsum("ij,ij->i", a[rows[some]], b[cols[some]])
    return np.round(out, PLACES)


class Pairs:
    """Some (user, candidate) pairs of a chunk, by candidate, so that the pairs of a tile are one slice."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray | None = None):
        order = np.argsort(cols, kind="stable")
        self.rows, self.cols = rows[order], cols[order]
        self.values = None if values is None else values[order]

    def inside(self, first: int, end: int) -> slice:
        return slice(*np.searchsorted(self.cols, (first, end)))


class Users:
    """One chunk of users with their components against a block of candidates.

    Components of all pairs are only formed as matrix products, tile by tile; `parts_of` has the exact ones of single pairs.
    """

    def __init__(self, table: pa.Table, cand: Candidates):
        self.cand, self.ids = cand, to_ids(table["user_id"])
        n, m = len(self.ids), max(1, len(cand.ids))
        profile, has_profile = _lists(table["profile"], cand.vectors.shape[1])
        self.profile, finite = _finite(_unit(profile))
        self.has_profile = has_profile & finite
        factor, has_factor = _lists(table["factor"], _width(table["factor"]))
        self.factor, finite = _finite(_padded(factor, cand.factors.shape[1]))
        self.has_factor = has_factor & finite
        prefs, has_prefs = _lists(table["prefs"], len(TOPICS))
        self.weights, _ = _lists(table["weights"], 4)
        self.prefs = np.full((n, len(NAMES)), np.nan)
        self.prefs[has_prefs, : len(TOPICS)] = np.round(prefs[has_prefs], PLACES)
        rows, cols, _ = _places(table["seen"], cand)
        seen = np.unique(rows * m + cols)
        self.seen = Pairs(seen // m, seen % m)
        #: Pairs with a collaborative value of their own, in the order of `key`.
        self.near, self.value = np.zeros(0, int), np.zeros(0)
        if "near" in table.column_names:
            rows, cols, hit = _places(table["near"], cand, "article_id")
            value = _list_column(table["near"]).flatten().field("collab").to_numpy(zero_copy_only=False).astype(float)[hit]
            both = self.has_factor[rows] & cand.has_factor[cols]
            keys = (rows * m + cols)[both]
            # Of several values of a pair, the last one.
            self.near, last = np.unique(keys[::-1], return_index=True)
            self.value = value[both][::-1][last]
        self.m = m
        fresh = np.isin(self.near, seen, invert=True)
        self.own = Pairs(self.near[fresh] // m, self.near[fresh] % m, self.value[fresh])

    def parts_of(self, rows: np.ndarray, cols: np.ndarray) -> dict[str, np.ndarray]:
        """Components of single pairs; NaN where one is missing."""
        cand = self.cand
        content = np.where(
            self.has_profile[rows] & cand.has_vector[cols], _dots(self.profile, rows, cand.vectors, cols), np.nan
        )
        collab = np.where(self.has_factor[rows] & cand.has_factor[cols], _dots(self.factor, rows, cand.factors, cols), np.nan)
        if len(self.near):
            keys = rows * self.m + cols
            at = np.minimum(np.searchsorted(self.near, keys), len(self.near) - 1)
            collab = np.where(self.near[at] == keys, self.value[at], collab)
        return {"content": content, "collab": collab, "topic_fit": self.prefs[rows, cand.topic[cols]]}

    def ranges(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Least and greatest value of each component over the unseen candidates that have one."""
        cand, n = self.cand, len(self.ids)
        low = {p: np.full(n, np.inf) for p in PARTS}
        high = {p: np.full(n, -np.inf) for p in PARTS}
        dense = cand.factors.shape[1] > 0
        for first, end, _ in cand.tiles:
            seen, own = self.seen.inside(first, end), self.own.inside(first, end)
            hidden = self.seen.rows[seen], self.seen.cols[seen] - first
            valued = self.own.rows[own], self.own.cols[own] - first
            without = np.flatnonzero(~cand.has_vector[first:end])
            _widen(self.profile @ cand.vectors[first:end].T, [hidden], without, low["content"], high["content"])
            if dense:
                without = np.flatnonzero(~cand.has_factor[first:end])
                _widen(self.factor @ cand.factors[first:end].T, [hidden, valued], without, low["collab"], high["collab"])
        for x in (low, high):
            x["content"] = np.round(x["content"], PLACES)
            x["collab"] = np.round(x["collab"], PLACES)
        low["content"][~self.has_profile], high["content"][~self.has_profile] = np.inf, -np.inf
        if not dense:
            # Every pair of a user and a candidate with clicks that has no value of its own has the value 0.
            taken = self.seen.rows[cand.has_factor[self.seen.cols]], self.own.rows
            zero = cand.has_factor.sum() - sum(np.bincount(rows, minlength=n) for rows in taken) > 0
            low["collab"][zero], high["collab"][zero] = 0.0, 0.0
        low["collab"][~self.has_factor], high["collab"][~self.has_factor] = np.inf, -np.inf
        there = ~np.isnan(self.own.values)
        np.minimum.at(low["collab"], self.own.rows[there], self.own.values[there])
        np.maximum.at(high["collab"], self.own.rows[there], self.own.values[there])
        hidden = np.zeros((n, len(NAMES)), int)
        np.add.at(hidden, (self.seen.rows, cand.topic[self.seen.cols]), 1)
        there = (cand.per_topic - hidden > 0) & ~np.isnan(self.prefs)
        low["topic_fit"] = np.where(there, self.prefs, np.inf).min(axis=1, initial=np.inf)
        high["topic_fit"] = np.where(there, self.prefs, -np.inf).max(axis=1, initial=-np.inf)
        return {p: (low[p], high[p]) for p in PARTS}

    def sides(self, ranges: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows whose products with `Candidates.sides` are the scores but for rounding; what the pairs of `own` have besides; and
        twice the most that a rounded score can be off these."""
        slope, start = {}, {}
        for p, (low, high) in ranges.items():
            with np.errstate(invalid="ignore", divide="ignore"):
                spread = np.where(high > low, 1.0 / (high - low), 0.0)
                slope[p], start[p] = spread, np.where(high > low, -low * spread, np.where(high == low, 1.0, 0.0))
        w = self.weights
        content = np.where(self.has_profile, w[:, 0], 0.0)
        collab = np.where(self.has_factor, w[:, 1], 0.0)
        fit = np.nan_to_num(self.prefs * slope["topic_fit"][:, None] + start["topic_fit"][:, None], nan=0.0) * w[:, 2:3]
        sides = np.hstack([
            self.profile * (content * slope["content"])[:, None], (content * start["content"])[:, None],
            self.factor * (collab * slope["collab"])[:, None], (collab * start["collab"])[:, None], fit, w[:, 3:4],
        ])
        slack = 2.2 * 10.0**-PLACES * (1 + np.abs(content) * slope["content"] + np.abs(collab) * slope["collab"])
        rows, cols, value = self.own.rows, self.own.cols, self.own.values
        dense = _dots(self.factor, rows, self.cand.factors, cols) * slope["collab"][rows] + start["collab"][rows]
        scaled = np.where(np.isnan(value), 0.0, value * slope["collab"][rows] + start["collab"][rows])
        return sides, collab[rows] * (scaled - dense), slack


def _widen(x: np.ndarray, pairs: list, without: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Widen ranges per row by a tile, but for some pairs and some columns."""
    for value, bound, least in ((-np.inf, high, False), (np.inf, low, True)):
        for rows, cols in pairs:
            x[rows, cols] = value
        if len(without):
            x[:, without] = value
        (np.minimum if least else np.maximum)(bound, x.min(axis=1) if least else x.max(axis=1), out=bound)


def _scaled(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Min-max inside the user; a single value scales to 1, a missing one to 0."""
    with np.errstate(invalid="ignore", divide="ignore"):
        y = np.where(high == low, 1.0, (x - low) / (high - low))
    return np.where(np.isnan(x), 0.0, y)


def _chunks(users: pa.Table) -> Iterator[pa.Table]:
    for at in range(0, users.num_rows, USERS_AT_ONCE):
        yield users.slice(at, USERS_AT_ONCE)


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest value of each row; -inf where there are fewer."""
    if x.shape[1] < k:
        return np.full(len(x), -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


class Best:
    """The pairs of a chunk that can still be among the n best of a user or the `per_topic` best of a topic.

    Scores come as products that are off the rounded ones by half of `slack` at most; what is that close to a limit stays, and
    the rounded scores of what is left decide.
    """

    def __init__(self, users: Users, ranges: dict, n: int, per_topic: int):
        self.users, self.ranges, self.n, self.per_topic = users, ranges, n, per_topic
        self.sides, self.own_more, self.slack = users.sides(ranges)
        size = len(users.ids)
        self.limit = np.full(size, -np.inf)
        self.limits = np.full((size, len(NAMES)), -np.inf if per_topic else np.inf)
        self.limits[:, len(TOPICS)] = np.inf
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.new = self.size = 0

    def exact(self, rows: np.ndarray, cols: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Scaled components and rounded score of single pairs."""
        u = self.users
        parts = u.parts_of(rows, cols)
        scaled = {p: _scaled(x, self.ranges[p][0][rows], self.ranges[p][1][rows]) for p, x in parts.items()}
        pop = u.cand.popularity[cols]
        total = sum(u.weights[rows, i] * x for i, x in enumerate([*scaled.values(), pop]))
        return scaled, np.round(total, PLACES)

    def add(self, first: int, end: int, topic: int) -> None:
        u, cand = self.users, self.users.cand
        x = self.sides @ cand.sides[first:end].T
        own, seen = u.own.inside(first, end), u.seen.inside(first, end)
        x[u.own.rows[own], u.own.cols[own] - first] += self.own_more[own]
        x[u.seen.rows[seen], u.seen.cols[seen] - first] = -np.inf
        dead = cand.unusable[(cand.unusable >= first) & (cand.unusable < end)] - first
        if len(dead):
            x[:, dead] = -np.inf
        for limit, k in ((self.limit, self.n), (self.limits[:, topic], self.per_topic)):
            unknown = np.flatnonzero(limit == -np.inf)
            if len(unknown):
                limit[unknown] = _kth(x[unknown], k)
        bar = np.minimum(self.limit, self.limits[:, topic]) - self.slack
        rows, cols = np.divmod(np.flatnonzero(x >= np.maximum(bar, -1e300)[:, None]), x.shape[1])
        self.held.append((rows, cols + first, x[rows, cols]))
        self.new += len(rows)
        self.size += len(rows)
        if self.new > 2 * self.n * len(u.ids):
            self.tighten()
        if self.size > PAIRS_HELD:
            rows, cols, _ = self.held[0] if len(self.held) == 1 else map(np.concatenate, zip(*self.held))
            rows, cols = self.chosen(rows, cols)
            self.held = [(rows, cols, self.exact(rows, cols)[1])]
            self.size = len(rows)

    def tighten(self) -> None:
        """Raise the limits by all that is held, and drop what is below them."""
        rows, cols, x = map(np.concatenate, zip(*self.held))
        size, topic = len(self.limit), self.users.cand.topic[cols]

        def raised(limit: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
            order = np.lexsort((-x, groups))
            starts = np.searchsorted(groups[order], np.arange(len(limit)))
            ends = np.searchsorted(groups[order], np.arange(len(limit)), side="right")
            there = ends - starts >= k
            out = limit.copy()
            out[there] = np.maximum(limit[there], x[order[starts[there] + k - 1]])
            return out

        self.limit = raised(self.limit, rows, self.n)
        if self.per_topic:
            flat = raised(self.limits.ravel(), rows * len(NAMES) + topic, self.per_topic)
            self.limits = flat.reshape(size, -1)
            self.limits[:, len(TOPICS)] = np.inf
        keep = x >= np.minimum(self.limit[rows], self.limits[rows, topic]) - self.slack[rows]
        self.held = [(rows[keep], cols[keep], x[keep])]
        self.size, self.new = int(keep.sum()), 0

    def chosen(self, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n best of each user and the best of each topic, by rounded score and id."""
        cand, keys = self.users.cand, -self.exact(rows, cols)[1]
        good = np.isfinite(keys)
        rows, cols, keys = rows[good], cols[good], keys[good]
        ids, topic = cand.ids[cols], cand.topic[cols]
        picks = [first_k(rows, keys, ids, self.n)]
        if self.per_topic:
            some = np.flatnonzero(topic < len(TOPICS))
            picks.append(some[first_k((rows * len(NAMES) + topic)[some], keys[some], ids[some], self.per_topic)])
        kept = np.unique(np.concatenate(picks))
        return rows[kept], cols[kept]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, int), np.zeros(0, int)
        self.tighten()
        return self.chosen(*self.held[0][:2])


def _score(users: pa.Table, cand: Candidates, n: int, per_topic: int, given: bool) -> pa.Table:
    """Best rows of one block; component ranges are read from the users when `given`."""
    found = []
    for part in _chunks(users):
        u = Users(part, cand)
        if given:
            ranges = {p: (to_ids(part[f"{p}_low"]).astype(float), to_ids(part[f"{p}_high"]).astype(float)) for p in PARTS}
        else:
            ranges = u.ranges()
        best = Best(u, ranges, n, per_topic)
        for tile in cand.tiles:
            best.add(*tile)
        r, c = best.result()
        order = np.lexsort((cand.ids[c], r))
        r, c = r[order], c[order]
        scaled, total = best.exact(r, c)
        found.append(
            pa.table(
                {
                    "user_id": u.ids[r],
                    "article_id": cand.ids[c],
                    "topic": pa.array(NAMES[cand.topic[c]], pa.string()),
                    **{p: np.round(x, PLACES) for p, x in scaled.items()},
                    "popularity": cand.popularity[c],
                    "score": total,
                }
            )
        )
    return pa.concat_tables(found) if found else _EMPTY_SCORED


_EMPTY_SCORED = pa.table(
    {
        "user_id": pa.array([], pa.int64()),
        "article_id": pa.array([], pa.int64()),
        "topic": pa.array([], pa.string()),
        **{c: pa.array([], pa.float64()) for c in (*PARTS, "popularity", "score")},
    }
)


def _block_ranges(users: pa.Table, cand: Candidates) -> pa.Table:
    columns: dict[str, list] = {"user_id": []}
    columns.update({f"{p}_{e}": [] for p in PARTS for e in ("low", "high")})
    for part in _chunks(users):
        u = Users(part, cand)
        columns["user_id"].append(u.ids)
        for p, (low, high) in u.ranges().items():
            columns[f"{p}_low"].append(low)
            columns[f"{p}_high"].append(high)
    kind = lambda c: np.int64 if c == "user_id" else np.float64
    return pa.table({c: np.concatenate(v) if v else np.zeros(0, kind(c)) for c, v in columns.items()})


def score_feeds(
    users: DataFrame,
    candidates: DataFrame,
    seen: DataFrame,
    n: int,
    per_topic: int = 0,
    article_block: int = ARTICLE_BLOCK,
    user_block: int = USER_BLOCK,
    near: DataFrame | None = None,
) -> DataFrame:
    """Rows of SCORED that a feed of n articles with `per_topic` per topic can use.

    users: (user_id, profile, factor, prefs, weights), arrays may be null; candidates: (article_id,
    vector, factor, topic_index, popularity); seen: (user_id, article_id) pairs to leave out; near: (user_id, article_id,
    collab), the collaborative part where it is not the product of factors (pairs without a row keep that).
    Both forms return the same rows.
    """
    width = lambda c: F.coalesce(F.max(F.size(c)), F.lit(0))
    size = candidates.agg(F.count(F.lit(1)).alias("n"), (width("vector") + width("factor")).alias("width")).first()
    article_block = min(article_block, max(1, BROADCAST_BYTES // (size["width"] * 8 + ROW_BYTES)))
    if size["n"] <= article_block:
        return _score_streamed(users, candidates, seen, near, n, per_topic)
    blocks = grid_blocks(size["n"], users.count(), size["width"], article_block, user_block)
    scored = _score_grid(users, candidates, seen, near, n, per_topic, *blocks)
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "article_id"))
    used = rank("user_id") <= n
    if per_topic:
        used |= F.col("topic").isNotNull() & (rank("user_id", "topic") <= per_topic)
    return scored.withColumn("_used", used).where("_used").drop("_used")


def _per_user(seen, near, candidates, *keys) -> DataFrame:
    """The candidates that a user has seen, and those with a value of their own. At most one entry per candidate, so
    the arrays have a bound however active the user is."""
    known = candidates.select("article_id", *keys[1:])
    mine = seen.join(known, "article_id").groupBy(*keys).agg(F.collect_set("article_id").alias("seen"))
    if near is None:
        return mine
    item = F.struct("article_id", "collab")
    values = near.join(known, "article_id").groupBy(*keys).agg(F.collect_list(item).alias("near"))
    return mine.join(values, list(keys), "full")


def _score_streamed(users, candidates, seen, near, n, per_topic) -> DataFrame:
    block = candidates.sparkSession.sparkContext.broadcast(candidates.toArrow())
    mine = _per_user(seen, near, candidates, "user_id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cand = Candidates(block.value)
        for batch in batches:
            if batch.num_rows:
                yield from _score(pa.Table.from_batches([batch]), cand, n, per_topic, False).to_batches()

    return users.join(mine, "user_id", "left").mapInArrow(task, SCORED)


def grid_blocks(articles: int, users: int, width: int, article_block: int, user_block: int) -> tuple[int, int]:
    """Blocks of articles and of users: of `article_block` and `user_block` rows, as long as these are few blocks; then larger ones.

    What the grid sends is each side times the blocks of the other. With blocks of a fixed small size that would grow with the
    product of the sides; so blocks grow with their side up to what a task can hold.
    """
    count = lambda rows, size: -(-rows // size) or 1
    full = max(1, min(ARTICLE_BLOCK, BROADCAST_BYTES // (width * 8 + ROW_BYTES)))
    a = max(count(articles, max(full, article_block)), min(count(articles, article_block), SIDE_BLOCKS))
    wanted = max(SIDE_BLOCKS, count(GRID_BLOCKS, a))
    return a, max(count(users, max(USER_BLOCK_MOST, user_block)), min(count(users, user_block), wanted))


def _score_grid(users, candidates, seen, near, n, per_topic, article_blocks: int, user_blocks: int) -> DataFrame:
    ab = F.pmod(F.xxhash64("article_id"), F.lit(article_blocks)).cast("int")
    mine = _per_user(seen, near, candidates.withColumn("ab", ab), "user_id", "ab")
    spread = (
        users.withColumn("ub", F.pmod(F.xxhash64("user_id"), F.lit(user_blocks)).cast("int"))
        .withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(article_blocks - 1))))
        .join(mine, ["user_id", "ab"], "left")
    )
    blocks = candidates.withColumn("ab", ab).withColumn(
        "ub", F.explode(F.sequence(F.lit(0), F.lit(user_blocks - 1)))
    )

    def ranges(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_ranges(left, Candidates(right))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(left, Candidates(right), n, per_topic, True)

    key = ["ub", "ab"]
    per_block = spread.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(ranges, RANGES)
    whole = per_block.groupBy("user_id").agg(
        *[F.min(f"{p}_low").alias(f"{p}_low") for p in PARTS], *[F.max(f"{p}_high").alias(f"{p}_high") for p in PARTS]
    )
    ready = spread.join(whole, "user_id")
    return ready.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(score, SCORED)
