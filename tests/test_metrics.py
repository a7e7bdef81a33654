from __future__ import annotations

import datetime as dt
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from newsloom.operators import metrics as K

START = dt.date(2024, 1, 1)


def visits(spark, n_users, n_days, spread=1, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(u) * spread - 70, int(d)) for u, d in zip(rng.integers(0, n_users, 4 * n_users), rng.integers(0, n_days, 4 * n_users))]
    stamped = [(u, dt.datetime.combine(START + dt.timedelta(days=d), dt.time(d % 24, u % 60))) for u, d in rows]
    return rows, spark.createDataFrame([*stamped, (None, stamped[0][1])], "user_id bigint, ts timestamp_ntz")


def test_cohorts_by_bitmaps_equal_sets(spark):
    """Ids below zero and in several bitmaps."""
    rows, df = visits(spark, 300, 40, spread=977)
    days = defaultdict(set)
    for u, d in rows:
        days[u].add(d)
    want = Counter((START + dt.timedelta(days=min(x)), d - min(x)) for x in days.values() for d in x if 1 <= d - min(x) <= 20)
    got = {(r.cohort, r.day_no): r.users for r in K.cohort_retention(df, 20).collect()}
    assert got == want and len(got) > 50
    assert K.cohort_retention(df.where("false")).count() == 0


def test_users_of_any_span_from_daily_sketches(spark):
    rows, df = visits(spark, 5_000, 14)
    sketches = K.daily_user_sketches(df.where("user_id IS NOT NULL")).cache()
    spans = [("all", 0, 13), ("one day", 3, 3), ("none", 100, 120), ("week", 4, 10)]
    table = spark.createDataFrame([(n, START + dt.timedelta(days=a), START + dt.timedelta(days=b)) for n, a, b in spans], "span string, first date, last date")
    got = {r.span: r.users for r in K.users_of_spans(sketches, table).collect()}
    for name, a, b in spans:
        exact = len({u for u, d in rows if a <= d <= b})
        assert abs(got.get(name, 0) - exact) <= 0.035 * exact
    assert sketches.agg(F.max(F.length("sketch"))).first()[0] < 40_000
