from __future__ import annotations

import datetime as dt
import random

from newsloom.operators import interactions as C
from newsloom.schemas import INTERACTION
from newsloom.streaming import streams as T

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    data = [(i, u, a, k, T0 + dt.timedelta(seconds=s), r) for i, u, a, k, s, r in rows]
    return spark.createDataFrame(data, INTERACTION)


def ids(spark, names, n):
    return spark.createDataFrame([(i,) for i in range(1, n)], f"{names} bigint")


def replay(rows):
    """The rules applied one event at a time, in order."""
    log = []
    for i, u, a, k, s, r in sorted(rows, key=lambda x: (x[4], x[0])):
        same = [x for x in log if x[1:4] == [u, a, k]]
        if k == "like" and same:
            log.remove(same[0])
        elif k == "read" and same:
            same[0][4] = s
            same[0][5] = r if r is not None else same[0][5]
        else:
            log.append([i, u, a, k, s, r])
    return sorted(tuple(x) for x in log)


def out(df):
    return sorted(
        (r.event_id, r.user_id, r.article_id, r.interaction_type, int((r.ts - T0).total_seconds()), r.read_time_seconds)
        for r in df.collect()
    )


def random_rows(n, seed, users=4, articles=3):
    rnd = random.Random(seed)
    return [
        (
            i, 1 if rnd.random() < 0.4 else rnd.randint(1, users), rnd.randint(1, articles),
            rnd.choice(["click", "read", "like", "skip"]), rnd.randint(0, 500),
            rnd.choice([None, 3, 9]),
        )
        for i in range(n)
    ]


def test_toggle_one_to_four_likes(spark):
    rows = [(10 * n + j, n, 1, "like", j, None) for n in (1, 2, 3, 4) for j in range(n)]
    got = out(C.like_toggle(events(spark, rows)))
    assert [(r[1], r[0]) for r in got] == [(1, 10), (3, 32)]


def test_read_keeps_first_id_last_time_and_last_known_read_time(spark):
    rows = [(1, 1, 1, "read", 5, 30), (2, 1, 1, "read", 9, None), (3, 2, 1, "read", 1, None)]
    assert out(C.read_upsert(events(spark, rows))) == [(1, 1, 1, "read", 9, 30), (3, 2, 1, "read", 1, None)]


def test_compaction_equals_replay(spark):
    rows = random_rows(400, 7)
    got = C.interactions_compact(events(spark, rows), ids(spark, "user_id", 9), ids(spark, "article_id", 9))
    assert out(got) == replay(rows)


def test_first_broken_rule_is_reported(spark):
    rows = [(1, 0, 0, "x", 0, -1), (2, 1, 0, "x", 0, -1), (3, 1, 1, "x", 0, -1), (4, 1, 1, "read", 0, -1), (5, 1, 1, "read", 0, 0)]
    got = {r.event_id: r.reason for r in C.interaction_validate(events(spark, rows)).collect()}
    assert got == {1: "user_id", 2: "article_id", 3: "interaction_type", 4: "read_time_seconds", 5: None}


def test_unknown_user_is_checked_before_unknown_article(spark):
    rows = [(1, 77, 77, "click", 0, None), (2, 1, 77, "click", 0, None), (3, 1, 1, "click", 0, None)]
    got = C.interaction_fk_check(events(spark, rows), ids(spark, "user_id", 3), ids(spark, "article_id", 3))
    assert {r.event_id: r.reason for r in got.collect()} == {1: "user not found", 2: "article not found", 3: None}


def _write_event_file(spark, folder, rows, part):
    """One event file under its own name, in the shape of the event table."""
    kinds = {"click": "click", "read": "view", "like": "purchase", "skip": "error"}
    data = [
        (i, T0 + dt.timedelta(seconds=s), u, kinds[k], float(r or 0), f'{{"k": {a}}}') for i, u, a, k, s, r in rows
    ]
    from newsloom.schemas import TABLES

    spark.createDataFrame(data, TABLES["events"]).toPandas().to_parquet(
        f"{folder}/events-{part}.parquet", index=False, coerce_timestamps="us"
    )


def test_stream_out_of_order_with_restart_and_full_snapshots(spark, tmp_path, monkeypatch):
    from newsloom.sources import views as V

    monkeypatch.setattr(T, "FANOUT", 2)
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    rows = random_rows(300, 3)
    users, articles = ids(spark, "user_id", 9), ids(spark, "article_id", 9)

    def go():
        stream = V.interactions_from_events(T.read_stream(spark, str(folder), "events", files_per_batch=1))
        T.interactions_stream(stream, users, articles, store)

    for part in range(3):
        _write_event_file(spark, folder, rows[part::5], part)
    go()
    for part in (3, 4):
        _write_event_file(spark, folder, rows[part::5], part)
    go()
    everything = [
        (i, u, a, k, s, (int(r or 0) if k == "read" and i % 5 else None)) for i, u, a, k, s, r in rows
    ]
    assert out(T.current_interactions(spark, store)) == replay(everything)
