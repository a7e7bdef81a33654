from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from newsloom import session
from newsloom.operators import articles as B, ingest as I
from newsloom.schemas import INTERACTION, LONG, TEXT, TABLES
from newsloom.sources import tables as S, views as V
from newsloom.streaming import streams as T
from pyspark.sql import types as Ty

PAIR = Ty.StructType([Ty.StructField("a", LONG), Ty.StructField("b", TEXT)])


def rows(spark, *items):
    return spark.createDataFrame(list(items), PAIR)


def test_snapshots_show_only_committed_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert S.write_snapshot(rows(spark, (1, "x")), root) == 1
    assert S.write_snapshot(rows(spark, (2, "y"), (3, "z")), root) == 2
    half = tmp_path / "t" / "v=3"
    half.mkdir()  # a writer that never finished
    assert S.read_snapshot(spark, root, PAIR).count() == 2
    assert S.read_snapshot(spark, root, PAIR, version=1).count() == 1
    assert S.write_snapshot(rows(spark, (4, "w")), root) == 4
    with pytest.raises(FileNotFoundError):
        S.read_snapshot(spark, str(tmp_path / "none"), PAIR)


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    root = str(tmp_path / "b")
    for batch, value in ((0, 1), (1, 2), (1, 2)):
        S.write_batch(rows(spark, (value, "x")), root, batch)
    assert S.read_batches(spark, root, PAIR).count() == 2
    assert [r.a for r in S.read_batches(spark, root, PAIR, before=1).collect()] == [1]


def test_dated_log_prunes_folders(spark, tmp_path):
    data = [(i, 1, 1, "click", dt.datetime(2024, 1, 1 + i % 5), None) for i in range(50)]
    path = str(tmp_path / "log")
    S.write_interactions_by_date(spark.createDataFrame(data, INTERACTION), path)
    old, live = S.archive_before(S.read_interactions_by_date(spark, path, INTERACTION), "2024-01-03")
    assert (old.count(), live.count()) == (20, 30)
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert len([f for f in os.listdir(path) if f.startswith("dt=")]) == 5


def test_scratch_needs_a_shared_folder_off_local(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "yarn"

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(RuntimeError):
        session.scratch_dir(Cluster, "x")
    assert session.scratch_dir(spark, "x") != session.scratch_dir(spark, "x")


def test_status_columns_are_added_once(spark):
    df = rows(spark, (1, "x"))
    once = I.add_status_columns(df)
    assert I.add_status_columns(once).columns == once.columns == ["a", "b", "processing_status", "processed_at", "processing_error"]


def test_page_limits_and_order(spark, small):
    a = V.articles(spark, small)
    for bad in ({"skip": -1}, {"limit": 0}, {"limit": 101}):
        with pytest.raises(ValueError):
            B.articles_page(a, **bad)
    page = B.articles_page(a, limit=5).collect()
    assert len(page) == 5
    both = [r.article_id for r in B.articles_page(a, limit=10).collect()]
    assert both[5:] == [r.article_id for r in B.articles_page(a, skip=5, limit=5).collect()]
    assert B.article_by_id(a, 999_999).count() == 0
    assert B.articles_page(a, topic="world").count() == 0  # names are matched exactly
    assert B.articles_page(a, source="%").count() == 0  # no wildcards


def _page(i, url, text):
    return (i, url, f"<html><head><title>t{i}</title></head><body><p>{text}</p></body></html>")


def test_ingest_stream_over_files_and_restart(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    body = "word " * 40
    parts = [
        [_page(1, "u1", body), _page(2, "u1", body), _page(3, "u2", "short")],
        [_page(4, "u1", body), _page(5, "u2", body), _page(6, "old", body)],
        [_page(7, "u2", body), _page(8, "u3", body)],
    ]
    stored = spark.createDataFrame([("old",)], "url string")

    def go():
        T.ingest_stream(V.entries_from_pages(T.read_stream(spark, str(folder), "pages", 1)), store, stored)

    def put(n):
        path = folder / f"pages-{n}.parquet"
        spark.createDataFrame(parts[n], TABLES["pages"]).toPandas().to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))

    put(0), put(1)
    go()
    put(2)
    go()
    assert sorted(r.page_id for r in T.ingested(spark, store).collect()) == [1, 5, 8]


def test_process_stream_numbers_vectors_across_batches(spark, tmp_path):
    from newsloom.operators import classify as E, processing as D

    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    model = E.train_nb(spark.createDataFrame([(0, "a b"), (1, "c d")], "label int, text string"), "text", "label")
    none = spark.createDataFrame([], TABLES["embeddings"])
    for n in range(3):
        docs = [(10 * n + i, f"a b{i}", "en", "s", 4) for i in range(4)]
        spark.createDataFrame(docs, TABLES["documents"]).toPandas().to_parquet(folder / f"documents-{n}.parquet", index=False)
    arriving = V.articles_from_documents(T.read_stream(spark, str(folder), "documents", 1), none)
    T.process_stream(arriving, D.nb_classifier(model), store, F.lit("2024-02-01").cast("timestamp_ntz"), first_position=5)
    done = T.processed_articles(spark, store)
    assert sorted(r.embedding_id for r in done.collect()) == list(range(5, 17))
    assert {(r.article_id, r.position) for r in T.processed_vectors(spark, store).collect()} == {
        (r.article_id, r.embedding_id) for r in done.collect()
    }


def test_windows_over_several_batches(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    t0 = dt.datetime(2024, 1, 1)
    seconds = [[10, 3500, 3700], [20, 7300, 3650], [7200, 7100]]
    for n, part in enumerate(seconds):
        ev = [(100 * n + i, t0 + dt.timedelta(seconds=s), 1, "click", 0.0, '{"k": 5}') for i, s in enumerate(part)]
        path = folder / f"events-{n}.parquet"
        spark.createDataFrame(ev, TABLES["events"]).toPandas().to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    clicks = V.interactions_from_events(T.read_stream(spark, str(folder), "events", 1))
    T.window_stream(clicks, "ts", "1 hour", ["article_id"], store)
    w = T.read_windows(spark, store, {"article_id": LONG})
    assert [(r.window_start.hour, r.n) for r in w.orderBy("window_start").collect()] == [(0, 3), (1, 3), (2, 2)]
    sessions = T.sessions_from_windows(w, ["article_id"], 3600).collect()
    assert [(r.messages, r.ended) for r in sessions] == [(8, t0 + dt.timedelta(seconds=7300))]
    last = T.rolling_24h(w).orderBy(F.col("until").desc()).collect()
    assert len(last) == 26 and last[0].clicks == 2 and last[-1].clicks == 3


@pytest.mark.parametrize("layout", ["files", "folder"])
def test_windows_count_every_row_of_shuffled_files(spark, tmp_path, layout):
    """Files are not in order of time, one is read per batch, and a table may be a folder of parts."""
    folder, store = tmp_path / "in", str(tmp_path / "store")
    parts = folder / "events.parquet" if layout == "folder" else folder
    parts.mkdir(parents=True)
    t0 = dt.datetime(2024, 1, 1)
    hours = [200, 3, 90, 0, 150, 3]
    for n, hour in enumerate(hours):
        rows = [(10 * n + i, t0 + dt.timedelta(hours=hour, minutes=i), 1, "click", 0.0, '{"k": 5}') for i in range(4)]
        path = parts / (f"part-{n:05}.parquet" if layout == "folder" else f"events-{n}.parquet")
        spark.createDataFrame(rows, TABLES["events"]).toPandas().to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    clicks = V.interactions_from_events(T.read_stream(spark, str(folder), "events", 1))
    T.window_stream(clicks, "ts", "1 hour", ["article_id"], store)
    got = {r.window_start: r.n for r in T.read_windows(spark, store, {"article_id": LONG}).collect()}
    assert got == {t0 + dt.timedelta(hours=h): 4 * hours.count(h) for h in hours}


def test_current_interactions_merge_runs(spark, tmp_path, monkeypatch):
    from newsloom.operators import interactions as C

    monkeypatch.setattr(T, "FANOUT", 2)
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    t0 = dt.datetime(2024, 1, 1)
    all_rows = []
    for n in range(5):
        rows = [(10 * n + i, t0 + dt.timedelta(minutes=10 * n + i), 1 + i % 2, ("purchase", "view", "click")[(n + i) % 3], 7.0, '{"k": %d}' % (1 + i % 3)) for i in range(6)]
        all_rows += rows
        path = folder / f"events-{n}.parquet"
        spark.createDataFrame(rows, TABLES["events"]).toPandas().to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    articles = spark.createDataFrame([(1,), (2,), (3,)], "article_id bigint")
    T.interactions_stream(V.interactions_from_events(T.read_stream(spark, str(folder), "events", 1)), users, articles, store)
    events = V.interactions_from_events(spark.createDataFrame(all_rows, TABLES["events"]))
    want = C.interactions_compact(events, users, articles)
    key = lambda df: sorted(map(str, df.select("event_id", "user_id", "article_id", "interaction_type", "ts", "read_time_seconds").collect()))
    assert key(T.current_interactions(spark, store)) == key(want)
    assert len(T.pair_states(spark, store).runs()) < 4
    one = spark.createDataFrame([(1, 2, "like")], "user_id bigint, article_id bigint, interaction_type string")
    liked = events.where("user_id = 1 AND article_id = 2 AND interaction_type = 'like'").count()
    assert [r.n for r in T.pair_history(spark, store, one).collect()] == ([liked] if liked else [])
