from __future__ import annotations

import hashlib
import html

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as X, vectors as L
from newsloom.operators import embed as E, ingest as I


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("value", [None, "", " ", "\t\n", "\r \t"])
def test_blank(spark, value):
    assert one(spark, X.is_blank(F.col("t")), t=value) is True


def test_words_of_any_script(spark):
    assert one(spark, X.tokens(F.col("t")), t="Über-All, 2x été!") == ["über", "all", "2x", "été"]


def test_page_parts(spark):
    page = (
        '<html><head><title> A &amp; B </title><meta name="author" content="Jo"></head><body><nav>menu</nav>'
        "<script>x('</p>')</script><p>One&nbsp;&lt;two&gt;</p><!-- no --> three</body></html>"
    )
    row = I.extract_articles(spark.createDataFrame([(1, page)], "page_id bigint, html string")).first()
    assert (row.title, row.content, row.page_author, row.image_url) == ("A & B", "One <two> three", "Jo", None)


REFERENCES = [
    "it&#8217;s &eacute;t&#233; &#x2019;&#X2019; &mdash;&lt;b&gt;", "&amp;lt; &amp;amp; &amp", "a & b &nosuch; &;", "&#150;&#128;&#0;&#55296;&#1114112; x",
    "&quot;&apos;&#39;", "&notin;&NotEqualTilde;&#128512;&", "", "no reference", "&#12 &#x41 ;&#99999999;", "&#x1F600;&hearts;&hearts;",
]


def test_references_are_decoded_as_the_standard_library_does(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*REFERENCES, None])], "i int, t string")
    got = {r.i: r.x for r in df.select("i", X.decode_references(F.col("t")).alias("x")).collect()}
    # The library also reads some names without a semicolon; here they stay.
    want = [html.unescape(t) if "&amp" != t[-4:] else html.unescape(t[:-4]) + "&amp" for t in REFERENCES]
    assert [got[i] for i in range(len(REFERENCES))] == want and got[len(REFERENCES)] is None


def test_page_parts_in_either_quotes_with_references(spark):
    page = (
        "<title>L&#8217;&eacute;t&eacute;&nbsp;2</title><meta content='Zo&euml; \"Z\"' name='author'>"
        "<meta property='og:image' content='a.png?x=1&amp;y=2'><body>A&#x2019;s&nbsp;&nbsp;b</body>"
    )
    row = I.extract_articles(spark.createDataFrame([(1, page)], "page_id bigint, html string")).first()
    assert (row.title, row.page_author, row.image_url) == ("L\u2019\u00e9t\u00e9 2", 'Zo\u00eb "Z"', "a.png?x=1&y=2")
    assert row.content.endswith("A\u2019s b")


def test_embedding_text_limits(spark):
    f = lambda t, c: one(spark, E.embedding_text(F.col("t"), F.col("c")), t=t, c=c)
    assert f("T", "body") == "T\n\nbody"
    assert f("T", "x" * 1997) == "T\n\n" + "x" * 1997
    assert f("T", "x" * 1998) == "T\n\n" + "x" * 1989 + "..."
    assert f("t" * 1990, "x" * 50) == "t" * 1990


def embed(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [np.array(r.e) for r in E.embed_batch(df, "t", "e").orderBy("i").collect()]


def test_embedding_is_unit_and_blank_is_zero(spark):
    long, short, german, empty, tabs, none = embed(spark, "word " * 7500, "Hi", "Das ist ein Satz", "", "\t", None)
    for v in (long, short, german):
        assert v.shape == (E.DIM,) and abs(np.linalg.norm(v) - 1) < 1e-9
    for v in (empty, tabs, none):
        assert v.shape == (E.DIM,) and not v.any()


def test_embedding_follows_the_hash_rule(spark):
    want = np.zeros(E.DIM)
    for w in "the cat the dog".split():
        h = hashlib.md5(w.encode()).hexdigest()
        want[int(h[:8], 16) % E.DIM] += 1 if int(h[8], 16) % 2 == 0 else -1
    assert np.allclose(embed(spark, "The cat, the dog")[0], want / np.linalg.norm(want))


def test_related_texts_rank_first(spark):
    texts = [
        "electric cars and vehicles are sold", "new electric vehicles reach the market of cars", "the team won the final match",
        "stocks fell after the report", "a goal in the last minute won the game",
    ]
    q, *rest = embed(spark, "Electric vehicles and cars", *texts)
    assert set(np.argsort([-(q @ r) for r in rest])[:2]) == {0, 1}


def test_no_rows_in_no_rows_out(spark):
    assert E.embed_batch(spark.createDataFrame([], "t string"), "t").count() == 0


def test_plug_in_encoder(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    load = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    assert sorted(r.embedding for r in E.embed_with_model(df, "t", load).collect()) == [[0.0, 1.0], [2.0, 1.0]]


def test_normalise_keeps_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r.x for r in df.select(L.l2_normalize(F.col("v")).alias("x")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_short_page_does_not_claim_its_url(spark):
    rows = [(1, "u", "short"), (2, "u", "x" * 100), (3, "u", "y" * 100), (4, "v", None), (5, "w", "z" * 200)]
    entries = spark.createDataFrame(rows, "page_id bigint, url string, content string")
    stored = spark.createDataFrame([("w",)], "url string")
    got = {r.page_id: r.outcome for r in I.ingest_outcomes(entries, stored, "page_id").collect()}
    assert got == {1: "failed", 2: "added", 3: "skipped", 4: "failed", 5: "skipped"}
    kept, rejected = I.content_gate(entries)
    assert [r.page_id for r in I.dedup_by_url(kept, stored, "page_id").collect()] == [2] and rejected.count() == 2


def test_embedding_of_many_words_takes_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    sizes = [0, 300_000, *[5_000] * 300, 0, 7]
    flat = rng.integers(0, 16, sum(sizes)).astype(np.int32)
    codes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat))
    tracemalloc.start()
    got = E._histogram(8).func(codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20  # numbers of 8 bytes for all 1,800,007 words would take more
    for part, vector in zip(np.split(flat, np.cumsum(sizes)[:-1]), got.to_pylist()):
        want = np.zeros(8)
        np.add.at(want, part // 2, 1.0 - 2.0 * (part % 2))
        assert np.allclose(vector, want / (np.linalg.norm(want) or 1.0), atol=1e-12)
    with_null = E._histogram(8).func(pa.array([None, [2, 2], []], pa.list_(pa.int32()))).to_pylist()
    assert with_null == [[0.0] * 8, [0.0, 1.0] + [0.0] * 6, [0.0] * 8]
    assert len(E._histogram(8).func(pa.array([], pa.list_(pa.int32())))) == 0
