"""Named queries: ingest (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.functions import text as X
from newsloom.operators import ingest as I
from newsloom.operators.interactions import accepted_interactions
from newsloom.plans.registry import CTES, query
from newsloom.schemas import ARTICLE, INTERACTION
from newsloom.session import scratch_dir
from newsloom.sources import tables as S, views as V

def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# The standard library's names of characters, and the numbers of the old Windows code page, as maps.
CTES["html_names"] = f"""
SELECT MAP([{', '.join(map(_text, X.NAMED))}], [{', '.join(map(_text, X.NAMED.values()))}]) AS named,
  MAP([{', '.join(map(str, X.WINDOWS))}], [{', '.join(map(_text, X.WINDOWS.values()))}]) AS windows
"""
_NUMBER = "CASE WHEN lower(r[3:3]) = 'x' THEN cast('0x' || rtrim(r[4:], ';') AS bigint) ELSE cast(rtrim(r[3:], ';') AS bigint) END"
_CHARACTER = f"""CASE WHEN r[2:2] <> '#' THEN coalesce(named[r], r)
  WHEN NOT ({_NUMBER}) BETWEEN 1 AND 1114111 OR ({_NUMBER}) BETWEEN 55296 AND 57343 THEN chr(65533)
  WHEN ({_NUMBER}) BETWEEN 128 AND 159 THEN windows[({_NUMBER})::int] ELSE chr(({_NUMBER})::int) END"""


def decoded(x: str) -> str:
    return f"""replace(array_to_string(list_transform(list_zip(regexp_split_to_array({x}, '{X.REFERENCE}'),
    list_concat([''], list_transform(regexp_extract_all({x}, '{X.REFERENCE}'), lambda r: {_CHARACTER}))),
    lambda p: p[2] || p[1]), ''), chr(160), ' ')"""


def extraction(source: str) -> str:
    """Articles of the pages in `source` (page_id, url, html)."""
    metas = []
    for attribute, value in (("name", "author"), ("property", "og:image")):
        named = f"""{attribute}=["'']{value}["'']"""
        content = """content=(?:"([^"]*)"|''([^'']*)'')"""
        found = [
            f"nullif(regexp_extract(html, '(?is)<meta[^>]*{a}[^>]*{b}', {group}), '')"
            for a, b in ((named, content), (content, named)) for group in (1, 2)
        ]
        metas.append(f"coalesce({', '.join(found)})")
    return rf"""
SELECT page_id, url, nullif(trim({decoded('t')}), '') AS title, trim(regexp_replace({decoded('c')}, '\s+', ' ', 'g')) AS content,
  CASE WHEN a IS NOT NULL THEN {decoded('a')} END AS page_author, CASE WHEN i IS NOT NULL THEN {decoded('i')} END AS image_url
FROM (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<!--.*?-->', ' ', 'g'), '(?is)<head[^>]*>.*?</head>', ' ', 'g'),
      '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
      '(?is)<nav[^>]*>.*?</nav>', ' ', 'g'), '(?is)<[^>]+>', ' ', 'g') AS c, {metas[0]} AS a, {metas[1]} AS i
  FROM {source}), html_names
"""


CTES["extracted"] = extraction("pages")
# Pages in which accents, quotes and some blanks are references of every kind, and attributes are in single quotes.
WRITTEN = (("é", "&eacute;"), ("ü", "&#252;"), (". ", "&#8217;&hellip; &#150; &nosuch; "), ("the ", "&amp;lt; "))
_PAGES = "regexp_replace(regexp_replace(html, '=\"([^\"]*)\"', '=''\\1''', 'g'), '([a-z])e ', '\\1e&#x2019;s&nbsp;', 'g')"
for _plain, _reference in WRITTEN:
    _PAGES = f"replace({_PAGES}, '{_plain}', '{_reference}')"
CTES["referring_pages"] = f"SELECT page_id, url, {_PAGES} AS html FROM pages"
CTES["referring"] = extraction("referring_pages")


@query("extract_articles", "SELECT page_id, url, title, content, page_author, image_url FROM extracted")
def extract_articles(spark, d) -> DataFrame:
    return I.extract_articles(S.read_table(spark, d, "pages"))


@query("extract_references", "SELECT page_id, url, title, content, page_author, image_url FROM referring")
def extract_references(spark, d) -> DataFrame:
    """Extraction from pages full of character references."""
    html = F.regexp_replace(F.regexp_replace("html", '="([^"]*)"', "='$1'"), "([a-z])e ", "$1e&#x2019;s&nbsp;")
    for plain, reference in WRITTEN:
        html = F.replace(html, F.lit(plain), F.lit(reference))
    return I.extract_articles(S.read_table(spark, d, "pages").withColumn("html", html))


def _incoming_pages(spark, d) -> DataFrame:
    """Every page, and every tenth once more under a new id: repeats within a batch."""
    pages = S.read_table(spark, d, "pages").select("page_id", "url")
    again = pages.where("page_id % 10 = 0").withColumn("page_id", F.col("page_id") + 1_000_000)
    return pages.unionByName(again)


@query(
    "ingest_dedup_url",
    """
WITH incoming AS (SELECT page_id, url FROM pages
  UNION ALL SELECT page_id + 1000000, url FROM pages WHERE page_id % 10 = 0)
SELECT min(page_id) AS page_id, url FROM incoming
WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0) GROUP BY url
""",
)
def ingest_dedup_url(spark, d) -> DataFrame:
    stored = S.read_table(spark, d, "pages").where("page_id % 4 = 0")
    return I.dedup_by_url(_incoming_pages(spark, d), stored, "page_id").select("page_id", "url")


@query(
    "ingest_content_gate",
    """
SELECT article_id, source, coalesce(length(content), 0) AS n_chars,
  CASE WHEN coalesce(length(content), 0) >= 100 THEN 'kept' ELSE 'rejected' END AS gate FROM articles
""",
)
def ingest_content_gate(spark, d) -> DataFrame:
    kept, rejected = I.content_gate(V.articles(spark, d))
    both = kept.withColumn("gate", F.lit("kept")).unionByName(rejected.withColumn("gate", F.lit("rejected")))
    chars = F.coalesce(F.length("content"), F.lit(0)).cast("bigint").alias("n_chars")
    return both.select("article_id", "source", chars, "gate")


@query(
    "ingest_defaults",
    """
SELECT page_id, feed, url, coalesce(entry_title, 'No Title') AS title, first_author AS author, published_at,
  'pending' AS processing_status FROM feed_entries
""",
)
def ingest_defaults(spark, d) -> DataFrame:
    return I.entry_defaults(V.feed_entries(spark, d)).select(
        "page_id", "feed", "url", "title", "author", "published_at", "processing_status"
    )


def _document_entries(spark, d) -> DataFrame:
    """Documents as feed entries; exact copies in one language share their url."""
    return S.read_table(spark, d, "documents").select(
        "doc_id",
        "source",
        F.concat(F.lit("https://"), "lang", F.lit(".example.com/"), F.md5(F.col("text").cast("binary"))).alias("url"),
        F.col("text").alias("content"),
    )


def _stored_entries(spark, d) -> DataFrame:
    done = V.articles(spark, d).where("processing_status = 'completed' AND topic = 'World'").select("article_id")
    e = _document_entries(spark, d)
    return e.join(done, e.doc_id == done.article_id, "left_semi").select("url")


CTES["entry_outcomes"] = """
SELECT e.doc_id, e.source, CASE
  WHEN e.url IN (SELECT s.url FROM doc_entries s JOIN articles a ON a.article_id = s.doc_id
                 WHERE processing_status = 'completed' AND topic = 'World') THEN 'skipped'
  WHEN EXISTS (SELECT 1 FROM doc_entries o WHERE o.url = e.url AND o.doc_id < e.doc_id AND length(o.content) >= 100)
    THEN 'skipped'
  WHEN coalesce(length(e.content), 0) < 100 THEN 'failed' ELSE 'added' END AS outcome
FROM doc_entries e
"""
CTES["doc_entries"] = """
SELECT doc_id, source, concat('https://', lang, '.example.com/', md5(text)) AS url, text AS content FROM documents
"""


@query(
    "ingest_summary",
    """
SELECT source AS feed, count(*) FILTER (outcome = 'added') AS added,
  count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed
FROM entry_outcomes GROUP BY source
""",
)
def ingest_summary(spark, d) -> DataFrame:
    outcomes = I.ingest_outcomes(_document_entries(spark, d), _stored_entries(spark, d), "doc_id")
    return I.ingest_summary(outcomes, "source")


@query("ingest_entry_outcomes", "SELECT doc_id, source, outcome FROM entry_outcomes")
def ingest_entry_outcomes(spark, d) -> DataFrame:
    outcomes = I.ingest_outcomes(_document_entries(spark, d), _stored_entries(spark, d), "doc_id")
    return outcomes.select("doc_id", "source", "outcome")


CTES["ingested"] = """
SELECT f.page_id, f.feed, f.url, coalesce(entry_title, 'No Title') AS title, e.page_author AS author,
  published_at, e.content, 'pending' AS processing_status, e.image_url
FROM feed_entries f JOIN extracted e ON e.page_id = f.page_id
WHERE length(e.content) >= 100 AND f.url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)
"""


@query("ingest_articles", "SELECT * FROM ingested")
def ingest_articles(spark, d) -> DataFrame:
    stored = S.read_table(spark, d, "pages").where("page_id % 4 = 0")
    return I.ingest(V.feed_entries(spark, d), stored).select(
        "page_id", "feed", "url", "title", "author", "published_at", "content", "processing_status", "image_url"
    )


@query(
    "add_status_columns",
    "SELECT 'pending' AS processing_status, count(*) AS articles FROM documents",
)
def add_status_columns(spark, d) -> DataFrame:
    old = S.read_table(spark, d, "documents")
    return I.count_by_status(I.add_status_columns(I.add_status_columns(old)))


@query(
    "count_by_status",
    "SELECT processing_status, count(*) AS articles FROM articles GROUP BY processing_status",
)
def count_by_status(spark, d) -> DataFrame:
    return I.count_by_status(I.add_status_columns(V.articles(spark, d)))


@query(
    "write_interactions_by_date",
    """
SELECT strftime(ts, '%Y-%m-%d') AS dt, CASE WHEN strftime(ts, '%Y-%m-%d') < '2024-01-15' THEN 'archive' ELSE 'live' END
  AS tier, count(*) AS events, count(DISTINCT user_id) AS users, min(event_id) AS first_event FROM accepted GROUP BY 1, 2
""",
)
def write_interactions_by_date(spark, d) -> DataFrame:
    """Write the accepted log by date, read it back and split it at a cut-off date."""
    path = scratch_dir(spark, "interactions-by-date")
    accepted = accepted_interactions(V.interactions_raw(spark, d), V.users(spark, d), V.article_ids(spark, d))
    S.write_interactions_by_date(accepted, path)
    old, live = S.archive_before(S.read_interactions_by_date(spark, path, INTERACTION), "2024-01-15")
    both = old.withColumn("tier", F.lit("archive")).unionByName(live.withColumn("tier", F.lit("live")))
    return both.groupBy("dt", "tier").agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("user_id").alias("users"),
        F.min("event_id").alias("first_event"),
    )


@query(
    "table_io",
    """
SELECT article_id, url, title, content, source, published_at, scraped_at, topic, topic_confidence, embedding_id,
  processing_status, processed_at, processing_error, author, image_url FROM articles
""",
)
def table_io(spark, d) -> DataFrame:
    """Write the article table as two snapshot versions and read the newest."""
    root = scratch_dir(spark, "articles")
    rows = V.articles(spark, d).select(*ARTICLE.fieldNames())
    S.write_snapshot(rows.where("processing_status = 'completed'"), root)
    S.write_snapshot(rows, root)
    return S.read_snapshot(spark, root, ARTICLE)
