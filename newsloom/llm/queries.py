"""The registered queries of this subpackage, with production parameters, and their SQL where there is any."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm import (
    align, bpe, chat_format, html_text, layouts, licenses, mixing, simhash, spelling, threshold, token_files, toxicity, url_rules, winnow,
)
from newsloom.llm.rows import read
from newsloom.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(read(spark, folder, "pages"))


def op2_bpe_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    return bpe.encode_documents(read(spark, folder, "documents"), path, pattern, splits_at_space=True)


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = scratch_dir(spark, "token-files")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs, pattern = read(spark, folder, "documents"), public_tokenizers.PATTERN
    token_files.write_token_files(docs, path, tokenizer, pattern, splits_at_space=True, added_tokens=True)
    return token_files.token_digests(spark, path)


def op4_threshold_topk(spark: SparkSession, folder: str) -> DataFrame:
    return threshold.top_k(read(spark, folder, "embeddings"), k=5, every=50, scale=256.0)


def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"), words=4, bits=4)


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, folder, "documents"))


def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"))


def op9_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op10_winnow_edits(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.compare_edits(read(spark, folder, "documents"))


#: What conversation -1 says, in both of its turns.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op11_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """The table's rows are records of one layout, conversation -1 is a record of another; fingerprints tell them apart."""
    table = read(spark, folder, "conversations")
    fields = [F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]
    rows = table.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))
    said = {"conv_id": -1, "messages": [{"role": role, "content": CONTROL} for role in ("user", "assistant")]}
    records = rows.unionByName(spark.range(1).select(F.lit(json.dumps(said)).alias("record")))
    path = scratch_dir(spark, "formatted")
    turns = layouts.canonical_turns(records, F.col("record")).where("role IS NOT NULL")
    chat_format.format_conversations(turns, path)
    return chat_format.conversation_digests(spark, path)


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_forms(read(spark, folder, "documents"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.alignment_counts(read(spark, folder, "documents"), a, public_tokenizers.PATTERN, b)


def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_rules.RULE_SCHEMA)
    return url_rules.judge_urls(read(spark, folder, "pages"), rules)


QUERIES: dict[str, Query] = {
    "op1_html_text": op1_html_text,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_token_files": op3_token_files,
    "op4_threshold_topk": op4_threshold_topk,
    "op5_url_rules": op5_url_rules,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_mix_sources": op8_mix_sources,
    "op9_toxicity_chain": op9_toxicity_chain,
    "op10_winnow_edits": op10_winnow_edits,
    "op11_chat_format": op11_chat_format,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_alignment": op13_token_alignment,
}

_RULE_ROWS = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)

ORACLE: dict[str, str] = {
    "op4_threshold_topk": """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
                row_number() OVER () AS place
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, q.place, c.vec_id,
                CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * coalesce(c.v[i], 0))) AS BIGINT) AS score
            FROM vectors q JOIN vectors c ON q.place <> c.place
            WHERE q.vec_id % 50 = 0
        ),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op11_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            SELECT -1, v.turn, v.role, '{CONTROL}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(
                string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''
            )) AS loss_sha256,
            CAST(sum(length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10))
                + length(regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'),
                    '<(\\\\*)\\|', '<\\\\\\1|', 'g'))
                + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g'))) AS BIGINT) AS formatted_chars
        FROM turns
        GROUP BY conv_id
    """,
    "op5_url_rules": f"""
        WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
        rest AS (
            SELECT page_id, url,
                CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail
            FROM pages
        ),
        parts AS (
            SELECT page_id, url,
                translate(regexp_extract(tail, '^([^/?#]*)', 1),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest
        )
        SELECT page_id, url, host, path,
            max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
            coalesce(max_by(rule_verdict, length(rule_host || rule_path)), 'allow') AS verdict
        FROM parts
        LEFT JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY page_id, url, host, path
    """,
}
