"""URL filter with hash-prefix lookup of host-suffix and path-prefix expressions.

A rule is (host, path, verdict). It fits a url whose host is the rule's or one of its subdomains and whose path starts
with the rule's. Every url expands to (host suffix, path prefix) expressions; a 4-byte prefix of their SHA-256 finds
rules by an equi-join, the whole digest confirms them, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREFIX_HEX = 8
RULE_SCHEMA = "host string, path string, verdict string"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null url or one without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(
        F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    # A null byte cannot be confused with a character of a host or path.
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path): its text, digest, digest prefix and verdict.

    Hosts are lower-cased (A-Z). Rules with a null host, a null or unknown verdict are ignored; a null path is empty. If
    the same (host, path) is listed with both verdicts, block wins.
    """
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = rules.where(F.col("host").isNotNull() & F.col("verdict").isin("allow", "block")).select(
        host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    return (
        known.groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            F.concat("host", "path").alias("rule"),
            F.char_length("host").alias("host_len"),
            F.char_length("path").alias("path_len"),
            "verdict",
            _digest(F.col("host"), F.col("path")).alias("digest"),
        )
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, verdict for each row of `pages`, repeated rows included.

    The longest rule that fits decides: more characters of host and path together, then the longer host. A url that no
    rule fits gets a null rule and the verdict `default`. Null, empty and malformed urls have an empty host and path,
    which only a rule with an empty host fits. Other columns of `pages` are not looked at. No rules: every url gets the default.

    Path prefixes are taken at the lengths that rules have (at most as many as a rule path is long), so a url makes
    (labels of its host + 1) x (rule lengths up to its own) expressions. Equal (host, path) pairs are judged once.
    """
    prepared = prepare_rules(rules)
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))

    lengths = sorted(r.path_len for r in prepared.select("path_len").distinct().collect())
    labels = F.split("host", r"\.")
    # Suffixes of the host: the last 1, 2, ... labels; the whole host is the last of them.
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n)),
    )
    expressions = (
        urls.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", "suffix", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("n"))
        .where(F.col("n") <= F.char_length("path"))
        .select("host", "path", _digest(F.col("suffix"), F.expr("left(path, n)")).alias("full"))
        .withColumn("prefix", F.substring("full", 1, PREFIX_HEX))
    )
    decided = (
        expressions.join(prepared, "prefix")
        .where(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(
            F.max(F.struct((F.col("host_len") + F.col("path_len")).alias("size"), "host_len", "rule", "verdict")).alias("best")
        )
        .select(F.col("host").alias("h"), F.col("path").alias("p"), "best")
    )
    return urls.join(decided, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
