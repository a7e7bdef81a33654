"""Document fingerprints by winnowing, in Spark SQL functions only.

A text is cut into tokens: runs of non-white-space characters, lower-cased, a run of more than TOKEN_CHARS characters into pieces of
that length. Each K tokens in a row have a hash; of each WINDOW hashes in a row the smallest is kept, the rightmost of equal
ones, with its position. So two texts that share K + WINDOW - 1 tokens in a row share a kept hash, and none shorter
than K tokens counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Pairs of neighbouring tokens, so that a hash holds the order of words and not only which words there are, and windows of two: of
#: any three tokens in a row a pair is kept, so a text of five words or more keeps several hashes and an edit of its end leaves those of
#: its beginning.
K = 2
WINDOW = 2
TOKEN_CHARS = 16
#: Documents per bucket of neighbouring ids, and the most cells of the id histogram that defines the buckets.
BUCKET_ROWS = 64
CELLS = 1_024
#: Bucket numbers that are put in order together.
RING_ROWS = 4_096

_LOW = (1 << 31) - 1


def token_hashes(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([^\\x20\\x09-\\x0D]{1,%d})" % TOKEN_CHARS), F.lit(1))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def gram_hashes(tokens: Column, k: int = K) -> Column:
    """A number for each k tokens in a row: 32 bits of their hash, then 31 bits that fall with the position.

    So the least of several numbers is the least hash and among equal ones the rightmost. Fewer than k tokens are one gram.
    """
    n = F.size(tokens)

    def number(h: Column, at: Column) -> Column:
        return F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(F.lit(_LOW) - at)

    grams = F.transform(
        F.slice(tokens, 1, F.greatest(n - (k - 1), F.lit(0))),
        lambda h, i: number(F.xxhash64(h, *(F.get(tokens, i + j) for j in range(1, k))), i),
    )
    return (
        F.when(n >= k, grams)
        .when(n > 0, F.array(number(F.xxhash64(tokens), F.lit(0))))
        .otherwise(F.array().cast("array<long>"))
    )


def winnowed(grams: Column, window: int = WINDOW) -> Column:
    """The numbers that are the least of some window, in text order; all grams form one window if they are fewer."""
    n = F.size(grams)
    least = F.transform(
        F.slice(grams, 1, F.greatest(n - (window - 1), F.lit(0))),
        lambda g, i: F.array_min(F.slice(grams, i + 1, window)),
    )
    return F.when(n > window, F.array_distinct(least)).when(n > 0, F.array(F.array_min(grams))).otherwise(grams)


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda v: F.shiftright(v, 31)))


def text_of(kept: Column) -> Column:
    """`hash:position` for each kept hash (8 hexadecimal digits, position in tokens), in text order."""
    return F.array_join(
        F.transform(
            kept,
            lambda v: F.concat(
                F.lower(F.lpad(F.hex(F.shiftright(v, 31)), 8, "0")), F.lit(":"),
                (F.lit(_LOW) - v.bitwiseAND(F.lit(_LOW))).cast("string"),
            ),
        ),
        " ",
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes; 1 if both texts have none."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        both / (F.size(a) + F.size(b) - both)
    )


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id and kept (array of numbers as of `winnowed`) of each row; a null text is the empty text, with none kept."""
    tokens = docs.select("doc_id", token_hashes(F.coalesce("text", F.lit(""))).alias("tokens"))
    grams = tokens.select("doc_id", gram_hashes(F.col("tokens"), k).alias("grams"))
    return grams.select("doc_id", winnowed(F.col("grams"), window).alias("kept"))


def id_buckets(docs: DataFrame, rows: int = BUCKET_ROWS, cells: int = CELLS) -> tuple[Column, int, int]:
    """(bucket number of `doc_id`, lowest, highest number). It rises with the id; about `rows` neighbouring ids share one.

    Ids are cut at quantiles into at most `cells` cells, and each cell evenly, so that gaps and outliers of the ids make no large
    bucket elsewhere. Only the quantiles travel to the driver. Null ids are bucket -1.
    """
    ids = F.col("doc_id").cast("long")
    marks = [i / cells for i in range(cells + 1)]
    found = docs.agg(
        F.percentile_approx(ids, marks, 10 * cells).alias("cuts"), F.count(ids).alias("n"),
        F.min(ids).alias("least"), F.count(F.lit(1)).alias("all"),
    ).first()
    cuts = sorted({found["least"] or 0, *(found["cuts"] or [])})
    parts = max(1, -(-found["n"] // (rows * len(cuts))))
    group = max(1, int(len(cuts) ** 0.5))
    # Two steps of comparisons instead of one over all cuts.
    heads = F.array(*map(F.lit, cuts[::group]))
    tails = F.array(*(F.array(*map(F.lit, cuts[i : i + group])) for i in range(0, len(cuts), group)))
    head = F.greatest(F.size(F.filter(heads, lambda c: c <= ids)), F.lit(1))
    tail = F.greatest(F.size(F.filter(F.element_at(tails, head), lambda c: c <= ids)), F.lit(1))
    cell = (head - 1) * group + tail  # from 1
    lower = F.element_at(F.array(*map(F.lit, cuts)), cell).cast("double")
    upper = F.element_at(F.array(*map(F.lit, cuts[1:] + [cuts[-1]])), cell).cast("double")
    within = F.floor((ids.cast("double") - lower) / F.greatest(upper - lower, F.lit(1.0)) * parts).cast("long")
    within = F.greatest(F.least(within, F.lit(parts - 1).cast("long")), F.lit(0).cast("long"))
    number = F.when(ids.isNull(), F.lit(-1).cast("long")).otherwise((cell.cast("long") - 1) * parts + within)
    return number, -1 if found["n"] < found["all"] else 0, len(cuts) * parts


def followers(numbers: DataFrame, most: int) -> DataFrame:
    """bucket, follower: the next larger of the distinct numbers (null after the last); they are from -1 to `most`.

    Numbers are ordered within groups; the last of a group follows from the same question about the groups, which are fewer.
    """
    if most + 1 < RING_ROWS:
        return numbers.withColumn("follower", F.lead("bucket").over(Window.partitionBy(F.lit(0)).orderBy("bucket")))
    group = F.floor((F.col("bucket") + 1) / RING_ROWS)
    inside = numbers.withColumn("group", group).withColumn(
        "inner", F.lead("bucket").over(Window.partitionBy("group").orderBy("bucket"))
    )
    firsts = numbers.groupBy(group.alias("group")).agg(F.min("bucket").alias("first"))
    after = followers(firsts.select(F.col("group").alias("bucket")), (most + 1) // RING_ROWS).join(
        firsts, F.col("follower") == F.col("group")
    ).select(F.col("bucket").alias("before"), "first")
    return inside.join(after, F.col("group") == F.col("before"), "left").select(
        "bucket", F.coalesce("inner", "first").alias("follower")
    )


def with_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, text, kept, next_text, next_kept: each row with the next one by ascending doc_id (null ids first, equal ids
    by text); after the last row comes the first. A null text is the empty text.

    Rows are sorted within buckets of neighbouring ids; the last row of a bucket is followed by the first of the next bucket.
    Only texts are dealt out: kept hashes are made after that, once per row, and a window over the same order hands them on.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    number, lowest, most = id_buckets(rows)
    bucket = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    placed = rows.select("*", number.alias("bucket")).select(
        "*", F.lead("text").over(bucket).alias("next_text"), F.row_number().over(bucket).alias("place")
    )

    def with_kept(df: DataFrame) -> DataFrame:
        others = df.columns
        tokens = df.select("*", token_hashes(F.col("text")).alias("tokens"))
        grams = tokens.select(*others, gram_hashes(F.col("tokens"), k).alias("grams"))
        return grams.select(*others, winnowed(F.col("grams"), window).alias("kept"))

    ordered = with_kept(placed).select("*", F.lead("kept").over(bucket).alias("next_kept"))
    firsts = with_kept(placed.where("place = 1").select("bucket", "text")).select(
        F.col("bucket").alias("at"), F.col("text").alias("first_text"), F.col("kept").alias("first_kept")
    )
    ring = followers(rows.select(number.alias("bucket")).distinct(), most).select(
        F.col("bucket").alias("before"), F.coalesce("follower", F.lit(lowest).cast("long")).alias("follower")
    )
    after = ring.join(firsts, F.col("follower") == F.col("at")).select("before", "first_text", "first_kept")
    joined = ordered.join(after, F.col("bucket") == F.col("before"))
    last = F.col("next_text").isNull()
    return joined.select(
        "doc_id", "text", "kept", F.when(last, F.col("first_text")).otherwise(F.col("next_text")).alias("next_text"),
        F.when(last, F.col("first_kept")).otherwise(F.col("next_kept")).alias("next_kept"),
    )


def compare_edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of `docs`.

    The edited text: the last quarter of the code points (rounded down) replaced by as many (or all) of the beginning of
    the next text. A null or empty text has no kept hash, an empty fingerprint, and a likeness of 1 to another without
    any, 0 to others. Repeated rows are compared each with its own next row; null ids come first. A single row is its own next. Other columns
    are not looked at; an empty table gives an empty result. Null ids share one bucket, as do rows of one id.
    """
    n = F.char_length("text")
    edited = F.concat(F.expr("left(text, cast(char_length(text) - floor(char_length(text) / 4) as int))"),
                      F.expr("left(next_text, cast(floor(char_length(text) / 4) as int))"))
    texts = with_next(docs, k, window).select("doc_id", "kept", "next_kept", n.alias("n"), edited.alias("edited"))
    tokens = texts.select(
        "doc_id", "kept", "next_kept", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        token_hashes(F.col("edited")).alias("tokens"),
    )
    same = ["doc_id", "n_chars", "edited_sha256", "kept", "next_kept"]
    grams = tokens.select(*same, gram_hashes(F.col("tokens"), k).alias("grams"))
    both = grams.select(*same, winnowed(F.col("grams"), window).alias("edited_kept"))
    sets = both.select(
        "*", hashes(F.col("kept")).alias("h"), hashes(F.col("edited_kept")).alias("eh"), hashes(F.col("next_kept")).alias("nh")
    )
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("kept")).alias("fingerprint"),
        text_of(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("eh")).alias("near_edited"), likeness(F.col("h"), F.col("nh")).alias("near_next"),
    )
