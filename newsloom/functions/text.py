"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

WORD_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda t: t != "")


def counted_tokens(text: Column) -> Column:
    """(word, n) of each different word. Counted inside the row: the words are sorted, and a run of equal ones ends where the next
    one starts. So no task holds the words of several texts."""

    def counts(words: Column, starts: Column) -> Column:
        after = lambda j: F.coalesce(F.get(starts, j + 1), F.size(words))
        return F.transform(starts, lambda at, j: F.struct(F.get(words, at).alias("word"), (after(j) - at).alias("n")))

    def runs(words: Column) -> Column:
        first = F.transform(words, lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), i))
        return F.flatten(F.transform(F.array(F.filter(first, lambda i: i.isNotNull())), lambda starts: counts(words, starts)))

    return F.flatten(F.transform(F.array(F.sort_array(tokens(text))), runs))


def is_blank(text: Column) -> Column:
    """Null, empty, or nothing but white space of any kind."""
    return text.isNull() | text.rlike(r"^\s*$")


def word_count(text: Column) -> Column:
    """Whitespace-separated words; 0 for null or blank text."""
    words = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.coalesce(F.size(words), F.lit(0)).cast("bigint")


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(_readable(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def page_meta(html: Column, attribute: str, value: str) -> Column:
    """Content of a meta element, whichever of its two attributes comes first, in either kind of quotes."""
    named, content = rf"""{attribute}=["']{value}["']""", r"""content=(["'])(.*?)\1"""
    found = [F.regexp_extract(html, rf"(?is)<meta[^>]*{a}[^>]*{b}", 2) for a, b in ((named, content), (content, named))]
    return _readable(F.coalesce(*[F.nullif(f, F.lit("")) for f in found]))


# Markup that carries no article text, removed in this order; then every other tag.
DROPPED_MARKUP = (
    r"(?is)<!--.*?-->",
    r"(?is)<head[^>]*>.*?</head>",
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
    r"(?is)<nav[^>]*>.*?</nav>",
    r"(?is)<[^>]+>",
)
#: A character reference: decimal, hexadecimal or named.
REFERENCE = r"&(?:#[0-9]{1,8};?|#[xX][0-9a-fA-F]{1,8};?|[A-Za-z][A-Za-z0-9]{0,31};)"
#: Characters by name, as the standard library lists them.
NAMED = {f"&{name}": char for name, char in html5.items() if name.endswith(";")}
#: Numbers 128 to 159 mean the characters of the old Windows code page.
WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}


def _constant_map(entries: dict[str, str]) -> Column:
    """A map that is one literal in the plan, not an expression per entry."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in entries.items())), F.lit("\x01"), F.lit("\x02"))


def _character(reference: Column) -> Column:
    """What a reference stands for; a number that is no character is U+FFFD, an unknown name stays as it is."""
    digits = F.regexp_replace(reference, r"[&#xX;]", "")
    hexadecimal = reference.rlike("^&#[xX]")
    n = F.when(hexadecimal, F.conv(digits, 16, 10).cast("bigint")).otherwise(F.conv(digits, 10, 10).cast("bigint"))
    windows, named = _constant_map({str(k): v for k, v in WINDOWS.items()}), _constant_map(NAMED)
    valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    number = F.when(~valid, F.lit("\ufffd")).when(n.between(128, 159), F.try_element_at(windows, n.cast("string"))).otherwise(plain)
    return F.when(reference.startswith("&#"), number).otherwise(F.coalesce(F.try_element_at(named, reference), reference))


def _spliced(text: Column) -> Column:
    rest = F.split(text, REFERENCE, -1)
    found = F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), F.lit(1))
    pairs = F.zip_with(found, F.slice(rest, 2, F.size(found)), lambda reference, after: F.concat(_character(reference), after))
    return F.when(text.rlike(REFERENCE), F.concat(F.get(rest, F.lit(0)), F.array_join(pairs, ""))).otherwise(text)


def decode_references(text: Column) -> Column:
    """Character references replaced by what they stand for, once each: the text is cut at them and joined again.

    The text is bound as a lambda variable, so whatever makes it runs once.
    """
    return F.get(F.transform(F.array(text), _spliced), F.lit(0))


def _readable(text: Column) -> Column:
    """With references decoded; a space that must not break is a space."""
    return F.replace(decode_references(text), F.lit("\u00a0"), F.lit(" "))


def page_text(html: Column) -> Column:
    """Visible text of a page with white space collapsed."""
    text = html
    for pattern in DROPPED_MARKUP:
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(_readable(text), r"\s+", " "))
