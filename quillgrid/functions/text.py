"""Text measures as column expressions: they stay in the JVM, inside one stage, next to the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, and signs of a person writing.
WORD = r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*"
EDGE, OPEN = "(?![A-Za-z0-9_])", "(?<![A-Za-z0-9_])"
CONTRACTION = rf"(?i){OPEN}\w+['’](?:t|s|re|ve|ll|d|m){EDGE}"
FIRST_PERSON = rf"{OPEN}(?:I(?:['’](?:m|ve|ll|d))?|[Ww]e(?:['’](?:re|ve|ll|d))?|[Mm]y|[Oo]ur|[Mm]e|[Uu]s){EDGE}"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def n_contractions(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CONTRACTION)).cast("long")


def n_first_person(text: Column) -> Column:
    return F.regexp_count(text, F.lit(FIRST_PERSON)).cast("long")


def beyond_latin(text: Column) -> Column:
    """Prose in a script that the rules aren't for: over 80 such characters and a quarter of the letters."""
    beyond = F.regexp_count(text, F.lit("[\\u3000-\\u9fff\\u3040-\\u30ff\\uac00-\\ud7af\\u0400-\\u04ff\\u0600-\\u06ff\\u0e00-\\u0e7f]"))
    return (beyond > 80) & (beyond * 3 > F.regexp_count(text, F.lit("[A-Za-z]")))


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up on the binary value."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def slug(title: Column) -> Column:
    """Anchor of a heading: lower case, without tags and punctuation, each space a hyphen."""
    bare = F.regexp_replace(F.trim(F.lower(title)), "<[^>]*>", "")
    return F.regexp_replace(F.regexp_replace(bare, r"""[!(),.:;'"`’“”?\[\]{}\\/|@#$%^&*+=~<>]+""", ""), r"\s", "-")


def resolved(base: Column, href: Column) -> Column:
    """href from the page base, as a path without . and ..; null if it leaves the tree."""
    start = F.when(href.startswith("/"), F.lit("")).otherwise(F.regexp_extract(base, r"^(.*/)?", 0))
    parts = F.split(F.concat(start, href), "/")
    step = lambda done, part: F.when(done.isNull() | part.isin("", "."), done).when(part == "..", F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def span_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-1 of a span with white space evened out."""
    kept = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    return F.substring(F.sha1(F.regexp_replace(F.array_join(kept, "\n"), r"[ \t]+", " ")), 1, 16)


def text_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def utf16(text: Column, offset: Column) -> Column:
    """An offset in code points as one in UTF-16 units, as editors count; past the end it is the end."""
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), F.greatest(offset, F.lit(0))), "UTF-16BE")) / 2).cast("int")


def squeezed(text: Column) -> Column:
    """White space at the ends of lines and of the text gone, empty lines at most one in a row, and one line end at the end."""
    even = F.regexp_replace(F.regexp_replace(text, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(even, r"^[ \t\n\r]+|[ \t\n\r]+\z", ""), F.lit("\n"))


def stripped(text: Column, mode: str = "none") -> Column:
    """A text before it goes to a model: as it is, with even white space, or as Python without strings over lines and comments."""
    if mode == "none":
        return text
    if mode == "whitespace":
        return squeezed(text)
    if mode == "python":
        bare = F.regexp_replace(text, r"(?s)\"\"\".*?\"\"\"|'''.*?'''", "")
        return squeezed(F.regexp_replace(bare, r"(?m)(?:^|[\t ])#[^\n\r]*$", ""))
    raise ValueError(f"no such mode: {mode}")


def cache_key(*parts: Column) -> Column:
    """SHA-256 of what a model's input depends on (its file, its text), as a key of kept results."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def hrefs(html: Column) -> Column:
    """Targets of a page's plain links."""
    return F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))


def heading_levels(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("<h([1-6])[^>]*>"), F.lit(1)).cast("array<int>")
