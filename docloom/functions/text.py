"""Text functions with the white-space rules of Unicode, as column expressions.

``trim`` strips blanks only and ``\\s`` knows ASCII only, so both are spelled out
here. A null argument gives null, unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All code points that count as white space.
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPLIT = r"(?U)[\s\x1c-\x1f]+"
#: How much of a page is compared, and a header that stands for none.
FIRST_CHARACTERS, FIRST_WORDS = 200, 50
SENTINEL = "Text that appears at the top of a page, like a page title."


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE_SPACE))


def words(c: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.array_remove(F.split(c, SPLIT), "")


def first_words(c: Column, n: int = FIRST_WORDS) -> Column:
    """The set of the first ``n`` words in lower case."""
    return F.array_distinct(F.slice(words(F.lower(c)), 1, n))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def is_different(a: Column, b: Column, threshold: float = 0.3) -> Column:
    """Whether the first words of two texts differ; a text that is null or has no words differs from all."""
    x, y = (first_words(F.coalesce(c, F.lit(""))) for c in (a, b))
    return (F.size(x) == 0) | (F.size(y) == 0) | (jaccard(x, y) < threshold)


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    """Whether any of the texts occurs, case counting. Texts that hold another are not searched for."""
    least = [n for n in dict.fromkeys(needles) if not any(o != n and o in n for o in needles)]
    return reduce(lambda a, b: a | b, (c.contains(n) for n in least), F.lit(False))


def strip_html(c: Column) -> Column:
    """Text without tags, stripped."""
    return strip(F.regexp_replace(c, "<[^>]+>", ""))


def is_upper(c: Column) -> Column:
    """At least one cased letter, and none in lower case."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def block_text(text: Column, html: Column) -> Column:
    """A block's text, or its markup without tags if that leaves anything; else null."""
    bare = strip_html(html)
    return F.when(F.coalesce(text, F.lit("")) != "", strip(text)).when(bare != "", bare)


def paragraphs(html: Column) -> Column:
    """The texts of plain paragraphs."""
    return F.regexp_extract_all(html, F.lit("<p>([^<]+)</p>"), F.lit(1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The last part of a path without its last extension; a leading dot is no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def is_pdf(name: Column) -> Column:
    return F.lower(name).endswith(".pdf")


def normalised_uuid(c: Column) -> Column:
    """A UUID with hyphens in lower case from any usual spelling (braces, URN, no hyphens); null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), "^urn:|uuid:", ""), "[{}-]", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def megabytes(n: Column) -> Column:
    """Bytes as MiB with two digits, ties to even."""
    return F.bround(n / F.lit(1024 * 1024), 2)


def storage_folder(type_: Column) -> Column:
    return F.when(type_ == "abstract", "abstracts").otherwise("publications")
