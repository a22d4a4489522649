"""Shared column expressions and bounds for text operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

#: A side may be broadcast up to this many bytes of text; beyond it the join is left to Spark.
BROADCAST_TEXT_BYTES = 16 * 1024 * 1024


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def alnum_words(text: Column) -> Column:
    """Runs of 0-9, a-z and all characters beyond ASCII, after ``lower_ascii``; null has none."""
    parts = F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def count_alnum_words(text: Column) -> Column:
    """``size(alnum_words(text))`` without lower-casing."""
    parts = F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.coalesce(F.size(F.array_remove(parts, "")), F.lit(0)).cast("long")


def bound(array: Column, body) -> Column:
    """``body(array)`` with the array computed once, however often ``body`` refers to it."""
    return F.transform(F.array(array), body)[0]


def row_key(doc_id: str, text: str) -> Column:
    """64 bits of a row's id and text; rows that agree in both are the same document.

    The hash skips nulls, so which of the two are null goes in as well.
    """
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text))


def if_small(df: DataFrame, text: str, limit: int = BROADCAST_TEXT_BYTES) -> bool:
    """Whether a table's texts stay below a broadcast bound; one pass over one column."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return size <= limit


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
