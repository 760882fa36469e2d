"""Column expressions that turn text records of several shapes into plain text."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's notion of white space: the Unicode separators plus the ASCII information separators.
_NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def not_blank(text: Column) -> Column:
    return text.isNotNull() & text.rlike(_NOT_BLANK)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def joined(left: Column, right: Column) -> Column:
    """``"left right"`` trimmed; NULL unless both are there."""
    return strip(F.concat(left, F.lit(" "), right))


def _unknown(columns: Collection[str]) -> Column:
    names = ", ".join(sorted(columns))
    return F.raise_error(F.lit(f"no text in record with fields: {names}")).cast("string")


def record_text(columns: Collection[str]) -> Column:
    """Text of one record. A missing key is a NULL field; list fields are ``sentences_list``
    and ``positive``."""
    choices = []
    for name in ("text", "sentence", "sentences"):
        if name in columns:
            choices.append(F.col(name))
    if {"query", "document"} <= set(columns):
        choices.append(joined(F.col("query"), F.col("document")))
    if {"query", "positive"} <= set(columns):
        choices.append(joined(F.col("query"), F.get("positive", F.lit(0))))
    if "query" in columns:
        choices.append(F.col("query"))
    return F.coalesce(*choices, _unknown(columns))


def pair_text(query: Column, document: Column) -> Column:
    return joined(query, document)


def batch_texts(columns: Collection[str]) -> Column:
    """All texts of one column-wise batch, every field being an array of strings."""
    choices = [F.col(name) for name in ("sentences", "sentence", "text") if name in columns]
    if {"title", "text"} <= set(columns):
        choices.append(F.zip_with("title", "text", joined))
    if "input" in columns:
        choices.append(F.col("input"))
    if {"query", "document"} <= set(columns):
        choices.append(F.zip_with("query", "document", joined))
    if "query" in columns:
        choices.append(F.col("query"))
    message = F.lit("no text in batch with fields: " + ", ".join(sorted(columns)))
    return F.coalesce(*choices, F.raise_error(message).cast("array<string>"))
