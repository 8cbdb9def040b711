"""Words and lines as the operators of this package count them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but these six white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"


def whole(text: Column) -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words; empty for a null or blank text."""
    return F.array_remove(F.split(whole(text), SPACE), "")


def count(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def split_bytes(text: str | None) -> list[bytes]:
    """The words as UTF-8; ``bytes.split`` cuts at exactly the six characters."""
    return text.encode().split() if text else []


def carried(documents: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The documents with the columns that an operator reads under their names and all
    others under neutral ones, so that none clashes with the operator's own; and what gives
    a result the documents' columns back."""
    names = [c if c in needed else f"__carried_{k}" for k, c in enumerate(documents.columns)]
    inner = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(documents.columns, names)])
    return inner, lambda df: df.select(*[F.col(n).alias(c) for c, n in zip(documents.columns, names)])
