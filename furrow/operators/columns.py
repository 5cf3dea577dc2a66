"""Carrying a caller's columns through an operator, whatever they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(df: DataFrame, **names: str | Column) -> DataFrame:
    """``df`` as one struct ``own`` beside the columns that the operator works on, under names of its choice: no column of the caller can clash with a helper."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in names.items()])


def unpack(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The caller's ``columns`` out of the struct, then the ``new`` ones; a column of the caller with the name of a new one is replaced."""
    return df.select(*[F.col("own")[c].alias(c) for c in columns if c not in new], *[v.alias(n) for n, v in new.items()])
