"""Whole rows carried beside what an operator works out, so that no column of theirs can clash with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(c: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + c.replace("`", "``") + "`")


def row_of(docs: DataFrame) -> Column:
    """A struct of all columns, numbered."""
    return F.struct(*(named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))


def unpacked(docs: DataFrame, leave: tuple[str, ...] = (), instead: dict[str, Column] | None = None) -> list[Column]:
    """The columns of docs out of such a struct called row; leave: without these; instead: other values."""
    return [(instead or {}).get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns) if c not in leave]
