"""Rows of any table, carried past columns that operators add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OWN = "_own"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def wrapped(docs: DataFrame, *names: str) -> DataFrame:
    """The columns ``names``, and all others in one struct, in which no name can clash with an operator's."""
    others = [F.col(_quoted(c)) for c in docs.columns if c not in names]
    return docs.select(*[F.col(_quoted(c)) for c in names], (F.struct(*others) if others else F.lit(True)).alias(_OWN))


def unwrapped(rows: DataFrame, columns: list[str], names: tuple[str, ...], **changed: Column) -> DataFrame:
    """``columns`` of the table that ``wrapped(docs, *names)`` was made from, those in ``changed`` with new values."""
    back = [changed[c] if c in changed else F.col(_quoted(c)) if c in names else F.col(_OWN)[c] for c in columns]
    return rows.select(*[value.alias(c) for value, c in zip(back, columns, strict=True)])
