"""Carrying a caller's columns through an operator, whatever their names are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns of this name are the operators' own.
DOC = "__doc"


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def bundle(names: Sequence[str]) -> Column:
    """All columns of ``names`` as one struct."""
    return F.struct(*(col(n) for n in names), F.lit(0).alias("__one")).alias(DOC)


def unbundle(names: Sequence[str], doc: str = DOC) -> list[Column]:
    return [F.col(doc).getField(n).alias(n) for n in names]
