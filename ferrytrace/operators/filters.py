"""Selecting the rows to deliver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_list(text: str) -> list[str]:
    """``"LU, DE,BE"`` to its trimmed items."""
    return [item.strip() for item in text.split(",")]


def keep_listed(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Rows whose column is in the list; a null never passes.  Reaches the scan as ``IN``."""
    return df.filter(F.col(column).isin(list(values)))


def keep_listed_in(df: DataFrame, column: str, wanted: DataFrame, wanted_column: str) -> DataFrame:
    """The same with the list as a table of any size.

    No broadcast hint: the optimizer and AQE broadcast the list when its measured size allows
    and otherwise shuffle, splitting skewed keys.
    """
    keys = wanted.select(F.col(wanted_column).alias(column)).distinct()
    return df.join(keys, column, "left_semi")
