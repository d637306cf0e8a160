"""Look-ups by keys of which some are hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 64                  # a key is hot with more than one part in so many of all rows


def is_hot(rows_of_key: str | Column, rows: int) -> Column:
    """Of at most ``SHARE`` keys."""
    return F.coalesce((F.col(rows_of_key) if isinstance(rows_of_key, str) else rows_of_key) * SHARE > rows, F.lit(False))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """Join rows to a table with one row for each key; its hot keys, ``SHARE`` at most, are broadcast, so their rows stay
    where they are and only the others are dealt by key."""
    common, rare = F.broadcast(table.where(hot)), table.where(~hot)
    return rows.join(common, keys).unionByName(rows.join(common.select(*keys), keys, "left_anti").join(rare, keys, how))
