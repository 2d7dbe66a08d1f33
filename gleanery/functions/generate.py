"""Arrays to rows without evaluating the array twice.

For a plain explode Catalyst infers the filter size(array) > 0 and pushes it below every projection
that builds the array, copying the whole expression (tokenisation, trees, chunks) into the filter.
An outer explode gets no such filter; its null row for an empty array is dropped afterwards, where
the test cannot be pushed below the generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, array: str | Column, name: str, keep: tuple = (), pos: str = "_pos") -> DataFrame:
    """`keep` columns and one row per element in `name`, with its position in `pos`."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())
    return rows.drop("_pos")


def inlined(df: DataFrame, array: str | Column, present: str, keep: tuple = ()) -> DataFrame:
    """`keep` columns and the struct fields of every element; field `present` is never null."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(present).isNotNull())


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once per row: a lambda written around an expression evaluates it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
