"""Joins and reductions used by many plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], at: str, out: str) -> DataFrame:
    """Latest day per key. Reduced on the map side, so one busy key costs no more than any other."""
    return df.groupBy(*keys).agg(F.max(at).alias(out))


def with_names(
    df: DataFrame, customers: DataFrame | None = None, products: DataFrame | None = None
) -> DataFrame:
    """Attach customer and product names; a row without a match keeps NULL names.

    No broadcast is forced: the dimensions grow with the business, so Spark decides by their size.
    """
    if customers is not None:
        df = df.join(customers.select("customer_id", "customer_name"), "customer_id", "left")
    if products is not None:
        df = df.join(products.select("product_id", "product_name"), "product_id", "left")
    return df


def money(col: Column | str) -> Column:
    """An amount as a decimal of cents, which adds up exactly in any order."""
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(18,2)")


def total(col: Column | str) -> Column:
    """Exact sum of money, as a double."""
    return F.sum(money(col)).cast("double")


def stacked(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
