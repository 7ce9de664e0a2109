"""Key lookups and set operations on texts: feature caches, what is missing from them, and distinct unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import fresh


def with_key(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` plus `h`, the md5 of the text (null counts as empty)."""
    return df.withColumn("h", F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def lookup(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join on h: missing features are null."""
    return df.join(cache, "h", "left")


def missing(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct keyed texts that the cache does not have."""
    return df.join(cache.select("h"), "h", "left_anti").dropDuplicates(["h"])


def usable(df: DataFrame, *features: str) -> DataFrame:
    """Rows whose features are all there and numbers."""
    return df.where(reduce(lambda a, b: a & b, (F.col(f).isNotNull() & ~F.isnan(f) for f in features)))


def distinct_union(parts: list[DataFrame], order_col: str, text_col: str = "text") -> DataFrame:
    """All parts together, of equal texts the first: by part, then by order. Aggregated before the shuffle."""
    rows = [with_key(p.select(order_col, text_col)).select(F.lit(k).alias("part"), order_col, "h", text_col) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, rows).groupBy("h").agg(F.min_by(F.struct("part", order_col, text_col), F.struct("part", order_col)).alias("x")).select("h", "x.*")


def first_by_prefix(df: DataFrame, text_col: str, order_col: str, length: int = 80) -> DataFrame:
    """Rows whose first `length` characters no earlier row has. Aggregated before the shuffle, so equal openings don't gather."""
    opening, row = fresh(df, "opening", "row")
    first = df.select(F.substring(text_col, 1, length).alias(opening), F.struct(*df.columns).alias(row), order_col)
    return first.groupBy(opening).agg(F.min_by(row, order_col).alias(row)).select(f"{row}.*")
