"""Seeded orders, exact stratified splits and balanced samples, the same at every parallelism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import fresh
from .prefix import running_totals

SEED = 1234


def seeded(key: Column, seed: int = SEED) -> Column:
    """A pseudo-random order of rows by key: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def ranked(df: DataFrame, rank: str, key: Column, seed: int = SEED, *by: str) -> DataFrame:
    """`df` plus the rank (from 1) of each row in the seeded order of its group."""
    return running_totals(df, [seeded(key, seed), key], {rank: F.lit(1)}, *by)


def split(df: DataFrame, label: str, key: Column, frac: float = 0.7, seed: int = SEED) -> DataFrame:
    """`df` plus `is_train`: exactly floor(n * frac) rows of each label, in seeded order."""
    rank, n, of = fresh(df, "rank", "n", "of")
    sizes = df.groupBy(F.col(label).alias(of)).agg(F.count("*").alias(n))
    d = ranked(df, rank, key, seed, label)
    d = d.join(F.broadcast(sizes), d[label].eqNullSafe(sizes[of]))  # a row for each label
    return d.select(*df.columns, (F.col(rank) <= F.floor(F.col(n) * frac)).alias("is_train"))


def balanced(df: DataFrame, label: str, key: Column, seed: int = SEED, most: int | None = None) -> DataFrame:
    """As many rows of each label as the smallest has (`most` at most), in seeded order."""
    rank, least = fresh(df, "rank", "least")
    n = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias(least))
    limit = F.least(F.col(least), F.lit(most)) if most else F.col(least)
    return ranked(df, rank, key, seed, label).join(F.broadcast(n), F.col(rank) <= limit).select(*df.columns)  # one row
