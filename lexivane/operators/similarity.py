"""Shingle overlap: nearest reference by equi-join, and near-duplicate rate over a fixed plan of pairs."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shared import checkpoint
from .prefix import running_totals


def nearest_reference(df: DataFrame, references: DataFrame, id_col: str = "doc_id", text_col: str = "text", ref_text_col: str = "text") -> DataFrame:
    """Rows (id, similarity): largest Jaccard of five-word shingle sets with any reference; texts without overlap are absent.

    An equi-join on shingles replaces the nested loop: only pairs that share one are counted.
    """
    own = df.select(F.col(id_col), T.shingles(T.word_tokens(text_col)).alias("s")).select(id_col, F.size("s").alias("na"), F.explode("s").alias("g"))
    refs = references.select(T.shingles(T.word_tokens(ref_text_col)).alias("s")).distinct()
    refs = refs.select(F.xxhash64("s").alias("ref"), F.size("s").alias("nb"), F.explode("s").alias("g"))
    shared = own.join(refs, "g").groupBy(id_col, "ref", "na", "nb").agg(F.count("*").alias("o"))
    return shared.groupBy(id_col).agg(F.max(F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).alias("similarity"))


def pair_plan(n: int, sample: int = 400, most: int = 4000, seed: int = 1234) -> list[tuple[int, int]]:
    """Pairs of document positions to compare: a function of the number of documents only, at most `most` rows.

    Drawn with replacement among `sample` documents at most; draws of a document with itself are skipped.
    """
    rng = random.Random(seed)
    pool = list(range(n)) if n <= sample else rng.sample(range(n), sample)
    out = []
    for _ in range(min(most, len(pool) * (len(pool) - 1) // 2)):
        i, j = rng.randrange(len(pool)), rng.randrange(len(pool))
        if i != j:
            out.append((pool[i], pool[j]))
    return out


def near_duplicate_pairs(df: DataFrame, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (a, b, n, jaccard) of the sampled pairs by document position; n counts how often the plan drew the pair."""
    spark: SparkSession = df.sparkSession
    n = df.count()
    plan = spark.createDataFrame(pair_plan(n) or [(-1, -1)], "a long, b long").groupBy("a", "b").agg(F.count("*").alias("n"))
    wanted = plan.select(F.col("a").alias("pos")).union(plan.select("b")).distinct()
    # Only ids are put in order; texts are then read for 400 positions at most. Rows of one id are told apart by their text.
    keyed = df.select(F.col(order_col).alias("o"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    place = running_totals(keyed.select("o", "h"), [F.col("o"), F.col("h")], {"upto": F.lit(1)}).select((F.col("upto") - 1).alias("pos"), "o", "h")
    place = checkpoint(place.join(F.broadcast(wanted), "pos"))
    pool = keyed.join(F.broadcast(place), keyed["o"].eqNullSafe(place["o"]) & (keyed["h"] == place["h"]))
    sets = pool.dropDuplicates(["pos"]).select("pos", T.shingles(T.word_tokens("t"), empty=False).alias("s"))
    both = plan.join(sets.withColumnsRenamed({"pos": "a", "s": "x"}), "a").join(sets.withColumnsRenamed({"pos": "b", "s": "y"}), "b")
    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))), F.lit(0.0))
    return both.select("a", "b", "n", jaccard.alias("jaccard"))


def near_duplicate_rate(df: DataFrame, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: share of the sampled pairs with a Jaccard over 0.5; 0 without pairs."""
    pairs = near_duplicate_pairs(df, order_col, text_col)
    rate = F.try_divide(F.sum(F.when(F.col("jaccard") > 0.5, F.col("n")).otherwise(0)), F.sum("n"))
    return pairs.agg(F.coalesce(rate, F.lit(0.0)).alias("near_duplicate_rate"))
