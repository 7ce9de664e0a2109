"""Six interpretable signals of synthetic-looking text, their weighted score and its explanation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import fresh

#: Weights in the order they are summed, and the signals that are high for human text.
WEIGHTS = {
    "repetition": 0.18,
    "filler_density": 0.20,
    "lexical_diversity": 0.16,
    "ngram_diversity": 0.16,
    "burstiness": 0.15,
    "duplicate_similarity": 0.15,
}
INVERTED = ("lexical_diversity", "ngram_diversity", "burstiness")
SYNTHETIC_THRESHOLD = 50.0
SIGNALS = tuple(WEIGHTS)


#: Helper columns of `with_features`; a caller's columns of these names are refused rather than overwritten.
TOKENS, LENGTHS, TRIGRAMS, HITS = "_tokens", "_lengths", "_trigrams", "_hits"


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` plus what several signals share, each computed once a row: tokens, sentence lengths, trigram hashes, phrase hits.

    Each is a column before the next one reads it: inside a condition, what is read twice would be computed twice.

    The trigrams of a text are told apart by 64-bit hashes, and sorted only where some are equal; otherwise the
    array is null, and there are two less trigrams than tokens.
    """
    if taken := {"_low", "_marked", TOKENS, LENGTHS, TRIGRAMS, HITS} & set(df.columns):
        raise ValueError(f"columns with reserved names: {sorted(taken)}")
    df = df.withColumn("_low", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumns({"_marked": T.marked_in("_low"), HITS: T.hits_in("_low")}).drop("_low").withColumn(LENGTHS, T.run_lengths("_marked"))
    df = df.withColumn(TOKENS, F.filter("_marked", lambda w: ~w.isin(".", "!", "?"))).drop("_marked")
    df = df.withColumn(TRIGRAMS, T.ngram_hashes(TOKENS, 3))
    return df.withColumn(TRIGRAMS, F.when(F.size(F.array_distinct(TRIGRAMS)) < F.size(TRIGRAMS), F.sort_array(TRIGRAMS)))


def variation(lens: str = LENGTHS) -> Column:
    """Population deviation over mean of the sentence lengths; null under two sentences."""
    n, s = F.size(lens).cast("long"), F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x * x)
    return F.when(n >= 2, F.sqrt((n * squares - s * s).cast("double")) / s)


def with_signals(df: DataFrame, text_col: str = "text", references: DataFrame | None = None, id_col: str = "doc_id", keep: bool = False) -> DataFrame:
    """`df` plus the six signals (doubles in 0 to 1). Without `references`, duplicate_similarity is 0.

    Sorted trigrams have equal ones side by side, which tells how many differ and how many occur only once. With
    `keep`, the tokens and sentence lengths stay as columns.
    """
    columns = [*df.columns, *((TOKENS, LENGTHS) if keep else ())]
    d = with_features(df, text_col)
    tokens, t = F.size(TOKENS), TRIGRAMS
    n = F.greatest(tokens - 2, F.lit(0))
    new = F.expr(f"size(filter({t}, (x, i) -> i = 0 or {t}[greatest(i - 1, 0)] <> x))")
    single = F.expr(f"size(filter({t}, (x, i) -> (i = 0 or {t}[greatest(i - 1, 0)] <> x) and (i = size({t}) - 1 or {t}[least(i + 1, size({t}) - 1)] <> x)))")
    all_differ = F.col(t).isNull()
    d = d.select(
        *columns,
        F.when(n <= 0, 0.0).when(all_differ, 0.0).otherwise((n - single) / n).alias("repetition"),
        F.when(tokens > 0, T.clamp(F.col(HITS) / F.greatest(F.lit(1.0), tokens / 50.0))).otherwise(0.0).alias("filler_density"),
        F.when(tokens > 0, F.size(F.array_distinct(TOKENS)) / tokens).otherwise(0.0).alias("lexical_diversity"),
        F.when(n <= 0, 0.0).when(all_differ, 1.0).otherwise(new / n).alias("ngram_diversity"),
        T.clamp(F.coalesce(variation(), F.lit(0.0))).alias("burstiness"),
        F.lit(0.0).alias("duplicate_similarity"),
    )
    if references is None:
        return d
    from ..operators.similarity import nearest_reference

    of, near = fresh(d, "of", "near")
    found = nearest_reference(df.select(id_col, text_col), references, id_col, text_col).toDF(of, near)
    d = d.join(found, d[id_col] == found[of], "left")
    return d.select(*(F.coalesce(near, F.lit(0.0)).alias(c) if c == "duplicate_similarity" else F.col(c) for c in d.columns if c not in (of, near)))


def combine(drop: Iterable[str] = ()) -> Column:
    """Score 0 to 100 over the signals that are not dropped, weights renormalised; 0 if all are."""
    kept = [s for s in SIGNALS if s not in set(drop)]
    total, parts = 0.0, F.lit(0.0)
    for s in kept:
        parts = parts + WEIGHTS[s] * ((1.0 - F.col(s)) if s in INVERTED else F.col(s))
        total += WEIGHTS[s]
    # Rounded as a double, like SQL and the reference do: F.round goes by the shortest decimal, which turns 1.005 to 1.01.
    return F.round(100.0 * T.clamp(parts / F.lit(total)) * 100.0) / 100.0 if kept else F.lit(0.0)


def explanation() -> Column:
    """Reasons in fixed order, from unrounded signals. The wordings are fixed values."""
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("duplicate_similarity") > 0.4, "high overlap with known synthetic outputs (recycling)"),
        F.when(F.col("filler_density") > 0.4, "dense canned filler phrasing"),
        F.when(F.col("lexical_diversity") < 0.45, "low lexical diversity"),
        F.when(F.col("burstiness") < 0.35, "uniform sentence lengths"),
        F.when(F.col("repetition") > 0.2, "repeated trigrams"),
    )
    return F.coalesce(F.nullif(reasons, F.lit("")), F.lit("varied vocabulary and sentence structure"))


def score(df: DataFrame, text_col: str = "text", references: DataFrame | None = None, id_col: str = "doc_id", keep: bool = False) -> DataFrame:
    """`df` plus signals, `synthetic_likelihood`, `is_synthetic` and `explanation`."""
    d = with_signals(df, text_col, references, id_col, keep).withColumn("synthetic_likelihood", combine())
    return d.withColumn("is_synthetic", F.col("synthetic_likelihood") >= SYNTHETIC_THRESHOLD).withColumn("explanation", explanation())


def verdict(scored: DataFrame, *by: str) -> DataFrame:
    """total, predicted_synthetic and estimated_contamination of scored rows, by group if asked."""
    flagged = F.count_if("is_synthetic")
    return scored.groupBy(*by).agg(F.count("*").alias("total"), flagged.alias("predicted_synthetic"), F.coalesce(F.round(F.try_divide(flagged, F.count("*")), 4), F.lit(0.0)).alias("estimated_contamination"))
