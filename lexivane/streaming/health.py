"""Corpus health over a stream of documents: windowed metrics with late data, and alerts per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import signals
from ..functions import text as T


def windowed_health(docs: DataFrame, ts: str = "ts", text_col: str = "text", every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows (start, end, n_docs, n_tokens, vocab, mean_synthetic_score, flagged_pct) per window, late rows up to a watermark.

    All aggregates have state of bounded size: the vocabulary is a HyperLogLog estimate over hashed documents' words.
    """
    d = signals.score(docs.withWatermark(ts, late), text_col).withColumn("toks", T.word_tokens(text_col))
    n = F.size("toks")
    # A document's own figures count on the row of its first word only.
    firsts = d.select(ts, "synthetic_likelihood", "is_synthetic", n.alias("n"), F.posexplode_outer(F.array_distinct("toks")).alias("i", "w"))
    own = F.coalesce(F.col("i"), F.lit(0)) == 0
    return (
        firsts.groupBy(F.window(ts, every))
        .agg(
            F.count_if(own).alias("n_docs"), F.sum(F.when(own, F.col("n"))).alias("n_tokens"), F.approx_count_distinct("w").alias("vocab"),
            F.avg(F.when(own, F.col("synthetic_likelihood"))).alias("mean_synthetic_score"),
            (100.0 * F.count_if(own & F.col("is_synthetic")) / F.count_if(own)).alias("flagged_pct"),
        )
        .select("window.start", "window.end", "n_docs", "n_tokens", "vocab", "mean_synthetic_score", "flagged_pct")
    )


def on_batch(docs: DataFrame, act: Callable[[DataFrame, int], None], folder: str) -> StreamingQuery:
    """Run `act` on each micro-batch of scored documents, with exactly-once progress kept in `folder`."""
    return signals.score(docs).writeStream.foreachBatch(act).option("checkpointLocation", folder).trigger(availableNow=True).start()
