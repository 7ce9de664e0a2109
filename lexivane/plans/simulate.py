"""Controlled experiments with the probe on stand-in corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals
from ..operators import evaluation, sampling
from ..operators.sampling import SEED
from .standins import Spec, generation_specs, make_dataset, make_datasets


def judged(df: DataFrame) -> DataFrame:
    return signals.score(df).withColumn("actual", F.col("label") == "synthetic")


def sweep_specs(n: int = 40, levels: int = 11) -> list[Spec]:
    return [(k / (levels - 1), n, k / (levels - 1), 2) for k in range(levels)]


def contamination_sweep(spark: SparkSession, n: int = 40, levels: int = 11, seed: int = SEED) -> DataFrame:
    """Rows (level, tp, fp, fn, tn, rates, estimated) for contamination 0 to 1."""
    d = judged(make_datasets(spark, sweep_specs(n, levels), seed).withColumnRenamed("part", "level"))
    counts = d.groupBy("level").agg(*(F.count_if(c).alias(k) for k, c in (("tp", F.expr("is_synthetic and actual")), ("fp", F.expr("is_synthetic and not actual")), ("fn", F.expr("not is_synthetic and actual")), ("tn", F.expr("not is_synthetic and not actual")))))
    estimated = F.round((F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 4)
    return counts.select("*", *(v.alias(k) for k, v in evaluation.rates(*(F.col(x) for x in ("tp", "fp", "fn", "tn"))).items()), estimated.alias("estimated"))


def generation_degradation(spark: SparkSession, generations: int = 4, n: int = 60, seed: int = SEED) -> DataFrame:
    """Rows (generation, accuracy, mean_separation); a generation without human texts counts their mean as 0."""
    d = judged(make_datasets(spark, generation_specs(generations, n), seed))
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("synthetic_likelihood"))), F.lit(0.0))
    return d.groupBy(F.col("part").cast("int").alias("generation")).agg(F.avg((F.col("is_synthetic") == F.col("actual")).cast("int")).alias("accuracy"), (mean(F.col("actual")) - mean(~F.col("actual"))).alias("mean_separation"))


def recycling(spark: SparkSession, known: int = 20, injected: int = 10, fresh: int = 10, seed: int = SEED) -> DataFrame:
    """One row (injected, caught, catch_rate, false_alarms): known outputs fed back among fresh human-like texts.

    Fed back are `injected` of the known outputs, in seeded order; an overlap with any known output of a half catches a text.
    """
    outputs = make_dataset(spark, known, 1.0, 1, seed)
    back = outputs.orderBy(sampling.seeded(F.col("doc_id"), seed)).limit(injected).select("doc_id", "text", F.lit(True).alias("fed"))
    new = make_dataset(spark, fresh, 0.0, 2, seed).select((F.col("doc_id") + known).alias("doc_id"), "text", F.lit(False).alias("fed"))
    d = signals.with_signals(back.unionByName(new), references=outputs.select("text")).withColumn("caught", F.round("duplicate_similarity", 3) >= 0.5)
    fed, caught = F.count_if("fed"), F.count_if(F.col("fed") & F.col("caught"))
    return d.agg(fed.alias("injected"), caught.alias("caught"), F.coalesce(F.try_divide(caught, fed), F.lit(0.0)).alias("catch_rate"), F.count_if(~F.col("fed") & F.col("caught")).alias("false_alarms"))


def false_positives(spark: SparkSession, n: int = 100, seed: int = SEED) -> DataFrame:
    d = judged(make_dataset(spark, n, 0.0, 1, seed))
    return d.agg(F.count("*").alias("total"), F.count_if("is_synthetic").alias("flagged"), F.avg(F.col("is_synthetic").cast("int")).alias("rate"))
