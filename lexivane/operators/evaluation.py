"""Detector quality: ranks, ROC, best F1, confusion, calibration and ablation, over scores aggregated first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import fresh
from ..functions.signals import SIGNALS, combine
from .prefix import running_totals

ROC_POINTS = 60


def score_counts(df: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """Rows (by, score, pos, neg): what most evaluations need, one row for each distinct score."""
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def average_ranks(df: DataFrame, score: str) -> DataFrame:
    """`df` plus `avg_rank`: 1-based ranks by score, ties share their mean."""
    value, n, upto, rank = fresh(df, "value", "n", "upto", "avg_rank")
    sizes = df.groupBy(F.col(score).alias(value)).agg(F.count("*").alias(n))
    ranks = running_totals(sizes, [F.col(value)], {upto: F.col(n)}).select(value, (F.col(upto) - (F.col(n) - 1) / 2.0).alias(rank))
    kept = [c for c in df.columns if c.lower() != "avg_rank"]
    return df.join(ranks, df[score].eqNullSafe(ranks[value])).select(*kept, F.col(rank).alias("avg_rank"))


def roc_auc(df: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """Rows (by, n_pos, n_neg, auc): rank AUC with average ranks for ties, 0.5 where one class is missing."""
    c = running_totals(score_counts(df, score, label, *by), [F.col("score")], {"below": F.col("neg")}, *by)
    # Pairs in which the positive wins, ties counting half.
    wins = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2.0))
    d = c.groupBy(*by).agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"), wins.alias("__w"))
    return d.select(*by, "n_pos", "n_neg", F.coalesce(F.try_divide(F.col("__w"), F.col("n_pos") * F.col("n_neg")), F.lit(0.5)).alias("auc"))


def directed_auc(df: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    return roc_auc(df, score, label, *by).withColumn("auc", F.greatest("auc", 1 - F.col("auc")))


def roc_points(df: DataFrame, score: str, label: str, order: str, most: int = ROC_POINTS) -> DataFrame:
    """Rows (point, fpr, tpr), one for each row from the highest score down (ties in `order`), thinned to `most` and the last."""
    d = df.select(F.col(score).cast("double").alias("s"), (F.col(label) == 1).cast("int").alias("y"), F.col(order).alias("o"))
    d = running_totals(d, [-F.col("s"), F.col("o")], {"k": F.lit(1), "tp": F.col("y"), "fp": 1 - F.col("y")})
    ends = d.agg(F.max("k").alias("n"), F.max("tp").alias("p"), F.max("fp").alias("q"))
    spark = df.sparkSession
    start = spark.sql("select 0L as k, 0L as tp, 0L as fp")
    pts = start.union(d.select("k", "tp", "fp")).join(F.broadcast(ends))  # one row of totals
    size = F.col("n") + 1
    wanted = spark.range(most).select(F.col("id").alias("i")).join(F.broadcast(ends)).where(size > most)
    wanted = wanted.select("i", F.floor(F.col("i") * (size / most)).alias("k")).union(ends.where(size > most).select(F.lit(most).cast("long"), "n"))
    thin = pts.join(wanted, "k").select("i", "fp", "tp", "p", "q")
    whole = pts.where(size <= most).select(F.col("k").alias("i"), "fp", "tp", "p", "q")
    return thin.union(whole).select(F.col("i").alias("point"), F.round(F.try_divide("fp", "q"), 4).alias("fpr"), F.round(F.try_divide("tp", "p"), 4).alias("tpr"))


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall and F1, 0 over nothing."""
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = zero(tp, tp + fp), zero(tp, tp + fn)
    return {"accuracy": zero(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "f1": zero(2 * precision * recall, precision + recall)}


def best_f1(df: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """Rows (by, threshold, rates): the lowest threshold with the largest F1, and the rates there. One sweep over distinct scores."""
    c = running_totals(score_counts(df, score, label, *by), [-F.col("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, *by)
    ends = c.groupBy(*by).agg(F.max("tp").alias("p"), F.max("fp").alias("q"))
    d = c.join(ends, list(by)) if by else c.join(F.broadcast(ends))  # one row
    d = d.withColumn("fn", F.col("p") - F.col("tp")).withColumn("tn", F.col("q") - F.col("fp"))
    d = d.select(*by, "score", *(v.alias(k) for k, v in rates(*(F.col(x) for x in ("tp", "fp", "fn", "tn"))).items()))
    rows = F.struct(*(c for c in d.columns if c not in by))
    best = d.groupBy(*by).agg(F.max_by(rows, F.struct("f1", (-F.col("score")).alias("m"))).alias("x"))
    return best.select(*by, F.col("x.score").alias("threshold"), "x.accuracy", "x.precision", "x.recall", "x.f1")


def confusion(df: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    tp, fp, fn, tn = F.count_if(predicted & actual), F.count_if(predicted & ~actual), F.count_if(~predicted & actual), F.count_if(~predicted & ~actual)
    d = df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    return d.select("*", *(v.alias(k) for k, v in rates(*(F.col(x) for x in ("tp", "fp", "fn", "tn"))).items()))


def ablation(signals: DataFrame, label: str) -> DataFrame:
    """Rows (signal, leave_one_out_auc, delta_auc, solo_auc), largest delta first; all score variants in one pass."""
    variants = {"full": combine()} | {f"without {s}": combine([s]) for s in SIGNALS} | {f"only {s}": combine([x for x in SIGNALS if x != s]) for s in SIGNALS}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("score")) for k, v in variants.items())))
    auc = roc_auc(signals.select(label, each.alias("x")).select(label, "x.*"), "score", label, "variant")
    row = auc.groupBy().pivot("variant", list(variants)).agg(F.first("auc"))
    cols = F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(s).alias("signal"), F.col(f"without {s}").alias("leave_one_out_auc"), (F.col("full") - F.col(f"without {s}")).alias("delta_auc"), F.col(f"only {s}").alias("solo_auc")) for k, s in enumerate(SIGNALS))))
    return row.select(cols.alias("x")).select("x.*").orderBy(F.desc("delta_auc"), "ord").drop("ord")


def evaluate_method(train: DataFrame | None, test: DataFrame, score: str, label: str, name: str) -> DataFrame:
    """One row (name, auc, sign_flipped, threshold, rates). With `train`, the sign turns if the train AUC is under 0.5."""
    flipped = train is not None and roc_auc(train, score, label).first()["auc"] < 0.5
    d = test.withColumn(score, -F.col(score)) if flipped else test
    return roc_auc(d, score, label).join(F.broadcast(best_f1(d, score, label))).select(F.lit(name).alias("name"), "auc", F.lit(flipped).alias("sign_flipped"), "threshold", "accuracy", "precision", "recall", "f1")


def separation(df: DataFrame, score: str, is_synthetic: Column) -> DataFrame:
    """One row: difference of the class means; a missing class counts 0."""
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col(score))), F.lit(0.0))
    return df.agg((mean(is_synthetic) - mean(~is_synthetic)).alias("separation"))
