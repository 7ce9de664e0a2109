"""`python -m lexivane.plans.demo` scores five stand-in corpora; `... demo --check` says whether the engine works here."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals, text as T
from ..operators.sampling import SEED, seeded
from ..sources import sinks
from .standins import Spec, make_datasets

#: Name, and (part, texts, contamination, generation) of its corpus.
SCENARIOS: tuple[tuple[str, Spec], ...] = (
    ("1 human texts", (1.0, 20, 0.0, 1)),
    ("2 a few synthetic", (2.0, 20, 0.15, 2)),
    ("3 mostly synthetic", (3.0, 20, 0.6, 2)),
    ("4 known outputs fed back", (4.0, 12, 0.0, 1)),
    ("5 fourth generation", (5.0, 20, 1.0, 4)),
)
#: Known outputs, and how many of them are fed back.
KNOWN, FED = (9.0, 15, 1.0, 1), 8
SNIPPET = 64


def scenarios(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """Scored rows (scenario, doc_id, text, ...) of all scenarios; the fourth is held against the known outputs."""
    names = F.create_map(*(F.lit(x) for name, spec in SCENARIOS for x in (spec[0], name)))
    d = make_datasets(spark, [spec for _, spec in SCENARIOS], seed).select(names[F.col("part")].alias("scenario"), "doc_id", "text")
    known = make_datasets(spark, [KNOWN], seed)
    back = known.orderBy(seeded(F.col("doc_id"), seed)).limit(FED).select(F.lit(SCENARIOS[3][0]).alias("scenario"), (F.col("doc_id") + 1000).alias("doc_id"), "text")
    fed = d.where(F.col("scenario") == SCENARIOS[3][0]).unionByName(back)
    return signals.score(d.where(F.col("scenario") != SCENARIOS[3][0])).unionByName(signals.score(fed, references=known.select("text")))


def check(spark: SparkSession) -> DataFrame:
    """Rows (component, ok): modules that import, and a score that is computed."""
    rows = []
    for name in ("functions.signals", "operators.corpus", "operators.classify", "plans.monitor", "plans.standins", "sources.readers", "streaming.health"):
        try:
            importlib.import_module(f"lexivane.{name}")
            rows.append((name, True))
        except ImportError:
            rows.append((name, False))
    score = signals.score(spark.createDataFrame([(0, "A short sentence. And one that is somewhat longer than it.")], "doc_id long, text string")).first()["synthetic_likelihood"]
    return spark.createDataFrame([*rows, ("score", 0 <= score <= 100)], "component string, ok boolean")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Prints each scenario's verdict and first texts, or the state of each component; 1 where one fails."""
    parser = argparse.ArgumentParser(prog="lexivane.plans.demo")
    parser.add_argument("--check", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexivane").getOrCreate()
    if args.check:
        found = check(spark)
        print(f"Python {sys.version.split()[0]}, Spark {spark.version}")
        print(sinks.table_text(found))
        return int(found.where("not ok").count() > 0)
    scored = scenarios(spark).cache()
    try:
        print(sinks.table_text(signals.verdict(scored, "scenario").orderBy("scenario")))
        first = scored.where(F.col("doc_id") % 20 < 3).orderBy("scenario", "doc_id")
        snippet = F.when(F.length("text") > SNIPPET, F.concat(F.substring("text", 1, SNIPPET), F.lit("..."))).otherwise(F.col("text"))
        print(sinks.table_text(first.select("scenario", "synthetic_likelihood", snippet.alias("text"), T.word_tokens("text")[0].alias("opens"))))
    finally:
        scored.unpersist()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
