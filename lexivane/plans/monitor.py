"""Drift monitor: compare a snapshot with a stored baseline, report, and exit with a code that CI understands."""

from __future__ import annotations

import argparse
import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from ..sources import readers

#: Metric, percent that warns, percent that is critical, and whether a rise (1) or a drop (-1) is bad.
THRESHOLDS = (
    ("trigram_diversity", 5.0, 15.0, -1),
    ("bigram_diversity", 5.0, 15.0, -1),
    ("vocab_per_10k_tokens", 8.0, 20.0, -1),
    ("type_token_ratio", 8.0, 20.0, -1),
    ("mean_burstiness", 10.0, 25.0, -1),
    ("near_duplicate_rate", 50.0, 150.0, 1),
    ("mean_synthetic_score", 25.0, 60.0, 1),
    ("flagged_synthetic_pct", 50.0, 150.0, 1),
)
LEVELS = ("ok", "warning", "critical")
METRIC_SCHEMA = "metric string, value double"


def metrics_frame(spark: SparkSession, snapshot: dict) -> DataFrame:
    """A snapshot's watched metrics as rows (metric, value); missing ones are null."""
    return spark.createDataFrame([(m, None if snapshot.get(m) is None else float(snapshot[m])) for m, *_ in THRESHOLDS], METRIC_SCHEMA)


def alerts(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Rows (metric, baseline, current, change_pct, level). Metrics that are missing, or 0 in the baseline, are left out."""
    spark = baseline.sparkSession
    limits = spark.createDataFrame(list(THRESHOLDS), "metric string, warn double, crit double, direction int")
    b = baseline.select("metric", F.col("value").alias("baseline")).where("baseline <> 0")
    c = current.select("metric", F.col("value").alias("current")).where("current is not null")
    change = 100.0 * (F.col("current") - F.col("baseline")) / F.abs("baseline")
    d = limits.join(b, "metric").join(c, "metric").withColumn("change_pct", change)
    bad = F.col("change_pct") * F.col("direction")
    level = F.when(bad >= F.col("crit"), "critical").when(bad >= F.col("warn"), "warning").otherwise("ok")
    return d.select("metric", "baseline", "current", "change_pct", level.alias("level"))


def status(alert_rows: DataFrame) -> DataFrame:
    """One row: the worst level, ok without alerts."""
    rank = F.array_position(F.lit(list(LEVELS)), F.col("level"))
    return alert_rows.agg(F.element_at(F.lit(list(LEVELS)), F.coalesce(F.max(rank), F.lit(1)).cast("int")).alias("status"))


def compare(spark: SparkSession, baseline: dict, current: dict) -> dict:
    """{status, alerts}, alerts in the order of the thresholds and change_pct rounded to one place."""
    rows = {r["metric"]: r.asDict() for r in alerts(metrics_frame(spark, baseline), metrics_frame(spark, current)).collect()}
    found = [rows[m] | {"change_pct": round(rows[m]["change_pct"], 1)} for m, *_ in THRESHOLDS if m in rows]
    return {"status": max((a["level"] for a in found), key=LEVELS.index, default="ok"), "alerts": found}


def html_report(current: dict, baseline: dict | None = None, result: dict | None = None) -> str:
    """The snapshot, and its comparison if there is one, as a page. Everything that comes from data is escaped."""
    esc = lambda x: html.escape(str(x))
    by = {a["metric"]: a for a in (result or {}).get("alerts", ())}
    rows = []
    for metric, value in current.items():
        if isinstance(value, list) or metric in ("version", "label"):
            continue
        a = by.get(metric)
        change = f"{a['change_pct']:+.1f}% ({a['level']})" if a else "&ndash;"
        rows.append(f"<tr class='{a['level'] if a else ''}'><td>{esc(metric)}</td><td>{esc((baseline or {}).get(metric, ''))}</td><td>{esc(value)}</td><td>{change}</td></tr>")
    most = max(current["score_histogram"], default=0) or 1
    bars = "".join(f"<div title='{10 * k}-{10 * k + 10}' style='display:inline-block;width:9%;background:#468;height:{round(100 * n / most)}px'></div>" for k, n in enumerate(current["score_histogram"]))
    grams = "".join(f"<li>{esc(g)}</li>" for g in current["top_repeated_5grams"])
    head = f"<h1>Corpus report: {esc(current['label'])}</h1>" + (f"<p>Status: <b>{esc(result['status'])}</b></p>" if result else "")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{esc(current['label'])}</title></head><body>{head}<table><tr><th>metric</th><th>baseline</th><th>current</th><th>change</th></tr>{''.join(rows)}</table><h2>Scores</h2>{bars}<h2>Repeated 5-grams</h2><ul>{grams}</ul></body></html>"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """`scan PATH` writes a snapshot; `compare PATH --baseline FILE` exits 0 (ok), 1 (warning) or 2 (critical, or no documents)."""
    parser = argparse.ArgumentParser(prog="lexivane")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "compare"):
        p = commands.add_parser(name)
        p.add_argument("path")
        p.add_argument("--label")
        p.add_argument("--out")
        p.add_argument("--html")
        if name == "compare":
            p.add_argument("--baseline", required=True)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexivane").getOrCreate()
    docs = readers.load_corpus(spark, args.path)
    if docs.isEmpty():
        print("no documents found")
        return 2
    current = corpus.snapshot(docs, args.label or args.path, "doc_ord")
    baseline = result = None
    if args.command == "compare":
        with open(args.baseline, encoding="utf-8") as f:
            baseline = json.load(f)
        result = compare(spark, baseline, current)
        print(json.dumps(result, indent=2))
    if args.out or args.command == "scan":
        text = json.dumps(current, indent=2)
        if args.out:
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
    if args.html:
        with open(args.html, "w", encoding="utf-8") as f:
            f.write(html_report(current, baseline, result))
    return LEVELS.index(result["status"]) if result else 0


if __name__ == "__main__":
    raise SystemExit(main())
