import hashlib
import json
import math
import os
import re
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexivane.functions import signals
from lexivane.operators import classify, neural
from lexivane.plans import collapse, monitor, simulate, standins
from lexivane.sources import readers, sinks
from lexivane.streaming import health


def test_entry_and_registration(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "total", "predicted_synthetic", "estimated_contamination"] and df.count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_optional_subpackage(tmp_path, pipeline):
    """On a copy with the folders really gone, with and without the pipeline's file."""
    root = Path(entry.__file__).parent
    gone = shutil.ignore_patterns("llm", "__pycache__", ".git", *(() if pipeline else ("corpus_pipeline.py",)))
    shutil.copytree(root, tmp_path / "copy", ignore=gone)
    ask = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sum(n[:2] == 'op' or n == 'pipeline' for n in q), set(s) <= set(q))"
    got = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, check=True)
    n, llm, known = got.stdout.split()
    assert int(n) > 50 and llm == "0" and known == "True"


def test_compare_levels_and_skipped_metrics(spark):
    base = {"trigram_diversity": 0.8908, "bigram_diversity": 0.5641, "near_duplicate_rate": 0.0, "mean_burstiness": None}
    now = {"trigram_diversity": 0.7921, "bigram_diversity": 0.5112, "near_duplicate_rate": 0.9, "mean_burstiness": 0.4}
    got = monitor.compare(spark, base, now)
    assert got["status"] == "warning"
    assert [(a["metric"], a["change_pct"], a["level"]) for a in got["alerts"]] == [("trigram_diversity", -11.1, "warning"), ("bigram_diversity", -9.4, "warning")]
    assert monitor.compare(spark, {}, now) == {"status": "ok", "alerts": []}


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one \n\n \ntwo\n")
    assert [r["text"] for r in readers.load_corpus(spark, str(tmp_path / "a.txt")).orderBy("doc_ord").collect()] == ["one", "two"]
    (tmp_path / "b.jsonl").write_text('{"text": " x "}\n{"text": 4, "content": "y"}\nno json\n42\n\n{"body": " ", "response": "z"}\n["a"]\n')
    assert [r["text"] for r in readers.load_corpus(spark, str(tmp_path / "b.jsonl")).orderBy("doc_ord").collect()] == ["x", "y", "z"]
    folder = tmp_path / "docs"
    folder.mkdir()
    for name, text in (("b.md", "second\nfile"), ("a.txt", " first "), ("c.csv", "no"), ("d.txt", " ")):
        (folder / name).write_text(text)
    assert [r["text"] for r in readers.load_corpus(spark, str(folder)).orderBy("doc_ord").collect()] == ["first", "second\nfile"]


def test_cache_file_last_row_wins(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("a\t1.0\nbad\nb\tx\na\t2.5\nc\tnan\n")
    got = {r["h"]: r["f"] for r in readers.read_cache(spark, str(tmp_path / "c.tsv"), "f").collect()}
    assert got["a"] == 2.5 and "b" not in got


def test_append_cache_adds_only_new_keys(spark, tmp_path):
    path = str(tmp_path / "cache")
    for rows in ([("a", 1.0)], [("a", 9.0), ("b", 2.0)]):
        sinks.append_cache(spark.createDataFrame(rows, "h string, f double"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1.0), ("b", 2.0)]


def test_monitor_command_line(spark, tmp_path):
    (tmp_path / "docs.txt").write_text("\n".join(f"the cat {i} sat on mat {w}. it slept well" for i, w in enumerate("red blue green gray".split())))
    snap = tmp_path / "snap.json"
    assert monitor.main(["scan", str(tmp_path / "docs.txt"), "--out", str(snap), "--html", str(tmp_path / "r.html"), "--label", "<b>"], spark) == 0
    assert json.loads(snap.read_text())["n_docs"] == 4 and "<h1>Corpus report: &lt;b&gt;" in (tmp_path / "r.html").read_text()
    assert monitor.main(["compare", str(tmp_path / "docs.txt"), "--baseline", str(snap)], spark) == 0
    worse = json.loads(snap.read_text()) | {"trigram_diversity": 1.0, "type_token_ratio": 1.0}
    snap.write_text(json.dumps(worse))
    assert monitor.main(["compare", str(tmp_path / "docs.txt"), "--baseline", str(snap)], spark) == 2
    (tmp_path / "empty.txt").write_text("\n")
    assert monitor.main(["scan", str(tmp_path / "empty.txt")], spark) == 2


def test_experiments_have_the_expected_shape(spark):
    sweep = {round(r["level"], 1): r for r in simulate.contamination_sweep(spark).collect()}
    assert min(r["accuracy"] for r in sweep.values()) > 0.85 and sweep[0.0]["estimated"] < 0.1 < 0.9 < sweep[1.0]["estimated"]
    fed = simulate.recycling(spark).first()
    assert fed["injected"] == 10 and fed["catch_rate"] == 1.0 and fed["false_alarms"] == 0
    assert simulate.false_positives(spark).first()["rate"] < 0.05


def test_standins_are_shuffled_and_round_half_to_even(spark):
    rows = standins.make_datasets(spark, [(0.0, 25, 0.5, 1), (1.0, 10, 0.25, 2)]).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(35))
    first, second = [[r["label"] for r in rows if r["part"] == p] for p in (0.0, 1.0)]
    assert first.count("synthetic") == 12 and second.count("synthetic") == 2 and first != sorted(first) and first != sorted(first, reverse=True)
    assert all(r["text"].endswith(".") and 4 <= r["text"].count(". ") + 1 <= (7 if r["label"] == "synthetic" else 9) for r in rows)


def plain_text(corpus_texts, u, length):
    """A text of the trigram model in plain Python."""
    tables, starts = [{}, {}, {}], Counter()
    for t in corpus_texts:
        w = re.findall(r"[a-z']+|[.!?]", t.lower())
        if len(w) >= 2:
            starts[w[0], w[1]] += 1
        for n in (1, 2, 3):
            for k in range(len(w) - n + 1):
                tables[n - 1].setdefault(tuple(w[k : k + n - 1]), Counter())[w[k + n - 1]] += 1

    def pick(counts, x):
        upto, total = 0, sum(counts.values())
        for w, c in sorted(counts.items()):
            upto += c
            if upto >= x * total:
                return w

    out = list(pick(starts, u[0]))
    while len(out) < length:
        counts = tables[2].get(tuple(out[-2:])) or tables[1].get((out[-1],)) or tables[0][()]
        out.append(pick(counts, u[len(out) - 1]))
    return re.sub(r"\s+([.!?])", r"\1", " ".join(out))


def test_sampler_and_joins_draw_what_plain_python_draws(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars between 100 and 2000").limit(12).collect()]
    texts += ["dead end", "one", "", "dead end."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts, length = collapse.Counts.fit(df), 14
    u = {r["doc_id"]: r["u"] for r in collapse.draws(spark, 30, length, 5, 1).collect()}
    want = {i: plain_text(texts, x, length) for i, x in u.items()}
    assert {r["doc_id"]: r["text"] for r in collapse.sample_corpus(spark, counts, 30, length, 5, 1).collect()} == want
    few = {i: plain_text(texts, x, 5) for i, x in u.items() if i < 9}
    joined = collapse.joined_corpus(collapse.draws(spark, 9, length, 5, 1), counts, 5)
    assert {r["doc_id"]: r["text"] for r in joined.collect()} == few
    nothing = collapse.Counts.fit(df.where("doc_id < 0"))
    assert {r["text"] for r in collapse.sample_corpus(spark, nothing, 3, 4, 1, 1).collect()} == {""} == {r["text"] for r in collapse.joined_corpus(collapse.draws(spark, 3, 4, 1, 1), nothing, 4).collect()}


def test_collapse_loses_vocabulary_and_is_measured_as_by_hand(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000").select("doc_id", "text")
    made = collapse.generations(docs, 2, 40, 40)
    t = collapse.measure(made).orderBy("generation").collect()
    assert t[0]["vocab"] > t[1]["vocab"] > t[2]["vocab"] and t[1]["trigram_diversity"] <= 1
    for r in t:
        texts = [x["text"] for x in made.where(F.col("generation") == r["generation"]).orderBy("doc_id").collect()]
        words = [w for x in texts for w in re.findall(r"[a-z']+|[.!?]", x.lower()) if re.fullmatch("[a-z]+", w)]
        tri = list(zip(words, words[1:], words[2:]))
        assert (r["vocab"], r["ttr"], r["trigram_diversity"]) == (len(set(words)), pytest.approx(len(set(words)) / len(words)), pytest.approx(len(set(tri)) / len(tri)))
    state = str(tmp_path / "state")
    rows = collapse.scaling(docs, (20,), 1, (1, 2), 20, state).collect()
    monkeypatch.setattr(collapse, "recursive_collapse", lambda *a: pytest.fail("made anew"))
    assert collapse.scaling(docs, (20,), 1, (1, 2), 20, state).collect() == rows and len(rows) == 2


def test_logistic_regression_on_the_driver_and_on_executors(spark, monkeypatch):
    rows = [(float(i % 7), float(i % 5), 1.0, int(i % 7 + i % 3 > 4)) for i in range(200)]
    d = spark.createDataFrame(rows, "a double, b double, c double, y int")
    near = classify.LogisticRegression(epochs=5).fit(d, "y", "a", "b", "c")
    monkeypatch.setattr(classify, "DRIVER_ROWS", 0)
    far = classify.LogisticRegression(epochs=5).fit(d, "y", "a", "b", "c")
    assert near.weights == pytest.approx(far.weights, abs=1e-9) and near.weights[2] == 0
    assert d.select(near.predict().alias("p")).where("p < 0 or p > 1").count() == 0


def test_neural_scorer_interface(spark):
    score = neural.scorer(lambda: lambda texts: [float(len(t)) if t else float("nan") for t in texts])
    d = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "doc_id long, text string").select("doc_id", score(F.col("text")).alias("v"))
    assert {r["doc_id"]: r["v"] for r in d.where("not isnan(v)").collect()} == {1: 2.0}


def _texts(spark, groups, n=14, seed=3):
    """Labelled texts with signals: positives (1) repeat themselves, in `groups`; negatives don't."""
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows = [(k, " ".join(rng.choice(words, 30)) + ". " + " ".join(rng.choice(words, 9)) + ".", 0, None) for k in range(60)]
    for j, g in enumerate(groups):
        for k in range(n):
            few = rng.choice(words, 4 + j)
            rows.append((100 + 100 * j + k, " ".join(rng.choice(few, 30)) + ". " + " ".join(rng.choice(few, 9)) + ".", 1, g))
    d = spark.createDataFrame(rows, "doc_id long, text string, y int, g string")
    return signals.with_signals(d)


def test_folds_take_every_group_and_find_planted_separation(spark):
    d = _texts(spark, [f"g{k:02}" for k in range(22)], n=3)
    folds = classify.leave_one_group_out(d, "y", "g").collect()
    assert sorted(r["held_out"] for r in folds) == [f"g{k:02}" for k in range(22)]
    assert all(r["n_test"] == 10 + 3 and r["classifier_auc"] == 1.0 and r["probe_auc"] > 0.9 for r in folds)


def test_one_fold_by_hand(spark):
    """Language model, descent and AUC of one fold against plain Python and numpy."""
    d = _texts(spark, ["a", "b"])
    rows = d.collect()
    neg = sorted((r for r in rows if not r["y"]), key=lambda r: hashlib.md5(f"1234:{r['doc_id']}".encode()).hexdigest())
    train = [r for r in rows if r["g"] == "b"] + neg[:50]
    test = [r for r in rows if r["g"] == "a"] + neg[50:]
    pad = lambda t: ["<s>", *re.findall("[a-z']+", t.lower()), "</s>"]
    pairs, first, vocabulary = Counter(), Counter(), set()
    for r in train:
        w = pad(r["text"])
        pairs.update(zip(w, w[1:]))
        first.update(w)
        vocabulary.update(w)

    def row(r):
        w = pad(r["text"])
        bits = [-math.log2((pairs[p] + 0.5) / (first[p[0]] + 0.5 * len(vocabulary))) for p in zip(w, w[1:])]
        return [*(r[s] for s in signals.SIGNALS), round(sum(bits) / len(bits), 9)]

    x, y = np.array([row(r) for r in train]), np.array([r["y"] for r in train])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale <= 1e-9] = 1
    z, w, b = (x - mean) / scale, np.zeros(7), 0.0
    for _ in range(300):
        e = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - 0.5 * (z.T @ e / len(z) + 1e-3 * w), b - 0.5 * e.mean()
    p = 1 / (1 + np.exp(-((np.array([row(r) for r in test]) - mean) / scale @ w + b)))
    wins = [(i > j) + (i == j) / 2 for i, r in zip(p.round(9), test) if r["y"] for j, s in zip(p.round(9), test) if not s["y"]]
    got = classify.leave_one_group_out(d, "y", "g").where("held_out = 'a'").first()
    assert got["classifier_auc"] == pytest.approx(np.mean(wins)) and got["n_test"] == len(test)
    assert [got[f"coef_{f}"] for f in classify.FEATURES] == pytest.approx(np.abs(w), abs=1e-8)


def test_seeds_resume_from_what_is_kept(spark, tmp_path, monkeypatch):
    d, state = _texts(spark, ["a", "b"]), str(tmp_path / "state")
    both = classify.seed_means(d, "y", "g", (1234, 7), state=state).collect()
    monkeypatch.setattr(classify, "leave_one_group_out", lambda *a, **k: pytest.fail("made anew"))
    again = classify.seed_means(d, "y", "g", (1234, 7), state=state)
    assert [tuple(r) for r in again.collect()] == [tuple(r) for r in both]
    assert classify.seed_comparison(again).first()["n"] == 2


def test_pooled_row_is_an_evaluation_of_its_own(spark):
    rows = {r["model"]: r for r in classify.cross_group(_texts(spark, ["a", "b", "c"]), "y", "g").collect()}
    assert set(rows) == {"a", "b", "c", "POOLED"} and rows["POOLED"]["n_machine"] == 42 and rows["a"]["n_machine"] == 14
    assert rows["a"]["n_test"] == 2 * (14 - 8) and all(r["probe_auc"] > 0.9 for r in rows.values())


def test_features_refuse_to_overwrite(spark):
    with pytest.raises(ValueError, match="_tokens"):
        signals.with_signals(spark.sql("select 1 as doc_id, 'a' as text, 'mine' as _tokens"))
    kept = signals.with_signals(spark.sql("select 1 as doc_id, 'a b' as text, 'mine' as toks, 'x' as lens")).first()
    assert (kept["toks"], kept["lens"]) == ("mine", "x")


def test_demo_and_its_check(spark, capsys):
    from lexivane.plans import demo

    assert demo.main([], spark) == 0 and demo.main(["--check"], spark) == 0
    out = capsys.readouterr().out
    assert all(name in out for name, _ in demo.SCENARIOS) and "operators.corpus" in out
    share = {r["scenario"][0]: r["estimated_contamination"] for r in signals.verdict(demo.scenarios(spark), "scenario").collect()}
    assert share["1"] <= 0.1 and share["5"] == 1.0 and share["2"] < share["3"] and share["4"] >= 0.35


def test_lines_answers_and_state(spark, tmp_path):
    path = str(tmp_path / "lines")
    sinks.write_lines(spark.createDataFrame([(1, "a\n b"), (2, None)], "doc_id long, text string"), path)
    assert [r["text"] for r in readers.read_lines(spark, path).collect()] == ["a b"]
    (tmp_path / "qa.jsonl").write_text("\n".join(json.dumps({"human_answers": [f"h{k} " * 300, "too short"], "chatgpt_answers": None if k % 2 else [f"m{k} " * 70]}) for k in range(6)))
    got = readers.read_answers(spark, str(tmp_path / "qa.jsonl")).collect()
    assert sorted(r["label"] for r in got) == [0, 0, 0, 1, 1, 1] and {len(r["text"].split()) for r in got if not r["label"]} == {250}
    state = str(tmp_path / "state")
    assert sinks.read_state(spark, state, "a int").count() == 0
    sinks.append_state(spark.createDataFrame([(1,)], "a int"), state, step=1)
    sinks.append_state(spark.createDataFrame([(2,)], "a int"), state, step=2)
    assert sorted(tuple(r) for r in sinks.read_state(spark, state, "a int, step int").collect()) == [(1, 1), (2, 2)]


def test_generations_are_pruned_and_paged(spark, tmp_path):
    path = str(tmp_path / "g")
    d = spark.range(40).select(F.col("id").alias("row_id"), F.when(F.col("id") < 30, "m1").otherwise("m2").alias("generator"), F.repeat(F.lit("word "), 70).alias("generation"))
    sinks.write_generations(d, path)
    sinks.write_generations(d.where("generator = 'm1'"), path)
    one = readers.read_generations(spark, path, "m2", F.col("row_id") > 32)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(generator" in plan and "GreaterThan(row_id,32)" in plan
    assert [r["row_id"] for r in readers.page(one, "row_id", 2, 3).collect()] == [35, 36, 37]
    assert readers.read_generations(spark, path, "m1").count() == 30
    assert [r["row_id"] for r in readers.collect_generations(d).collect()] == [0]


def test_unusable_features_and_prefixes(spark):
    from lexivane.operators import caches

    d = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "doc_id long, f double")
    assert [r["doc_id"] for r in caches.usable(d, "f").collect()] == [1]
    same = spark.createDataFrame([(3, "x" * 90 + "a"), (1, "x" * 90 + "b"), (2, "y"), (4, None), (5, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in caches.first_by_prefix(same, "text", "doc_id").collect()) == [1, 2, 4]


def test_rank_scorer(spark):
    score = neural.rank_scorer(neural.unigram_ranks([("a", 3), ("b", 1), ("c", 1)]))
    d = spark.createDataFrame([(1, "A a b"), (2, ""), (3, "zzz")], "doc_id long, text string").select("doc_id", score(F.col("text")).alias("x"))
    got = {r["doc_id"]: tuple(r["x"]) for r in d.collect()}
    assert got[1] == (pytest.approx((2 * math.log(4 / 8) + math.log(2 / 8)) / 3), 1.0) and got[3] == (pytest.approx(math.log(1 / 8)), 1.0)
    assert all(map(math.isnan, got[2]))


def test_late_rows_are_dropped_and_batches_are_scored(spark, tmp_path):
    """A row over an hour behind the watermark does not count; one within it does. Each batch is scored once."""
    src = tmp_path / "in"
    src.mkdir()
    stream = health.windowed_health(spark.readStream.schema("ts timestamp, text string").option("maxFilesPerTrigger", 1).parquet(str(src)), every="1 hour")
    for k, (at, text) in enumerate([("10:10", "first"), ("12:30", "second"), ("11:40", "late but in time"), ("10:20", "much too late"), ("15:00", "third")]):
        spark.sql(f"select timestamp'2024-01-01 {at}:00' as ts, '{text}' as text").coalesce(1).write.mode("append").parquet(str(src))
        part = max(src.glob("*.parquet"), key=os.path.getmtime)
        os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
    q = stream.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {str(r["start"])[11:13]: r["n_docs"] for r in spark.table("late").collect()}
    assert got == {"10": 1, "11": 1, "12": 1}
    seen = []
    act = lambda df, k: seen.extend((k, r["text"], r["synthetic_likelihood"] >= 0) for r in df.collect())
    for _ in range(2):
        health.on_batch(spark.readStream.schema("ts timestamp, text string").parquet(str(src)), act, str(tmp_path / "ck2")).awaitTermination(180)
    assert sorted(t for _, t, ok in seen if ok) == sorted(["first", "second", "much too late", "late but in time", "third"])


def test_streaming_health(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 'one two. three' as text union all select timestamp'2024-01-01 11:00:00', 'one' union all select timestamp'2024-01-02 10:00:00', ''").write.parquet(src)
    stream = health.windowed_health(spark.readStream.schema("ts timestamp, text string").parquet(src))
    q = stream.writeStream.format("memory").queryName("health").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {str(r["start"])[:10]: (r["n_docs"], r["n_tokens"], r["vocab"]) for r in spark.table("health").collect()}
    assert got == {"2024-01-01": (2, 4, 3), "2024-01-02": (1, 0, 0)}
