"""Small cases of what the second round of findings is about."""

import math
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivane.functions import signals
from lexivane.operators import classify, corpus, lm, neural, similarity
from lexivane.plans import collapse
from lexivane.sources import readers, sinks


def test_a_large_model_is_drawn_from_in_blocks_without_the_driver(spark, sf, monkeypatch):
    """joins by blocks of texts give what the driver's sampler gives."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars between 100 and 2000").limit(12).collect()]
    df = spark.createDataFrame(list(enumerate([*texts, "dead end", "one", "", "dead end."])), "doc_id long, text string")
    counts = collapse.Counts.fit(df)
    rows = lambda: {r["doc_id"]: r["text"] for r in collapse.sample_corpus(spark, counts, 30, 9, 5, 1).collect()}
    want = rows()
    monkeypatch.setattr(collapse, "MODEL_BYTES", 0)
    monkeypatch.setattr(collapse, "BLOCK", 11)
    monkeypatch.setattr(collapse, "Sampler", lambda *a: pytest.fail("the driver takes the model"))
    assert rows() == want and len(want) == 30
    table = collapse.followers(counts, 3)
    assert table.columns == ["h", "w", "low", "upto", "total"] and table.where(F.col("low") >= F.col("upto")).isEmpty()


def test_scores_round_as_doubles(spark):
    """1.035 * 100 is just under 103.5, so SQL rounds to 1.03; the shortest decimal would give 1.04."""
    fixed = {c: 1.0 if c in signals.INVERTED else 0.0 for c in signals.SIGNALS} | {"filler_density": 0.05175}
    assert spark.range(1).select(*(F.lit(v).alias(c) for c, v in fixed.items())).select(signals.combine()).first()[0] == 1.03


def test_cache_of_many_files_is_read_in_the_order_of_their_names(spark, tmp_path):
    """Spark reads the larger file first; the last row still holds."""
    (tmp_path / "part-0.txt").write_text("a\t1.0\n" + "".join(f"x{k}\t0.5\n" for k in range(5000)))
    (tmp_path / "part-1.txt").write_text("a\t2.0\n")
    for most in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            got = {r["h"]: r["f"] for r in readers.read_cache(spark, str(tmp_path), "f").collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got["a"] == 2.0 and len(got) == 5001


def test_a_large_generator_is_written_by_several_tasks(spark, tmp_path):
    """F11"""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        d = spark.range(0, 20000, 1, 8).select("id", F.md5(F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 19990, "a").otherwise("b").alias("generator"))
        sinks.write_generations(d, str(tmp_path / "g"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list(Path(tmp_path / "g/generator=a").glob("*.parquet"))) > 1
    assert readers.read_generations(spark, str(tmp_path / "g"), "a").count() == 19990


def test_standardised_columns_are_computed_once(spark):
    """F21"""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def x(i):
        seen.add(1)
        return float(i)

    rows = classify.standardise(spark.range(50).select(x("id").alias("x")), "x").collect()
    assert seen.value == 50 and sum(r["x"] for r in rows) == pytest.approx(0)


def test_ranks_turn_few_texts_into_strings_at_once(monkeypatch):
    """F23"""
    sizes = []
    real = neural._slices
    monkeypatch.setattr(neural, "_slices", lambda t, n: (sizes.append(len(x)) or x for x in real(t, n)))
    assert [x for s in neural._slices(pa.array(["a", None, "c"] * 7), 8) for x in s] == ["a", "", "c"] * 7 and max(sizes) == 8


def test_near_duplicates_order_ids_only(spark, sf):
    """no text is shuffled to be ranked, and the pairs are those of all documents in order."""
    d = spark.createDataFrame([(k, f"one two three four five six {'x' * (k // 2)}") for k in range(10)], "doc_id long, text string")
    toks = [set(zip(*(re.findall("[a-z]+", f"one two three four five six {'x' * (k // 2)}")[j:] for j in range(5)))) for k in range(10)]
    got = similarity.near_duplicate_pairs(d).collect()
    assert got and all(r["jaccard"] == pytest.approx(len(toks[r["a"]] & toks[r["b"]]) / len(toks[r["a"]] | toks[r["b"]])) for r in got)


def test_folds_descend_together(spark, monkeypatch):
    """One job a step for all large folds, and the weights that the driver finds."""
    rows = [("ab"[i % 2], float(i % 7), float("nan") if i % 50 == 3 else float(i % 5), int(i % 7 + i % 3 > 4)) for i in range(300)]
    d = spark.createDataFrame(rows, "f string, a double, b double, y int").repartition(3)
    near = classify.fit_folds(d, "y", "f", ["a", "b", "none"], "a", "b")
    monkeypatch.setattr(classify, "DRIVER_ROWS", 0)
    spark.sparkContext.setJobGroup("descent", "")
    far = classify.fit_folds(d, "y", "f", ["a", "b", "none"], "a", "b")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("descent"))
    assert jobs <= 300 + 20
    for f in ("a", "b"):
        assert near[f].weights == pytest.approx(far[f].weights, abs=1e-9) and near[f].bias == pytest.approx(far[f].bias) and any(near[f].weights)
    assert not any(far["none"].weights)


def test_checkpointed_tokens_come_back(spark):
    """texts without tokens have none, not an empty one."""
    d = spark.createDataFrame([(1, "A b. c'd"), (2, ""), (3, None), (4, "é 1")], "doc_id long, text string")
    got = {r["o"]: r["toks"] for r in corpus.tokenised(d).collect()}
    assert got == {1: ["a", "b", "c'd"], 2: [], 3: [], 4: []}
    assert dict(corpus.unpacked(spark.createDataFrame([("a b",)], "t string"), "t").dtypes)["t"] == "array<string>"


def test_a_corpus_and_a_part_of_it_are_counted_together(spark):
    """as if each were counted by itself; n-grams across borders belong to their own sequence."""
    rows = [(1, "a b c", "en"), (2, "b", "de"), (3, "c a b c d", "en"), (4, "", "en"), (5, "a b c", None), (6, "d a", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["n"]: (r["whole"], r["some"]) for r in corpus.nested_diversities(corpus.tokenised(d.withColumn("e", F.expr("lang = 'en'")), part="e"), 2, 3).collect()}
    for n in (2, 3):
        want = tuple(corpus.ngram_diversity(x, n).first()["diversity"] for x in (d, d.where("lang = 'en'")))
        assert got[n] == pytest.approx(want)
    none = corpus.tokenised(d.where("doc_id < 0").withColumn("e", F.lit(True)), part="e")
    assert [tuple(r) for r in corpus.nested_diversities(none, 2).collect()] == [(2, 0.0, 0.0)]


def _mean_bits(train, text):
    """Plain Python of an add-half bigram model's mean bits."""
    pad = lambda s: ["<s>", *re.findall("[a-z']+", (s or "").lower()), "</s>"]
    pairs, first = Counter(), Counter()
    for s in train:
        pairs.update(zip(pad(s), pad(s)[1:]))
        first.update(pad(s)[:-1])
    size = max(1, len(first) + bool(first))
    return sum(-math.log2((pairs[p] + 0.5) / (first[p[0]] + 0.5 * size)) for p in zip(pad(text), pad(text)[1:])) / (len(pad(text)) - 1)


@pytest.mark.parametrize("common", [0, 10, 10**6])
def test_pairs_travel_once_and_as_hashes(spark, monkeypatch, common):
    """bits of several models at once, with all, some and no first words broadcast; no exchange has the words of a pair."""
    monkeypatch.setattr(lm, "COMMON", common)
    texts = ["a b a b c", "The b the b", "z", "", None, "a b c d e f g a b", "b b b b b b", "it's a b"]
    rows = [(i, s, (i % 2) + 2 * (i < 3), 1 + 2 * (i > 0)) for i, s in enumerate(texts)]
    d = spark.createDataFrame(rows, "id long, text string, fits int, asks int").repartition(3)
    found = lm.mean_bits(d, 3)
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == len(texts)
    for i, s, _, asks in rows:
        for j in range(3):
            want = _mean_bits([s for _, s, fits, _ in rows if fits >> j & 1], s) if asks >> j & 1 else None
            assert got[i][f"b{j}"] == pytest.approx(want)
    part = lm.part_entropy(d, F.expr("id < 3"), "id")
    assert {r["id"]: r["bits"] for r in part.collect()} == pytest.approx({i: _mean_bits(texts[:3], s) for i, s in enumerate(texts)})
    model = lm.BigramModel.fit(d.where("id < 3")).cross_entropy(d, "id")
    assert {r["id"]: r["bits"] for r in model.collect()} == pytest.approx({i: _mean_bits(texts[:3], s) for i, s in enumerate(texts)})
    plan = part._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and not re.search(r"Aggregate \[[^\]]*\ba#\d+, b#\d+", plan)


def test_entropy_queries_use_that_step(spark, sf, monkeypatch):
    """F12, F13"""
    from lexivane import registry

    monkeypatch.setattr(lm, "transitions", lambda *a, **k: pytest.fail("pairs as words"))
    for name in ("cross_entropy", "perplexity_auc"):
        assert registry.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("most", [60, 2])
def test_cross_group_reads_chosen_texts_only(spark, monkeypatch, most):
    """F16: signals and transitions of the texts that the balanced folds hold, in one pass for all folds, or few at a time."""
    monkeypatch.setattr(lm, "MODELS", most)
    monkeypatch.setattr(classify, "transitions", lambda *a, **k: pytest.fail("transitions of all texts"))
    words = ["red", "blue", "green", "old"]
    rows = [(i, " ".join(words[(i * k) % 4] for k in range(1, 6 + i % 3)) + ".", int(i % 6 == 0), "xyz"[i % 18 // 6]) for i in range(72)]
    d = spark.createDataFrame(rows, "doc_id long, text string, y int, g string")
    seen = []
    real = lm.mean_bits
    monkeypatch.setattr(lm, "mean_bits", lambda t, *a: seen.append(t.count()) or real(t, *a))
    got = {r["model"]: tuple(r) for r in classify.cross_group(d, "y", "g").collect()}
    assert set(got) == {"x", "y", "z", "POOLED"} and len(seen) == -(-4 // most) and max(seen) <= 24
    assert {r["model"]: tuple(r) for r in classify.cross_group(signals.with_signals(d), "y", "g").collect()} == got
    members = spark.createDataFrame([("x", i, i < 40) for i in range(60)] + [("y", i, i >= 30) for i in range(20, 60)], "fold string, id long, fits boolean")
    bits = {(r["fold"], r["id"]): r["perplexity"] for r in classify.fold_bits(d.select(F.col("doc_id").alias("id"), "text"), members, ["x", "y"]).collect()}
    text = {i: s for i, s, _, _ in rows}
    assert len(bits) == 100
    for f, train in (("x", range(40)), ("y", range(30, 60))):
        for i in range(20, 60, 7):
            assert bits[f, i] == pytest.approx(_mean_bits([text[j] for j in train], text[i]), abs=1e-8)
    assert classify.fold_bits(d.select(F.col("doc_id").alias("id"), "text"), members, []).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_ngrams_travel_in_pieces(spark, n):
    """counts as in plain Python; from three words on, fewer pieces than n-grams are sent, and none is counted before."""
    texts = ["The quick brown fox jumps. The quick brown dog!", "a b c a b c a b c", "of the a of the a of the", "extraordinary " * 9, "one two", "", None, "é x? y"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    toks = [re.findall(r"[a-z']+|[.!?]", (s or "").lower()) for s in texts]
    want = Counter(" ".join(t[i : i + n]) for t in toks for i in range(len(t) - n + 1))
    found = lm.gram_counts(d, n)
    assert found.columns == ["g", "c"] and {r["g"]: r["c"] for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    before = plan.split("Exchange", 1)[1] if "Exchange" in plan else plan.split("Repartition", 1)[-1]
    assert n < 3 or "HashAggregate" not in before
