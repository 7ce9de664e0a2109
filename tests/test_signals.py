import itertools

import pytest
from pyspark.sql import functions as F

from lexivane.functions import signals as S
from lexivane.functions import text as T
from lexivane.operators import caches, corpus, evaluation, lm, prefix, sampling, similarity, stats


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, expression, text):
    return docs(spark, text).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "score"), [("", 47.0), ("hello", 31.0), ("Overall.", 51.0), ("a b c a b c", 36.0), (None, 47.0)])
def test_scores_of_short_texts(spark, text, score):
    r = S.score(docs(spark, text)).first()
    assert r["synthetic_likelihood"] == pytest.approx(score) and r["is_synthetic"] == (score >= 50)


def test_tokens_and_sentences(spark):
    assert one(spark, T.word_tokens("text"), "Don't STOP 42!") == ["don't", "stop"]
    assert one(spark, T.alpha_tokens("text"), "Don't STOP 42!") == ["stop"]
    assert one(spark, T.sentence_lengths("text"), "a b. c d e f.") == [2, 4]
    d = docs(spark, "a b. c d e f.", "one sentence").select("doc_id", T.sentence_lengths("text").alias("lens")).select(S.variation("lens").alias("v"))
    assert [r["v"] for r in d.collect()] == [pytest.approx(1 / 3), None]
    assert one(spark, T.shingles(T.word_tokens("text")), "") == [""] and one(spark, T.shingles(T.word_tokens("text"), empty=False), "") == []
    assert one(spark, T.mean_word_length(T.word_tokens("text")), "ab abcd") == 3.0
    assert one(spark, T.first_words("text", 2), " a\t b c ") == "a b"


def test_dropping_all_signals_scores_nothing(spark):
    d = S.with_signals(docs(spark, "a b c"))
    assert d.select(S.combine(S.SIGNALS)).first()[0] == 0.0


def test_references_and_recycling(spark):
    d = docs(spark, "one two three four five six", "other words here", "")
    near = S.with_signals(d, references=docs(spark, "one two three four five six", "").select("text"))
    assert {r["doc_id"]: r["duplicate_similarity"] for r in near.collect()} == {0: 1.0, 1: 0.0, 2: 1.0}


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_corpus_ngrams_cross_documents(spark, n):
    texts = ["a b c d e f g", "", "h", "i j", None, "k l m n", "a b c d e f"]
    flat = [w for t in texts if t for w in t.split()]
    want = sorted((i, " ".join(flat[i : i + n])) for i in range(len(flat) - n + 1))
    assert sorted(tuple(r) for r in corpus.corpus_ngrams(docs(spark, *texts), n).collect()) == want


def test_running_totals_of_sparse_and_skewed_orders(spark):
    """Hashed 64-bit ids, and values with one outlier, spread over the ranges; totals are those of a plain loop."""
    d = spark.range(4000).select(F.xxhash64("id").alias("doc_id"), F.when(F.col("id") == 7, 1e12).otherwise(F.col("id") % 997).alias("x"), (F.col("id") % 3).alias("g"))
    got = prefix.running_totals(d, [F.col("x"), F.col("doc_id")], {"upto": F.lit(1)}, "g").collect()
    for g in range(3):
        assert [r["upto"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["x"], r["doc_id"]))] == list(range(1, sum(r["g"] == g for r in got) + 1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for order in ("doc_id", "x"):  # the ranges that running_totals deals to
            sizes = [r["count"] for r in d.repartitionByRange(order).groupBy(F.spark_partition_id()).count().collect()]
            assert max(sizes) <= 2 * 4000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["pos"] for r in prefix.dense_index(d, "doc_id").orderBy("doc_id").collect()] == list(range(4000))


def test_running_totals_across_buckets(spark):
    d = spark.createDataFrame([(i * 40_000,) for i in range(30)], "doc_id long")
    assert [r["pos"] for r in prefix.dense_index(d, "doc_id").orderBy("doc_id").collect()] == list(range(30))


def test_corpus_of_nothing(spark):
    d = docs(spark, "x").limit(0)
    c = corpus.counts(d).first()
    assert (c["n_docs"], c["n_tokens"], c["type_token_ratio"]) == (0, 0, 0.0)
    assert corpus.ngram_diversity(d, 2).first()["diversity"] == 0.0
    assert similarity.near_duplicate_rate(d).first()[0] == 0.0 and similarity.near_duplicate_rate(docs(spark, "a")).first()[0] == 0.0


def test_histogram_takes_100_in_the_last_bin(spark):
    d = spark.createDataFrame([(100.0,), (0.0,), (9.99,)], "synthetic_likelihood double")
    assert [r["n"] for r in corpus.histogram(d).orderBy("bin").collect()] == [2, 0, 0, 0, 0, 0, 0, 0, 0, 1]


def scores(spark, pairs):
    return spark.createDataFrame([(i, float(s), y) for i, (s, y) in enumerate(pairs)], "i long, s double, y int")


def test_auc(spark):
    d = scores(spark, [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)])
    assert evaluation.roc_auc(d, "s", "y").first()["auc"] == 0.875
    assert evaluation.roc_auc(d.withColumn("s", -F.col("s")), "s", "y").first()["auc"] == 0.125
    assert evaluation.roc_auc(d.where("y = 1"), "s", "y").first()["auc"] == 0.5
    assert [r["avg_rank"] for r in evaluation.average_ranks(d, "s").orderBy("i").collect()] == [1.0, 2.5, 2.5, 4.0]


def test_best_f1_takes_the_lowest_of_equal_thresholds(spark):
    best = evaluation.best_f1(scores(spark, [(1, 1), (2, 0), (3, 1), (4, 1)]), "s", "y").first()
    assert best["threshold"] == 1.0 and best["f1"] == pytest.approx(6 / 7)


def test_bigram_model(spark):
    model = lm.BigramModel.fit(docs(spark, "a b"))
    bits = {r["doc_id"]: r["bits"] for r in model.cross_entropy(docs(spark, "a b", "z")).collect()}
    assert bits[0] == pytest.approx(1.0) and bits[1] == pytest.approx(2.2925, abs=1e-4)


def test_statistics(spark):
    ten = spark.createDataFrame([(i, 0.5) for i in range(10)], "i long, d double")
    assert stats.sign_flip_test(ten, "d", "i").first()["p"] == pytest.approx(2 / 1024)
    d = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    r = stats.mean_interval(d, "x").first()
    assert r["ci_high"] - r["mean"] == pytest.approx(2.262 * r["std"] / 10**0.5)


@pytest.mark.parametrize("values", [[0.3], [0.1, -0.2, 0.05], [0.0, 0.0], [0.4, 0.1, 0.1, -0.6, 0.2, 0.2, 0.1]])
def test_sign_flips_by_hand(spark, values):
    d = spark.createDataFrame(list(enumerate(values)), "i long, d double")
    far = [abs(sum(s * v for s, v in zip(signs, values)) / len(values)) >= abs(sum(values) / len(values)) - 1e-12 for signs in itertools.product((1, -1), repeat=len(values))]
    r = stats.sign_flip_test(d, "d", "i").first()
    assert r["p"] == pytest.approx(sum(far) / len(far)) and r["wins"] == sum(v > 0 for v in values)


def test_sign_flips_of_many_differences(spark):
    d = spark.createDataFrame([(i, 1.0) for i in range(40)], "i long, d double")
    assert stats.sign_flip_test(d, "d", "i").first()["p"] == 2 / 2**40


def test_t_quantiles_reach_few_and_many_values(spark):
    for n, t in ((2, 1.96), (5, 2.776), (16, 2.131), (17, 1.96)):
        d = spark.createDataFrame([(float(i),) for i in range(n)], "x double")
        r = stats.mean_interval(d, "x").first()
        assert r["ci_high"] - r["mean"] == pytest.approx(t * r["std"] / n**0.5)


def test_split_is_exact_and_balanced(spark):
    d = spark.createDataFrame([(i, int(i < 13)) for i in range(50)], "i long, y int")
    got = sampling.split(d, "y", F.col("i")).groupBy("y").agg(F.count_if("is_train").alias("n"))
    assert {r["y"]: r["n"] for r in got.collect()} == {0: int(37 * 0.7), 1: int(13 * 0.7)}
    assert {r["y"]: r["count"] for r in sampling.balanced(d, "y", F.col("i")).groupBy("y").count().collect()} == {0: 13, 1: 13}


def test_cache_joins(spark):
    d = caches.with_key(docs(spark, "a", "b", None))
    cache = d.limit(1).select("h", F.lit(1.0).alias("f"))
    assert caches.missing(d, cache).count() == 2
    assert caches.usable(caches.lookup(d, cache), "f").count() == 1
