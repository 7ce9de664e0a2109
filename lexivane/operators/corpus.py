"""Corpus health: counts, vocabulary, n-gram diversity across document borders, boilerplate, histogram, snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signals, text as T
from ..functions.shared import checkpoint
from .prefix import running_totals
from .similarity import near_duplicate_rate

VERSION = "0.1.0"
BINS = 10


def packed(toks) -> Column:
    """Tokens as one string, which takes a fraction of an array's place in a checkpoint. No token has a space."""
    return F.array_join(toks, " ")


def unpacked(df: DataFrame, name: str) -> DataFrame:
    """`df` with a column of `packed` tokens as arrays again."""
    return df.withColumn(name, F.filter(F.split(name, " ", -1), lambda w: w != ""))


def tokenised(df: DataFrame, order_col: str = "doc_id", text_col: str = "text", tokens=T.word_tokens, part: str | None = None) -> DataFrame:
    """Rows (part, o, row, toks), checkpointed: all metrics read the tokens, which are taken from the texts once.

    `part` names a column that tells several corpora apart, which are then measured together.
    """
    of = F.lit(0) if part is None else F.col(part)
    return unpacked(checkpoint(df.select(of.alias("part"), F.col(order_col).alias("o"), F.monotonically_increasing_id().alias("row"), packed(tokens(text_col)).alias("toks"))), "toks")


def counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n_docs, n_tokens, mean_doc_tokens, vocab, vocab_per_10k_tokens, type_token_ratio; ratios are 0 over nothing."""
    return token_counts(df.select(T.word_tokens(text_col).alias("toks")))


def token_counts(d: DataFrame) -> DataFrame:
    """`counts` of rows (toks), in one pass: tokens are counted by word, and documents beside them as the null word."""
    words = d.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), "toks")).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    n = words.agg(*(F.coalesce(x, F.lit(0)).cast("long").alias(k) for k, x in (("n_docs", F.sum(F.when(F.col("w").isNull(), F.col("c")))), ("n_tokens", F.sum(F.when(F.col("w").isNotNull(), F.col("c")))), ("vocab", F.count("w")))))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return n.select(
        "n_docs", "n_tokens", ratio(F.col("n_tokens"), F.col("n_docs")).alias("mean_doc_tokens"), "vocab",
        ratio(10000 * F.col("vocab"), F.col("n_tokens")).alias("vocab_per_10k_tokens"), ratio(F.col("vocab"), F.col("n_tokens")).alias("type_token_ratio"),
    )


def _starts(toks: DataFrame) -> DataFrame:
    """Rows (row, at): how many tokens of its part stand before a document. Only sizes are put in order."""
    sizes = toks.select("part", "o", "row", F.size("toks").alias("n"))
    return running_totals(sizes, [F.col("o"), F.col("row")], {"upto": F.col("n")}, "part").select("row", (F.col("upto") - F.col("n")).alias("at"))


def _across(toks: DataFrame, at: DataFrame, *ns: int) -> DataFrame:
    """Rows (part, n, pos, t): the words of the n-grams that cross borders of documents.

    They are put together from the first and last tokens of documents, so the token sequence is never sorted as a whole.
    """
    most, size = max(ns), F.size("toks")
    ends = F.filter(F.transform("toks", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: (x["i"] < most - 1) | (x["i"] > F.size("toks") - most))
    edge = toks.where("size(toks) > 0").select("part", "row", size.alias("size"), F.explode(ends).alias("x")).select("part", "row", "size", "x.i", "x.w")
    edge = checkpoint(edge.join(at, "row"))
    out = None
    for n in ns:
        near = edge.where((F.col("i") < n - 1) | (F.col("i") > F.col("size") - n))
        placed = near.select("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"), "at", "i", "size", "w")
        starts = placed.select("part", (F.col("at") + F.col("i") - F.col("k")).alias("pos"), "k", "w", ((F.col("k") == 0) & (F.col("i") > F.col("size") - n)).alias("tail"))
        cross = starts.groupBy("part", "pos").agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("t"), F.bool_or("tail").alias("tail"))
        cross = cross.where(F.col("tail") & (F.size("t") == n)).select("part", F.lit(n).alias("n"), "pos", F.transform("t", lambda x: x["w"]).alias("t"))
        out = cross if out is None else out.union(cross)
    return out


def _keys(n: int, toks: str, at: str) -> str:
    """SQL of two hashes of the n tokens from a place on: 80 bits that stand for an n-gram.

    They are nearly all that is shuffled. Among a billion n-grams, any two share them with a probability of 4e-7.
    """
    words = ", ".join(f"{toks}[{at} + {k}]" for k in range(n))
    return f"struct(xxhash64({words}) as k1, cast(shiftright(xxhash64(1, {words}), 48) as smallint) as k2)"


def _inside(n: int) -> str:
    """SQL of the keys of all n-grams inside a document, in order."""
    return f"if(size(toks) < {n}, cast(array() as array<struct<k1:bigint,k2:smallint>>), transform(sequence(0, size(toks) - {n}), i -> {_keys(n, 'toks', 'i')}))"


def corpus_ngrams(df: DataFrame, n: int, order_col: str = "doc_id", text_col: str = "text", tokens=T.word_tokens) -> DataFrame:
    """Rows (pos, g): the n-grams of all documents' tokens written one after another, in the order of an id."""
    toks = tokenised(df, order_col, text_col, tokens)
    at = _starts(toks)
    inside = toks.join(at, "row").select("at", F.posexplode(T.ngrams("toks", n)).alias("i", "g")).select((F.col("at") + F.col("i")).alias("pos"), "g")
    return inside if n == 1 else inside.union(_across(toks, at, n).select("pos", F.array_join("t", " ")))


def diversities(toks: DataFrame, *ns: int) -> DataFrame:
    """Rows (part, n, total, distinct_ngrams, diversity) of `tokenised` documents; 0 without any n-gram.

    N-grams are told apart by 80 bits of hashes, which are counted instead of strings.
    """
    grams = None
    for n in ns:
        own = toks.select("part", F.lit(n).alias("n"), F.explode(F.expr(_inside(n))).alias("k")).select("part", "n", "k.*")
        grams = own if grams is None else grams.union(own)
    if cross := [n for n in ns if n > 1]:
        borders = _across(toks, _starts(toks), *cross)
        key = F.expr("case n " + " ".join(f"when {n} then {_keys(n, 't', '0')}" for n in cross) + " end")
        grams = grams.union(borders.select("part", "n", key.alias("k")).select("part", "n", "k.*"))
    d = grams.groupBy("part", "n", "k1", "k2").agg(F.count("*").alias("c")).groupBy("part", "n").agg(F.sum("c").alias("total"), F.count("*").alias("distinct_ngrams"))
    d = toks.select("part").distinct().select("part", F.explode(F.lit(list(ns))).alias("n")).join(d, ["part", "n"], "left").fillna(0, ["total", "distinct_ngrams"])
    return d.withColumn("diversity", F.coalesce(F.try_divide(F.col("distinct_ngrams"), F.col("total")), F.lit(0.0)))


def nested_diversities(toks: DataFrame, *ns: int) -> DataFrame:
    """Rows (n, whole, some): the diversity of all `tokenised` documents, and of those whose `part` is true, 0 without any n-gram.

    The n-grams inside documents are counted once for both; only those that cross borders differ.
    """
    grams = None
    for n in ns:
        own = toks.select(F.lit(n).alias("n"), F.explode(F.expr(_inside(n))).alias("k"), F.lit(1).alias("a"), F.coalesce("part", F.lit(False)).cast("int").alias("s"))
        grams = own if grams is None else grams.union(own)
    if cross := [n for n in ns if n > 1]:
        key = F.expr("case n " + " ".join(f"when {n} then {_keys(n, 't', '0')}" for n in cross) + " end")
        for a, d in ((1, toks), (0, toks.where("part"))):
            d = d.withColumn("part", F.lit(0))
            grams = grams.union(_across(d, _starts(d), *cross).select("n", key.alias("k"), F.lit(a).alias("a"), F.lit(1 - a).alias("s")))
    d = grams.select("n", "k.*", "a", "s").groupBy("n", "k1", "k2").agg(F.sum("a").alias("a"), F.sum("s").alias("s"))
    share = lambda c: F.coalesce(F.try_divide(F.count_if(F.col(c) > 0), F.sum(c)), F.lit(0.0))
    every = toks.sparkSession.createDataFrame([(n,) for n in ns], "n int")
    return every.join(d.groupBy("n").agg(share("a").alias("whole"), share("s").alias("some")), "n", "left").fillna(0.0)


def ngram_diversity(df: DataFrame, n: int, order_col: str = "doc_id", text_col: str = "text", tokens=T.word_tokens) -> DataFrame:
    """One row: total, distinct and diversity of the corpus's n-grams; 0 without any."""
    found = diversities(tokenised(df, order_col, text_col, tokens), n).drop("part", "n")
    total = found.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("total", "distinct_ngrams")), F.coalesce(F.max("diversity"), F.lit(0.0)).alias("diversity"))
    return total  # one row, also of no document


def repeated_ngrams(df: DataFrame, n: int = 5, top: int = 8, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (rank, g, c): the `top` most frequent n-grams (ties by first position), then those frequent enough.

    Enough is three times, or once per 20,000 tokens if that is more.
    """
    return most_repeated(tokenised(df, order_col, text_col), n, top)


def most_repeated(toks: DataFrame, n: int = 5, top: int = 8) -> DataFrame:
    """`repeated_ngrams` of `tokenised` documents. Keys are counted; words are looked up for the few that are reported."""
    at = checkpoint(_starts(toks))
    grams = toks.join(at, "row").select("at", F.posexplode(F.expr(_inside(n))).alias("i", "k")).select((F.col("at") + F.col("i")).alias("pos"), "k.*")
    cross = checkpoint(_across(toks, at, n)) if n > 1 else None
    if cross is not None:
        grams = grams.union(cross.select("pos", F.expr(_keys(n, "t", "0")).alias("k")).select("pos", "k.*"))
    best = grams.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.min("pos").alias("pos")).orderBy(F.desc("c"), "pos").limit(top)
    best = checkpoint(best.select("pos", "c"))
    own = toks.join(at, "row").join(F.broadcast(best), F.expr(f"pos >= at and pos <= at + size(toks) - {n}"))  # `top` rows
    found = own.select("pos", "c", F.array_join(F.expr(f"slice(toks, cast(pos - at as int) + 1, {n})"), " ").alias("g"))
    if cross is not None:
        found = found.union(cross.join(F.broadcast(best), "pos").select("pos", "c", F.array_join("t", " ")))
    total = toks.agg(F.sum(F.size("toks")).alias("n_tokens"))
    ranked = found.agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("m"), "pos", "g", "c"))).alias("t")).select(F.posexplode("t").alias("i", "x"))
    ranked = ranked.select((F.col("i") + 1).cast("long").alias("rank"), "x.g", "x.c")
    return ranked.join(F.broadcast(total), F.col("c") >= F.greatest(F.lit(3), F.floor(F.col("n_tokens") / 20000))).select("rank", "g", "c")  # one row


def histogram(scored: DataFrame, column: str = "synthetic_likelihood") -> DataFrame:
    """Rows (bin, n): ten 10-point bins, 100 in the last, empty bins with 0."""
    bins = scored.sparkSession.range(BINS).select(F.col("id").alias("bin"))
    n = scored.groupBy(F.least(F.lit(BINS - 1), F.floor(F.col(column) / 10)).alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def mean_burstiness(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: mean of the unclamped burstiness of documents with two sentences or more; 0 without any."""
    d = df.select(T.run_lengths(T.marked_tokens(text_col)).alias("lens")).select(signals.variation("lens").alias("v"))
    return d.agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean_burstiness"), F.count("v").alias("n_docs"))


def snapshot(df: DataFrame, label: str = "corpus", order_col: str = "doc_id", text_col: str = "text") -> dict:
    """All metrics of a corpus as a dict, rounded as the report shows them. Only single rows reach the driver.

    Texts are read twice: once for their tokens and the scores, which are checkpointed, and once for the few that the
    near-duplicate rate compares.
    """
    scored = signals.score(df.select(order_col, text_col), text_col, id_col=order_col, keep=True)
    scored = checkpoint(scored.select(F.col(order_col).alias("o"), F.monotonically_increasing_id().alias("row"), packed(signals.TOKENS).alias("toks"), signals.variation().alias("variation"), "synthetic_likelihood", "is_synthetic"))
    toks = unpacked(scored.select(F.lit(0).alias("part"), "o", "row", "toks"), "toks")
    means = scored.agg(F.avg("synthetic_likelihood").alias("score"), F.count_if("is_synthetic").alias("flagged"), F.coalesce(F.avg("variation"), F.lit(0.0)).alias("burstiness")).first()
    bins = {r["bin"]: r["n"] for r in histogram(scored).collect()}
    c = token_counts(toks).first()
    diversity = {r["n"]: r["diversity"] for r in diversities(toks, 2, 3).collect()}
    return {
        "version": VERSION,
        "label": label,
        "n_docs": c["n_docs"],
        "n_tokens": c["n_tokens"],
        "mean_doc_tokens": round(c["mean_doc_tokens"], 1),
        "vocab": c["vocab"],
        "vocab_per_10k_tokens": round(c["vocab_per_10k_tokens"], 1),
        "type_token_ratio": round(c["type_token_ratio"], 4),
        "bigram_diversity": round(diversity.get(2, 0.0), 4),
        "trigram_diversity": round(diversity.get(3, 0.0), 4),
        "mean_burstiness": round(means["burstiness"], 3),
        "near_duplicate_rate": round(near_duplicate_rate(df, order_col, text_col).first()[0], 4),
        "mean_synthetic_score": round(means["score"] or 0, 1),
        "flagged_synthetic_pct": round(100 * means["flagged"] / c["n_docs"], 1) if c["n_docs"] else 0,
        "score_histogram": [bins.get(k, 0) for k in range(BINS)],
        "top_repeated_5grams": [r["g"] for r in most_repeated(toks, 5, 8).orderBy("rank").collect()],
    }
