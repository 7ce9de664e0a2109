"""N-gram language models as count tables: add-k bigram cross entropy, and next-word distributions with backoff."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shared import checkpoint
from .corpus import _keys

OPEN, CLOSE = "<s>", "</s>"
K = 0.5
#: A word that makes up one in so many first words is broadcast with its counts; there are no more such words than that.
COMMON = 500_000
#: Parts to which n-grams are dealt, and the length up to which words count as short.
PARTS, SHORT = 16_384, 3
#: Models that one pass can count, as bits of a long.
MODELS = 60
#: Parts of a frequent first word, as of the opening mark that every text has.
SALTS = 16


def padded(text_col: str = "text"):
    return F.concat(F.array(F.lit(OPEN)), T.word_tokens(text_col), F.array(F.lit(CLOSE)))


def unigram_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.select(F.explode(padded(text_col)).alias("w")).groupBy("w").agg(F.count("*").alias("c"))


def transitions(df: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """Rows (keep, a, b) of every pair of neighbours, padding included."""
    t = df.select(*keep, padded(text_col).alias("t"))
    ahead = F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return t.select(*keep, F.explode(ahead).alias("p")).select(*keep, "p.a", "p.b")


def bigram_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    return transitions(df, text_col=text_col).groupBy("a", "b").agg(F.count("*").alias("c"))


def part_entropy(df: DataFrame, part, id_col: str = "doc_id", text_col: str = "text", k: float = K) -> DataFrame:
    """Rows (id, bits) of every text under the model of those that meet the condition `part`, in one pass over the pairs."""
    fits = F.coalesce(part, F.lit(False)).cast("long")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fits.alias("fits"), F.lit(1).alias("asks"))
    return mean_bits(texts, 1, k).select(F.col("id").alias(id_col), F.col("b0").alias("bits"))


@dataclass
class BigramModel:
    """Add-k bigram model: counts of words and of pairs. Padding marks count as words of the vocabulary."""

    unigrams: DataFrame
    bigrams: DataFrame
    k: float = K

    @classmethod
    def fit(cls, df: DataFrame, text_col: str = "text", k: float = K) -> BigramModel:
        return cls(unigram_counts(df, text_col), bigram_counts(df, text_col), k)

    def cross_entropy(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows (id, bits): mean bits of a transition; pairs and words that were not seen count 0."""
        texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).alias("fits"), F.lit(1).alias("asks"))
        return mean_bits(texts, 1, self.k, self).select(F.col("id").alias(id_col), F.col("b0").alias("bits"))


def mean_bits(texts: DataFrame, models: int, k: float = K, known: BigramModel | None = None) -> DataFrame:
    """Rows (id, b0, b1, ...): mean bits of a transition of each text under add-k bigram models.

    texts: rows (id, text, fits, asks), whose masks say by bit j that a text is counted for model j, and that its bits are
    asked for; rows of an id ask alike. Bits not asked for are null. `known` adds counts to model 0. There are MODELS at most.

    The bits are logarithms of pair counts less those of word counts. Pairs travel once, as 80 bits of hashes, to where they
    are counted and looked up at the same time, and come back as sums of a text and task. Common words are looked up on the
    way, and only the other words travel.
    """
    every = range(models)
    bit = lambda c, j: F.shiftright(F.col(c).cast("long"), j).bitwiseAND(F.lit(1).cast("long"))
    t = texts.select("id", F.col("fits").cast("long").alias("fits"), F.col("asks").cast("long").alias("asks"), padded("text").alias("t")).where("fits <> 0 or asks <> 0")
    firsts = F.explode(F.slice("t", F.lit(1), F.size("t") - 1)).alias("w")

    seen = t.select(firsts, "fits", (F.col("asks") != 0).cast("long").alias("asked"), F.lit(1).cast("long").alias("n"))
    pairs = t.select("id", "fits", "asks", F.explode(F.expr(f"transform(sequence(0, size(t) - 2), i -> {_keys(2, 't', 'i')})")).alias("k")).select("id", "fits", "asks", F.lit(1).cast("long").alias("n"), "k.k1", "k.k2")
    if known is not None:
        seen = seen.union(known.unigrams.where(F.col("w") != CLOSE).select("w", F.lit(1), F.lit(0), "c"))
        of = known.bigrams.select(F.array("a", "b").alias("t"), "c").select("c", F.expr(_keys(2, "t", "0")).alias("k"))
        pairs = pairs.union(of.select(F.lit(None), F.lit(1), F.lit(0), "c", "k.k1", "k.k2"))

    words = checkpoint(seen.groupBy("w").agg(F.sum("asked").alias("asked"), *(F.sum(bit("fits", j) * F.col("n")).alias(f"u{j}") for j in every)))
    total, *sizes = words.agg(F.coalesce(F.sum("asked"), F.lit(0)), *(F.count_if(F.col(f"u{j}") > 0) for j in every)).first()
    # The closing mark is a word too, but never one that something follows.
    less = lambda j: -F.log2(F.col(f"u{j}") + k * max(1, sizes[j] + (sizes[j] > 0)))
    common = words.where(F.col("asked") * COMMON >= max(1, total)).select("w", *(less(j).alias(f"d{j}") for j in every))
    own = t.where("asks <> 0").select("id", "asks", firsts).join(F.broadcast(common), "w", "left")  # COMMON rows at most
    # What common words of a text come to goes under a name that no word has.
    name = F.when(F.col("d0").isNull(), F.col("w")).otherwise(F.concat(F.lit(" "), F.pmod(F.xxhash64("id"), F.lit(1000))))
    own = own.withColumn("w", name).groupBy("id", "asks", "w").agg(F.count("*").alias("n"), *(F.sum(f"d{j}").alias(f"d{j}") for j in every))
    own = own.join(words.drop("asked"), "w", "left").select("id", "asks", F.lit(0).alias("n"), *(F.coalesce(F.col(f"d{j}"), F.col("n") * less(j)).alias(f"s{j}") for j in every))

    key = Window.partitionBy("k1", "k2")
    found = pairs.select("id", "asks", *(F.sum(bit("fits", j) * F.col("n")).over(key).alias(f"c{j}") for j in every)).where("asks <> 0")
    found = found.select("id", "asks", F.lit(1).alias("n"), *(F.log2(F.col(f"c{j}") + k).alias(f"s{j}") for j in every))
    sums = found.union(own).groupBy("id").agg(F.sum("n").alias("n"), *(F.sum(F.when(bit("asks", j) == 1, F.col(f"s{j}"))).alias(f"s{j}") for j in every))
    return sums.select("id", *((-F.col(f"s{j}") / F.col("n")).alias(f"b{j}") for j in every))


def gram_counts(df: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """Rows (g, c) of the n-grams inside documents, sentence marks being tokens.

    Neighbours travel together: an n-gram goes to where its longest word does (the one with the largest hash, if several
    are as long), so a stretch that has the same longest word is sent as one piece, and cut into n-grams there. N-grams of
    short words alone, which are the frequent ones, are dealt out by themselves. Nothing is counted before, so no task
    holds n-grams that hardly repeat in it.
    """
    d = df.select(T.marked_tokens(text_col).alias("t"))
    if n < 3:  # pairs repeat so much that tasks had better count them first
        return d.select(F.explode(T.ngrams("t", n)).alias("g")).groupBy("g").agg(F.count("*").alias("c"))
    words = [f"t[i + {j}]" for j in range(n)]
    # The length stands above 48 bits of a hash.
    d = d.where(F.size("t") >= n).withColumn("o", F.expr("transform(t, w -> least(length(w), 30000) * 281474976710656 + shiftrightunsigned(xxhash64(w), 16))"))
    most = f"greatest({', '.join(w.replace('t[', 'o[') for w in words)})"
    d = d.withColumn("m", F.expr(f"transform(sequence(0, size(o) - {n}), i -> if({most} < {SHORT + 1} * 281474976710656, xxhash64({', '.join(words)}), {most}))")).drop("o")
    d = d.withColumn("at", F.expr("filter(sequence(0, size(m) - 1), i -> i = 0 or m[i] <> m[i - 1])"))
    piece = f"struct(cast(pmod(m[a], {PARTS}) as int) as p, array_join(slice(t, a + 1, b - a + {n - 1}), ' ') as s)"
    d = d.select(F.explode(F.expr(f"zip_with(at, concat(slice(at, 2, size(at)), array(size(m))), (a, b) -> {piece})")).alias("x")).select("x.p", "x.s")
    d = d.repartition("p").select("p", F.split("s", " ", -1).alias("t"))
    d = d.select("p", F.explode(F.expr(f"transform(sequence(0, size(t) - {n}), i -> concat_ws(' ', {', '.join(words)}))")).alias("g"))
    return d.groupBy("p", "g").agg(F.count("*").alias("c")).select("g", "c")


def start_pairs(df: DataFrame, text_col: str = "text") -> DataFrame:
    t = df.select(T.marked_tokens(text_col).alias("t")).where("size(t) >= 2")
    return t.groupBy(F.element_at("t", 1).alias("w1"), F.element_at("t", 2).alias("w2")).agg(F.count("*").alias("c"))


def next_words(counts: DataFrame) -> DataFrame:
    """Rows (context, w, c, upto, total): cumulative counts of the words that follow a context, in word order."""
    parts = F.split("g", " ")
    d = counts.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), " ").alias("context"), F.element_at(parts, -1).alias("w"), "c")
    w = Window.partitionBy("context")
    return d.select("*", F.sum("c").over(w.orderBy("w").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(w).alias("total"))
