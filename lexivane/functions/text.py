"""Column builders for tokens, sentences, n-grams, shingles and phrase counts. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a word, a word or sentence mark, and a sentence end.
WORD = r"[a-zA-Z']+"
WORD_OR_MARK = r"[a-zA-Z']+|[.!?]"
SENTENCE_END = r"[.!?]+"

#: Canned phrases, in order.
FILLER_PHRASES = (
    "it is important to note",
    "it is worth noting",
    "in conclusion",
    "in summary",
    "as we can see",
    "a wide range of",
    "plays a crucial role",
    "plays a vital role",
    "it is essential to",
    "delve into",
    "navigate the",
    "in today's world",
    "in the realm of",
    "a testament to",
    "rich tapestry",
    "ever-evolving",
    "ever-changing",
    "shed light on",
    "when it comes to",
    "first and foremost",
    "needless to say",
    "in essence",
    "furthermore",
    "moreover",
    "additionally",
    "overall",
)


def _text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_tokens(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and apostrophes; null text has none."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit(f"({WORD})"), F.lit(1))


def marked_tokens(text: Column | str) -> Column:
    """Word tokens and single sentence marks, in order."""
    return marked_in(F.lower(_text(text)))


def marked_in(low: Column | str) -> Column:
    """`marked_tokens` of a text that is lower-cased already."""
    return F.regexp_extract_all(low, F.lit(f"({WORD_OR_MARK})"), F.lit(1))


def alpha_tokens(text: Column | str) -> Column:
    """Marked tokens of letters only: marks and tokens with an apostrophe are dropped."""
    return F.filter(marked_tokens(text), lambda t: t.rlike("^[a-z]+$"))


def sentences(text: Column | str) -> Column:
    """Non-blank pieces between sentence marks, stripped of Unicode white space."""
    parts = F.transform(F.split(_text(text), SENTENCE_END, -1), lambda s: strip(s))
    return F.filter(parts, lambda s: s != "")


def sentence_lengths(text: Column | str) -> Column:
    """Word tokens of each sentence that has any."""
    return F.filter(F.transform(F.split(_text(text), SENTENCE_END, -1), lambda s: F.size(word_tokens(s))), lambda n: n > 0)


def run_lengths(marked: Column | str) -> Column:
    """Word tokens of each sentence that has any, from `marked_tokens`: the distances between marks."""

    def lengths(m: Column) -> Column:
        at = F.filter(F.transform(m, lambda w, i: F.when(w.isin(".", "!", "?"), i)), lambda i: i.isNotNull())
        ends = F.concat(F.array(F.lit(-1)), at, F.array(F.size(m)))
        return once(ends, lambda e: F.filter(F.zip_with(F.slice(e, F.lit(2), F.size(e) - 1), F.slice(e, F.lit(1), F.size(e) - 1), lambda b, a: b - a - 1), lambda n: n > 0))

    return once(marked, lengths)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squash(text: Column | str) -> Column:
    """Runs of white space become one space, none at the ends."""
    return strip(F.regexp_replace(_text(text), r"(?U)\s+", " "))


def split_words(text: Column | str) -> Column:
    """White-space separated words; blank text has none."""
    return F.filter(F.split(squash(text), " ", -1), lambda w: w != "")


def first_words(text: Column | str, n: int) -> Column:
    return F.array_join(F.slice(split_words(text), 1, n), " ")


def once(value: Column | str, use) -> Column:
    """use(value) with the value computed once a row, even where `use` reads it inside a lambda."""
    return F.element_at(F.transform(F.array(F.col(value) if isinstance(value, str) else value), use), 1)


def _ngrams(t: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).otherwise(none)


def ngrams(tokens: Column | str, n: int) -> Column:
    """Space-joined n-grams; shorter token lists have none."""
    return once(tokens, lambda t: _ngrams(t, n))


def ngram_hashes(tokens: str, n: int) -> Column:
    """64-bit hashes of the n-grams of a column of tokens, in order: enough to tell those of one text apart."""
    words = ", ".join(f"{tokens}[i + {k}]" for k in range(n))
    return F.expr(f"if(size({tokens}) < {n}, cast(array() as array<bigint>), transform(sequence(0, size({tokens}) - {n}), i -> xxhash64({words})))")


def shingles(tokens: Column | str, k: int = 5, empty: bool = True) -> Column:
    """Distinct k-word shingles; 1 to k-1 tokens make one. Without tokens: one empty shingle, or none if not `empty`."""

    def make(t: Column) -> Column:
        whole = F.array(F.array_join(t, " "))
        short = whole if empty else F.when(F.size(t) > 0, whole).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(t) < k, short).otherwise(F.array_distinct(_ngrams(t, k)))

    return once(tokens, make)


def filler_hits(text: Column | str) -> Column:
    """Non-overlapping occurrences of each phrase in the lower-cased text, summed over phrases."""
    return once(F.lower(_text(text)), hits_in)


def hits_in(low: Column | str) -> Column:
    """`filler_hits` of a text that is lower-cased already."""
    low = F.col(low) if isinstance(low, str) else low
    hits = F.lit(0)
    for p in FILLER_PHRASES:
        hits = hits + ((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p)).cast("int")
    return hits


def mean_word_length(tokens: Column | str) -> Column:
    def mean(t: Column) -> Column:
        return F.when(F.size(t) > 0, F.aggregate(t, F.lit(0), lambda a, w: a + F.length(w)) / F.size(t)).otherwise(F.lit(0.0))

    return once(tokens, mean)


def tidy_marks(text: Column | str) -> Column:
    """No white space before a sentence mark."""
    return F.regexp_replace(_text(text), r"(?U)\s+([.!?])", "$1")


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
