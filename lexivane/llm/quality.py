"""Quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAPS, checkpoint, fresh, words_of

#: A line may be in this many documents of one host before it counts as boilerplate there.
HOST_LIMIT = 20
#: A document is depleted where less than this share of its word characters is left.
MIN_LEFT = 0.5
SYMBOLS = "#*$%&|<>"
SALTS = 16


def document_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, t (a hash of text and host), the base counts, and `lines`, an array of (k1, k2, chars) for each line with a word.

    k1 and k2 are two 64-bit hashes of host and line; lines are compared lower-cased and trimmed. The three-word
    windows of a text are compared by 64-bit hashes within that text only.
    """
    gaps = F.lit(WORD_GAPS)
    d = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(host_col).cast("string").alias("host"))
    d = d.withColumn("w", words_of(F.col("text"))).withColumn("n", F.size("w"))
    d = d.withColumn("g", F.expr("if(n < 3, array(), transform(sequence(0, n - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"))
    d = d.withColumn("l", F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, WORD_GAPS, "") != ""))
    d = d.select(
        "id", "host", F.xxhash64("text", "host").alias("t"), "l", F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("text", WORD_GAPS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr("if(size(array_distinct(g)) = size(g), array(), sort_array(transform(g, (x, i) -> struct(x as h, i as i))))").alias("s"),
    )
    # Starts of windows found twice or more, in order; each covers three words or as many as the next leaves.
    d = d.withColumn("p", F.expr("sort_array(transform(filter(s, (x, k) -> (k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = x.h)), x -> x.i))"))
    covered = F.expr("aggregate(transform(p, (v, k) -> if(k = size(p) - 1, 3, least(3, p[least(k + 1, size(p) - 1)] - v))), 0L, (a, x) -> a + x)")
    line = F.transform("l", lambda x: F.struct(F.trim(F.lower(F.translate(x, WORD_GAPS, " " * len(WORD_GAPS)))).alias("norm"), F.length(F.translate(x, WORD_GAPS, "")).alias("chars")))
    keys = F.transform(line, lambda x: F.struct(F.xxhash64(F.col("host"), x["norm"]).alias("k1"), F.xxhash64(F.lit(1), F.col("host").isNull(), F.col("host"), x["norm"]).alias("k2"), x["chars"].alias("chars")))
    return d.select("id", "t", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), keys.alias("lines"))


def _judged(df: DataFrame, id_col: str, text_col: str, host_col: str, limit: int = HOST_LIMIT, min_left: float = MIN_LEFT) -> DataFrame:
    """The rows of `judge`, t, and `gone`: which of the lines with a word are over the limit, null where none is."""
    d = checkpoint(document_counts(df, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()))
    once = d.select("id", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"))))).alias("k"))
    keys = ["k1", "k2"]
    rows = once.groupBy("k.k1", "k.k2").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") > limit)
    rows = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = d.select("row", "id", F.posexplode("lines").alias("pos", "x")).select("row", "id", "pos", "x.*").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    each = checkpoint(each.join(rows, [*keys, "salt"]))
    # Lines that enough rows have are few; only of these are the distinct ids counted, each null id for itself.
    ids = each.select(*keys, F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row "), F.col("row"))).alias("doc")).distinct().groupBy(*keys).agg(F.count("*").alias("docs"))
    often = ids.where(F.col("docs") > limit).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lost = each.where(~F.col("id").eqNullSafe(F.col("first"))).join(often, [*keys, "salt"], "left_semi").groupBy("row").agg(F.sum("chars").alias("lost"), F.collect_list("pos").alias("gone"))
    d = d.drop("lines").join(lost, "row", "left")
    left = F.col("word_chars") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select(
        "id", "t", "gone", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        left.cast("long").alias("left_chars"), (~failed & (left >= min_left * F.col("word_chars"))).alias("kept"),
    )


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = HOST_LIMIT, min_left: float = MIN_LEFT) -> DataFrame:
    """Per row of `df`: id, base counts, base_failed, left_chars and kept.

    A line that more than `limit` documents (distinct ids) of its host hold counts as removed from all of them but the
    one with the smallest id (`clean_good` takes it out), so one whole copy of a text that many repeat stays. A document
    that keeps less than `min_left` of its word characters is depleted. kept is false where the base rules fail or it is
    depleted. Null texts count as empty (base rules fail); null hosts make one host; a row with a null id is a document
    of its own that never counts as the first; repeated rows are judged alike; an empty table gives an empty result;
    other columns are left out, whatever their names. A very long text is one row, in memory of some 40 times its size.
    """
    return _judged(df, id_col, text_col, host_col, limit, min_left).drop("t", "gone")


def _kept(df: DataFrame, verdicts: DataFrame, id_col: str, text_col: str, host_col: str) -> tuple[DataFrame, str]:
    """The rows of `df` but for those whose verdict (id, t, gone, kept) is not kept, with `gone` in a new column, and its name."""
    of, t, gone, kept, own = fresh(df, "of", "t", "gone", "kept", "own")
    verdicts = verdicts.groupBy("id", "t").agg(F.first("gone"), F.first("kept")).toDF(of, t, gone, kept)  # equal rows are judged alike
    d = df.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(host_col).cast("string")))
    d = d.join(verdicts, d[id_col].eqNullSafe(verdicts[of]) & (d[own] == verdicts[t]), "left").where(F.coalesce(kept, F.lit(True)))
    return d.select(*df.columns, gone), gone


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows of `df`, all columns as they are, that `judge` keeps. Each row has its own verdict, also where ids are null or repeated."""
    bad = _judged(df, id_col, text_col, host_col, **limits).where("not kept").select("id", "t", "gone", "kept")
    return _kept(df, bad, id_col, text_col, host_col)[0].select(*df.columns)


def clean_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows that `keep_good` keeps, their over-limit lines taken out of the texts; other columns as they are.

    The document with the smallest id keeps its lines, as do lines without a word; the others keep their order.
    """
    judged = checkpoint(_judged(df, id_col, text_col, host_col, **limits).where("not kept or gone is not null").select("id", "t", "gone", "kept"))
    d, lost = _kept(df, judged, id_col, text_col, host_col)
    line, wordy = fresh(d, "line", "wordy")
    d = d.withColumn(line, F.split(text_col, "\n", -1))
    d = d.withColumn(wordy, F.filter(F.sequence(F.lit(0), F.size(line) - 1), lambda i: F.translate(F.get(line, i), WORD_GAPS, "") != ""))
    left = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), F.transform(lost, lambda k: F.get(wordy, k)))
    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(line, i)), "\n"))
    return d.select(*(text.alias(c) if c.lower() == text_col.lower() else F.col(c) for c in df.columns))


#: SQL over `documents` with the same result.
SQL = rf"""
with d as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)),
p as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
r as (select doc_id, sum(c) as n_repeat_words from (select doc_id, least(3, coalesce(lead(i) over (partition by doc_id order by i) - i, 3)) as c from p) group by doc_id),
ln as (select doc_id, source, trim(lower(translate(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '))) as norm, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) as chars from (select doc_id, source, unnest(l) as x from w)),
f as (select source, norm, min(doc_id) as first from ln group by source, norm having count(distinct doc_id) > {HOST_LIMIT}),
lost as (select ln.doc_id, sum(chars) as lost from ln join f on ln.norm = f.norm and ln.source is not distinct from f.source where ln.doc_id <> f.first group by ln.doc_id),
b as (select w.doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
 coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(lost, 0) as lost from w left join r using (doc_id) left join lost using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
 (word_chars - lost)::bigint as left_chars, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and word_chars - lost >= {MIN_LEFT} * word_chars as kept from b
"""
