"""Cross-site boilerplate lines: HyperLogLog sketches of the sites of each line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAPS, checkpoint, fresh, words_of

#: A line is boilerplate from so many distinct sites on.
MIN_SITES = 10
#: Shorter lines are too common by chance to tell boilerplate.
MIN_WORDS = 3
LG_CONFIG_K = 12
#: Lines whose estimate is within this share (and one site) of the threshold are counted exactly: three standard errors.
MARGIN = 3 * 1.04 / (1 << LG_CONFIG_K) ** 0.5
SALTS = 16


def _lines(df: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """Rows (id, t, site, pos, k1, k2) of the lines that are long enough; t hashes the whole text."""
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.trim(F.lower(F.translate(x, WORD_GAPS, " " * len(WORD_GAPS)))).alias("norm")))
    d = d.select("id", "site", F.xxhash64("text").alias("t"), F.explode(lines).alias("x"))
    d = d.where(F.size(words_of(F.col("x.norm"))) >= MIN_WORDS)
    return d.select("id", "t", "site", "x.pos", F.xxhash64("x.norm").alias("k1"), F.xxhash64(F.lit(1), "x.norm").alias("k2"))


def spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Rows (k1, k2, first) of the lines in at least `min_sites` distinct sites; first is the smallest id."""
    keys = ["k1", "k2"]
    sketches = lines.groupBy(*keys).agg(F.hll_sketch_agg("site", LG_CONFIG_K).alias("sites"), F.min("id").alias("first"))
    room = max(1.0, MARGIN * min_sites)
    rated = checkpoint(sketches.select(*keys, "first", F.hll_sketch_estimate("sites").alias("n")).where(F.col("n") >= min_sites - room))
    near = rated.where(F.col("n") <= min_sites + room).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = lines.select(*keys, "site", F.pmod(F.xxhash64("id", "t"), F.lit(SALTS)).cast("int").alias("salt"))
    exact = salted.join(near, [*keys, "salt"], "left_semi").select(*keys, "site").distinct().groupBy(*keys).agg(F.count("site").alias("exact"))
    return rated.join(exact, keys, "left").where(F.coalesce("exact", "n") >= min_sites).select(*keys, "first")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """`df` with boilerplate lines taken out of its texts, plus `n_lines` and `n_removed_lines`.

    A line (compared lower-cased and trimmed, three words or more) that at least `min_sites` distinct sites hold
    stays only in the document with the smallest id; other lines keep their order. Null sites don't count as a
    site. A null text stays null with no lines; rows with a null id never count as the first; rows of one id are one
    document, and equal rows get equal texts; an empty table gives an empty result. Extra columns pass through, but for
    `n_lines` and `n_removed_lines`, which are replaced. A very long text is split in one row, in memory of a few times
    its size; its lines then travel on their own.
    """
    lines = checkpoint(_lines(df, id_col, text_col, site_col))
    found = spread(lines, min_sites).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("id", "t"), F.lit(SALTS)).cast("int"))
    gone = salted.join(found, ["k1", "k2", "salt"]).where(~F.col("id").eqNullSafe(F.col("first")))
    gone = gone.groupBy("id", "t").agg(F.collect_set("pos"))
    own = [c for c in df.columns if c.lower() not in ("n_lines", "n_removed_lines")]
    h, line, left, of, t, lost = fresh(df, "h", "line", "left", "of", "t", "lost")
    gone = gone.toDF(of, t, lost)
    d = df.select(*own, F.xxhash64(text_col).alias(h))
    d = d.join(gone, d[id_col].eqNullSafe(gone[of]) & (d[h] == gone[t]), "left").withColumn(line, F.split(text_col, "\n", -1))
    d = d.withColumn(left, F.array_except(F.sequence(F.lit(0), F.size(line) - 1), F.coalesce(lost, F.array().cast("array<int>"))))
    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(line, i)), "\n"))
    n, n_lost = (F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long") for c in (line, lost))
    return d.select(*(text.alias(c) if c.lower() == text_col.lower() else F.col(c) for c in own), n.alias("n_lines"), n_lost.alias("n_removed_lines"))


def clean_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """`dedup_lines` with the columns of `df` only, without the documents that lost every line they had."""
    d = dedup_lines(df, id_col, text_col, site_col, min_sites)
    emptied = (F.col("n_removed_lines") > 0) & (F.size(words_of(F.col(text_col))) == 0)
    return d.where(~emptied).select(*df.columns)


#: SQL over `documents` with the same result as the query.
SQL = rf"""
with l as (select doc_id, source, i, ls[i] as line, trim(lower(translate(ls[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '))) as norm
 from (select doc_id, source, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, source, string_split(text, chr(10)) as ls from documents))),
m as (select *, len(regexp_extract_all(norm, '[^\x20\x09-\x0D]+')) >= {MIN_WORDS} as long_enough from l),
b as (select norm, min(doc_id) as first from m where long_enough group by norm having count(distinct source) >= {MIN_SITES}),
k as (select m.doc_id, i, line, b.norm is not null and m.doc_id <> b.first as gone from m left join b on m.norm = b.norm and m.long_enough)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed_lines, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from k group by doc_id
"""
