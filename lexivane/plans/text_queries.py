"""Registered queries over single documents: tokens, signals, scores. SQL beside each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import text as T
from ..operators import caches, lm
from ..operators.similarity import nearest_reference
from ..sources import readers
from .catalog import query, table

DOCS = "d as (select doc_id, lang, source, coalesce(text, '') as text from documents)"
TOKS = DOCS + ",\nt as (select *, regexp_extract_all(lower(text), '[a-zA-Z'']+') as toks from d)"


def grams_sql(toks: str, n: int) -> str:
    return f"list_transform(range(1, len({toks}) - {n - 2}), lambda i: " + " || ' ' || ".join(f"{toks}[i + {k}]" for k in range(n)) + ")"


def hits_sql(text: str) -> str:
    phrases = ", ".join("'" + p.replace("'", "''") + "'" for p in T.FILLER_PHRASES)
    return f"list_sum(list_transform([{phrases}], lambda p: (length(lower({text})) - length(replace(lower({text}), p, ''))) // length(p)))"


#: Six signals and the score of every document, as CTEs ending in `scored`.
SIGNALS = (
    TOKS
    + f""",
g as (select doc_id, unnest({grams_sql("toks", 3)}) as g from t where len(toks) >= 3),
gc as (select doc_id, g, count(*) as c from g group by all),
gs as (select doc_id, sum(c) as n, count(*) as kinds, sum(case when c > 1 then c else 0 end) as repeated from gc group by doc_id),
s as (select doc_id, len(regexp_extract_all(lower(x), '[a-zA-Z'']+')) as l from (select doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) as x from d)),
b as (select doc_id, count(*) as n, sum(l)::bigint as s, sum(l * l)::bigint as ss from s where l > 0 group by doc_id),
sig as (select t.doc_id, lang, source, text, toks, coalesce(repeated / gs.n, 0.0) as repetition,
 case when len(toks) > 0 then least(1.0, {hits_sql("text")} / greatest(1.0, len(toks) / 50.0)) else 0.0 end as filler_density,
 case when len(toks) > 0 then len(list_distinct(toks)) / len(toks) else 0.0 end as lexical_diversity,
 coalesce(kinds / gs.n, 0.0) as ngram_diversity,
 case when b.n >= 2 then least(1.0, sqrt((b.n * b.s_s - b.s * b.s)::double) / b.s) else 0.0 end as burstiness, 0.0::double as duplicate_similarity,
 case when b.n >= 2 then sqrt((b.n * b.s_s - b.s * b.s)::double) / b.s end as variation
 from t left join gs using (doc_id) left join (select doc_id, n, s, ss as s_s from b) b using (doc_id))"""
)


def score_sql(drop: tuple[str, ...] = ()) -> str:
    kept = [s for s in S.SIGNALS if s not in drop]
    if not kept:
        return "0.0::double"
    total = 0.0
    for s in kept:
        total += S.WEIGHTS[s]
    parts = " + ".join(f"{S.WEIGHTS[s]}::double * ({'1.0 - ' if s in S.INVERTED else ''}{s})" for s in kept)
    return f"round(100.0 * least(1.0, greatest(0.0, (0.0 + {parts}) / {total!r}::double)), 2)"


SCORED = SIGNALS + f",\nscored as (select *, {score_sql()} as synthetic_likelihood from sig)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@query(f"with {TOKS} select doc_id, len(toks)::bigint as n_tokens from t")
def tokens_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.word_tokens("text")).cast("long").alias("n_tokens"))


@query(f"with {TOKS} select doc_id, len(list_distinct(toks))::bigint as vocab from t")
def vocab_per_doc(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(F.array_distinct(T.word_tokens("text"))).cast("long").alias("vocab"))


@query(f"with {DOCS} select doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''))::bigint as n_sentences from d")
def sentence_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.sentences("text")).cast("long").alias("n_sentences"))


@query(f"with {SIGNALS} select doc_id, b.n::bigint as n_sentences, b.s as n_tokens, sig.variation from b join sig using (doc_id)")
def sentence_lengths(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.sentence_lengths("text").alias("lens")).where("size(lens) > 0")
    return d.select("doc_id", F.size("lens").cast("long").alias("n_sentences"), F.aggregate("lens", F.lit(0), lambda a, x: a + x).cast("long").alias("n_tokens"), S.variation("lens").alias("variation"))


@query(f"with {TOKS} select doc_id, len(b)::bigint as n_bigrams, len(list_distinct(b))::bigint as bigram_kinds, len(g)::bigint as n_trigrams, len(list_distinct(g))::bigint as trigram_kinds from (select doc_id, {grams_sql('toks', 2)} as b, {grams_sql('toks', 3)} as g from t)")
def ngram_counts(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.word_tokens("text").alias("t"))
    d = d.select("doc_id", *(T.ngram_hashes("t", n).alias(c) for n, c in ((2, "b"), (3, "g"))))
    size = lambda c: F.size(c).cast("long")
    return d.select("doc_id", size("b").alias("n_bigrams"), size(F.array_distinct("b")).alias("bigram_kinds"), size("g").alias("n_trigrams"), size(F.array_distinct("g")).alias("trigram_kinds"))


@query(f"with {DOCS} select doc_id, {hits_sql('text')}::bigint as hits from d")
def filler_hits(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.filler_hits("text").cast("long").alias("hits"))


@query(f"with {TOKS} select distinct doc_id, md5(g) as shingle, left(md5(g), 12) as short_shingle from (select doc_id, unnest(case when len(toks) < 5 then [array_to_string(toks, ' ')] else {grams_sql('toks', 5)} end) as g from t)")
def shingles_md5(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.explode(T.shingles(T.word_tokens("text"))).alias("g"))
    return d.select("doc_id", F.md5("g").alias("shingle"), F.substring(F.md5("g"), 1, 12).alias("short_shingle"))


MARKED = "regexp_extract_all(lower(text), '[a-zA-Z'']+|[.!?]')"


@query(f"with {DOCS} select doc_id, len(m)::bigint as n_marked, len(list_filter(m, lambda x: regexp_matches(x, '^[a-z]+$')))::bigint as n_alpha from (select doc_id, {MARKED} as m from d)")
def marked_and_alpha_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.marked_tokens("text")).cast("long").alias("n_marked"), F.size(T.alpha_tokens("text")).cast("long").alias("n_alpha"))


SQUASHED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"with {DOCS}, w as (select doc_id, list_filter(string_split({SQUASHED}, ' '), lambda x: x <> '') as w from d) select doc_id, array_to_string(w[1:250], ' ') as text from w where len(w) >= 60")
def clean_truncate(spark, sf_dir):
    return readers.clean_answers(_docs(spark, sf_dir), "text").select("doc_id", "text")


@query(rf"with {DOCS} select doc_id, regexp_replace(text, '\s+([.!?])', '\1', 'g') as text from d")
def tidy_marks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.tidy_marks("text").alias("text"))


@query(f"with {TOKS} select doc_id, case when len(toks) > 0 then list_sum(list_transform(toks, lambda w: length(w))) / len(toks) else 0.0 end as mean_word_length from t")
def mean_word_length(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.mean_word_length(T.word_tokens("text")).alias("mean_word_length"))


def _rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


@query(f"with {SIGNALS} select doc_id, {_rounded(*S.SIGNALS)} from sig")
def probe_signals(spark, sf_dir):
    return S.with_signals(_docs(spark, sf_dir)).select("doc_id", *(F.round(s, 6).alias(s) for s in S.SIGNALS))


REASONS = """concat_ws('; ', case when duplicate_similarity > 0.4 then 'high overlap with known synthetic outputs (recycling)' end, case when filler_density > 0.4 then 'dense canned filler phrasing' end,
 case when lexical_diversity < 0.45 then 'low lexical diversity' end, case when burstiness < 0.35 then 'uniform sentence lengths' end, case when repetition > 0.2 then 'repeated trigrams' end)"""


@query(f"with {SCORED} select doc_id, synthetic_likelihood, synthetic_likelihood >= 50 as is_synthetic, coalesce(nullif({REASONS}, ''), 'varied vocabulary and sentence structure') as explanation from scored")
def probe_score(spark, sf_dir):
    return S.score(_docs(spark, sf_dir)).select("doc_id", "synthetic_likelihood", "is_synthetic", "explanation")


#: Largest Jaccard with a benchmark text, as CTE `near`.
NEAREST = f"""bt as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z'']+') as toks from benchmark),
bs as (select distinct item_id, unnest(case when len(toks) < 5 then [array_to_string(toks, ' ')] else {grams_sql("toks", 5)} end) as g from bt),
bn as (select *, count(*) over (partition by item_id) as nb from bs),
ds as (select distinct doc_id, unnest(case when len(toks) < 5 then [array_to_string(toks, ' ')] else {grams_sql("toks", 5)} end) as g from t),
dn as (select *, count(*) over (partition by doc_id) as na from ds),
near as (select doc_id, max(o / (na + nb - o)) as similarity from (select doc_id, item_id, na, nb, count(*) as o from dn join bn using (g) group by all) group by doc_id)"""


@query(f"with {TOKS}, {NEAREST} select doc_id, round(similarity, 6) as similarity from near")
def duplicate_similarity(spark, sf_dir):
    near = nearest_reference(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return near.select("doc_id", F.round("similarity", 6).alias("similarity"))


@query(f"with {SIGNALS}, {NEAREST}, r as (select * replace (coalesce(similarity, 0.0) as duplicate_similarity) from sig left join near using (doc_id)) select doc_id, {score_sql()} as synthetic_likelihood from r")
def probe_score_with_references(spark, sf_dir):
    d = S.score(_docs(spark, sf_dir), references=table(spark, sf_dir, "benchmark").select("text"))
    return d.select("doc_id", "synthetic_likelihood")


@query(f"with {SIGNALS} select doc_id, " + ", ".join(f"{score_sql((s,))} as without_{s}" for s in S.SIGNALS) + f", {score_sql(S.SIGNALS)} as without_all from sig")
def scores_without(spark, sf_dir):
    d = S.with_signals(_docs(spark, sf_dir))
    return d.select("doc_id", *(S.combine([s]).alias(f"without_{s}") for s in S.SIGNALS), S.combine(S.SIGNALS).alias("without_all"))


@query(f"with {SCORED} select source, count(*)::bigint as total, count(*) filter (where synthetic_likelihood >= 50)::bigint as predicted_synthetic, round(count(*) filter (where synthetic_likelihood >= 50) / count(*), 4) as estimated_contamination from scored group by source")
def flagged_by_source(spark, sf_dir):
    return S.verdict(S.score(_docs(spark, sf_dir)), "source")


# Language models


PADDED = TOKS + ", p as (select doc_id, lang, ['<s>'] || toks || ['</s>'] as p from t)"
PAIRS = PADDED + ", tr as (select doc_id, lang, p[i] as a, p[i + 1] as b from (select doc_id, lang, p, unnest(range(1, len(p))) as i from p))"


@query(f"with {PADDED} select w, count(*)::bigint as c from (select unnest(p) as w from p) group by w")
def unigram_counts(spark, sf_dir):
    return lm.unigram_counts(_docs(spark, sf_dir))


@query(f"with {PAIRS} select a, b, count(*)::bigint as c from tr group by a, b")
def bigram_counts(spark, sf_dir):
    return lm.bigram_counts(_docs(spark, sf_dir))


@query(f"with {DOCS}, m as (select {MARKED} as m from d) select g, count(*)::bigint as c from (select unnest({grams_sql('m', 3)}) as g from m where len(m) >= 3) group by g")
def trigram_counts(spark, sf_dir):
    return lm.gram_counts(_docs(spark, sf_dir), 3)


@query(f"with {DOCS}, m as (select {MARKED} as m from d) select m[1] as w1, m[2] as w2, count(*)::bigint as c from m where len(m) >= 2 group by all")
def start_pairs(spark, sf_dir):
    return lm.start_pairs(_docs(spark, sf_dir))


@query(f"with {DOCS}, m as (select {MARKED} as m from d), c as (select m[i] as context, m[i + 1] as w, count(*)::bigint as c from (select m, unnest(range(1, len(m))) as i from m) group by all) select context, w, c, sum(c) over (partition by context order by w)::bigint as upto, sum(c) over (partition by context)::bigint as total from c")
def next_word_steps(spark, sf_dir):
    return lm.next_words(lm.gram_counts(_docs(spark, sf_dir), 2))


#: Bits per transition of every document under the model of the English ones, as CTE `ce`.
ENTROPY = (
    PAIRS
    + """, u as (select w, count(*) as c from (select unnest(p) as w from p where lang = 'en') group by w), bg as (select a, b, count(*) as c from tr where lang = 'en' group by a, b),
ce as (select doc_id, avg(-log2((coalesce(bg.c, 0) + 0.5::double) / (coalesce(u.c, 0) + 0.5::double * (select count(*) from u)))) as bits from tr left join bg on tr.a = bg.a and tr.b = bg.b left join u on u.w = tr.a group by doc_id)"""
)


@query(f"with {ENTROPY} select doc_id, round(bits, 6) as bits from ce")
def cross_entropy(spark, sf_dir):
    return lm.part_entropy(_docs(spark, sf_dir), F.expr("lang = 'en'")).select("doc_id", F.round("bits", 6).alias("bits"))


# Caches and sets of texts


CACHE = "cache as (select md5(coalesce(text, '')) as h, min(n_chars)::double as feature from documents where lang <> 'fr' group by 1)"


def _cache(spark, sf_dir):
    d = caches.with_key(table(spark, sf_dir, "documents").where("lang <> 'fr'"))
    return d.groupBy("h").agg(F.min("n_chars").cast("double").alias("feature"))


@query(f"with {CACHE} select doc_id, md5(coalesce(text, '')) as h, feature from documents left join cache on h = md5(coalesce(text, ''))")
def cache_lookup(spark, sf_dir):
    return caches.lookup(caches.with_key(_docs(spark, sf_dir)), _cache(spark, sf_dir)).select("doc_id", "h", "feature")


@query(f"with {CACHE} select distinct md5(coalesce(text, '')) as h from documents where md5(coalesce(text, '')) not in (select h from cache)")
def cache_missing(spark, sf_dir):
    return caches.missing(caches.with_key(_docs(spark, sf_dir)), _cache(spark, sf_dir)).select("h")


@query("""with p as (select 0 as part, doc_id as id, coalesce(text, '') as text from documents union all select 1, item_id, coalesce(text, '') from benchmark)
select md5(text) as h, arg_min(part, part * 1000000000 + id)::int as part, arg_min(id, part * 1000000000 + id)::bigint as id from p group by text""")
def distinct_union(spark, sf_dir):
    parts = [_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")]
    return caches.distinct_union(parts, "id").select("h", "part", "id")


@query("select min(doc_id)::bigint as doc_id from documents group by substr(text, 1, 80)")
def first_by_prefix(spark, sf_dir):
    return caches.first_by_prefix(_docs(spark, sf_dir), "text", "doc_id").select("doc_id")
