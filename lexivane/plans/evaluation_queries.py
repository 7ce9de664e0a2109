"""Registered queries that evaluate detectors: ranks, ROC, thresholds, ablation, splits, classifiers and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import text as T
from ..operators import caches, classify, evaluation as E, lm, neural, sampling, stats
from .catalog import query, table
from .text_queries import ENTROPY, SCORED, SIGNALS, score_sql


def _scored(spark, sf_dir):
    """Labelled documents with their signals and score."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return S.score(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").join(labels, "doc_id"))


JUDGED = SCORED + ",\nj as (select scored.*, quality, toxic from scored join labels using (doc_id))"


def auc_sql(rows: str, score: str, label: str, by: str = "") -> str:
    """AUC over rows of a CTE, from average ranks."""
    part = f"partition by {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""select {keys}n_pos::bigint as n_pos, n_neg::bigint as n_neg, round(case when n_pos = 0 or n_neg = 0 then 0.5 else (rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) end, 6) as auc from (select {keys}sum(r) filter (where y = 1) as rs, count(*) filter (where y = 1) as n_pos, count(*) filter (where y <> 1) as n_neg
 from (select {keys}{label} as y, rank() over ({part} order by {score}) + (count(*) over (partition by {keys}{score}) - 1) / 2.0 as r from {rows}) {f"group by {by}" if by else ""})"""


@query(f"with {JUDGED} select doc_id, synthetic_likelihood, rank() over (order by synthetic_likelihood) + (count(*) over (partition by synthetic_likelihood) - 1) / 2.0::double as avg_rank from j")
def average_ranks(spark, sf_dir):
    return E.average_ranks(_scored(spark, sf_dir).select("doc_id", "synthetic_likelihood"), "synthetic_likelihood")


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"with {JUDGED} {auc_sql('j', 'synthetic_likelihood', 'quality')}")
def roc_auc_quality(spark, sf_dir):
    return _round(E.roc_auc(_scored(spark, sf_dir), "synthetic_likelihood", "quality"), "auc")


@query(f"with {JUDGED} {auc_sql('j', 'synthetic_likelihood', 'toxic', 'lang')}")
def roc_auc_toxic_by_lang(spark, sf_dir):
    return _round(E.roc_auc(_scored(spark, sf_dir), "synthetic_likelihood", "toxic", "lang"), "auc")


TURNS = "c as (select conv_id * 1000 + turn as id, role, coalesce(text, '') as text from conversations where role <> 'system'), tt as (select id, case when role = 'assistant' then 1 else 0 end as y, regexp_extract_all(lower(text), '[a-zA-Z'']+') as toks from c), tm as (select id, y, case when len(toks) > 0 then list_sum(list_transform(toks, lambda w: length(w))) / len(toks) else 0.0 end as s from tt)"


@query(f"with {TURNS}, a as ({auc_sql('tm', 's', 'y')}) select n_pos, n_neg, round(greatest(auc, 1 - auc), 6) as auc from a")
def directed_auc_role(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'")
    d = turns.select((F.col("role") == "assistant").cast("int").alias("y"), T.mean_word_length(T.word_tokens("text")).alias("s"))
    return _round(_round(E.directed_auc(d, "s", "y"), "auc"), "auc")


@query(f"""with {JUDGED}, k as (select row_number() over (order by synthetic_likelihood desc, doc_id) as k, sum(case when quality = 1 then 1 else 0 end) over w as tp, sum(case when quality = 1 then 0 else 1 end) over w as fp from j window w as (order by synthetic_likelihood desc, doc_id rows unbounded preceding)),
z as (select 0 as k, 0 as tp, 0 as fp union all select * from k), n as (select max(k) as n, max(tp) as p, max(fp) as q from z),
i as (select i, floor(i * ((n + 1) / 60.0::double))::bigint as k from n, range(60) r(i) where n + 1 > 60 union all select 60, n from n where n + 1 > 60 union all select k, k from z, n where n + 1 <= 60)
select i::bigint as point, round(fp / q, 4) as fpr, round(tp / p, 4) as tpr from i join z using (k), n""")
def roc_points(spark, sf_dir):
    return E.roc_points(_scored(spark, sf_dir), "synthetic_likelihood", "quality", "doc_id")


def best_f1_sql(rows: str, score: str, label: str, by: str = "") -> str:
    part, keys = (f"partition by {by} ", f"{by}, ") if by else ("", "")
    return f"""select {keys}threshold, round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from (select {keys}threshold, (tp + nn - fp) / (np + nn) as accuracy, tp / (tp + fp) as precision, case when np > 0 then tp / np else 0.0 end as recall, case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / np) / (tp / (tp + fp) + tp / np) else 0.0 end as f1
 from (select {keys}threshold, sum(pos) over ({part}order by threshold desc) as tp, sum(neg) over ({part}order by threshold desc) as fp, sum(pos) over ({part}) as np, sum(neg) over ({part}) as nn from (select {keys}{score} as threshold, count(*) filter (where {label} = 1) as pos, count(*) filter (where {label} <> 1) as neg from {rows} group by {keys}{score}))) qualify row_number() over ({part}order by f1 desc, threshold) = 1"""


@query(f"with {JUDGED} {best_f1_sql('j', 'synthetic_likelihood', 'quality')}")
def best_f1_quality(spark, sf_dir):
    return _round(E.best_f1(_scored(spark, sf_dir), "synthetic_likelihood", "quality"), "accuracy", "precision", "recall", "f1")


@query(f"""with {JUDGED}, x as (select lang, count(*) filter (where f and a) as tp, count(*) filter (where f and not a) as fp, count(*) filter (where not f and a) as fn, count(*) filter (where not f and not a) as tn from (select lang, synthetic_likelihood >= 50 as f, quality = 0 as a from j) group by lang),
r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall from x)
select lang, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end, 6) as f1 from r""")
def confusion_by_lang(spark, sf_dir):
    d = E.confusion(_scored(spark, sf_dir), F.col("is_synthetic"), F.col("quality") == 0, "lang")
    return _round(d, "accuracy", "precision", "recall", "f1")


_VARIANTS = {"full": ()} | {f"w{k}": (s,) for k, s in enumerate(S.SIGNALS)} | {f"o{k}": tuple(x for x in S.SIGNALS if x != s) for k, s in enumerate(S.SIGNALS)}


@query(f"""with {SIGNALS}, v as (select quality, unnest([{", ".join(f"struct_pack(variant := '{k}', score := {score_sql(d)})" for k, d in _VARIANTS.items())}], recursive := true) from sig join labels using (doc_id)), a as ({auc_sql("v", "score", "quality", "variant")})
{" union all ".join(f"select '{s}' as signal, w.auc as leave_one_out_auc, round(f.auc - w.auc, 5) as delta_auc, o.auc as solo_auc from a w, a o, a f where w.variant = 'w{k}' and o.variant = 'o{k}' and f.variant = 'full'" for k, s in enumerate(S.SIGNALS))}""")
def ablation(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = S.with_signals(table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id"))
    rows = E.ablation(d, "quality")
    return rows.select("signal", F.round("leave_one_out_auc", 6).alias("leave_one_out_auc"), F.round(F.round("delta_auc", 6), 5).alias("delta_auc"), F.round("solo_auc", 6).alias("solo_auc"))


SPLIT = "sp as (select doc_id, quality, row_number() over (partition by quality order by md5('1234:' || doc_id), doc_id) as r, count(*) over (partition by quality) as n from labels)"


@query(f"with {SPLIT} select doc_id, quality, r <= floor(n * 0.7::double) as is_train from sp")
def stratified_split(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", F.col("doc_id"))


@query(f"with {SPLIT} select doc_id, quality from sp where r <= (select min(n) from sp)")
def balanced_sample(spark, sf_dir):
    return sampling.balanced(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", F.col("doc_id"))


@query(f"with {JUDGED} select round(coalesce(avg(synthetic_likelihood) filter (where quality = 0), 0) - coalesce(avg(synthetic_likelihood) filter (where quality <> 0), 0), 4) as separation from j")
def class_separation(spark, sf_dir):
    d = E.separation(_scored(spark, sf_dir), "synthetic_likelihood", F.col("quality") == 0)
    return d.select(F.round("separation", 4).alias("separation"))


def _method_sql(name: str, score: str) -> str:
    return f"""select '{name}' as name, a.auc, flipped as sign_flipped, b.* from (select * from fl where name = '{name}') f, lateral (select 1) l, ({auc_sql(f"(select doc_id, y, {score} * (select case when flipped then -1 else 1 end from fl where name = '{name}') as s from ev where not is_train)", 's', 'y')}) a, ({best_f1_sql(f"(select y, {score} * (select case when flipped then -1 else 1 end from fl where name = '{name}') as s from ev where not is_train)", 's', 'y')}) b"""


@query(f"""with {SCORED}, {SPLIT}, ml as (select doc_id, case when len(toks) > 0 then list_sum(list_transform(toks, lambda w: length(w))) / len(toks) else 0.0 end as mean_len from t),
ev as (select doc_id, quality as y, r <= floor(n * 0.7::double) as is_train, synthetic_likelihood as probe, round(mean_len, 6) as mean_word_length from sp join scored using (doc_id) join ml using (doc_id)),
fl as (select 'probe' as name, false as flipped union all select 'mean_word_length', (select auc from ({auc_sql("(select * from ev where is_train)", "mean_word_length", "y")})) < 0.5)
{_method_sql("probe", "probe")} union all {_method_sql("mean_word_length", "mean_word_length")}""".replace(", lateral (select 1) l", ""))
def evaluate_methods(spark, sf_dir):
    d = _scored(spark, sf_dir).withColumn("mean_word_length", F.round(T.mean_word_length(T.word_tokens("text")), 6))
    d = sampling.split(d.select("doc_id", "quality", F.col("synthetic_likelihood").alias("probe"), "mean_word_length"), "quality", F.col("doc_id"))
    train, test = d.where("is_train"), d.where("not is_train")
    rows = E.evaluate_method(None, test, "probe", "quality", "probe").union(E.evaluate_method(train, test, "mean_word_length", "quality", "mean_word_length"))
    return _round(rows, "auc", "accuracy", "precision", "recall", "f1")


@query(f"with {ENTROPY}, e as (select bits, quality from ce join labels using (doc_id)), x as (select round(bits, 6) as s, quality from e) {auc_sql('x', 's', 'quality')}")
def perplexity_auc(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    bits = lm.part_entropy(d, F.expr("lang = 'en'")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return _round(E.roc_auc(bits.withColumn("s", F.round("bits", 6)), "s", "quality"), "auc")


# Scores of a language model


MOST_WORDS = 50_000
_RANKED = f"""{JUDGED}, uw as (select w, count(*) as c from (select unnest(toks) as w from t where lang = 'en') group by w order by c desc, w limit {MOST_WORDS}),
ur as (select w, c, count(*) over (order by c desc range between unbounded preceding and current row) as r, sum(c) over () as n, count(*) over () as v from uw), un as (select sum(c) as n, count(*) as v from uw),
tk as (select doc_id, unnest(toks[1:192]) as w from t), rf as (select doc_id, avg(ln((coalesce(c, 0) + 1) / (un.n + un.v))) as mean_logp, avg(case when coalesce(r, un.v + 1) <= 10 then 1.0 else 0.0 end) as frac_topk from tk left join ur using (w), un group by doc_id)"""


def _ranks(spark, sf_dir):
    """Token ranks of the labelled documents under the word frequencies of the English ones."""
    d = table(spark, sf_dir, "documents")
    words = d.where("lang = 'en'").select(F.explode(T.word_tokens("text")).alias("w")).groupBy("w").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "w").limit(MOST_WORDS)
    score = neural.rank_scorer(neural.unigram_ranks([tuple(r) for r in words.collect()]))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("x", score(F.col("text")))


@query(f"with {_RANKED} select doc_id, round(mean_logp, 6) as mean_logp, round(frac_topk, 6) as frac_topk from rf join j using (doc_id)")
def rank_features(spark, sf_dir):
    d = caches.usable(_ranks(spark, sf_dir).select("doc_id", "x.mean_logp", "x.frac_topk"), "mean_logp", "frac_topk")
    return d.select("doc_id", F.round("mean_logp", 6).alias("mean_logp"), F.round("frac_topk", 6).alias("frac_topk"))


@query(f"with {_RANKED}, f as (select quality, unnest([struct_pack(feature := 'mean_logp', s := round(mean_logp, 6)), struct_pack(feature := 'frac_topk', s := round(frac_topk, 6)), struct_pack(feature := 'probe', s := synthetic_likelihood)], recursive := true) from rf join j using (doc_id)), a as ({auc_sql('f', 's', 'quality', 'feature')}) select feature, n_pos, n_neg, round(greatest(auc, 1 - auc), 6) as auc from a")
def rank_feature_table(spark, sf_dir):
    """Each feature's directed AUC, over the documents that the cache of features has whole."""
    cache = caches.with_key(_ranks(spark, sf_dir)).groupBy("h").agg(F.first("x").alias("x")).select("h", "x.*")
    d = caches.usable(caches.lookup(caches.with_key(_scored(spark, sf_dir)), cache), "mean_logp", "frac_topk")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), v.alias("s")) for k, v in (("mean_logp", F.round("mean_logp", 6)), ("frac_topk", F.round("frac_topk", 6)), ("probe", F.col("synthetic_likelihood"))))))
    return _round(_round(E.directed_auc(d.select("quality", each.alias("f")).select("quality", "f.*"), "s", "quality", "feature"), "auc"), "auc")


@query(f"with {SCORED}, o as (select * from t order by doc_id limit 60) select round(coalesce(avg(exp(least(20.0, length(text) / 400.0))), 'nan'::double), 4) as ref_perplexity from o where len(toks) >= 2")
def reference_perplexity(spark, sf_dir):
    """Mean perplexity of the first documents under a pluggable scorer, here one of lengths; texts of under two words have no loss."""
    loss = neural.scorer(lambda: lambda texts: [len(t) / 400 if len(neural._WORD.findall(t)) >= 2 else float("nan") for t in texts])
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neural.mean_perplexity(d, loss, 60, "doc_id").select(F.round("ref_perplexity", 4).alias("ref_perplexity"))


# Classifiers


@query(f"with {SIGNALS} select doc_id, " + ", ".join(f"round(({s} - avg({s}) over ()) / case when stddev_pop({s}) over () > 1e-9 then stddev_pop({s}) over () else 1 end, 5) as {s}" for s in S.SIGNALS) + " from sig")
def standardised_signals(spark, sf_dir):
    d = S.with_signals(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classify.standardise(d.select("doc_id", *S.SIGNALS), *S.SIGNALS).select("doc_id", *(F.round(s, 5).alias(s) for s in S.SIGNALS))


def descent_sql(rows: str, keys: str, label: str, train: str, features: tuple[str, ...]) -> str:
    """CTEs st, z and w: standardised rows, and the weights of each of `keys` after every step of the descent."""
    on, each = f"using ({keys})", range(1, len(features) + 1)
    z = "b + " + " + ".join(f"w{j} * z{j}" for j in each)
    sigmoid = "case when {0} < -35 then 0.0 when {0} > 35 then 1.0 else 1 / (1 + exp(-({0}))) end"
    moments = ", ".join(f"avg({f}) as m{j}, stddev_pop({f}) as s{j}" for j, f in zip(each, features))
    scaled = ", ".join(f"({f} - m{j}) / case when s{j} > 1e-9 then s{j} else 1 end as z{j}" for j, f in zip(each, features))
    steps = ", ".join(f"any_value(w{j}) - 0.5 * (avg(err * z{j}) + 0.001 * any_value(w{j}))" for j in each)
    return f"""st as (select {keys}, {moments} from {rows} where {train} group by {keys}),
z as materialized (select r.*, {scaled} from {rows} r join st {on}),
w as (select {keys}, 0 as e, 0.0::double as b, {", ".join(f"0.0::double as w{j}" for j in each)} from st
 union all select {keys}, e + 1, any_value(b) - 0.5 * avg(err), {steps} from (select w.*, {", ".join(f"z{j}" for j in each)}, {sigmoid.format(f"({z})")} - {label} as err from w join z {on} where {train} and e < 300) group by {keys}, e),
p as (select z.*, round({sigmoid.format(f"({z})")}, 9) as p from z join w {on} where e = 300)"""


_ALL = f"x as (select 1 as fold, true as is_train, quality as y, {', '.join(S.SIGNALS)} from sig join labels using (doc_id))"


@query(f"with recursive {SIGNALS}, {_ALL}, {descent_sql('x', 'fold', 'y', 'is_train', S.SIGNALS)} " + " union all ".join(f"select '{f}' as feature, round({c}, 6) + 0.0 as weight from w where e = 300" for f, c in zip((*S.SIGNALS, "bias"), (*(f"w{j}" for j in range(1, 7)), "b"))))
def logistic_regression(spark, sf_dir):
    d = _scored(spark, sf_dir).select("quality", *S.SIGNALS)
    model = classify.LogisticRegression().fit(d, "quality", *S.SIGNALS)
    return spark.createDataFrame([(s, round(float(w), 6) + 0.0) for s, w in zip((*S.SIGNALS, "bias"), (*model.weights, model.bias))], "feature string, weight double")


def _junk_texts(spark, sf_dir):
    """Labelled documents; those of low quality are the positives, grouped by language."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("junk"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(labels, "doc_id")


def _junk(spark, sf_dir):
    return S.with_signals(_junk_texts(spark, sf_dir))


PERPLEXED = """fb as (select {keys}, a, b, sum(n) as c from m join tr using (doc_id) where is_train group by all), fu as (select {keys}, a, sum(c) as c from fb group by all), fv as (select {keys}, count(*) + 1 as v from fu group by all),
px as (select {keys}, doc_id, round(sum(n * -log2((coalesce(fb.c, 0) + 0.5) / (coalesce(fu.c, 0) + 0.5 * v))) / sum(n), 9) as perplexity from m join tr using (doc_id) left join fb using ({keys}, a, b) left join fu using ({keys}, a) join fv using ({keys}) group by {keys}, doc_id)"""
LABELLED = f"""lab as materialized (select doc_id, lang, case when quality = 0 then 1 else 0 end as y, toks, {", ".join(S.SIGNALS)} from sig join labels using (doc_id)),
tr as materialized (select doc_id, a, b, count(*) as n from (select doc_id, p[i] as a, p[i + 1] as b from (select doc_id, p, unnest(range(1, len(p))) as i from (select doc_id, list_concat(['<s>'], toks, ['</s>']) as p from lab))) group by all)"""


def folds_sql(seeds: tuple[int, ...]) -> str:
    """CTEs ending in `folds`, a row for each seed and held-out language with its AUCs, F1 and weights, and `w`."""
    turned = lambda kind: auc_sql(f"(select seed, held, y, perplexity from p where is_train = {kind})", "perplexity", "y", "seed, held")
    return f"""{SIGNALS}, {LABELLED},
seeds as (select unnest([{", ".join(map(str, seeds))}]) as seed),
neg as (select seed, doc_id, row_number() over (partition by seed order by md5(seed || ':' || doc_id), doc_id) <= floor(count(*) over (partition by seed) * {5 / 6!r}::double) as is_train from lab, seeds where y = 0),
held as (select distinct lang as held from lab where y = 1 and lang is not null),
m as materialized (select s.seed, held, l.doc_id, y, case when y = 1 then lang <> held else is_train end as is_train from lab l cross join seeds s cross join held left join neg n on n.doc_id = l.doc_id and n.seed = s.seed where y = 0 or lang is not null),
{PERPLEXED.format(keys="seed, held")},
x as materialized (select m.seed, m.held, m.doc_id, m.y, m.is_train, {", ".join(S.SIGNALS)}, perplexity from m join px using (seed, held, doc_id) join lab using (doc_id)),
{descent_sql("x", "seed, held", "y", "is_train", (*S.SIGNALS, "perplexity"))},
te as (select *, {score_sql()} as probe from p where not is_train),
folds as (select c.seed, c.held, c.n_pos + c.n_neg as n_test, c.auc as classifier_auc, f.f1 as classifier_f1, h.auc as probe_auc, case when tx.auc < 0.5 then 1 - px_.auc else px_.auc end as perplexity_auc
 from ({auc_sql("te", "p", "y", "seed, held")}) c join ({best_f1_sql("te", "p", "y", "seed, held")}) f using (seed, held) join ({auc_sql("te", "probe", "y", "seed, held")}) h using (seed, held) join ({turned("false")}) px_ using (seed, held) join ({turned("true")}) tx using (seed, held))"""


ONE_SEED = folds_sql((sampling.SEED,))
_AUCS = ("classifier_auc", "probe_auc", "perplexity_auc")


@query(f"with recursive {ONE_SEED} select held as held_out, n_test::bigint as n_test, round(classifier_f1, 5) as classifier_f1, {', '.join(f'round({c}, 5) as {c}' for c in _AUCS)} from folds")
def leave_one_group_out(spark, sf_dir):
    d = classify.leave_one_group_out(_junk(spark, sf_dir), "junk", "lang")
    return d.select("held_out", "n_test", *(F.round(F.round(c, 6), 5).alias(c) for c in ("classifier_f1", *_AUCS)))


@query(f"with recursive {ONE_SEED} " + " union all ".join(f"select '{c}' as metric, round(avg({c}), 4) as mean, round(min({c}), 4) as least, round(max({c}), 4) as most from folds" for c in _AUCS))
def fold_summary(spark, sf_dir):
    d = classify.summary(classify.leave_one_group_out(_junk(spark, sf_dir), "junk", "lang"), *_AUCS)
    return d.select("metric", *(F.round(c, 4).alias(c) for c in ("mean", "least", "most")))


@query(f"with recursive {ONE_SEED} " + " union all ".join(f"select '{f}' as feature, round(avg(abs(w{j})), 5) as mean_abs_coef from w where e = 300" for j, f in enumerate(classify.FEATURES, 1)))
def feature_importance(spark, sf_dir):
    d = classify.importance(classify.leave_one_group_out(_junk(spark, sf_dir), "junk", "lang"))
    return d.select("feature", F.round("mean_abs_coef", 5).alias("mean_abs_coef"))


MANY_SEEDS = folds_sql(classify.SEEDS) + ", sm as (select seed, avg(classifier_auc) as classifier_auc, avg(perplexity_auc) as perplexity_auc, avg(probe_auc) as probe_auc from folds group by seed)"


@query(f"with recursive {MANY_SEEDS} " + " union all ".join(f"select '{c}' as metric, count(*)::bigint as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(avg({c}) - 2.262 * stddev_samp({c}) / sqrt(10), 4) as ci_low, round(avg({c}) + 2.262 * stddev_samp({c}) / sqrt(10), 4) as ci_high from sm" for c in _AUCS))
def seeded_folds(spark, sf_dir):
    d = classify.seed_summary(classify.seed_means(_junk(spark, sf_dir), "junk", "lang"))
    return d.select("metric", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "ci_low", "ci_high")))


@query(f"""with recursive {MANY_SEEDS}, q as (select seed, classifier_auc - perplexity_auc as d from sm), o as (select d, row_number() over (order by seed) - 1 as k from q), f as (select i, abs(sum(case when (i >> k) & 1 = 1 then d else -d end) / 10) as mean from o, range(1024) r(i) group by i)
select count(*)::bigint as n, round(avg(d), 4) as mean_diff, round(stddev_samp(d), 4) as std_diff, count(*) filter (where d > 0)::bigint as wins, (select round(avg(case when f.mean >= abs((select avg(d) from q)) - 1e-9 then 1.0 else 0.0 end), 6) from f) as p from q""")
def seeded_comparison(spark, sf_dir):
    d = classify.seed_comparison(classify.seed_means(_junk(spark, sf_dir), "junk", "lang"))
    return d.select("n", F.round("mean_diff", 4).alias("mean_diff"), F.round("std_diff", 4).alias("std_diff"), "wins", F.round("p", 6).alias("p"))


@query(f"""with {SIGNALS}, {LABELLED}, held as (select distinct lang as fold from lab where y = 1 union all select 'POOLED'),
r as (select fold, doc_id, y, row_number() over (partition by fold, y order by md5('1234:' || doc_id), doc_id) as r, count(*) filter (where y = 1) over (partition by fold) as n1, count(*) filter (where y = 0) over (partition by fold) as n0 from lab, held where y = 0 or fold = 'POOLED' or lang = fold),
m as materialized (select fold, doc_id, y, r <= floor(least(n0, n1) * 0.6::double) as is_train from r where r <= least(n0, n1)),
{PERPLEXED.format(keys="fold")}, x as (select fold, y, is_train, perplexity, {score_sql()} as probe from m join px using (fold, doc_id) join (select doc_id, {", ".join(S.SIGNALS)} from lab) using (doc_id)), te as (select * from x where not is_train), tx as (select * from x where is_train)
select fold as model, n_machine::bigint as n_machine, n_test::bigint as n_test, round(h.auc, 5) as probe_auc, round(f.f1, 5) as probe_f1, round(case when k.auc < 0.5 then 1 - g.auc else g.auc end, 5) as perplexity_auc from (select fold, count(*) filter (where y = 1) as n_machine, count(*) filter (where not is_train) as n_test from x group by fold)
 join ({auc_sql("te", "probe", "y", "fold")}) h using (fold) join ({best_f1_sql("te", "probe", "y", "fold")}) f using (fold) join ({auc_sql("te", "perplexity", "y", "fold")}) g using (fold) join ({auc_sql("tx", "perplexity", "y", "fold")}) k using (fold)""")
def cross_group(spark, sf_dir):
    d = classify.cross_group(_junk_texts(spark, sf_dir), "junk", "lang")
    return d.select("model", "n_machine", "n_test", *(F.round(F.round(c, 6), 5).alias(c) for c in ("probe_auc", "probe_f1", "perplexity_auc")))


# Statistics over seeds


_VALUES = "v as (select source, avg(n_chars)::double as x from documents group by source)"


@query(f"with {_VALUES} select count(*)::bigint as n, round(avg(x), 4) as mean, round(stddev_samp(x), 4) as std, round(avg(x) - 1.96 * stddev_samp(x) / sqrt(count(*)), 4) as ci_low, round(avg(x) + 1.96 * stddev_samp(x) / sqrt(count(*)), 4) as ci_high from v")
def mean_interval(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.avg("n_chars").alias("x"))
    return stats.mean_interval(d, "x").select("n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "ci_low", "ci_high")))


_DIFFS = "q as (select source, avg(quality) - avg(1 - toxic) as d from documents join labels using (doc_id) group by source), n as (select count(*) as n from q), o as (select *, row_number() over (order by source) - 1 as k from q)"


@query(f"with {_DIFFS}, f as (select i, abs(sum(case when (i >> k) & 1 = 1 then d else -d end) / any_value(n)) as m from o, n, range((1 << (select n from n))::bigint) r(i) group by i) select (select n from n)::bigint as n, round(avg(d), 6) as mean_diff, count(*) filter (where d > 0)::bigint as wins, (select round(avg(case when m >= abs((select avg(d) from q)) - 1e-9 then 1.0 else 0.0 end), 6) from f) as p from q")
def sign_flip_test(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source")
    d = d.agg((F.avg("quality") - F.avg(1 - F.col("toxic"))).alias("d"))
    return stats.sign_flip_test(d, "d", "source").select("n", F.round("mean_diff", 6).alias("mean_diff"), "wins", F.round("p", 6).alias("p"))
