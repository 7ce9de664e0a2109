"""Registered queries that simulate: generated stand-ins, controlled experiments and recursive collapse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals
from . import collapse, demo, simulate
from .catalog import query, table
from .standins import datasets_sql, generation_specs, make_datasets
from .text_queries import DOCS, MARKED, NEAREST, SCORED, SIGNALS, grams_sql, score_sql

_MIXED = [(0.0, 25, 0.5, 1), (1.0, 25, 0.3, 2), (2.0, 10, 1.0, 4), (3.0, 10, 0.0, 3)]


@query(f"select doc_id::bigint as doc_id, text, label, part from ({datasets_sql(_MIXED)})")
def standin_texts(spark, sf_dir):
    return make_datasets(spark, _MIXED)


def _made(specs) -> str:
    """`documents` as stand-in texts, with their label as language and part as source."""
    return f"documents as (select doc_id, text, label as lang, part as source, length(text) as n_chars from ({datasets_sql(specs)}))"


_COUNTS = "count(*) filter (where f and a) as tp, count(*) filter (where f and not a) as fp, count(*) filter (where not f and a) as fn, count(*) filter (where not f and not a) as tn"
_JUDGED = "j as (select *, synthetic_likelihood >= 50 as f, lang = 'synthetic' as a from scored)"


@query(f"""with {_made(simulate.sweep_specs())}, {SCORED}, {_JUDGED}, c as (select source as level, {_COUNTS} from j group by source), r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall from c)
select level, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end, 6) as f1, round((tp + fp) / (tp + fp + fn + tn), 4) as estimated from r""")
def contamination_sweep(spark, sf_dir):
    d = simulate.contamination_sweep(spark)
    return d.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


@query(f"""with {_made(generation_specs())}, {SCORED}, {_JUDGED} select source::int as generation, round(avg((f = a)::int), 6) as accuracy, round(coalesce(avg(synthetic_likelihood) filter (where a), 0) - coalesce(avg(synthetic_likelihood) filter (where not a), 0), 4) as mean_separation from j group by source""")
def generation_degradation(spark, sf_dir):
    return simulate.generation_degradation(spark).select("generation", F.round("accuracy", 6).alias("accuracy"), F.round("mean_separation", 4).alias("mean_separation"))


@query(f"""with o as ({datasets_sql([(0.0, 20, 1.0, 1)])}), benchmark as (select doc_id as item_id, text from o),
documents as (select * from (select doc_id, text, 'fed' as lang, '' as source from o order by md5('1234:' || doc_id) limit 10) union all select doc_id + 20, text, 'new', '' from ({datasets_sql([(0.0, 10, 0.0, 2)])})), {SIGNALS}, {NEAREST},
r as (select lang, coalesce(round(similarity, 3) >= 0.5, false) as caught from sig left join near using (doc_id))
select count(*) filter (where lang = 'fed')::bigint as injected, count(*) filter (where lang = 'fed' and caught)::bigint as caught, count(*) filter (where lang = 'fed' and caught) / count(*) filter (where lang = 'fed') as catch_rate, count(*) filter (where lang = 'new' and caught)::bigint as false_alarms from r""")
def recycling(spark, sf_dir):
    return simulate.recycling(spark)


@query(f"with {_made([(0.0, 100, 0.0, 1)])}, {SCORED} select count(*)::bigint as total, count(*) filter (where synthetic_likelihood >= 50)::bigint as flagged, count(*) filter (where synthetic_likelihood >= 50) / count(*) as rate from scored")
def false_positives(spark, sf_dir):
    return simulate.false_positives(spark)


_NAMES = " ".join(f"when {spec[0]!r} then '{name}'" for name, spec in demo.SCENARIOS)
_FED = demo.SCENARIOS[3][0]


@query(f"""with o as ({datasets_sql([demo.KNOWN])}), benchmark as (select doc_id as item_id, text from o),
documents as (select doc_id, text, case part {_NAMES} end as lang, '' as source from ({datasets_sql([spec for _, spec in demo.SCENARIOS])}) union all select * from (select doc_id + 1000, text, '{_FED}', '' from o order by md5('1234:' || doc_id) limit {demo.FED})), {SIGNALS}, {NEAREST},
r as (select * replace (case when lang = '{_FED}' then coalesce(similarity, 0.0) else 0.0 end as duplicate_similarity) from sig left join near using (doc_id)), s as (select lang as scenario, {score_sql()} as x from r)
select scenario, count(*)::bigint as total, count(*) filter (where x >= 50)::bigint as predicted_synthetic, round(count(*) filter (where x >= 50) / count(*), 4) as estimated_contamination from s group by scenario""".replace("), s as (select lang", "), sx as (select lang").replace("from s group by scenario", "from sx group by scenario"))
def demo_scenarios(spark, sf_dir):
    return signals.verdict(demo.scenarios(spark), "scenario")


@query("select unnest(['functions.signals', 'operators.corpus', 'operators.classify', 'plans.monitor', 'plans.standins', 'sources.readers', 'streaming.health', 'score']) as component, true as ok")
def health_check(spark, sf_dir):
    return demo.check(spark)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_STEPS = f"""m as (select {MARKED} as m from d), gr as (select m[1] || ' ' || m[2] as g, 0 as n from m where len(m) >= 2 union all select unnest(m), 1 from m union all select unnest({grams_sql('m', 2)}), 2 from m where len(m) >= 2 union all select unnest({grams_sql('m', 3)}), 3 from m where len(m) >= 3),
gc as (select n, g, count(*) as c, case when n = 0 then '' else array_to_string(string_split(g, ' ')[1:n - 1], ' ') end as ctx, case when n = 0 then g else string_split(g, ' ')[n] end as w from gr group by n, g),
nx as materialized (select n, ctx, w, sum(c) over (partition by n, ctx order by w) as upto, sum(c) over (partition by n, ctx) as total from gc)"""
_TEXTS, _WORDS = 30, 16


@query(rf"""with recursive {DOCS}, {_STEPS}, dr as materialized (select i, t, ('0x' || substr(md5('5:1:' || i || ':' || t), 1, 13))::bigint::double / 4503599627370496.0::double as u from range({_TEXTS}) a(i), range({_WORDS}) b(t)),
st as (select i, 0 as t, arg_min(w, upto) as pair from dr, nx where t = 0 and n = 0 and upto >= u * total group by i),
tx as (select i, t, string_split(pair, ' ')[1] as a, string_split(pair, ' ')[2] as b, pair as text from st
 union all select i, t, any_value(b), arg_min(w, (3 - n) * 1e15 + upto), any_value(text) || ' ' || arg_min(w, (3 - n) * 1e15 + upto) from (select tx.i, dr.t, tx.b, tx.text, nx.w, nx.n, nx.upto from tx join dr on dr.i = tx.i and dr.t = tx.t + 1 join nx on nx.n > 0 and nx.ctx = case nx.n when 1 then '' when 2 then tx.b else tx.a || ' ' || tx.b end and nx.upto >= dr.u * nx.total where tx.t + 2 < {_WORDS}) group by i, t)
select i::bigint as doc_id, regexp_replace(text, '\s+([.!?])', '\1', 'g') as text from tx where t = {_WORDS - 2}""")
def sampled_texts(spark, sf_dir):
    """Texts of the trigram model of all documents, with backoff to pairs and words."""
    return collapse.sample_corpus(spark, collapse.Counts.fit(_docs(spark, sf_dir)), _TEXTS, _WORDS, 5, 1)


@query(f"""with {SCORED}, al as (select lang, doc_id, list_filter({MARKED}, lambda x: regexp_matches(x, '^[a-z]+$')) as a from d), sq as (select lang, w, row_number() over (partition by lang order by doc_id, i) as pos from (select lang, doc_id, unnest(a) as w, unnest(range(len(a))) as i from al)),
tg as (select lang, w, w || ' ' || lead(w, 1) over p || ' ' || lead(w, 2) over p as g from sq window p as (partition by lang order by pos)), wd as (select lang, count(distinct w) as vocab, count(distinct w) / count(*) as ttr, count(distinct g) / count(g) as tri from tg group by lang),
sc as (select lang, avg(synthetic_likelihood) as score, avg((synthetic_likelihood >= 50)::int) as flagged from scored group by lang)
select lang, vocab::bigint as vocab, round(ttr, 6) as ttr, round(tri, 6) as trigram_diversity, round(score, 4) as mean_synth_score, round(flagged, 6) as est_contamination from wd join sc using (lang)""")
def measured_languages(spark, sf_dir):
    d = collapse.measure(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "lang")
    return d.select("lang", "vocab", *(F.round(c, 6).alias(c) for c in ("ttr", "trigram_diversity")), F.round("mean_synth_score", 4).alias("mean_synth_score"), F.round("est_contamination", 6).alias("est_contamination"))


@query("""with g as (select source, doc_id % 4 as generation, count(distinct lang) * 10 + count(*) as vocab, avg(n_chars) as tri, max(n_chars)::double as score from documents group by all), e as (select source, arg_min(vocab, generation) as v0, arg_max(vocab, generation) as v1, arg_min(tri, generation) as t0, arg_max(tri, generation) as t1, arg_min(score, generation) as s0, arg_max(score, generation) as s1 from g group by source)
select source, round(coalesce(100 * (v0 - v1) / nullif(v0, 0), 0.0), 6) as vocab_drop_pct, round(t1 - t0, 6) as trigram_diversity_change, round(s1 - s0, 6) as score_change from e""")
def endpoint_changes(spark, sf_dir):
    """Changes from the first to the last generation of a trajectory that stands for one."""
    d = table(spark, sf_dir, "documents").groupBy("source", (F.col("doc_id") % 4).alias("generation"))
    d = d.agg((F.countDistinct("lang") * 10 + F.count("*")).alias("vocab"), F.avg("n_chars").alias("trigram_diversity"), F.max("n_chars").cast("double").alias("mean_synth_score"))
    return collapse.endpoint_changes(d, "source").select("source", *(F.round(c, 6).alias(c) for c in ("vocab_drop_pct", "trigram_diversity_change", "score_change")))


# Each generation is drawn from a model of the one before: no SQL; tests hold model, draws and measures against plain Python.


@query()
def collapse_trajectory(spark, sf_dir):
    return collapse.recursive_collapse(_docs(spark, sf_dir))


@query()
def collapse_scaling(spark, sf_dir):
    return collapse.scaling(_docs(spark, sf_dir))
