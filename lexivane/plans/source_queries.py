"""Registered queries that write a table in one of the formats of the readers, read it back and return what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shared import shared_folder
from ..operators import caches, corpus
from ..sources import readers, sinks
from . import monitor
from .catalog import query, table
from .text_queries import DOCS, SQUASHED


def _folder(spark) -> str:
    """A new folder where all executors read and write."""
    return f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query(f"with {DOCS} select {SQUASHED} as text, count(*)::bigint as n from d where {SQUASHED} <> '' group by 1")
def line_scan(spark, sf_dir):
    path = _folder(spark)
    sinks.write_lines(_docs(spark, sf_dir), path)
    return readers.read_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


_STRIPPED = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"with {DOCS} select {_STRIPPED} as text, count(*)::bigint as n from d where {_STRIPPED} <> '' and doc_id % 11 <> 10 group by 1")
def json_scan(spark, sf_dir):
    """Each text in another field, beside fields that are blank, no string, or come later; some lines are no JSON object."""
    path, k = _folder(spark), F.pmod(F.col("doc_id"), F.lit(5))
    own = [F.when(k == j, F.col("text")).when(k > j, F.lit(" ")).otherwise(F.lit("a later field")).alias(name) for j, name in enumerate(readers.TEXT_FIELDS)]
    bad = F.when(F.pmod(F.col("doc_id"), F.lit(11)) == 10, F.lit('{"text": "not ended'))
    _docs(spark, sf_dir).select(F.coalesce(bad, F.to_json(F.struct(*own, F.col("doc_id").alias("number")))).alias("value")).write.text(path)
    first = readers.read_json_lines(spark, path).where(F.col("text") != "a later field")
    return first.groupBy("text").agg(F.count("*").alias("n"))


@query("select row_number() over (order by item_id) - 1 as doc_ord, trim(text) as text from benchmark")
def folder_scan(spark, sf_dir):
    """The few benchmark items as files of their own, and one that no reader takes."""
    path = _folder(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = [(f"{r['item_id']:012}.{'txt' if r['item_id'] % 2 else 'md'}", f"  {r['text']}\n") for r in table(spark, sf_dir, "benchmark").collect()]
    for name, text in [*files, ("0.csv", "no text file"), ("1.txt", " \n")]:
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        out = place.getFileSystem(conf).create(place)
        out.write(text.encode())
        out.close()
    return readers.load_corpus(spark, path)


_CLEAN = f"select label, array_to_string(w[1:250], ' ') as text from (select label, list_filter(string_split({SQUASHED}, ' '), lambda x: x <> '') as w from a) where len(w) >= 60"


@query(f"with {DOCS}, a as (select text, case when lang = 'en' then 0 else 1 end as label from d), c as ({_CLEAN}), n as (select min(n) as n from (select count(*) as n from c group by label)) select label::int as label, text from (select *, row_number() over (partition by label order by md5('1234:' || text), text) as r from c), n where r <= least(n, 2500)")
def answer_dump(spark, sf_dir):
    path = _folder(spark)
    d = _docs(spark, sf_dir).withColumn("part", F.pmod(F.col("doc_id"), F.lit(97)))
    own = lambda c: F.collect_list(F.when(c, F.coalesce("text", F.lit(""))))
    d.groupBy("part").agg(own(F.col("lang") == "en").alias("human_answers"), own(F.col("lang") != "en").alias("chatgpt_answers")).write.json(path)
    return readers.read_answers(spark, path)


@query(f"with {DOCS}, l as (select case when lang = 'en' then 0 else 1 end as label, unnest(string_split(text, chr(10))) as text from d) select label, text, count(*)::bigint as n from l where {_STRIPPED} <> '' group by all")
def answer_files(spark, sf_dir):
    """Two files of lines, whose blanks at either end are kept."""
    paths = []
    for where in ("lang = 'en'", "lang <> 'en'"):
        paths.append(_folder(spark))
        table(spark, sf_dir, "documents").where(where).select(F.coalesce("text", F.lit("")).alias("value")).write.text(paths[-1])
    return readers.load_answers(spark, *paths).groupBy("label", "text").agg(F.count("*").alias("n"))


@query(f"""with {DOCS}, w as (select doc_id, text as raw, list_filter(string_split({SQUASHED}, ' '), lambda x: x <> '') as w from d), k as (select *, row_number() over (partition by substr(raw, 1, 80) order by doc_id) as r from w where len(w) >= 60)
select doc_id, array_to_string(w[1:250], ' ') as text from k where r = 1 order by doc_id limit 400""")
def collected_generations(spark, sf_dir):
    return readers.collect_generations(_docs(spark, sf_dir), "text", "doc_id").select("doc_id", "text")


@query("select doc_id, generator, text from (select doc_id, lang as generator, text from documents where lang = 'de' and n_chars > 200 order by doc_id limit 20 offset 10)")
def generator_page(spark, sf_dir):
    """One generator of a partitioned table, and of it one page."""
    path = _folder(spark)
    sinks.write_generations(_docs(spark, sf_dir), path, "lang")
    return readers.page(readers.read_generations(spark, path, "de", F.col("n_chars") > 200), "doc_id", 10, 20).select("doc_id", "generator", "text")


@query("with l as (select md5(coalesce(text, '')) as h, n_chars::double as f, 0 as pass, doc_id from documents union all select md5(coalesce(text, '')), n_chars + 0.5, 1, doc_id from documents where doc_id % 5 = 0) select h, arg_max(f, pass * 1000000000 + doc_id) as f from l group by h")
def cache_scan(spark, sf_dir):
    """A tab-separated cache with malformed rows, in which later rows replace earlier ones."""
    path, d = _folder(spark), caches.with_key(_docs(spark, sf_dir))
    rows = d.select("doc_id", F.lit(0).alias("pass"), F.concat_ws("\t", "h", F.col("n_chars").cast("string")).alias("value"))
    late = d.where("doc_id % 5 = 0").select("doc_id", F.lit(1), F.concat_ws("\t", "h", (F.col("n_chars") + 0.5).cast("string")))
    bad = d.where("doc_id % 7 = 0").select("doc_id", F.lit(2), F.concat_ws("\t", "h", F.lit("none")))
    short = d.where("doc_id % 9 = 0").select("doc_id", F.lit(2), F.col("h"))
    rows.union(late).union(bad).union(short).repartitionByRange("pass", "doc_id").sortWithinPartitions("pass", "doc_id").select("value").write.text(path)
    return readers.read_cache(spark, path, "f")


@query("select md5(coalesce(text, '')) as h, min(n_chars)::double as f from documents group by 1")
def appended_cache(spark, sf_dir):
    """A Parquet cache that is appended to twice and keeps what it has."""
    path, d = _folder(spark), caches.with_key(_docs(spark, sf_dir)).groupBy("h").agg(F.min("n_chars").cast("double").alias("f"))
    sinks.append_cache(d.where("substring(h, 1, 1) < '8'"), path)
    sinks.append_cache(d.withColumn("f", F.when(F.col("h") < "8", -1.0).otherwise(F.col("f"))), path)
    return spark.read.parquet(path)


@query("select metric, value::double as value from (values ('trigram_diversity', 0.5), ('bigram_diversity', 0.25), ('type_token_ratio', 0.0)) v(metric, value)")
def baseline_scan(spark, sf_dir):
    """A stored snapshot read back as the metrics that the monitor watches."""
    path = _folder(spark)
    sinks.write_json(spark.createDataFrame([(corpus.VERSION, 0.5, 0.25, 0.0)], "version string, trigram_diversity double, bigram_diversity double, type_token_ratio double"), path)
    stored = readers.read_snapshot(spark, path).first().asDict()
    return monitor.metrics_frame(spark, stored).where("value is not null")


@query(f"with {DOCS}, o as (select * from d order by doc_id limit 60) select doc_id, left({_STRIPPED}, 64) as snippet, length(text)::bigint as n from o")
def first_snippets(spark, sf_dir):
    """The start of the first documents."""
    d = _docs(spark, sf_dir).orderBy("doc_id").limit(60)
    return d.select("doc_id", F.substring(T.strip(F.col("text")), 1, 64).alias("snippet"), F.length("text").cast("long").alias("n"))
