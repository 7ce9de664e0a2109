"""Readers: corpora of lines, JSON lines or a folder; question-answer and generation dumps; caches and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.prefix import dense_index

#: Fields of a JSON line that may hold the text, in order of preference.
TEXT_FIELDS = ("text", "content", "body", "output", "response")
MIN_WORDS, MAX_WORDS = 60, 250


def _place():
    """Where a row of a file source stands: by file, part of the file, and line. Spark's numbers alone put large files first."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))


def _ordered(df: DataFrame) -> DataFrame:
    """`text` with a dense `doc_ord` in the order of the files and their lines."""
    d = df.withColumn("__o", F.monotonically_increasing_id())
    return dense_index(d, "__o").select(F.col("pos").cast("long").alias("doc_ord"), "text")


def read_lines(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """One document for each non-blank line, stripped unless told otherwise."""
    lines = spark.read.text(path, lineSep="\n").withColumn("bare", T.strip(F.col("value"))).where("bare <> ''")
    return _ordered(lines.select(F.col("bare" if strip else "value").alias("text")))


def load_answers(spark: SparkSession, human: str, machine: str) -> DataFrame:
    """Rows (label, doc_ord, text) of two prepared files of lines, which are kept as they are: 0 human, 1 machine."""
    parts = [read_lines(spark, path, strip=False).select(F.lit(y).alias("label"), "doc_ord", "text") for y, path in enumerate((human, machine))]
    return parts[0].unionByName(parts[1])


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """The first field of TEXT_FIELDS that holds a non-blank string; lines that are no JSON object are skipped."""
    v = F.try_parse_json("value")
    fields = []
    for name in TEXT_FIELDS:
        field = F.try_variant_get(v, f"$.{name}", "string")
        is_string = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING"
        fields.append(F.when(is_string, F.nullif(T.strip(field), F.lit(""))))
    return _ordered(spark.read.text(path, lineSep="\n").select(F.coalesce(*fields).alias("text")).where("text is not null"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """One document for each .txt or .md file directly inside a folder, by file name; empty ones are left out."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{txt,md}").select(T.strip(F.col("value")).alias("text"), F.col("_metadata.file_name").alias("name"))
    files = files.where("text <> ''")
    return _ordered(files.repartitionByRange("name").sortWithinPartitions("name").select("text"))


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_ord, text) of a folder, a .jsonl file, or a file of lines."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(hadoop).isDirectory():
        return read_folder(spark, path)
    return read_json_lines(spark, path) if path.endswith(".jsonl") else read_lines(spark, path)


def clean_answers(df: DataFrame, text: Column | str, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """`df` with `text` squashed and cut to `max_words`, without texts of fewer than `min_words`."""
    d = df.withColumn("text", T.squash(text))
    return d.where(F.size(T.split_words("text")) >= min_words).withColumn("text", T.first_words("text", max_words))


def read_answers(spark: SparkSession, path: str, seed: int = 1234, most: int = 2500) -> DataFrame:
    """Rows (text, label) of a dump with human_answers and chatgpt_answers: cleaned, in a seeded order, as many of either."""
    raw = spark.read.schema("human_answers array<string>, chatgpt_answers array<string>").json(path)
    parts = [clean_answers(raw.select(F.explode(c).alias("text")), "text").select("text", F.lit(y).alias("label")) for y, c in enumerate(("human_answers", "chatgpt_answers"))]
    from ..operators.sampling import balanced

    return balanced(parts[0].unionByName(parts[1]), "label", F.col("text"), seed, most)


def collect_generations(df: DataFrame, text_col: str = "generation", order_col: str = "row_id", target: int = 400) -> DataFrame:
    """Up to `target` cleaned texts in order, the first of those that share their first 80 raw characters."""
    from ..operators.caches import first_by_prefix

    kept = first_by_prefix(df.where(F.size(T.split_words(text_col)) >= MIN_WORDS), text_col, order_col)
    return clean_answers(kept, text_col).orderBy(order_col).limit(target)


def read_generations(spark: SparkSession, path: str, generator: str, where: Column | None = None) -> DataFrame:
    """The rows of one generator from a table partitioned by `generator`; the other partitions are not read.

    `where` is a further condition, which reaches the Parquet scan.
    """
    d = spark.read.parquet(path).where(F.col("generator") == generator)
    return d if where is None else d.where(where)


def page(df: DataFrame, order_col: str, offset: int, length: int) -> DataFrame:
    """The rows `offset` to `offset + length` in an order."""
    return df.orderBy(order_col).offset(offset).limit(length)


def read_cache(spark: SparkSession, path: str, *features: str) -> DataFrame:
    """Rows (h, features) of a tab-separated cache; malformed rows are skipped and the last row of a key holds.

    A cache may be a folder, whose files follow one another by name.
    """
    parts = F.split("value", "\t", -1)
    d = spark.read.text(path, lineSep="\n").select("value", _place().alias("__n")).where(F.size(parts) == 1 + len(features))
    values = {f: F.try_element_at(parts, F.lit(k + 2)).try_cast("double") for k, f in enumerate(features)}
    d = d.select(F.element_at(parts, 1).alias("h"), "__n", *(v.alias(f) for f, v in values.items())).dropna(subset=list(features))
    return d.groupBy("h").agg(*(F.max_by(f, "__n").alias(f) for f in features))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot, or any result document, as one row."""
    return spark.read.json(path, multiLine=True)
