"""The cleaning pipeline: each stage works on what the one before kept, written as Parquet between.

All stages take nulls in any column, empty and very long texts, ties, repeated rows and empty tables, and keep extra
columns whatever their names; what each makes of them is said there. A very long text is one row, worked on whole, in
memory of some 20 to 60 times its size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.functions.shared import delete_folder, shared_folder
from lexivane.llm import bpe, decontaminate, lines, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines over the host limit; n_chars follows the text.

    Each row has its own verdict, so of rows with a null or repeated id the good ones stay. Null and empty texts have too
    few words and go; a null source is one host; equal rows are judged alike; of no rows none are left.
    """
    return _measured(quality.clean_good(docs), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; n_chars follows the text.

    The document with the smallest id keeps such a line, a row with a null id never does; a null source is no site. A
    document that loses all lines it had goes; null and empty texts stay as they are; equal rows lose equal lines.
    """
    return _measured(lines.clean_lines(docs), docs)


def _measured(cleaned: DataFrame, docs: DataFrame) -> DataFrame:
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies (a Jaccard similarity of 0.8 of five-word shingles).

    Texts of fewer words are one shingle; null and empty texts are equal to each other. Rows with a null id stay, and so
    do all rows of the smallest id; the choice has no ties. Of no rows none are left.
    """
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold none and stay; rows are judged by their text alone, so null ids, repeated rows and ties are
    like any others; with no items all rows stay.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded_sha256): the documents' token ids, and a digest of what they decode to.

    Null and empty texts have no tokens; every row, also of a null or repeated id, has its own; other columns end here.
    """
    import public_tokenizers

    done = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_tokens", tokens),
]

#: SimHash groups and BPE are beyond SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the rows of each are written to the shared folder and read again.

    A stage's folder goes once the next one's rows are written, so two copies of the corpus at most are held; the last,
    which the returned rows are read from, stays.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete_folder(spark, before)
        before = path
    return docs
