"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import checkpoint, delete_folder, fresh, shared_folder  # noqa: F401

#: Code points that separate words: space, and tab to carriage return.
WORD_GAPS = " \t\n\v\f\r"
#: Rows, and bytes, handed to Python at once; long texts make large rows, so batches stay short.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Edges of a part of a step of connected components, and least parts.
PART_EDGES, LEAST_PARTS = 100_000, 16


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short and small, unless the session already asks for smaller ones."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def words_of(text: Column) -> Column:
    """Array of the runs of anything but WORD_GAPS; null text gives an empty array."""
    flat = F.translate(F.coalesce(text, F.lit("")), WORD_GAPS[1:], " " * (len(WORD_GAPS) - 1))
    return F.array_remove(F.split(flat, " ", -1), "")


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[tuple]], Iterable[tuple]]], schema: pa.Schema, ddl: str, chunk_bytes: int = 4 << 20, size_of: int | None = None) -> DataFrame:
    """Run a Python function over lists of rows through Arrow, in chunks of bounded text size.

    `make` is called once a task and returns a function from a list of row tuples to row tuples; column
    number `size_of` (a string or binary) measures a chunk. Output batches are cut at 10,000 rows.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for lo, hi in chunks(columns[size_of] if size_of is not None else None, batch.num_rows, chunk_bytes):
                yield from to_batches(work(list(zip(*(c[lo:hi] for c in columns)))), schema)

    return df.mapInArrow(run, ddl)


def chunks(texts: list | None, n: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about `most` units at most (one row at least)."""
    if texts is None:
        yield 0, n
        return
    lo = held = 0
    for i, t in enumerate(texts):
        size = len(t) if t is not None else 0
        if i > lo and held + size > most:
            yield lo, i
            lo, held = i, 0
        held += size
    if n > lo:
        yield lo, n


def to_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Record batches of `schema` from row tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, root) for every node of the undirected edges; root is the least node reachable.

    Alternates large-star and small-star steps over (node, smaller node) pairs. Each step moves as many
    rows as there are edges, aggregates before it shuffles, and is checkpointed, so long chains take few steps.
    The edges of a hub meet its one row of the aggregate in a join, whose large partitions Spark splits
    (spark.sql.adaptive.skewJoin); callers tie large groups to their smallest node, so that a hub's edges are few
    to others. Ends when a step changes nothing.
    """
    now = checkpoint(_ordered(edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))))
    state = _state(now)
    while True:
        # A step over few edges takes few tasks, whatever the session's number of shuffle partitions.
        n = max(LEAST_PARTS, state[0] // PART_EDGES)
        now = checkpoint(_small_star(_large_star(now.coalesce(n), n), n).coalesce(n))
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select("v", "v")).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops, the larger node first."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").coalesce(n).distinct().coalesce(n)


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(n)
    return _ordered(moved.union(least.select("u", F.col("m").alias("v")).coalesce(n)))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(20,0))"))).first())
