"""Remote sources: a file that is fetched once, and a paged row service as a Spark data source."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes read at once, and size from which a file that is there already is taken for whole.
CHUNK, WHOLE = 1 << 20, 1 << 20
#: Attempts of one request, seconds between them, and the answers of a busy service that are worth another.
ATTEMPTS, WAIT, BUSY = 8, 12.0, (500, 502, 503)
#: Rows of a page.
LENGTH = 100


def fetch_file(url: str, path: str, whole: int = WHOLE) -> bool:
    """Fetch a file to the driver, for `spark.read` to take from there; False where it is there already.

    It is written beside its place and moved there at the end, so a fetch that breaks off leaves nothing behind.
    """
    if os.path.exists(path) and os.path.getsize(path) > whole:
        return False
    part = f"{path}.part"
    with urllib.request.urlopen(url) as source, open(part, "wb") as out:
        while data := source.read(CHUNK):
            out.write(data)
    os.replace(part, path)
    return True


def get_json(url: str, attempts: int = ATTEMPTS, wait: float = WAIT) -> dict:
    """The JSON document at a URL; a busy service is asked again."""
    for k in range(attempts):
        try:
            with urllib.request.urlopen(url) as f:
                return json.load(f)
        except urllib.error.HTTPError as e:
            if e.code not in BUSY or k == attempts - 1:
                raise
        time.sleep(wait)
    raise ValueError("no attempt was asked for")


class Page(InputPartition):
    def __init__(self, offset: int, length: int) -> None:
        self.offset, self.length = offset, length


class PagedReader(DataSourceReader):
    """Reads a page in each task."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.schema = options, schema

    def _url(self, offset: int, length: int) -> str:
        query = {"offset": offset, "length": length} | ({"where": self.options["where"]} if self.options.get("where") else {})
        return f"{self.options['url']}{'&' if '?' in self.options['url'] else '?'}{urllib.parse.urlencode(query)}"

    def _get(self, offset: int, length: int) -> dict:
        return get_json(self._url(offset, length), int(self.options.get("attempts", ATTEMPTS)), float(self.options.get("wait", WAIT)))

    def partitions(self) -> list[Page]:
        length = int(self.options.get("length", LENGTH))
        total = int(self._get(0, 1)["num_rows_total"])
        total = min(total, int(self.options.get("limit", total)))
        return [Page(at, min(length, total - at)) for at in range(0, total, length)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for x in self._get(partition.offset, partition.length)["rows"]:
            yield tuple(x["row"].get(f.name) for f in self.schema.fields)


class PagedSource(DataSource):
    """`spark.read.format("paged").option("url", ...)`: rows of a service that answers where, offset and length.

    An answer is a JSON object with num_rows_total and rows, a list of objects whose `row` holds the columns. Options:
    url, where, length (of a page), limit (of rows), attempts, wait. The schema is given by the caller.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "generation string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options, schema)


def read_pages(spark: SparkSession, url: str, schema: str, where: dict[str, str | int] | None = None, **options) -> DataFrame:
    """The rows of a paged service whose columns equal the values of `where`; the service picks them, so no others travel.

    The condition is an option of the source rather than a filter that Spark pushes: Spark keeps what it pushed to a
    Python source for later reads of the same frame.
    """
    spark.dataSource.register(PagedSource)
    quoted = {k: v if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for k, v in (where or {}).items()}
    reader = spark.read.format("paged").schema(schema).option("url", url)
    if quoted:
        reader = reader.option("where", " AND ".join(f'"{k}"={v}' for k, v in quoted.items()))
    return reader.options(**options).load()
