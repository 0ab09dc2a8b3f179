"""Raw zone: documents as fetched, written once and read back by URI; and the small file formats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.versions import read_if_exists

SCHEMES = ("file", "s3", "s3a", "hdfs", "viewfs")


def put_raw(df: DataFrame, root: str, key: str = "key", content: str = "content") -> DataFrame:
    """Append (key, content binary) to the zone; returns key and raw_uri. Keys that exist are kept as they are."""
    spark = df.sparkSession
    new, known = df.select(F.col(key), content).dropDuplicates([key]), read_if_exists(spark, root)
    new = new if known is None else new.join(known.select(F.col("key").alias(key)), key, "left_anti")
    new.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content")).write.mode("append").parquet(root)
    return df.select(F.col(key), F.concat(F.lit(root.rstrip("/") + "#"), F.col(key)).alias("raw_uri"))


def get_raw(spark: SparkSession, uri: str) -> DataFrame:
    """Content of one URI, of the zone (root#key) or a plain file; other schemes are an error."""
    scheme = uri.split(":", 1)[0] if "://" in uri or uri.startswith("file:") else "file"
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme: {scheme}")
    root, _, key = uri.partition("#")
    if key:
        return spark.read.parquet(root).where(F.col("key") == key).select("content")
    return spark.read.format("binaryFile").load(uri).select("content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(key, raw_uri, xml) of every file under a path; the key is the file name without its ending."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("xml"), F.col("_metadata.file_path").alias("raw_uri"))
    return rows.select(F.regexp_extract("raw_uri", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("key"), "raw_uri", "xml")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines but for blank ones and those that begin with #."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


Fetch = Callable[[int], list[tuple]]


def paged_source(label: str, row_schema: str, fetch: Fetch, total: Callable[[], int] | None = None, page_size: int = 20) -> type[DataSource]:
    """A paged listing as a batch source to register: one partition per page. How many pages there are follows from `total`, the
    number of rows the listing reports, or from the option `pages`; one of them must be given. Nothing is left off: without `total`,
    a row on the page after the last is an error."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return row_schema

        def reader(self, schema) -> DataSourceReader:
            if total is None and "pages" not in self.options:
                raise ValueError("either a total or the option pages is needed")
            pages = int(self.options["pages"]) if "pages" in self.options else -(-total() // page_size)

            class Reader(DataSourceReader):
                def partitions(self) -> list[InputPartition]:
                    return [Page(n) for n in range(1, pages + 1 + (total is None))]

                def read(self, partition: Page) -> Iterator[tuple]:
                    rows = fetch(partition.number)
                    if rows and partition.number > pages:
                        raise ValueError(f"the listing goes on after {pages} pages")
                    yield from rows

            return Reader()

    return Paged


def with_retries(fetch: Fetch, tries: int = 3, wait: Callable[[float], None] | None = None, pause: float = 0.0, preview: int = 200) -> Fetch:
    """A fetcher that pauses before each call and tries again after 1, 2, 4... seconds (time-outs are OSErrors too). The last error
    is raised, with the page and the beginning of its message."""
    import time

    def run(page: int) -> list[tuple]:
        for n in range(tries):
            if pause:
                (wait or time.sleep)(pause)
            try:
                return fetch(page)
            except OSError as e:
                if n == tries - 1:
                    raise OSError(f"page {page}: {str(e)[:preview]}") from e
                (wait or time.sleep)(2.0**n)
        return []

    return run


def fetch_documents(keys: DataFrame, fetch: Callable[[str], bytes], root: str) -> DataFrame:
    """Every key's document, fetched by the tasks and put into the zone: key and raw_uri. Keys that the zone has are not fetched."""
    spark = keys.sparkSession
    known = read_if_exists(spark, root)
    new = keys.select("key").distinct() if known is None else keys.select("key").distinct().join(known.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "content": [fetch(k) for k in batch["key"]]})

    new.mapInPandas(run, "key string, content binary").write.mode("append").parquet(root)
    return keys.select("key", F.concat(F.lit(root.rstrip("/") + "#"), F.col("key")).alias("raw_uri"))
