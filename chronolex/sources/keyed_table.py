"""Tables for incremental writes: dealt into buckets by key, of which a write reads and replaces only those it touches.

Data folders are written once and never changed. A manifest, a small table to which each write adds the buckets it has replaced and
where their rows are now, says what the table is: of each bucket the last entry counts. A write that dies leaves a data
folder that no entry names, and the table as it was. A write can carry a label; one whose label is there already does
nothing, so that a batch can be run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import written

MANIFEST = "bucket int, folder string, label string, version long"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class KeyedTable:
    """schema: DDL or a StructType; keys: what rows are told apart by; by: the columns that buckets are dealt by, some of the keys."""

    spark: SparkSession
    folder: str
    schema: StructType | str
    keys: list[str]
    by: list[str] = field(default_factory=list)
    buckets: int = 64

    def __post_init__(self):
        self.schema = StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema
        self.by = self.by or self.keys

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def entries(self) -> DataFrame:
        """All entries of the manifest; those of a write that has not ended are not among them."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def version(self) -> int:
        return self.entries().agg(F.max("version")).first()[0] or 0

    def places(self, buckets: list[int] | None = None) -> dict[int, str]:
        """Where the rows of each bucket are: at most one entry for each."""
        rows = self.entries().where("bucket is not null")
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return {r["bucket"]: r["folder"] for r in rows.groupBy("bucket").agg(F.max_by("folder", "version").alias("folder")).collect()}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The whole table, or some buckets."""
        paths = [f"{folder}/bucket={b}" for b, folder in sorted(self.places(buckets).items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def merge(self, new: DataFrame, how: Merge, label: str | None = None) -> list[int]:
        """Replace the buckets of the new rows by how(their rows so far, new rows); returns which."""
        entries = self.entries()
        if label is not None and entries.where(F.col("label") == label).limit(1).count():
            return []
        new = written(new, "new")  # it is read twice, and is to be the same rows both times
        version, touched = self.version(), self.touched(new)
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        if touched:
            rows = how(self.read(touched), new).select(*self.schema.names)
            rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
        entry = self.spark.createDataFrame([(b, folder, label, version + 1) for b in touched] or [(None, None, label, version + 1)], MANIFEST)
        # A folder for each version: of two writes from one state the second fails.
        entry.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/manifest/write={version + 1}")
        return touched

    def upsert(self, new: DataFrame, label: str | None = None) -> list[int]:
        """New rows replace those with their keys; of new rows with equal keys any one stays."""
        return self.merge(new.dropDuplicates(self.keys), lambda old, rows: old.join(rows.select(*self.keys), self.keys, "left_anti").unionByName(rows), label)

    def insert_ignore(self, new: DataFrame, order: list[str | Column] | None = None, label: str | None = None) -> list[int]:
        """New rows whose keys are not there yet are added, of equal ones the first in order; a null in a key never clashes."""
        nulls = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in self.keys])

        def added(old: DataFrame, rows: DataFrame) -> DataFrame:
            place = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*(order or [F.lit(0)])))
            first = rows.withColumn("_n", place).where((F.col("_n") == 1) | nulls).drop("_n")
            return old.unionByName(first.join(old.select(*self.keys), self.keys, "left_anti").select(*self.schema.names))

        return self.merge(new, added, label)
