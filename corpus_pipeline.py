"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each as Parquet and reads it back as the next
one's documents. All but the last return the columns of `documents`.

Edge cases, for every stage: a null or empty text is a clean document without shingles, windows or personal data, and stays; a null
doc_id stays, as nothing can name it (packing: a piece with a null id); very long texts are taken whole; rows equal in id and text are
one document to near_duplicates, and each a document of its own to the other stages; an empty table gives an empty one; columns
beside those of `documents` are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm.common import materialise
from chronolex.llm.decontaminate import contaminated
from chronolex.llm.ngram_join import ngram_jaccard_join
from chronolex.llm.packing import pack
from chronolex.llm.pii import find_pii, mask
from chronolex.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents whose id is not among the rejected; those without an id stay."""
    return docs.select(*COLUMNS).join(rejected.select("doc_id").distinct(), "doc_id", "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return without(docs, materialise(score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1"), "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id stays; of rows equal in id and text, one.

    Documents are told apart by id and text: another text under the same id is a document of its own.
    """
    members = materialise(ngram_jaccard_join(docs, keep_row=True).where("doc_id is not null and n_shingles > 0").select("doc_id", "row", "root"), "members")
    first = members.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    copies = materialise(members.select("row").distinct().join(first, "row", "left_anti"), "copies")
    kept = docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row")).join(copies, "row", "left_anti")
    return kept.where("doc_id is null").union(kept.where("doc_id is not null").dropDuplicates(["row"])).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return without(docs, materialise(contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "leaks"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its personal data masked and n_chars as it is then."""
    found = find_pii(docs, keep_text=True).select("doc_id", mask(F.col("text"), F.col("spans")).alias("text"), "lang", "source", "n_chars", (F.size("spans") > 0).alias("masked"))
    return found.select("doc_id", "text", "lang", "source", F.when(F.col("masked"), F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for every piece of every document: bucket, lane, batch and slot."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The classifier of the first stage is trained, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
