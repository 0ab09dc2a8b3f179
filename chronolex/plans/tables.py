"""The driver's tables seen as a versioned corpus: customers as articles, their orders as versions, orders that name parts as
rulings, consecutive parts of an order as references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.adjacency import Adjacency
from ..operators.text_index import TrigramIndex
from ..operators.versions import close_versions, first_write

EDGE_TYPES = {"R": "DELEGATES", "A": "REFERS_TO", "N": "MUTATIS"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("article_id"), F.to_date("o_orderdate").alias("valid_from"), F.col("o_orderkey").alias("article_key"), "o_orderstatus", "o_totalprice", "o_orderpriority")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close_versions(first_write(raw_versions(spark, sf_dir), ["article_id", "valid_from"], ["article_key"]))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    kind = F.coalesce(*(F.when(F.col("l_returnflag") == k, F.lit(v)) for k, v in EDGE_TYPES.items()))
    # Delegations end after 400 days; a line of 50 pieces has been there always.
    end = F.when(F.col("l_returnflag") == "R", F.date_add(F.to_date("l_shipdate"), 400))
    rows = line.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), kind.alias("type"), F.when(F.col("l_quantity") < 50, F.to_date("l_shipdate")).alias("valid_from"), end.alias("valid_to"), F.col("l_quantity").alias("quantity"))
    return rows.where("dst is not null")


def rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rulings: the parts they name, flagged where any was returned; F is lost, O won."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("l_partkey")).alias("cited_article_ids"), F.array_remove(F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == "R", "returned"))), "").alias("anti_avoidance"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("decided_on"), F.col("o_orderstatus").alias("outcome"))
    return orders.join(line, "o_orderkey").withColumnRenamed("o_orderkey", "ruling_id")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) of every part that an order names."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return line.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src")), "src", "left_semi")


def part_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of a part as its versions, one per day."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("article_id"), F.to_date("l_shipdate").alias("valid_from")).distinct()
    return close_versions(line)


_indexes: dict[tuple[str, str], TrigramIndex] = {}


def document_index(spark: SparkSession, sf_dir: str) -> TrigramIndex:
    """The trigram index of all documents, built once in a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _indexes:
        _indexes[at] = TrigramIndex.build(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    return _indexes[at]


_graphs: dict[tuple[str, str], Adjacency] = {}


def laid_out_edges(spark: SparkSession, sf_dir: str) -> Adjacency:
    """All edges, laid out for traversal once in a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _graphs:
        _graphs[at] = Adjacency.build(edges(spark, sf_dir))
    return _graphs[at]


# The same views for DuckDB.
VERSIONS_SQL = """
w AS (SELECT o_custkey AS article_id, CAST(o_orderdate AS DATE) AS valid_from, o_orderkey AS article_key, o_orderstatus, o_totalprice, o_orderpriority,
             row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS n FROM orders),
v AS (SELECT article_id, valid_from, article_key, o_orderstatus, o_totalprice, o_orderpriority,
             lead(valid_from) OVER (PARTITION BY article_id ORDER BY valid_from) AS valid_to FROM w WHERE n = 1)"""
EDGES_SQL = """
e0 AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS dst,
              CASE l_returnflag WHEN 'R' THEN 'DELEGATES' WHEN 'A' THEN 'REFERS_TO' ELSE 'MUTATIS' END AS type, CASE WHEN l_quantity < 50 THEN CAST(l_shipdate AS DATE) END AS valid_from, CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) + 400 END AS valid_to, l_quantity AS quantity FROM lineitem),
e AS (SELECT * FROM e0 WHERE dst IS NOT NULL)"""
RULINGS_SQL = """
c AS (SELECT DISTINCT l_orderkey AS ruling_id, l_partkey AS article_id FROM lineitem),
f AS (SELECT DISTINCT l_orderkey AS ruling_id FROM lineitem WHERE l_returnflag = 'R'),
r AS (SELECT o_orderkey AS ruling_id, CAST(o_orderdate AS DATE) AS decided_on, o_orderstatus AS outcome FROM orders WHERE o_orderkey IN (SELECT ruling_id FROM c))"""
PART_VERSIONS_SQL = """
p0 AS (SELECT DISTINCT l_partkey AS article_id, CAST(l_shipdate AS DATE) AS valid_from FROM lineitem),
pv AS (SELECT article_id, valid_from, lead(valid_from) OVER (PARTITION BY article_id ORDER BY valid_from) AS valid_to FROM p0)"""
