"""Edges laid out for traversal: lists by source, bucketed, so that no hop moves them again.

A node's edges are lists of at most about HUB; a node with more is a hub, whose edges are dealt to several lists by their target. The
table is bucketed by source and list. A hop joins the frontier with it: the frontier is dealt out, a row of a hub once for each list of
it, and the edges stay where they are. What a hop finds is written out, so the plan of a hop doesn't hold the ones before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import edge_in_force
from ..scratch import new_folder, written

HUB = 10_000


@dataclass(frozen=True)
class Adjacency:
    """hubs: (src, lists) of the nodes with several lists, of which there are at most one for each HUB edges."""

    lists: DataFrame
    hubs: DataFrame

    @classmethod
    def build(cls, edges: DataFrame, hub: int = HUB, buckets: int | None = None) -> "Adjacency":
        """From (src, dst, type, valid_from, valid_to); a table of the session's catalog, with its files in the shared folder."""
        spark = edges.sparkSession
        edges = written(edges.select("src", "dst", "type", "valid_from", "valid_to").where("src is not null and dst is not null"), "edges")
        hubs = written(edges.groupBy("src").agg(F.ceil(F.count("*") / hub).cast("int").alias("lists")).where("lists > 1"), "hubs")
        dealt = edges.join(F.broadcast(hubs), "src", "left").withColumn("list", F.coalesce(F.pmod(F.xxhash64("dst"), "lists").cast("int"), F.lit(0)))
        made = dealt.groupBy("src", "list").agg(F.collect_list(F.struct("dst", "type", "valid_from", "valid_to")).alias("edges"))
        name = f"adjacency_{uuid.uuid4().hex}"
        # Grouping deals rows out as the buckets do, where there are as many of these as shuffle partitions.
        shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
        number = buckets or shuffled
        (made if number == shuffled else made.repartition(number, "src", "list")).write.bucketBy(number, "src", "list").sortBy("src", "list").option("path", new_folder(spark, "adjacency")).saveAsTable(name)
        return cls(spark.table(name), hubs)

    @property
    def spark(self) -> SparkSession:
        return self.lists.sparkSession

    def step(self, frontier: DataFrame, types: Iterable[str], as_of: date | None) -> DataFrame:
        """The frontier's columns beside dst and type of each different edge that leaves its column `node`, of these types and in force
        on the day (None: at any time)."""
        many = frontier.join(F.broadcast(self.hubs.withColumnRenamed("src", "node")), "node", "left")
        asked = many.withColumn("list", F.explode(F.sequence(F.lit(0), F.coalesce("lists", F.lit(1)) - 1))).drop("lists")
        holds = lambda e: F.lit(True) if as_of is None else edge_in_force(as_of, e["valid_from"], e["valid_to"])
        edge = F.filter("edges", lambda e: e["type"].isin(*types) & holds(e))
        met = asked.join(self.lists.withColumnRenamed("src", "node"), ["node", "list"])
        found = F.array_distinct(F.transform(edge, lambda e: F.struct(e["dst"].alias("dst"), e["type"].alias("type"))))
        return met.select(*frontier.columns, F.explode(found).alias("e")).select(*frontier.columns, "e.dst", "e.type")


    def sources(self, type_: str) -> DataFrame:
        """node: those that an edge of the type leaves."""
        return self.lists.where(F.exists("edges", lambda e: e["type"] == type_)).select(F.col("src").alias("node")).distinct()


def adjacency_of(edges: DataFrame | Adjacency) -> Adjacency:
    return edges if isinstance(edges, Adjacency) else Adjacency.build(edges)
