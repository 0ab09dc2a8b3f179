"""The reference graph as edge tables: (src, dst, type, valid_from, valid_to), and bounded traversal by joins.

Start nodes come as a table, so a batch of any size is one traversal. Edges are laid out for it once and stay in place
(`adjacency`); what a hop reaches is de-duplicated and written out; no path is enumerated unless paths are the result.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import require_as_of
from ..functions.text import definitions
from ..functions.tree import full_text
from ..scratch import written
from .adjacency import Adjacency, adjacency_of
from .versions import effective_at, insert_ignore, latest_open, supersedes

REFERENCES = ("DELEGATES", "REFERS_TO", "MUTATIS")


def hierarchy_edges(statute: DataFrame) -> DataFrame:
    return statute.where("parent_id is not null").select(F.col("statute_id").alias("src"), F.col("parent_id").alias("dst"), F.lit("DELEGATES_TO").alias("type"))


def version_edges(version: DataFrame) -> DataFrame:
    return version.select(F.col("article_id").alias("src"), F.col("article_key").alias("dst"), F.lit("HAS_VERSION").alias("type"))


def supersedes_edges(version: DataFrame) -> DataFrame:
    return supersedes(version, "article_id", "valid_from", "article_key").withColumn("type", F.lit("SUPERSEDES"))


def pattern_vertices(pattern_type: DataFrame) -> DataFrame:
    """One vertex per pattern, by its code."""
    return pattern_type.select(F.col("code").alias("pattern_type"), "description").dropDuplicates(["pattern_type"])


def reference_edges(delegations: DataFrame, statute: DataFrame, article: DataFrame) -> DataFrame:
    """Edges between articles from parsed delegations; dropped if the statute or either end is unknown."""
    by_mst = statute.select("statute_id", F.col("current_mst"), "enforced_on")
    ends = article.select("article_id", "statute_id", "art_no", "branch_no")
    source = ends.select(F.col("article_id").alias("src"), F.col("statute_id").alias("s_id"), F.col("art_no").alias("source_art_no"), F.col("branch_no").alias("source_branch_no"))
    target = ends.select(F.col("article_id").alias("dst"), F.col("statute_id").alias("t_id"), F.col("art_no").alias("target_art_no"), F.col("branch_no").alias("target_branch_no"))
    own = by_mst.select(F.col("current_mst").alias("source_mst"), F.col("statute_id").alias("s_id"), F.col("enforced_on").alias("valid_from"))
    other = by_mst.select(F.col("current_mst").alias("target_law_mst"), F.col("statute_id").alias("t_id"))
    joined = delegations.join(own, "source_mst").join(other, "target_law_mst").join(source, ["s_id", "source_art_no", "source_branch_no"]).join(target, ["t_id", "target_art_no", "target_branch_no"])
    return joined.select("src", "dst", F.col("edge_type").alias("type"), "valid_from", F.lit(None).cast("date").alias("valid_to")).dropDuplicates(["src", "dst", "type"])


def defines_edges(version: DataFrame) -> DataFrame:
    """Article to term, from the body and tree of the latest open version."""
    text = F.concat_ws("\n", "body", full_text(F.col("tree.clauses")))
    return latest_open(version).select(F.col("article_id").alias("src"), F.explode(definitions(text)).alias("term")).distinct()


def cites_edges(ruling: DataFrame, article: DataFrame) -> DataFrame:
    cited = ruling.select(F.col("ruling_id").alias("src"), F.explode("cited_article_ids").alias("dst")).distinct()
    return cited.join(article.select(F.col("article_id").alias("dst")), "dst", "left_semi")


def build_graph(statute: DataFrame, article: DataFrame, version: DataFrame, ruling: DataFrame, delegations: DataFrame, pattern_type: DataFrame) -> dict[str, DataFrame]:
    """All edge tables, and the vertices of patterns; other vertices are the tables themselves."""
    return {
        "PATTERN": pattern_vertices(pattern_type),
        "DELEGATES_TO": hierarchy_edges(statute), "HAS_VERSION": version_edges(version), "SUPERSEDES": supersedes_edges(version),
        "REFERENCES": reference_edges(delegations, statute, article), "DEFINES": defines_edges(version), "CITES": cites_edges(ruling, article),
    }


def all_edges(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, src, dst) of every edge of a graph, as strings; references under their own types."""
    ends = {name: df.withColumnRenamed("term", "dst") for name, df in tables.items() if name != "PATTERN"}
    rows = [df.select(F.col("type") if name == "REFERENCES" else F.lit(name).alias("kind"), F.col("src").cast("string"), F.col("dst").cast("string")).toDF("kind", "src", "dst") for name, df in ends.items()]
    return reduce(DataFrame.union, rows)


def write_graph(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table of a graph in its place, in the stead of what was there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name.lower()}")


def expand_refs(starts: DataFrame, edges: DataFrame | Adjacency, as_of: date, hops: int = 2, types: Iterable[str] = REFERENCES) -> tuple[DataFrame, DataFrame]:
    """Nodes (start, node, hop) within `hops` valid edges, the start at 0, and edges (start, src, dst, type) on the way. Edges that
    are asked more than once are best laid out before, as an Adjacency."""
    require_as_of(as_of)
    graph = adjacency_of(edges)
    frontier = starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("hop")).distinct()
    seen, walked = frontier, None
    for hop in range(1, hops + 1):
        step = written(graph.step(frontier.select("start", "node"), types, as_of).select("start", F.col("node").alias("src"), "dst", "type"), "step")
        walked = step if walked is None else walked.union(step)
        reached = step.select("start", F.col("dst").alias("node")).distinct()
        frontier = written(reached.join(seen, ["start", "node"], "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        seen = seen.unionByName(frontier)
    return seen, walked


def delegation_chains(starts: DataFrame, edges: DataFrame | Adjacency, longest: int = 3, type_: str = "DELEGATES") -> DataFrame:
    """The longest path of at most `longest` edges, none twice, from each start; of equal ones the smallest. (start, chain)"""
    graph = adjacency_of(edges)
    path = starts.select("start", F.array("start").alias("chain"), F.array().cast("array<string>").alias("used"), F.col("start").alias("node"))
    found = None
    for _ in range(longest):
        edge = F.concat_ws(">", F.col("node").cast("string"), F.col("dst").cast("string"))
        step = graph.step(path, (type_,), None).where(~F.array_contains("used", edge))
        path = written(step.select("start", F.concat("chain", F.array("dst")).alias("chain"), F.concat("used", F.array(edge)).alias("used"), F.col("dst").alias("node")), "path")
        found = path if found is None else found.union(path)
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("start").orderBy(F.desc(F.size("chain")), "chain")))
    return ranked.where("_n = 1").select("start", "chain")


def resolve_chain(chains: DataFrame, version: DataFrame, as_of: date) -> DataFrame:
    """The versions in force of the nodes after the start, in order; nodes without one are left out."""
    nodes = chains.select("start", F.posexplode("chain").alias("position", "article_id")).where("position > 0")
    return nodes.join(effective_at(version, as_of), "article_id")


def terminals(starts: DataFrame, edges: DataFrame | Adjacency, hops: int = 4, type_: str = "MUTATIS") -> DataFrame:
    """Nodes within 1..hops edges that no edge of the type leaves. (start, node)"""
    graph = adjacency_of(edges)
    frontier = starts.select("start", F.col("start").alias("node")).distinct()
    reached = None
    for _ in range(hops):
        step = graph.step(frontier, (type_,), None).select("start", F.col("dst").alias("node")).distinct()
        frontier = written(step if reached is None else step.join(reached, ["start", "node"], "left_anti"), "frontier")
        reached = frontier if reached is None else reached.unionByName(frontier)
    return reached.join(graph.sources(type_), "node", "left_anti").select("start", "node")


def term_conflicts(defines: DataFrame, term: str | None = None) -> DataFrame:
    """All definers of a term, or of every term that has several."""
    if term is not None:
        return defines.where(F.col("term") == term)
    several = defines.groupBy("term").agg(F.count_distinct("src").alias("definers")).where("definers > 1")
    return defines.join(several, "term")


def risk_neighbours(cites: DataFrame, lost: DataFrame, starts: DataFrame) -> DataFrame:
    """Articles cited by the same lost rulings, with the number of these. (start, neighbour, n)

    The join on the ruling makes the square of one ruling's citations, which are tens; citations of an article, of which there may be
    very many, are never paired."""
    own = cites.join(lost.select(F.col("ruling_id").alias("src")).distinct(), "src", "left_semi").distinct()
    mine = starts.join(own, starts["start"] == own["dst"]).select("start", "src")
    return mine.join(own, "src").where("dst <> start").groupBy("start", F.col("dst").alias("neighbour")).agg(F.count("*").alias("n"))


def unpatched(ruling: DataFrame, cites: DataFrame, version: DataFrame, since: date | None, won: str | Column) -> DataFrame:
    """Won rulings on articles whose open version was there already on the day of the decision; a caller that shows them puts the newest first."""
    wins = ruling.where(F.col("outcome") == won) if isinstance(won, str) else ruling.where(won)
    if since is not None:
        wins = wins.where(F.col("decided_on") >= F.lit(since))
    open_ = version.where("valid_to is null").select(F.col("article_id").alias("dst"), "valid_from")
    hits = wins.select(F.col("ruling_id").alias("src"), "decided_on").join(cites, "src").join(open_, "dst").where("valid_from <= decided_on")
    return hits.select(F.col("src").alias("ruling_id"), F.col("dst").alias("article_id"), "decided_on").distinct()


def risk_score(rate: Column) -> Column:
    """A rate as it is stored: three places, halves to the even digit, 0 where it is unknown."""
    return F.bround(F.coalesce(rate, F.lit(0.0)), 3)


def materialise_unpatched(candidates: DataFrame, rates: DataFrame, existing: DataFrame) -> DataFrame:
    """New loophole rows with their rounded risk score; to be appended."""
    rows = candidates.join(rates, "article_id", "left").select("article_id", F.col("ruling_id").alias("origin_ruling"), F.lit("alive").alias("status"), risk_score(F.col("rate")).cast("decimal(4,3)").alias("risk_score"))
    return insert_ignore(existing, rows, ["article_id", "origin_ruling"])
