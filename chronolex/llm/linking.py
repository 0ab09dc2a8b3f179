"""Links between members of inverted lists, without spelling out all pairs of a list.

postings: t (the list), node, n (size of the node's set), own (how many of its tokens are in no other set). Own tokens bound the
overlap of a pair, since they are in no intersection. Every node is compared once with a central member (least own tokens) that
most of its lists share; then only members that are still in different components, and whose bound allows a link, are paired. So
families of thousands of variants stay near linear, while no link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialise

#: A list of rows of up to so many ids is broadcast (16 bytes each); a longer one is joined by shuffling.
BROADCAST_IDS = 1_000_000


def sent_if_small(ids: DataFrame) -> DataFrame:
    """Rows of one or two longs, marked for broadcasting if there are few enough of them."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def possible(x: str, y: str, percent: int) -> str:
    """Whether the shared tokens of x and y allow a similarity of so many percent, as SQL over two structs."""
    both = f"least({x}.n - {x}.own, {y}.n - {y}.own)"
    return f"100 * {both} >= {percent} * ({x}.n + {y}.n - {both})"


def prefix_length(n, percent: int):
    """|x| - ceil(t|x|) + 1, for numbers, arrays and columns of integers."""
    return n - (percent * n + 99) // 100 + 1


def rare_prefixes(tokens: DataFrame, percent: int) -> DataFrame:
    """Postings (t, node, n, own, place) of the first |x| - ceil(t|x|) + 1 tokens of each set, after its own ones by rarity. Similar sets
    share one of them. tokens: node, n, t and columns that are kept."""
    counts = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    by_node = Window.partitionBy("node")
    known = tokens.join(counts, "t").withColumn("own", F.col("n") - F.count("*").over(by_node)).withColumn("rank", F.row_number().over(by_node.orderBy("df", "t")))
    return known.withColumn("place", F.col("own") + F.col("rank")).where(F.expr(f"place <= n - (({percent} * n + 99) div 100) + 1")).drop("df", "rank")


def early(percent: int) -> str:
    """Whether the first common token of x and y, as SQL over two structs with its places, comes early enough in both: a pair of
    these sizes needs so many tokens in common."""
    need = f"(({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent})"
    return " and ".join(f"{k}.place <= {k}.n - {need} + 1" for k in "xy")


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of 256 classes of tokens whether the set has an odd number of them, in four longs."""
    return np.packbits((np.bincount(shingles & 255, minlength=256) & 1).astype(np.uint8)).view(np.int64)


def alike(percent: int) -> str:
    """Whether x and y, as SQL over two structs with `bits` of `parities`, can be similar: each bit that differs takes a token that
    only one of them has."""
    differ = " + ".join(f"bit_count(x.bits[{k}] ^ y.bits[{k}])" for k in range(4))
    return f"{100 + percent} * ({differ}) <= {100 - percent} * (x.n + y.n)"


def _labelled(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Postings with the label of each node's component, of those lists whose members have different labels."""
    rows = postings.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    mixed = rows.groupBy("t").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("t")
    return materialise(rows.join(materialise(mixed, "mixed"), "t"), "labelled")


def _to_pivots(rows: DataFrame, first: Column, verified: Callable[[DataFrame], DataFrame], percent: int, every: bool = False) -> DataFrame:
    """Links of each node with the pivot that most of its lists share, or with every pivot of its lists; the pivot of a list is its
    first member in the given order."""
    member = F.struct(first.alias("order"), (F.col("own") / F.col("n")).alias("share"), "node", "n", "own", "label")
    pivots = materialise(rows.groupBy("t").agg(F.min(member).alias("pivot")), "pivots")
    votes = rows.join(pivots, "t").where("label <> pivot.label").groupBy("node", "n", "own", "pivot").agg(F.count("*").alias("votes"))
    best = votes if every else votes.groupBy("node", "n", "own").agg(F.expr("max_by(pivot, struct(votes, -pivot.node))").alias("pivot"))
    best = best.select(F.struct("node", "n", "own").alias("x"), F.col("pivot").alias("y"))
    return materialise(verified(best.where(possible("x", "y", percent)).select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))), "links")


def component_links(postings: DataFrame, verified: Callable[[DataFrame], DataFrame], percent: int, finer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of the components. verified: keeps the pairs (a, b) that are similar. finer: makes the postings of the last steps,
    with places by rarity, of nodes; without it those given have places. Postings with `bits` (`parities`) make fewer pairs."""
    links = _to_pivots(postings.withColumn("label", F.col("node")), F.lit(0), verified, percent)
    roots = materialise(components(links), "roots")
    rows = _labelled(postings, roots)
    if finer is not None:
        # Members of a family that are too far from its centre are mostly near to one that has some of their changes and is in
        # the family already: these are compared with the member of the largest component in each of their finer lists.
        finer_rows = materialise(finer(rows.select("node").distinct()), "finer")
        sizes = roots.groupBy(F.col("root").alias("label")).agg(F.count("*").alias("size"))
        sized = _labelled(finer_rows, roots).join(materialise(sizes, "sizes"), "label", "left")
        links = _to_pivots(sized, -F.coalesce("size", F.lit(1)), verified, percent, every=True)
        roots = materialise(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)), "roots")
        rows = _labelled(finer_rows, roots)
    # The rest: members of a list that are still apart.
    x, y = (rows.select("t", F.struct(*(c for c in rows.columns if c != "t")).alias(k)) for k in "xy")
    close = f"{early(percent)} and {possible('x', 'y', percent)}" + (f" and {alike(percent)}" if "bits" in rows.columns else "")
    apart = x.join(y, "t").where("x.node < y.node and x.label <> y.label and " + close)
    rest = materialise(verified(apart.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()), "links")
    if not rest.limit(1).count():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest))
