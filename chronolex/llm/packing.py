"""Packing into optimal length buckets.

A text of more than `longest` words is cut into pieces of that length, so nothing is lost. The histogram of all piece
lengths, at most `longest` rows whatever the corpus, goes to the driver, where dynamic programming chooses `buckets` upper
bounds of least total padding. Every piece is padded to the bound of its bucket, and consecutive pieces of a bucket
form batches of at most `budget` padded words. Numbering runs inside lanes of about `lane` pieces, as many per bucket as the
histogram says, so no bucket is ordered in one place; only the last batch of a lane may be short.

Edge cases: null, empty and blank texts are one piece of length 0 and padded like any other; repeated rows and ids are pieces of
their own; ties in a lane are ordered by id, piece and text hash; an empty table returns no rows; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise


def optimal_bounds(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of least padding for counts[n] pieces of length n; the last is the greatest length met.

    Padding of lengths a+1..b under bound b is b * pieces - words, by prefix sums; the best split before b only moves up
    with b, so each layer is solved by halving.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    pieces = np.concatenate([[0], np.cumsum(counts[lengths])]).astype(float)
    words = np.concatenate([[0], np.cumsum(counts[lengths] * lengths)]).astype(float)
    n = len(lengths)
    best = np.concatenate([[0.0], lengths * pieces[1:] - words[1:]])
    splits = []
    for _ in range(1, min(buckets, n)):
        new, split = best.copy(), np.zeros(n + 1, int)
        jobs = [(1, n, 0, n - 1)]
        while jobs:
            low, high, left, right = jobs.pop()
            if low > high:
                continue
            b = (low + high) // 2
            a = np.arange(left, min(b - 1, right) + 1)
            cost = best[a] + lengths[b - 1] * (pieces[b] - pieces[a]) - (words[b] - words[a])
            k = int(cost.argmin())
            new[b], split[b] = cost[k], a[k]
            jobs += [(low, b - 1, left, int(a[k])), (b + 1, high, int(a[k]), right)]
        best = new
        splits.append(split)
    bounds, b = [], n
    for split in reversed(splits):
        if b <= 0:
            break
        bounds.append(int(lengths[b - 1]))
        b = int(split[b])
    if b > 0:
        bounds.append(int(lengths[b - 1]))
    return sorted(set(bounds))


def pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048, buckets: int = 16, budget: int = 16_384, lane: int = 50_000, length_col: str | None = None) -> DataFrame:
    """One row per piece: id, piece, n_words, bucket (its padded length), lane, batch, slot.

    Lengths are words between white space or, if a column gives them, numbers of tokens; `longest`, `budget` and n_words are then tokens."""
    given = F.greatest(F.col(length_col).cast("int"), F.lit(0)) if length_col else F.regexp_count(F.col(text_col), F.lit(r"\S+"))
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(given, F.lit(0)).alias("n"), F.xxhash64(text_col).alias("tie"))
    pieces = docs.select("id", "tie", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0)).cast("int"))).alias("piece"))
    pieces = materialise(pieces.select("id", "tie", "piece", F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).alias("n_words")), "pieces")
    histogram = {r["n_words"]: r["count"] for r in pieces.groupBy("n_words").count().collect()}  # at most longest + 1 rows
    counts = np.array([histogram.get(n, 0) for n in range(longest + 1)])
    bounds = optimal_bounds(counts, buckets) or [0]
    low = [-1, *bounds[:-1]]
    lanes = [max(1, -(-int(counts[a + 1 : b + 1].sum()) // lane)) for a, b in zip(low, bounds)]
    which = F.element_at(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("n_words")), 1)
    lanes_of = F.element_at(F.array(*map(F.lit, lanes)), F.array_position(F.array(*map(F.lit, bounds)), F.col("bucket")).cast("int"))
    placed = pieces.withColumn("bucket", which).withColumn("lane", F.pmod(F.xxhash64("id", "piece", "tie"), lanes_of).cast("int"))
    number = F.row_number().over(Window.partitionBy("bucket", "lane").orderBy("n_words", "id", "piece", "tie")) - 1
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket", F.lit(1)))).cast("int")
    return placed.select(F.col("id").alias(id_col), "piece", "n_words", "bucket", "lane", number.alias("k"), size.alias("size")).select(
        id_col, "piece", "n_words", "bucket", "lane", F.floor(F.col("k") / F.col("size")).cast("int").alias("batch"), (F.col("k") % F.col("size")).alias("slot")
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
