"""N-gram Jaccard join by multiple global orders.

Two sets of similarity t or more share a token among the first |x| - ceil(t|x|) + 1 tokens of each, under
*any* one order of all tokens. The join uses three orders; a pair is a candidate only if all of them agree, and only
candidates get their whole sets fetched and their exact intersection counted:

1. Rarity, in two steps. Tokens that no other text has come first, then the rarer ones. A set with enough tokens of
   its own for a whole prefix needs no further look. This is tried on the 35 percent of tokens of lowest hash,
   over all documents, and then on all tokens of the sets that are left. Copies of one set count as one.
2. and 3. Two independent hash orders. Each pair that the first order proposes must share a token in the prefixes under these
   two as well, which are kept beside the sets, a quarter as long.

Own tokens also bound the overlap of a pair, since they are in no intersection, and the sizes of both say how early their
first common token must come. Inside a posting list pairs are not spelt out (`linking`).

Words are told apart by 62-bit hashes modulo a prime; similarity is exact over these.

Edge cases: null and blank texts have no shingles, n_shingles 0, and stay alone; very long texts are taken whole; repeated rows and
ids each return a row, and different texts under one id are documents of their own; a null id returns null as component unless its
text links it; an empty table returns no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoded, lean, materialise, mix, shingle_sets
from .linking import component_links, prefix_length, rare_prefixes, sent_if_small

#: Share of the hash range whose tokens come first, by rarity. Above 1 - t, so that it can fill a prefix.
SAMPLED = 0.35
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def _tokens(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    for s in shingle_sets(texts, n):
        yield np.unique((s >> np.uint64(1)).astype(np.int64))


def _signatures(limit: int, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, first, second, heads = [], [], [], []
            for s in _tokens(encoded(batch["text"]), n):
                u = s.astype(np.uint64)
                sizes.append(len(s))
                first.append(int(np.add.reduce(mix(u)).astype(np.int64)))
                second.append(int(np.add.reduce(mix(u ^ np.uint64(SEEDS[0]))).astype(np.int64)))
                heads.append(s[: np.searchsorted(s, limit)])
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "row": batch["row"], "n": pd.Series(sizes, dtype="int64"), "s1": pd.Series(first, dtype="int64"), "s2": pd.Series(second, dtype="int64"), "head": heads})

    return run


def _sets(n: int, percent: int):
    """Sets with their prefixes under the further orders."""

    def prefix(s: np.ndarray, seed: int) -> np.ndarray:
        h, k = mix(s.astype(np.uint64) ^ np.uint64(seed)), int(prefix_length(len(s), percent))
        return (h if k >= len(h) else np.partition(h, k - 1)[:k]).view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = list(_tokens(encoded(batch["text"]), n))
            yield pd.DataFrame({"node": batch["node"], "n": [len(s) for s in sets], "tokens": sets, **{f"prefix{k}": [prefix(s, seed) for s in sets] for k, seed in enumerate(SEEDS, 2)}})

    return run


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            sides = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column("ta"), batch.column("tb"))]
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = (v[o[i] : o[i + 1]] for o, v in sides)
                if percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    return run


def _agreed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that share a prefix token under every further order."""
    orders = range(2, 2 + len(SEEDS))
    side = lambda k: sets.select(F.col("node").alias(k), *(F.col(f"prefix{o}").alias(f"{k}{o}") for o in orders))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(" and ".join(f"arrays_overlap(a{o}, b{o})" for o in orders)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda k: sets.select(F.col("node").alias(k), F.col("tokens").alias(f"t{k}"))
    return _agreed(pairs, sets).join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(lean(_verifier(percent)), "a long, b long")


def ngram_jaccard_join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, keep_row: bool = False) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that links reach, or its own).

    keep_row: also row, the hash of id and text, and root, the same for all documents that links reach."""
    assert percent > 100 * (1 - SAMPLED), "the sampled share of the tokens must be able to fill a prefix"
    limit = int(SAMPLED * (1 << 63))
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("id", "text"))
    signed = materialise(docs.mapInPandas(lean(_signatures(limit, n)), "id long, row long, n long, s1 long, s2 long, head array<long>"), "signatures")
    # A set is known by its hash, not by an id, which other texts may have too; one row stands for it.
    classes = signed.groupBy("s1", "s2").agg(F.min("id").alias("least"), F.min("row").alias("row"), F.max("n").alias("n")).withColumn("node", F.col("s1"))

    # Order 1, first use: how many of its sampled tokens has each set for itself?
    owners = signed.select(F.explode("head").alias("t"), "s1").groupBy("t").agg(F.min("s1").alias("s1"), F.max("s1").alias("other"))
    own = owners.where("s1 = other").groupBy("s1").agg(F.count("*").alias("own"))
    prefix = F.expr(f"n - (({percent} * n + 99) div 100) + 1")
    shared = classes.where("n > 0").join(own, "s1", "left").where(F.coalesce("own", F.lit(0)) < prefix)
    shared = materialise(shared.select("node", "row"), "shared")

    chosen = docs.join(sent_if_small(shared), "row").select("node", "text")
    found = chosen.mapInPandas(lean(_sets(n, percent)), "node long, n long, tokens array<long>, prefix2 array<long>, prefix3 array<long>")
    repeated = signed.groupBy("row").count().where("count > 1").limit(1).count()
    sets = materialise(found.dropDuplicates(["node"]) if repeated else found, "sets")

    # Order 1, second use: the prefix of each remaining set, after its own tokens, by rarity among these.
    postings = materialise(rare_prefixes(sets.select("node", "n", F.explode("tokens").alias("t")), percent), "postings")
    roots = component_links(postings, lambda pairs: _verified(pairs, sets, percent), percent)

    linked = materialise(classes.where("n > 0").join(roots, "node").select("s1", "s2", "root", "least"), "linked")
    smallest = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    merged = classes.where("n > 0").join(linked.drop("least").join(smallest, "root"), ["s1", "s2"], "left")
    merged = merged.select("s1", "s2", F.coalesce("root", "node").alias("root"), F.coalesce("smallest", "least").alias("smallest"))
    return (
        signed.join(merged, ["s1", "s2"], "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("id")).alias("component_id"), *(["row", "root"] if keep_row else []))
    )


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
