"""A persistent inverted index of trigrams, for similarity search with a threshold.

A trigram is a number, its three characters at 21 bits each. The index is dealt by text, as search clusters do it: a row of `shards` holds
the inverted lists of some thousand texts, which it numbers by size, so that no trigram, however common, is a key that rows are shuffled by.
`frequencies` says how many texts hold a trigram.

A query of m trigrams can reach the threshold t only with texts of t * m to m / t trigrams: one stretch of each list, as lists are in
the order of sizes. And only with those that share one of its rarest m - ceil(t * m) + 1 trigrams, or more of them as the text is larger:
these lists are counted first, and the lists of its frequent trigrams, which most postings belong to, only where a text is still in question.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_folder, spread, written

#: Characters of text that one vectorised step takes, but for a longer text; postings of a shard; postings counted at a time.
STEP = 1 << 20
SHARD = 1 << 19
COUNTED = 1 << 21
#: Shards of a row group: writers hold one row group, and Spark's reader decodes up to 4096 rows of one at once, some megabytes each here.
GROUP = 4
#: Queries that go to the shards at a time.
BLOCK = 4096
#: Thresholds are products of floating numbers.
SLACK = 1e-9


def gram_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams, how many each text has): distinct ones of texts of words with two blanks before and one after each."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    first, second, third = codes[:-2], codes[1:-1], codes[2:]
    good = (first != 10) & (second != 10) & (third != 10) & ((second != 32) | (third != 32))
    grams, number = np.unique((first << 42 | second << 21 | third)[good], return_inverse=True)
    text = np.cumsum(codes == 10)[:-2][good]
    both = np.unique(text * max(1, len(grams)) + number)
    return grams[both % max(1, len(grams))], np.bincount(both // max(1, len(grams)), minlength=len(texts))


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, sizes, trigrams) of runs of (key, text of words)."""
    for batch in batches:
        texts, first, size = batch.column(1).to_pylist(), 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size > STEP or k == len(texts) - 1:
                grams, sizes = gram_sets(texts[first : k + 1])
                yield batch.column(0).slice(first, k + 1 - first), sizes, grams
                first, size = k + 1, 0


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, sizes, grams in _sets(batches):
        yield pa.RecordBatch.from_arrays([keys, lists(pa.array(grams), sizes)], names=["key", "grams"])


def _shard(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys, sizes, grams = pa.concat_arrays([p[0] for p in parts]), *(np.concatenate([p[k] for p in parts]) for k in (1, 2))
    order = np.argsort(sizes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    known, number = np.unique(grams, return_inverse=True)
    both = np.sort(number * len(sizes) + np.repeat(place, sizes))
    own = np.bincount(both // len(sizes), minlength=len(known))
    one = lambda x: lists(x, np.array([len(x)]))
    columns = [keys.take(pa.array(order)), pa.array(sizes[order], pa.int32()), pa.array(known), pa.array(own, pa.int32()), pa.array(both % len(sizes), pa.int32())]
    return pa.RecordBatch.from_arrays([one(c) for c in columns], names=["keys", "sizes", "grams", "counts", "texts"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in _sets(batches):
        held.append(part)
        size += len(part[2])
        if size >= SHARD:
            yield _shard(held)
            held, size = [], 0
    if held:
        yield _shard(held)


def words_of(texts: DataFrame, key: str) -> DataFrame:
    """key, text: the lower-case alphanumeric words, each with two blanks before and one after it."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.concat(F.lit("  "), F.array_join(F.array_distinct(words), "  "), F.lit(" "))
    return texts.select(F.col(key).alias("key"), padded.alias("text")).where("text is not null")


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


@dataclass(frozen=True)
class Asked:
    """Queries of a block: their sizes, and their trigrams in the order of query and rarity, of which the first `rare` ones are looked
    up first."""

    sizes: np.ndarray
    grams: np.ndarray
    threshold: float

    def near(self, sizes: np.ndarray, own_grams: np.ndarray, counts: np.ndarray, texts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, text, score) of a shard's texts that reach the threshold."""
        n, t = len(sizes), self.threshold
        low, high = np.searchsorted(sizes, self.sizes * t - SLACK), np.searchsorted(sizes, self.sizes / t + SLACK, side="right")
        query, begin = np.repeat(np.arange(len(self.sizes)), self.sizes), np.cumsum(self.sizes) - self.sizes
        place = np.minimum(np.searchsorted(own_grams, self.grams), len(own_grams) - 1)
        met = own_grams[place] == self.grams
        # Postings in the order of trigram and text are one ordered list of numbers.
        flat = np.repeat(np.arange(len(own_grams)), counts) * n + texts
        first = np.where(met, np.searchsorted(flat, place * n + low[query]), 0)
        size = np.where(met, np.searchsorted(flat, place * n + high[query]) - first, 0)
        most = np.ceil(self.sizes * t - SLACK).astype(np.int64) - 1  # trigrams that are not looked up at first
        rare = np.arange(len(query)) - begin[query] < (self.sizes - most)[query]
        total = np.concatenate([[0], np.cumsum(size)])[np.append(begin, len(query))]
        for a, b in self.turns(total, n):
            inside = slice(begin[a], begin[a] + self.sizes[a:b].sum())
            shared = lambda which, a=a, b=b, s=inside: self.counted(texts, query[s][which[s]] - a, first[s][which[s]], size[s][which[s]], (b - a, n))
            found = shared(rare)
            least = np.ceil((self.sizes[a:b, None] + sizes[None]) * (t / (1 + t)) - SLACK) - most[a:b, None]
            open_ = (found > 0) & (found >= least)
            wanted = rare | ~np.isin(query, a + np.flatnonzero(open_.any(1)))
            found += shared(~wanted)
            q, text = np.nonzero(open_)
            both = found[q, text]
            score = both / (self.sizes[a + q] + sizes[text] - both)
            good = score >= t
            yield a + q[good], text[good], score[good]

    def turns(self, total: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Consecutive queries that together have so many postings, and counters, as are counted at a time; or one query."""
        a = 0
        while a < len(self.sizes):
            b = max(a + 1, min(int(np.searchsorted(total, total[a] + COUNTED, side="right")) - 1, a + COUNTED // max(1, n)))
            yield a, b
            a = b

    @staticmethod
    def counted(texts: np.ndarray, query: np.ndarray, first: np.ndarray, size: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        return np.bincount(np.repeat(query * shape[1], size) + texts[ranges(first, size)], minlength=shape[0] * shape[1]).reshape(shape)


def _hits(asked: Asked, top: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, *columns = (batch.column(c)[k].values for c in range(5))
                found = list(asked.near(*(c.to_numpy().astype(np.int64) for c in columns)))
                query, text, score = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
                hits = pa.table({"i": query, "key": keys.take(pa.array(text)), "score": score.astype(float)})
                if top is not None and len(query) > top:
                    hits = hits.sort_by([("i", "ascending"), ("score", "descending"), ("key", "ascending")])
                    own = hits.column("i").to_numpy()
                    new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    rank = np.arange(len(own)) - np.repeat(new, np.diff(np.append(new, len(own))))
                    hits = hits.filter(pa.array(rank < top))
                yield from hits.to_batches()

    return run


@dataclass(frozen=True)
class TrigramIndex:
    spark: SparkSession
    folder: str
    key: str = "chunk_id"

    @classmethod
    def build(cls, texts: DataFrame, folder: str | None = None, key: str = "chunk_id") -> "TrigramIndex":
        """Write the index of (key, text) under a folder, by default one of its own. Texts without trigrams, which are never found, are
        left out."""
        spark = texts.sparkSession
        index = cls(spark, folder or new_folder(spark, "trigrams"), key)
        kind = texts.schema[key].dataType.simpleString()
        rows = words_of(spread(texts.select(key, "text")), key).mapInArrow(_shards, f"keys array<{kind}>, sizes array<int>, grams array<bigint>, counts array<int>, texts array<int>")
        rows.write.mode("overwrite").option("parquet.block.row.count.limit", GROUP).parquet(f"{index.folder}/shards")
        each = index.shards.select(F.explode(F.arrays_zip("grams", "counts")).alias("g"))
        each.groupBy(F.col("g.grams").alias("gram")).agg(F.sum("g.counts").alias("texts")).write.mode("overwrite").parquet(f"{index.folder}/frequencies")
        return index

    @property
    def shards(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/shards")

    @property
    def frequencies(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/frequencies")

    def hits(self, queries: DataFrame, threshold: float = 0.3, top: int | None = None, block: int = BLOCK) -> DataFrame:
        """query_id, key, score of all pairs of (query_id, text) and indexed texts whose similarity reaches the threshold; with `top`,
        at least the first so many of each query.

        Queries go to the shards in blocks; of more than one block, each block's hits are written out, so that neither the driver nor the
        plan grows with the queries."""
        if not 0 < threshold <= 1:
            raise ValueError(f"no threshold: {threshold}")
        kinds = {"i": "bigint", self.key: self.shards.schema["keys"].dataType.elementType.simpleString()}
        grams = words_of(queries.select("query_id", "text"), "query_id").mapInArrow(_gram_rows, f"key {queries.schema['query_id'].dataType.simpleString()}, grams array<bigint>")
        each = grams.where(F.size("grams") > 0).select(F.monotonically_increasing_id().alias("n"), F.col("key").alias("query_id"), "grams")
        asked = written(each, "asked")
        blocks = -(-asked.count() // block)
        number = F.pmod(F.xxhash64("n"), F.lit(max(1, blocks)))
        rarity = F.array_sort(F.collect_list(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")))
        ordered = asked.select("n", "query_id", F.explode("grams").alias("gram")).join(self.frequencies, "gram", "left").groupBy("n", "query_id").agg(rarity.alias("r"))
        ordered = ordered.select("n", "query_id", F.col("r.gram").alias("grams"), number.alias("block"))
        ordered = written(ordered, "ordered") if blocks > 1 else ordered

        def found(b: int) -> DataFrame:
            part = ordered.where(F.col("block") == b).select("query_id", "grams").toArrow()
            own = part.column("grams").combine_chunks()
            terms = Asked(np.diff(own.offsets.to_numpy()).astype(np.int64), own.flatten().to_numpy(), threshold)
            names = self.spark.createDataFrame(pa.table({"i": np.arange(part.num_rows), "query_id": part.column("query_id")}))
            hits = self.shards.mapInArrow(_hits(terms, top), f"i bigint, {self.key} {kinds[self.key]}, score double")
            return hits.join(F.broadcast(names), "i").select("query_id", self.key, "score")

        if blocks <= 1:
            return found(0)
        folder = new_folder(self.spark, "hits")
        for b in range(blocks):
            found(b).write.parquet(f"{folder}/block={b}")
        return self.spark.read.parquet(folder).drop("block")
