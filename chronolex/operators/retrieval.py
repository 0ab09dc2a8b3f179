"""Hybrid retrieval, for a batch of queries at a time: trigrams, cosine, reciprocal rank fusion, routing, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import in_force, require_as_of
from ..functions.text import citation
from ..scratch import new_folder, written
from ..settings import settings
from .graph import expand_refs
from .text_index import TrigramIndex
from .vector_index import VectorIndex, vector


def similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams of both, 0 where neither has any."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ > 0, both / any_).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def dated_chunks(chunks: DataFrame, version: DataFrame, as_of: date | None = None) -> DataFrame:
    """Chunks (article_key, ...) with the article_id, valid_from and valid_to of their version; on a date, those in force then."""
    dated = chunks.join(version.select("article_key", "article_id", "valid_from", "valid_to"), "article_key")
    return dated if as_of is None else dated.where(in_force(require_as_of(as_of)))


def top_n(hits: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n hits of each query with their rank."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= n)


def keyword_search(queries: DataFrame, chunks: DataFrame | None, top: int = 30, threshold: float = 0.3, key: str = "chunk_id", index: TrigramIndex | None = None) -> DataFrame:
    """(query_id, key, score, rank) of chunks whose similarity to the query text reaches the threshold.

    With an index of texts, `chunks` says which of them count (None: all); without one, the texts of `chunks` are indexed first.
    """
    found = index or TrigramIndex.build(chunks, key=key)
    hits = found.hits(queries, threshold, top if index is None or chunks is None else None)
    if index is not None and chunks is not None:
        hits = hits.join(chunks.select(key), key, "left_semi")
    return top_n(hits, top, [F.desc("score"), F.col(key)]).select("query_id", key, "score", "rank")


#: Rows of vectors that are scored at a time.
SLICE = 1000


def _nearest(asked: list[np.ndarray | None], top: int):
    """(i, key, score, place) of the best `top` rows of a partition for each vector asked, i its number; place orders them."""
    sizes = {len(q) for q in asked if q is not None}

    def scores(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, whether there is one) by vector asked and row."""
        score, known = np.zeros((len(asked), len(vectors))), np.zeros((len(asked), len(vectors)), bool)
        for n in sizes:
            at = np.flatnonzero([q is not None and len(q) == n for q in asked])
            rows = np.flatnonzero([v is not None and len(v) == n for v in vectors])
            if not len(rows):
                continue
            q, v = np.stack([asked[i] for i in at]).astype(float), np.stack(list(vectors[rows])).astype(float)
            with np.errstate(invalid="ignore", divide="ignore"):
                norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))
                score[np.ix_(at, rows)] = q @ v.T / norm
            known[np.ix_(at, rows)] = norm != 0
        return score, known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                order = pc.array_sort_indices(part.column(0), null_placement="at_start")
                keys = part.column(0).take(order)
                score, known = scores(part.column(1).take(order).to_numpy(zero_copy_only=False))
                # As Spark sorts: what is no number above all numbers, and no score at the end.
                place = np.where(known, np.where(np.isnan(score), np.inf, np.round(score, 9)), -np.inf)
                best = np.argsort(-place, axis=1, kind="stable")[:, :top]
                pick = lambda x: np.take_along_axis(x, best, 1).ravel()  # noqa: E731, B023
                new = pd.DataFrame({"i": np.repeat(np.arange(len(asked)), best.shape[1]), "score": pick(score), "known": pick(known), "place": pick(place)})
                new["key"] = pd.Series(keys.take(pa.array(best.ravel())), dtype=pd.ArrowDtype(keys.type))
                both = new if held is None else pd.concat([held, new])
                held = both.sort_values(["i", "place", "key"], ascending=[True, False, True], na_position="first").groupby("i").head(top)
        if held is not None:
            score = pa.array(held["score"].to_numpy(), mask=~held["known"].to_numpy(), from_pandas=False)
            columns = [pa.array(held["i"].to_numpy(), pa.int64()), pa.array(held["key"]), score, pa.array(held["place"].to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "key", "score", "place"])

    return run


def vector_search(queries: DataFrame, chunks: DataFrame, as_of: date, today: date, top: int = 30, key: str = "chunk_id", block: int = 1000, index: VectorIndex | None = None) -> DataFrame:
    """(query_id, key, score, rank) by exact cosine. Scores equal to nine places are ties. From today on the current chunks count, without a
    look at dates; before, those in force. Chunks without a vector come last.

    An index of the current chunks answers searches from today on. Else queries go to the chunks in blocks of about `block` rows, and of each
    partition only its best hits of each query move; of more than one block, each block's hits are written out.
    """
    current = require_as_of(as_of) >= today
    if current and index is not None:
        return index.nearest(queries, top, block)
    rows = chunks.where("is_current") if current else chunks.where(in_force(as_of))
    vectors, asked = rows.select(F.col(key).alias("key"), vector("embedding").alias("v")), queries.select("query_id", vector("embedding").alias("q"))
    blocks = max(1, -(-asked.count() // block))
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (rows, key))}

    def found(b: int) -> DataFrame:
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        names = queries.sparkSession.createDataFrame([(i, r["query_id"]) for i, r in enumerate(part)], f"i long, query_id {types['query_id']}")
        near = vectors.mapInArrow(_nearest([None if r["q"] is None else np.array(r["q"]) for r in part], top), f"i long, key {types[key]}, score double, place double")
        best = near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("place"), "key"))).where(F.col("rank") <= top)
        return best.join(F.broadcast(names), "i").select("query_id", F.col("key").alias(key), "score", "rank")

    if blocks == 1:
        return found(0)
    folder = new_folder(queries.sparkSession, "nearest")
    for b in range(blocks):
        found(b).write.parquet(f"{folder}/block={b}")
    return queries.sparkSession.read.parquet(folder).drop("block")


def rrf_fuse(*lists: DataFrame, k: int = 60, top: int = 30, key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, key, rank): of repeated keys the last rank counts, a key that a list lacks ranks
    after its end, and equal scores keep the order of first sight."""
    all_ = written(reduce(DataFrame.unionByName, [x.select("query_id", key, F.col("rank").cast("int").alias("rank"), F.lit(i).alias("list_id")) for i, x in enumerate(lists)]), "lists")  # it is read twice
    placed = all_.groupBy("query_id", key).agg(
        *(F.max(F.when(F.col("list_id") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(lists))), F.min(F.struct("list_id", "rank")).alias("first")
    )
    sizes = all_.groupBy("query_id").agg(*(F.count_if(F.col("list_id") == i).alias(f"n{i}") for i in range(len(lists))))
    score = reduce(lambda a, b: a + b, [1.0 / (k + F.coalesce(F.col(f"r{i}"), F.col(f"n{i}") + 1)) for i in range(len(lists))])
    return top_n(placed.join(sizes, "query_id").withColumn("score", score), top, [F.desc("score"), F.col("first")]).select("query_id", key, "score", "rank")


def route_direct(queries: DataFrame, versions: DataFrame, names: list[str] | DataFrame, as_of: date, **patterns) -> DataFrame:
    """Queries that name an article, beside its version on the date they state, else on as_of. versions: law, art_no, branch_no, ...;
    patterns: what else `citation` takes."""
    parsed = queries.withColumn("c", citation(F.col("text"), names, **patterns)).where("c is not null")
    asked = parsed.select("query_id", "c.law", "c.art_no", "c.branch_no", F.coalesce("c.historical_date", F.lit(require_as_of(as_of))).alias("anchor"))
    return asked.join(versions, ["law", "art_no", "branch_no"]).where(in_force(F.col("anchor")))


def rerank(hits: DataFrame, top: int = 20, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """By a scorer that adds `rerank_score`; without one, or where it scores nothing of a query, the order stays."""
    if scorer is None:
        return hits.where(F.col("rank") <= top)
    scored = scorer(hits).withColumn("_any", F.max("rerank_score").over(Window.partitionBy("query_id")))
    kept = scored.where(F.col("_any").isNull() | F.col("rerank_score").isNotNull()).withColumnRenamed("rank", "_rank")
    return top_n(kept, top, [F.desc_nulls_last("rerank_score"), F.col("_rank")]).drop("_rank", "_any")


def search(
    queries: DataFrame, chunks: DataFrame, versions: DataFrame, edges: DataFrame, rulings: DataFrame, addenda: DataFrame, names: list[str] | DataFrame, as_of: date, today: date,
    top: int = 20, hops: int = 1, k: int | None = None, scorer: Callable[[DataFrame], DataFrame] | None = None, vector_chunks: DataFrame | None = None,
    index: TrigramIndex | None = None, vector_index: VectorIndex | None = None, **patterns,
) -> DataFrame:
    """Routed or fused articles of each query, one row per hit, with what belongs to them: `related`, the versions in force of the
    articles they refer to; `rulings` on them; `addenda`, the texts of addendum items that name them.

    queries: query_id, text, embedding. chunks: chunk_id, article_id, text, embedding, is_current, valid_from, valid_to.
    versions: article_id, article_key, law, art_no, branch_no, body, valid_from, valid_to. addenda: addendum_id, body, target_articles.
    vector_chunks: the chunks that have vectors, if not all have; index, vector_index: of the texts of all chunks and of the vectors of current ones, if
    there are any; patterns: what else `citation` takes.
    """
    knobs = settings(queries.sparkSession)
    k, retrieve = k or knobs.rrf_k, knobs.retrieve_top_k
    direct = route_direct(queries, versions, names, as_of, **patterns).select("query_id", "article_id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    open_ = queries.join(direct.select("query_id"), "query_id", "left_anti")
    by_text = keyword_search(open_, chunks.where(in_force(as_of)), top=retrieve, index=index)
    by_vector = vector_search(open_, chunks if vector_chunks is None else vector_chunks, as_of, today, top=retrieve, index=vector_index)
    fused = rrf_fuse(by_text, by_vector, k=k, top=top).join(chunks.select("chunk_id", "article_id"), "chunk_id")
    current = versions.where(in_force(require_as_of(as_of)))
    articles = fused.groupBy("query_id", "article_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank")).join(current.select("article_id", "body"), "article_id")
    hits = rerank(articles, top, scorer).select("query_id", "article_id", "score", "rank").unionByName(direct)
    found = hits.select("article_id").distinct()
    nodes, _ = expand_refs(found.select(F.col("article_id").alias("start")), edges, as_of, hops)
    version = F.struct("article_id", "article_key", "body")
    related = nodes.where("hop > 0").select("start", F.col("node").alias("article_id")).join(current, "article_id").groupBy("start").agg(F.sort_array(F.collect_list(version)).alias("related"))
    cited = rulings.select(F.explode(F.array_distinct("cited_article_ids")).alias("article_id"), "ruling_id").join(found, "article_id", "left_semi")
    cited = cited.groupBy("article_id").agg(F.sort_array(F.collect_set("ruling_id")).alias("rulings"))
    named = addenda.select("addendum_id", "body", F.explode(F.array_distinct("target_articles")).alias("article_id")).join(found, "article_id", "left_semi")
    named = named.groupBy("article_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("addendum_id", "body"))), lambda a: a["body"]).alias("addenda"))
    rows = hits.join(related.withColumnRenamed("start", "article_id"), "article_id", "left").join(cited, "article_id", "left").join(named, "article_id", "left")
    full = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    return rows.select("query_id", "article_id", "score", "rank", full("related"), full("rulings"), full("addenda"))
