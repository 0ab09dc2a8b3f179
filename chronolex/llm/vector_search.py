"""Nearest neighbours by score-aware (anisotropic) product quantisation, four bits per code.

The nearest vector to q has the largest <q, x> - |x|^2 / 2, an inner product, and what counts there is the error
along x. So codebooks and codes minimise |r|^2 + (eta - 1) <r, u>^2 of the residual r of the direction u = x/|x|: the parallel
part is penalised eta times, eta = (d - 1) t^2 / (1 - t^2) for a score threshold t. Directions are quantised, so that rows of
all norms are met alike; the norm is kept beside the codes, scaled so that the score of x itself is exact.

* Fit: coordinate descent on about `sample` rows (those of low id hash), by the driver.
* Index: every row is encoded, two components per code, two codes per byte, with its scale and its exact |x|^2 / 2.
* Search: queries go out in blocks of `block` rows. A task scans its codes by table look-ups, one table of 256 sums
  per byte and query, and keeps `rerank` rows per query, of equal scores those of smaller id; these are merged, and reranked
  by the exact distance.
* Check: the distance of the k-th row found is the query's limit. A row is as far from what its codes say as its index row
  tells (`gap`), so by the triangle inequality the codes rule most rows out; what they don't is compared exactly. So the result is
  that of comparing all pairs, on any rows; where codes tell little apart (near copies), more is compared.

Vectors are taken relative to the middle of the sample, which changes no distance, so a part that all rows share takes no codes.

Edge cases: null, zero or non-finite vectors, and those of another than the most common dimension, take no part;
of rows with one id the smallest vector counts; ties go to the smaller id; with fewer candidates than k all are
returned; an empty table returns no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, sampled

CENTRES = 16
#: Pairs of vectors that are compared at a time.
PAIRS = 1 << 15


def _units(x: np.ndarray) -> np.ndarray:
    """The directions of vectors; zeros stay."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


class Quantiser:
    """Codebooks of 16 centres for each pair of components."""

    def __init__(self, vectors: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 5):
        x = self._padded(vectors)
        self.eta = max(1.0, (x.shape[1] - 1) * threshold**2 / (1 - threshold**2))
        pairs = x.reshape(len(x), -1, 2)
        chosen = np.random.default_rng(seed).integers(0, len(x), (pairs.shape[1], CENTRES))
        self.books = np.stack([pairs[chosen[m], m] for m in range(pairs.shape[1])])
        for _ in range(rounds):
            self._update(pairs, self.codes_of(x))

    @staticmethod
    def _padded(vectors: np.ndarray) -> np.ndarray:
        """Four components to a byte of codes; zeros are added to make that even."""
        return np.pad(np.asarray(vectors, np.float64), ((0, 0), (0, -vectors.shape[1] % 4)))

    @staticmethod
    def _directions(pairs: np.ndarray) -> np.ndarray:
        return _units(pairs.reshape(len(pairs), -1)).reshape(pairs.shape)

    def codes_of(self, vectors: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """The code of each pair, chosen in turn so that the anisotropic loss given the other pairs is least."""
        pairs = self._padded(vectors).reshape(len(vectors), -1, 2)
        along = self._directions(pairs)
        codes = np.zeros(pairs.shape[:2], np.int64)
        for m in range(pairs.shape[1]):
            codes[:, m] = ((pairs[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1)
        rows = np.arange(len(pairs))
        parallel = np.stack([((pairs[:, m] - self.books[m][codes[:, m]]) * along[:, m]).sum(1) for m in range(pairs.shape[1])], 1)
        total = parallel.sum(1)
        for _ in range(sweeps):
            for m in range(pairs.shape[1]):
                residual = pairs[:, m, None] - self.books[m]
                own = (residual * along[:, m, None]).sum(2)
                loss = (residual**2).sum(2) + (self.eta - 1) * ((total - parallel[:, m])[:, None] + own) ** 2
                codes[:, m] = loss.argmin(1)
                total += own[rows, codes[:, m]] - parallel[:, m]
                parallel[:, m] = own[rows, codes[:, m]]
        return codes

    def _update(self, pairs: np.ndarray, codes: np.ndarray) -> None:
        """The best centre of each code given all others: a weighted least-squares problem of two unknowns."""
        along = self._directions(pairs)
        parallel = np.stack([((pairs[:, m] - self.books[m][codes[:, m]]) * along[:, m]).sum(1) for m in range(pairs.shape[1])], 1)
        total = parallel.sum(1)
        for m in range(pairs.shape[1]):
            u, rest = along[:, m], total - parallel[:, m]
            gram = np.eye(2) + (self.eta - 1) * u[:, :, None] * u[:, None, :]
            target = pairs[:, m] + (self.eta - 1) * u * (rest + (pairs[:, m] * u).sum(1))[:, None]
            for c in range(CENTRES):
                own = codes[:, m] == c
                if own.any():
                    self.books[m][c] = np.linalg.solve(gram[own].sum(0), target[own].sum(0))
            now = ((pairs[:, m] - self.books[m][codes[:, m]]) * u).sum(1)
            total += now - parallel[:, m]
            parallel[:, m] = now

    def packed(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two codes to a byte, and the part of each unit vector that its codes have of it."""
        codes = self.codes_of(units)
        decoded = np.take_along_axis(self.books[None], codes[:, :, None, None], 2)[:, :, 0]
        along = (decoded * self._padded(units).reshape(decoded.shape)).sum((1, 2))
        codes = codes.astype(np.uint8)
        return codes[:, 0::2] | (codes[:, 1::2] << 4), along

    def unpacked(self, packed: np.ndarray, components: int) -> np.ndarray:
        """What the bytes of codes stand for."""
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)
        return self.books[np.arange(codes.shape[1]), codes].reshape(len(packed), -1)[:, :components]

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each byte of codes the part of <query, x> that its 256 values stand for."""
        pairs = self._padded(query[None])[0].reshape(-1, 2)
        each = np.einsum("mcd,md->mc", self.books, pairs)
        return (each[1::2, :, None] + each[0::2, None, :]).reshape(len(each) // 2, 256).astype(np.float32)


def _bytes_of(codes: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)


def _encode(quantiser: Quantiser, middle: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()) - middle
                norm = np.linalg.norm(x, axis=1)
                packed, along = quantiser.packed(_units(x))
                scale = norm / np.maximum(along, 0.1)  # a direction that is met so badly gets no more than ten times its codes' part
                gap = np.linalg.norm(x - scale[:, None] * quantiser.unpacked(packed, x.shape[1]), axis=1)
                yield pd.DataFrame({"id": batch["id"], "codes": [r.tobytes() for r in packed], "scale": scale, "half": norm**2 / 2, "gap": gap, "v": batch["v"]})

    return run


def _best(ids: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """The places of the `keep` largest scores, of equal ones those of smaller id."""
    if len(scores) <= keep:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - keep)[len(scores) - keep]
    above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    return np.concatenate([above, equal[np.argsort(ids[equal], kind="stable")[: keep - len(above)]]])


def _scan(quantiser: Quantiser, ids: np.ndarray, queries: np.ndarray, keep: int):
    tables = np.stack([quantiser.tables(q) for q in queries])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list = [(np.empty(0, np.int64), np.empty(0, np.float32))] * len(ids)
        for batch in batches:
            if not len(batch):
                continue
            codes = _bytes_of(batch["codes"]).T.copy()
            own, scale, half = batch["id"].to_numpy(), batch["scale"].to_numpy(np.float32), batch["half"].to_numpy(np.float32)
            for k, table in enumerate(tables):
                score = table[0].take(codes[0])
                for j in range(1, len(codes)):
                    score = score + table[j].take(codes[j])
                score = score * scale - half
                score[(own == ids[k]) | ~np.isfinite(score)] = -np.inf
                top = _best(own, score, keep)
                i, s = np.concatenate([best[k][0], own[top]]), np.concatenate([best[k][1], score[top]])
                top = _best(i, s, keep)
                best[k] = (i[top], s[top])
        for q, (i, s) in zip(ids.tolist(), best):
            live = np.isfinite(s)
            if live.any():
                yield pd.DataFrame({"query_id": q, "id": i[live], "approximate": s[live].astype(np.float64)})

    return run


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, components added in their order as the exact score does."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, y.T):
        total += (a - b) * (a - b)
    return np.sqrt(total)


def _within(quantiser: Quantiser, middle: np.ndarray, ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int):
    """The k nearest rows of each task that are within a query's limit. Rows that their codes rule out are not compared."""
    asked = queries - middle
    squares, sizes = (asked**2).sum(1), np.linalg.norm(queries, axis=1)

    def firsts(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["query_id", "score", "id"]).groupby("query_id").head(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"query_id": np.empty(0, np.int64), "id": np.empty(0, np.int64), "score": np.empty(0)})
        for batch in batches:
            if not len(batch):
                continue
            own, x = batch["id"].to_numpy(), np.stack(batch["v"].to_numpy())
            told = batch["scale"].to_numpy()[:, None] * quantiser.unpacked(_bytes_of(batch["codes"]), x.shape[1])
            both = squares[:, None] + (told**2).sum(1)
            # Both sides leave room for rounding; what overflows is compared.
            reach = (limits[:, None] + batch["gap"].to_numpy()) * (1 + 1e-9) + 1e-12 * (sizes[:, None] + np.linalg.norm(x, axis=1))
            out = both * (1 - 1e-12) - 2 * (asked @ told.T) > reach**2 + 1e-300
            q, r = np.nonzero(~out & (ids[:, None] != own))
            for first in range(0, len(q), PAIRS):
                a, b = q[first : first + PAIRS], r[first : first + PAIRS]
                score = _distances(x[b], queries[a])
                near = score <= limits[a]
                if near.any():
                    held = firsts(pd.concat([held, pd.DataFrame({"query_id": ids[a[near]], "id": own[b[near]], "score": score[near]})]))
        yield held

    return run


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, rerank: int = 400, sample: int = 20_000, block: int = 1024, threshold: float = 0.2
) -> DataFrame:
    """For each row of `queries` (ids of `vectors`) its k nearest others: query_id, rank, id, score (Euclidean)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(usable).groupBy("id").agg(F.min("v").alias("v"))
    rows = materialise(rows, "vectors")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double").withColumnRenamed("id", id_col)
    rows = rows.where(F.size("v") == common["d"])
    fit = np.stack(sampled(rows, ["id"], sample).select("v").toPandas()["v"].to_numpy())
    middle = (fit / len(fit)).sum(0)
    quantiser = Quantiser(_units(fit - middle), threshold)
    index = materialise(rows.mapInPandas(_encode(quantiser, middle), "id long, codes binary, scale double, half double, gap double, v array<double>"), "index")
    codes = index.select("id", "codes", "scale", "half")

    asked = materialise(queries.select(F.col(id_col).cast("long").alias("id")).distinct().join(rows, "id"), "queries")
    blocks = max(1, -(-asked.count() // block))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    found = []
    for b in range(blocks):
        # About `block` queries at a time reach the driver and the tasks, whatever their number.
        part = numbered.where(F.col("block") == b).select("id", "v").toPandas()
        if len(part):
            scan = _scan(quantiser, part["id"].to_numpy(), np.stack(part["v"].to_numpy()) - middle, rerank)
            found.append(materialise(codes.mapInPandas(scan, "query_id long, id long, approximate double"), "candidates"))
    candidates = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, id long, approximate double")
    first = Window.partitionBy("query_id").orderBy(F.desc("approximate"), "id")
    kept = candidates.withColumn("r", F.row_number().over(first)).where(F.col("r") <= rerank).select("query_id", "id")
    exact = kept.join(rows, "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    score = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    ranked = exact.select("query_id", "id", score.alias("score")).withColumn("rank", place).where(F.col("rank") <= k)
    limits = ranked.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.max("score")).alias("limit"))

    # What is nearer than the k-th row found, if anything is.
    limited = materialise(numbered.join(limits, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf")))), "limits")
    nearest = []
    for b in range(blocks):
        part = limited.where(F.col("block") == b).select("id", "v", "limit").toPandas()
        if len(part):
            check = _within(quantiser, middle, part["id"].to_numpy(), np.stack(part["v"].to_numpy()), part["limit"].to_numpy(), k)
            nearest.append(materialise(index.select("id", "codes", "scale", "gap", "v").mapInPandas(check, "query_id long, id long, score double"), "nearest"))
    if not nearest:
        return ranked.limit(0).select("query_id", "rank", F.col("id").alias(id_col), "score")
    ranked = reduce(DataFrame.union, nearest).withColumn("rank", place)
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))
