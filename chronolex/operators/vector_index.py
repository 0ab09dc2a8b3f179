"""Exact nearest vectors by cosine from cells with certified bounds.

Vectors are scaled to length one and dealt to the cells of K centres. With d the distance of a query to a centre and r the cell's
radius, the farthest that one of its vectors lies from the centre, no vector of the cell is nearer than d - r; so its cosine is at
most 1 - max(0, d - r)**2 / 2. A search visits the nearest cells of each query first; then every cell whose bound reaches the
score that the query's last hit has by then. No other cell can hold a hit, so the result is that of a full scan.

The table is written by cell, a folder each, and only the folders of visited cells are read. Rows that have no direction (null, zero, not
finite, of another length) are a cell of their own, OTHERS, that every query visits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import new_folder, spread, written

OTHERS = -1
#: Rows that the centres are fitted on, centres at most, cells that are visited first, and queries that go out at a time.
SAMPLE = 50_000
CENTRES = 4096
FIRST = 4
BLOCK = 4096
#: Distances are rounded by less than this.
SLACK = 1e-6
#: Scores equal to so many places are ties.
PLACES = 9


def place_of() -> Column:
    return F.row_number().over(Window.partitionBy("i").orderBy(F.desc("place"), "key"))


def fitted_centres(vectors: np.ndarray, number: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Centres by a few rounds of k-means."""
    centres = vectors[np.random.default_rng(seed).choice(len(vectors), number, replace=False)]
    for _ in range(rounds):
        own = (vectors @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        count = np.bincount(own, minlength=number)
        total = np.stack([np.bincount(own, column, number) for column in vectors.T], 1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def directions(values: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors of this length that have a direction, the directions)."""
    kept = [(k, v) for k, v in enumerate(values.to_numpy(zero_copy_only=False)) if v is not None and len(v) == size]
    x = np.array([v for _, v in kept], float).reshape(len(kept), size)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        return np.array([k for k, _ in kept], np.int64)[good], x[good] / norm[good, None]


def _dealt(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.full(batch.num_rows, OTHERS), np.zeros(batch.num_rows)
            places, units = directions(batch.column(1), centres.shape[1])
            for at in range(0, len(places), 4096):
                d = distances(units[at : at + 4096], centres)
                cell[places[at : at + 4096]], away[places[at : at + 4096]] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return run


def vector(c: str) -> Column:
    """A vector with a null in it is none."""
    return F.when(~F.exists(c, lambda x: x.isNull()), F.col(c)).cast("array<double>")


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    folder: str
    key: str = "chunk_id"
    kind: str = "bigint"

    @classmethod
    def build(cls, vectors: DataFrame, folder: str | None = None, key: str = "chunk_id", embedding: str = "embedding") -> "VectorIndex":
        """Write the index of (key, embedding). All rows are indexed; the centres are fitted on about SAMPLE of them."""
        spark = vectors.sparkSession
        index = cls(spark, folder or new_folder(spark, "vectors"), key, vectors.schema[key].dataType.simpleString())
        rows = written(spread(vectors.select(F.col(key).alias("key"), vector(embedding).alias("v"))), "vectors")
        total = rows.where("v is not null").count()
        some = rows.where("v is not null").where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, total))))
        sample = some.select("v").toArrow().column("v").combine_chunks() if total else pa.array([], pa.list_(pa.float64()))
        lengths = np.array([len(v) for v in sample.to_pylist()], np.int64)
        size = int(np.bincount(lengths).argmax()) if len(lengths) else 1
        units = directions(sample, size)[1]
        number = min(CENTRES, max(1, round(np.sqrt(total))), len(units))
        centres = fitted_centres(units, number) if len(units) else np.zeros((1, size))
        dealt = rows.mapInArrow(_dealt(centres), f"key {index.kind}, v array<double>, cell int, away double")
        dealt.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{index.folder}/rows")
        cells = index.rows.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("rows"))
        shape = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
        shape.join(cells, "cell", "left").unionByName(cells.where(F.col("cell") == OTHERS).withColumn("centre", F.lit(None).cast("array<double>"))).coalesce(1).write.mode("overwrite").parquet(f"{index.folder}/cells")
        return index

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"key {self.kind}, v array<double>, away double, cell int").parquet(f"{self.folder}/rows")

    def nearest(self, queries: DataFrame, top: int = 30, block: int = BLOCK, read: list | None = None) -> DataFrame:
        """(query_id, key, score, rank) by exact cosine: what a full scan returns, rows without a score last, ties by key.

        Queries that have no direction score nothing, so for these all rows tie. `read` gets, for each block, how many rows its queries
        were compared with, and how many a full scan takes."""
        cells = self.spark.read.parquet(f"{self.folder}/cells").orderBy("cell").toArrow().to_pylist()  # one row per centre
        asked = written(queries.select("query_id", vector("embedding").alias("v")).withColumn("n", F.monotonically_increasing_id()), "asked")
        blocks = max(1, -(-asked.count() // block))
        folder = new_folder(self.spark, "nearest")
        for b in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).select("query_id", "v").toArrow()
            self._block(part, cells, top, read).write.parquet(f"{folder}/block={b}")
        return self.spark.read.parquet(folder).drop("block")

    def _block(self, asked: pa.Table, cells: list[dict], top: int, read: list | None) -> DataFrame:
        known = [c for c in cells if c["cell"] != OTHERS]
        centres = np.array([c["centre"] for c in known], float)
        radius = np.array([c["radius"] if c["rows"] else -np.inf for c in known], float)
        sizes = np.array([c["rows"] or 0 for c in known], np.int64)
        others = sum(c["rows"] for c in cells if c["cell"] == OTHERS)
        values = asked.column("v").combine_chunks()
        places, units = directions(values, centres.shape[1])
        far = distances(units, centres)
        bound = 1 - np.maximum(0, far - radius - SLACK) ** 2 / 2
        bound[:, sizes == 0] = -np.inf
        visits = np.zeros(bound.shape, bool)
        if bound.size:
            np.put_along_axis(visits, np.argsort(np.where(sizes, far, np.inf), axis=1)[:, :FIRST], True, 1)
            visits &= sizes > 0
        odd = np.setdiff1d(np.arange(asked.num_rows), places)  # these go everywhere
        seen = self._visited(asked, values, places, visits, odd, top, True)
        first = written(seen, "first")
        last = np.full(len(places), -np.inf)
        kth = first.withColumn("rank", place_of()).where((F.col("rank") == top) & F.col("known")).select("i", "score").toArrow()
        spot = {int(i): k for k, i in enumerate(places)}
        for i, score in zip(kth.column("i").to_pylist(), kth.column("score").to_pylist()):
            if i in spot:
                last[spot[i]] = score
        more = (bound >= last[:, None] - 10.0**-PLACES - SLACK) & ~visits & (sizes > 0)
        if read is not None:
            total = int(sizes.sum()) + others
            read.append((int(((visits | more) * sizes).sum()) + others * len(places) + len(odd) * total, asked.num_rows * total))
        second = self._visited(asked, values, places, more, np.empty(0, np.int64), top, False)
        names = self.spark.createDataFrame(pa.table({"i": np.arange(asked.num_rows), "query_id": asked.column("query_id")}))
        ranked = first.unionByName(second).withColumn("rank", place_of()).where(F.col("rank") <= top)
        return ranked.join(F.broadcast(names), "i").select("query_id", F.col("key").alias(self.key), F.when(F.col("known"), F.col("score")).alias("score"), "rank")

    def _visited(self, asked: pa.Table, values: pa.Array, places: np.ndarray, visits: np.ndarray, odd: np.ndarray, top: int, everyone: bool) -> DataFrame:
        """(i, key, score, known, place): of each partition the best `top` rows of every query, among the cells it visits; `everyone`
        visits OTHERS too, and odd queries all cells."""
        by_cell = {int(c): np.concatenate([places[visits[:, c]], odd]) for c in range(visits.shape[1]) if visits[:, c].any() or len(odd)}
        if everyone:
            by_cell[OTHERS] = np.arange(asked.num_rows)
        rows = self.rows.where(F.col("cell").isin(list(by_cell))).select("key", "v", "cell")
        vectors = [v.values.to_numpy() if v.is_valid else None for v in values]
        return rows.mapInArrow(_scores(vectors, by_cell, top), f"i bigint, key {self.kind}, score double, known boolean, place double")


def _scores(vectors: list[np.ndarray | None], by_cell: dict[int, np.ndarray], top: int):
    lengths = np.array([-1 if v is None else len(v) for v in vectors])

    def scored(asked: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score, known = np.zeros((len(asked), len(own))), np.zeros((len(asked), len(own)), bool)
        sizes = np.array([-1 if v is None else len(v) for v in own])
        for n in np.intersect1d(lengths[asked], sizes):
            if n >= 0:
                i, j = np.flatnonzero(lengths[asked] == n), np.flatnonzero(sizes == n)
                q, x = np.stack([vectors[k] for k in asked[i]]).astype(float), np.stack(list(own[j])).astype(float)
                with np.errstate(all="ignore"):
                    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))
                    score[np.ix_(i, j)] = q @ x.T / norm
                known[np.ix_(i, j)] = norm != 0
        return score, known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cells, values = batch.column(2).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                asked, at = by_cell[int(cell)], np.flatnonzero(cells == cell)
                for a in range(0, len(at), 1000):
                    own = at[a : a + 1000]
                    score, known = scored(asked, values[own])
                    # As Spark sorts: what is no number above all numbers, and no score at the end.
                    place = np.where(known, np.where(np.isnan(score), np.inf, np.round(score, PLACES)), -np.inf)
                    new = pa.table({"i": np.repeat(asked, len(own)), "key": batch.column(0).take(pa.array(np.tile(own, len(asked)))), "score": score.ravel(), "known": known.ravel(), "place": place.ravel()})
                    held = _first(new if held is None else pa.concat_tables([held, new]), top)
        if held is not None:
            yield from held.to_batches()

    return run


def _first(rows: pa.Table, top: int) -> pa.Table:
    """The best rows of each i."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("i", "ascending"), ("place", "descending"), ("key", "ascending")]))
    own = rows.column("i").to_numpy()
    new = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(new, np.diff(np.append(new, len(own))))
    return rows.filter(pa.array(rank < top)).combine_chunks()
