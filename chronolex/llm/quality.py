"""Quality classification by a factorisation machine.

A text's features are its hashed lower-case words, weighted by the logarithm of their number and scaled to length one; statistics of its
structure (share of capitals, digits and other signs, distinct words, words that repeat the one before, share of
the most frequent word, word and line lengths), each in
a bin; and numeric metadata columns, in bins too. The score is the logistic function of

    bias + sum(w_i x_i) + sum over f of ((sum(v_if x_i))**2 - sum((v_if x_i)**2)) / 2,

which covers all pairwise interactions <v_i, v_j> x_i x_j in time linear in the number of features.

The machine is fitted by Adagrad on about `sample` labelled training rows (those of low id hash), which is all that reaches the
driver; all rows are scored. Labels of held-out rows teach nothing; labels, lang, source and doc_id are never inputs of a score.

Edge cases: null and empty texts have no words, only the bins of an empty structure; repeated rows each return a row; labels that are
null, or of unknown documents, teach nothing, and of several labels of one document the highest counts; without training labels
every score is the bias of the share 0.5; metadata that is null has a bin of its own, and a metadata column that the table lacks is that
everywhere; an empty table returns no rows; very long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoded, lean, sampled, steps, word_hashes
from .toxicity import held_out

BUCKETS = 1 << 15
#: Upper bounds of the bins of shares; numbers are in bins by powers of two, at most NUMBERS.
SHARES = np.array([0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9])
NUMBERS = 32
STATISTICS = 11
WIDTH = 34
METADATA = ("n_chars",)

CAPITAL, DIGIT, SIGN, LETTER = (np.zeros(256, np.int64) for _ in range(4))
CAPITAL[65:91] = 1
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = 1
DIGIT[48:58] = 1
SIGN[33:48] = SIGN[58:65] = SIGN[91:97] = SIGN[123:127] = 1


def _number_bins(x: np.ndarray) -> np.ndarray:
    """0 where unknown, then by powers of two."""
    known = np.isfinite(x)
    return np.where(known, 1 + np.minimum(np.floor(np.log2(1 + np.maximum(np.where(known, x, 0), 0))), NUMBERS), 0).astype(np.int64)


def _structure(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, *counts: np.ndarray) -> np.ndarray:
    """The bin of each statistic of each text; each statistic has WIDTH bins. counts: numbers of words of some kind."""
    total = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets])
    line = np.zeros(256, np.int64)
    line[10] = 1
    size, letters, lines = np.diff(offsets) - 1, total(LETTER), total(line)  # each text ends with a line feed of ours
    share = lambda a, b: np.searchsorted(SHARES, a / np.maximum(b, 1), side="right")
    columns = [
        share(total(CAPITAL), letters), share(total(DIGIT), size), share(total(SIGN), size), share(letters, size), *(share(c, words) for c in counts),
        _number_bins(words.astype(float)), np.minimum(np.round(2 * np.sqrt(size / np.maximum(words, 1))), WIDTH - 1).astype(np.int64), _number_bins(words / lines), _number_bins(lines - 1.0),
    ]
    return np.stack(columns, 1)


def features(texts: list[bytes], metadata: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, values, number of each text) of runs of texts. metadata: a column for each, not a number where unknown."""
    for first, past, data, offsets in steps(texts):
        hashes, _, _, bounds = word_hashes(data, offsets)
        words = np.diff(bounds)
        doc = np.repeat(np.arange(past - first, dtype=np.uint64), words)
        key, times = np.unique(doc * np.uint64(BUCKETS) + hashes % np.uint64(BUCKETS), return_counts=True)
        doc, bucket = (key // np.uint64(BUCKETS)).astype(np.int64), (key % np.uint64(BUCKETS)).astype(np.int64)
        distinct, most = np.bincount(doc, minlength=past - first), np.zeros(past - first, np.int64)
        np.maximum.at(most, doc, times)
        same = np.concatenate([[0], np.cumsum(np.append(False, hashes[1:] == hashes[:-1]))]) if len(hashes) else np.zeros(1, np.int64)
        again = np.maximum(same[bounds[1:]] - same[np.minimum(bounds[:-1] + 1, len(same) - 1)], 0)
        bins = np.column_stack([_structure(data, offsets, words, distinct, again, most), *(_number_bins(m) for m in metadata[:, first:past])])
        bins += BUCKETS + WIDTH * np.arange(bins.shape[1])
        weight = np.log1p(times)
        weight /= np.sqrt(np.bincount(doc, weight * weight, past - first))[doc]
        index = np.concatenate([bucket, bins.ravel()])
        value = np.concatenate([weight, np.full(bins.size, 1 / np.sqrt(bins.shape[1]))])
        order = np.argsort(np.concatenate([doc, np.repeat(np.arange(past - first), bins.shape[1])]), kind="stable")
        yield index[order], value[order], distinct + bins.shape[1]


class FactorisationMachine:
    def __init__(self, size: int, rank: int, seed: int = 11):
        self.bias, self.linear = 0.0, np.zeros(size)
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (size, rank))

    def score(self, index: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The logit of each text; each has a feature at least."""
        first = np.cumsum(sizes) - sizes
        mixed = self.factors[index] * value[:, None]
        total = np.add.reduceat(mixed, first)
        pairs = (total * total - np.add.reduceat(mixed * mixed, first)).sum(1) / 2
        return self.bias + np.add.reduceat(self.linear[index] * value, first) + pairs

    def fit(self, index: np.ndarray, value: np.ndarray, sizes: np.ndarray, labels: np.ndarray, updates: int = 500, batch: int = 128, rate: float = 0.3, ridge: float = 2e-5, seed: int = 12) -> None:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        self.bias = float(np.log(share / (1 - share)))
        start, random = np.cumsum(sizes) - sizes, np.random.default_rng(seed)
        squares, moved = np.full(len(self.linear), 1e-2), np.full(self.factors.shape, 1e-2)
        for _ in range(max(8, -(-updates * batch // max(len(sizes), batch)))):
            order = random.permutation(len(sizes))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                own = sizes[rows]
                at = np.repeat(start[rows] - np.cumsum(own) + own, own) + np.arange(own.sum())
                i, x, row = index[at], value[at], np.repeat(np.arange(len(rows)), own)
                error = 1 / (1 + np.exp(-np.clip(self.score(i, x, own), -30, 30))) - labels[rows]
                mixed = self.factors[i] * x[:, None]
                total = np.add.reduceat(mixed, np.cumsum(own) - own)
                slope, met, inverse = (error[row] * x), *np.unique(i, return_inverse=True)
                deep = slope[:, None] * (total[row] - mixed)
                gradient = np.bincount(inverse, slope) / len(rows) + ridge * self.linear[met]
                deep = np.stack([np.bincount(inverse, d) for d in deep.T], 1) / len(rows) + ridge * self.factors[met]
                squares[met] += gradient**2
                moved[met] += deep**2
                self.linear[met] -= rate * gradient / np.sqrt(squares[met])
                self.factors[met] -= rate * deep / np.sqrt(moved[met])
                self.bias -= rate * 0.1 * error.mean()


def _columns(batch: pd.DataFrame, metadata: tuple[str, ...]) -> np.ndarray:
    return np.stack([batch[f"meta_{k}"].to_numpy(float, na_value=np.nan) for k in range(len(metadata))]) if metadata else np.empty((0, len(batch)))


def _learning(metadata: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            labels, done = batch["label"].tolist(), 0
            for index, value, sizes in features(encoded(batch["text"]), _columns(batch, metadata)):
                cuts = np.cumsum(sizes)[:-1]
                written = lambda x, kind: [part.tobytes() for part in np.split(x.astype(kind), cuts)]  # noqa: E731, B023
                yield pd.DataFrame({"label": labels[done : done + len(sizes)], "index": written(index, "<i4"), "value": written(value, "<f4")})
                done += len(sizes)

    return run


def _scoring(machine: FactorisationMachine, metadata: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            logits = [machine.score(*found) for found in features(encoded(batch["text"]), _columns(batch, metadata))]
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(logits or [np.empty(0)]), -30, 30)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": score})

    return run


def train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...], sample: int, rank: int) -> FactorisationMachine:
    """docs: doc_id, text, meta_k. labels: doc_id, label, of training rows, each id once."""
    machine = FactorisationMachine(BUCKETS + WIDTH * (STATISTICS + len(metadata)), rank)
    # A bounded number of labels is broadcast; the texts stay where they are.
    chosen = docs.join(F.broadcast(sampled(labels, ["doc_id"], sample)), "doc_id")
    rows = chosen.mapInPandas(lean(_learning(metadata)), "label int, index binary, value binary").toPandas()
    if len(rows):
        sizes = rows["index"].map(len).to_numpy(np.int64) // 4
        index, value = (np.frombuffer(b"".join(rows[c]), kind) for c, kind in (("index", "<i4"), ("value", "<f4")))
        machine.fit(index.astype(np.int64), value.astype(float), sizes, rows["label"].to_numpy(float))
    return machine


def score_quality(documents: DataFrame, labels: DataFrame, sample: int = 12_000, rank: int = 8, threshold: float = 0.7, metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    meta = [(F.col(m) if m in documents.columns else F.lit(None)).cast("double").alias(f"meta_{k}") for k, m in enumerate(metadata)]
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *meta)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    training = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    machine = train(docs, training, metadata, sample, rank)
    scored = docs.mapInPandas(lean(_scoring(machine, metadata)), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
