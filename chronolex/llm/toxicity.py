"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels.

* Voters say toxic, clean or nothing of a text: a fixed lexicon of insults, repeated hits, hits per word, insulting
  turns of phrase, words and word beginnings mined from labelled training rows (strong ones, several weak ones), and
  the absence of all of these. Words of the lexicon that mark clean training rows as much as toxic ones are left out.
* The label model is fitted by expectation maximisation on the histogram of vote patterns, at most 3**voters rows,
  whatever the number of documents. It estimates each voter's accuracy and the correlations of voters given the class;
  correlated voters share their weight, so that several versions of one signal don't outvote the rest.
* A logistic regression on the voters' features is fitted to the posteriors of `sample` training rows.

Labels are used for the class balance and for mining, from training rows only; mining reads about `mined_rows` of them (those of
low id hash, each text once) and keeps every mark that 1.5 percent of the toxic ones hold: a text has so many marks, so there are
at most 67 times as many of these, whatever the number of rows. lang, source and doc_id are never inputs of a score.

Edge cases: null and empty texts have no hits and get the score of a clean text; repeated rows each return a row; labels
that are null, or of unknown documents, teach nothing; without any labels the balance is 0.1 and nothing is mined; an empty
table returns no rows; very long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialise, sampled

# Common insults in the four languages of the corpus.
LEXICON = frozenset(
    """
    asshole bastard bitch clown coward creep cretin crap cunt damn degenerate dickhead dimwit disgusting dumb dumbass
    dunce fool filth filthy freak garbage halfwit horrible idiot idiotic ignorant imbecile jackass jerk lame liar loser
    lunatic maggot moron moronic nasty numbskull parasite pathetic pig psycho retard rubbish scum scumbag shit shut
    sick slob stupid sucker trash twit ugly useless vermin vile weirdo worthless
    abruti connard connasse débile imbécile minable ordure pourri salaud salope crétin raté
    abschaum arschloch blödmann dummkopf trottel vollidiot wertlos widerlich versager mistkerl
    asqueroso basura cabrón estúpido imbécil inútil idiota patético perdedor tonto escoria
    """.split()
)
WORD = re.compile(r"[^\W\d_]+")
PHRASE = re.compile(r"\b(?:you|this|these|those|such|he|she|they)\s+(?:are\s+|is\s+)?(?:an?\s+|the\s+|all\s+)?(?:" + "|".join(sorted(LEXICON)) + r")\b")
FEATURES = 9
#: Word beginnings of so many letters are mined too, since insults take endings.
BEGINNINGS = (3, 4, 5, 6, 7)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _features(lexicon: frozenset[str], strong: dict[str, float], weak: dict[str, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            features, votes = [], []
            for text in batch["text"]:
                lower = text.lower() if isinstance(text, str) else ""
                words = WORD.findall(lower)
                hits = [w for w in words if w in lexicon]
                marks = [(w, *(w[:k] + "*" for k in BEGINNINGS if len(w) >= k)) for w in words]
                sure = sum(any(m in strong for m in own) for own in marks) if strong else 0
                maybe = [max((weak.get(m, 0.0) for m in own), default=0.0) for own in marks] if weak else []
                signs, evidence = sum(v > 0 for v in maybe), sum(maybe)
                phrases = len(PHRASE.findall(lower)) if hits else 0
                size = max(1, len(words))
                said = (
                    1 if hits else 2,
                    1 if len(hits) > 1 else 2,
                    1 if len(hits) > 0.004 * size else 2,
                    1 if phrases else 2,
                    1 if sure > 1 else 0 if not sure else 2,
                    1 if signs > 2 and signs > 0.02 * size and sure else 2,
                    0 if not hits and sure < 2 else 2,
                )
                votes.append("".join(map(str, said)))
                features.append([min(len(hits), 1), np.log1p(len(hits)), np.log1p(len(set(hits))), np.sqrt(len(hits) / size), min(sure, 2), np.log1p(sure), np.sqrt(signs / size), np.log1p(evidence), min(phrases, 1)])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "votes": votes, "features": features})

    return run


def label_model(patterns: np.ndarray, counts: np.ndarray, balance: float, rounds: int = 40):
    """(posterior of each pattern, accuracies by class and vote, correlations given the class) by expectation maximisation."""
    one_hot = (patterns[:, :, None] == np.arange(3)).astype(float)
    toxic = np.where((patterns == 1).sum(1) > (patterns == 0).sum(1), 0.9, 0.1)
    weights, odds = np.ones(patterns.shape[1]), np.log(balance / (1 - balance))
    tables, correlations = np.zeros((2, patterns.shape[1], 3)), np.zeros((patterns.shape[1],) * 2)
    for step in range(rounds):
        for y, belief in enumerate((1 - toxic, toxic)):
            mass = counts * belief
            tables[y] = (np.tensordot(mass, one_hot, (0, 0)) + 0.5) / (mass.sum() + 1.5)
        # What the voters share beyond the class: correlation of their residuals, averaged over both classes.
        said = (patterns == 1).astype(float)
        total = np.zeros_like(correlations)
        for y, belief in enumerate((1 - toxic, toxic)):
            mass = counts * belief + 1e-9
            residual = said - (mass @ said) / mass.sum()
            cov = (residual * mass[:, None]).T @ residual / mass.sum()
            scale = np.sqrt(np.clip(np.diag(cov), 1e-6, None))
            total += cov / np.outer(scale, scale) / 2
        correlations = total - np.diag(np.diag(total))
        weights = 1 / (1 + np.abs(correlations).sum(1))
        likelihood = (np.log(tables[1] / tables[0])[None] * one_hot).sum(2)
        toxic = 1 / (1 + np.exp(-np.clip(odds + likelihood @ weights, -30, 30)))
    return toxic, tables, correlations


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Newton's method on soft labels; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(x) + ridge * 1e-2 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return w


def _mined(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[frozenset[str], dict[str, float], dict[str, float]]:
    """The lexicon without misleading words, and strong and weak marks with their log-odds, from training rows."""
    # A bounded number of labels, 16 bytes each, is broadcast; the texts stay where they are.
    chosen = sampled(labels, ["doc_id"], rows)
    known = docs.join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    known = materialise(known.select("toxic", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[^\W\d_]+"), F.lit(0))).alias("words")), "mined")
    sizes = known.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    bad, good = sizes["bad"] or 0, sizes["good"] or 0
    starts = [F.expr(f"transform(filter(words, w -> length(w) >= {n}), w -> concat(substring(w, 1, {n}), '*'))") for n in BEGINNINGS]
    each = known.select("toxic", F.explode(F.array_distinct(F.concat("words", *starts))).alias("mark"))
    by_mark = each.groupBy("mark").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    # Near copies of a few texts share all their words: a mark needs a share of the toxic rows, not just some of them.
    least = max(6, round(0.015 * bad))
    by_mark = materialise(by_mark.where((F.col("bad") >= least) | F.col("mark").isin(*LEXICON)).withColumn("odds", odds), "marks")
    best = lambda low, high: {r["mark"]: r["odds"] for r in by_mark.where((F.col("bad") >= least) & F.col("odds").between(low, high)).collect()}
    misleading = {r["mark"] for r in by_mark.where("good >= 3 and odds < 1").where(F.col("mark").isin(*LEXICON)).collect()}
    return LEXICON - misleading, best(3.0, 99.0), best(2.3, 3.0)


def score_toxicity(documents: DataFrame, labels: DataFrame, sample: int = 50_000, mined_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    balance = training.agg(F.avg("toxic")).first()[0]
    found = _mined(docs, training, mined_rows)
    featured = materialise(docs.mapInPandas(lean(_features(*found)), "doc_id long, votes string, features array<double>"), "features")
    learning = featured.where(F.coalesce(~held_out(F.col("doc_id")), F.lit(True)))
    histogram = learning.groupBy("votes").count().orderBy("votes").toPandas()
    weights = np.append(np.zeros(FEATURES), -5.0)
    if len(histogram):
        patterns = np.array([[int(c) for c in v] for v in histogram["votes"]])
        posterior, _, _ = label_model(patterns, histogram["count"].to_numpy(float), min(max(balance if balance is not None else 0.1, 0.01), 0.99))
        belief = dict(zip(histogram["votes"], posterior))
        rows = sampled(learning, ["doc_id", "votes"], sample).select("votes", "features").toPandas()
        weights = logistic(np.stack(rows["features"].to_numpy()), rows["votes"].map(belief).to_numpy())
    linear = F.lit(float(weights[-1]))
    for k, w in enumerate(weights[:-1]):
        linear = linear + F.col("features")[k] * float(w)
    score = 1 / (1 + F.exp(-linear))
    return featured.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
