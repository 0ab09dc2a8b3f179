"""Periodic run detection by string synchronising sets.

A run is a maximal stretch of words with smallest period q, at least 4 * q words long. Words are numbered within a step of texts,
so they are compared exactly, and a separator of its own ends each text.

* Periods below SMALL are detected directly, by comparing each word with the one q places on.
* Periods of tau to 2 * tau - 1, for tau = SMALL, 2 * SMALL and so on, are met at the scale tau. Its synchronising set holds the
  positions where the least hash of the windows of tau words that begin within tau places stands first or last. Whether a
  position belongs depends on the 2 * tau words from it alone, so it repeats with them; and every tau places hold
  one, but where the text is highly periodic. Those regions, windows of period tau / 4 or less, are just the runs of smaller
  periods, which are known by then: their windows are left out of the hashes, which keeps the set small.
* Positions of a set with equal contexts of 2 * tau words, next to each other in the text, propose their distance as period.
  Proposals of one distance that touch are one; the stretch is extended word by word to its ends, which the set's density puts within
  tau words. So a scale costs time in proportion to the text, and all scales n log n.

Hashes (64 bits) only propose; each run's words are compared before it counts.

Edge cases: null and empty texts have no words and no runs; repeated rows and ids each return a row; a very long text is a step
of its own and is read whole; an empty table returns no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoded, lean, mix, steps

#: The first scale; smaller periods are detected directly.
SMALL = 8
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
FACTOR = np.uint64(0xD6E8FEB86659FD93)
WORD = r"[^\x20\x09-\x0D]+"

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def stretches(words: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of the consecutive words that equal the one a period on, where there are three periods of them."""
    equal = np.concatenate([[False], words[period:] == words[:-period], [False]])
    edge = np.flatnonzero(equal[1:] != equal[:-1])
    starts, sizes = edge[0::2], edge[1::2] - edge[0::2]
    long = sizes >= 3 * period
    return starts[long], sizes[long]


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, fewer at the end: by prefixes and suffixes of blocks of that width."""
    blocks = np.concatenate([x, np.full(width + -len(x) % width, MOST)]).reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: len(x)], prefix[width - 1 : width - 1 + len(x)])


def synchronising_set(hashes: np.ndarray, tau: int, periodic: np.ndarray) -> np.ndarray:
    """hashes: of the tau words from each position; periodic: whether these have a period of tau / 4 or less."""
    ids = np.where(periodic, MOST, hashes)
    n = max(0, len(ids) - tau)
    least = window_minimum(ids, tau + 1)[:n]
    return np.flatnonzero((least != MOST) & ((ids[:n] == least) | (ids[tau:] == least)))


def _proposals(places: np.ndarray, contexts: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, past, period) of the words that equal the one a period on, by neighbouring positions of equal context."""
    order = np.argsort(contexts, kind="stable")
    place, context = places[order], contexts[order]
    gap = np.diff(place)
    good = (context[1:] == context[:-1]) & (gap >= tau) & (gap < 2 * tau)
    first, period = place[:-1][good], gap[good]
    order = np.lexsort((first, period))
    first, period = first[order], period[order]
    new = np.ones(len(first), bool)
    new[1:] = (period[1:] != period[:-1]) | (first[1:] > first[:-1] + 2 * tau)
    last = np.flatnonzero(np.append(new[1:], True)) if len(first) else np.empty(0, np.int64)
    return first[new], first[last] + 2 * tau, period[new]


def _extension(words: np.ndarray, at: np.ndarray, period: np.ndarray, step: int, tau: int) -> np.ndarray:
    """How many words from `at` on, in the direction of step, equal the one a period on."""
    total, going = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(going):
        place = (at[going] + step * total[going])[:, None] + step * np.arange(tau)
        inside = (place >= 0) & (place + period[going, None] < len(words))
        place = np.where(inside, place, 0)
        equal = inside & (words[place] == words[np.minimum(place + period[going, None], len(words) - 1)])
        more = np.where(equal.all(1), tau, (~equal).argmax(1))
        total[going] += more
        going = going[more == tau]
    return total


def _at_scale(words: np.ndarray, hashes: np.ndarray, twice: np.ndarray, tau: int, known: Runs) -> Runs:
    """The runs of periods tau to 2 * tau - 1. twice: hashes of the 2 * tau words from each position."""
    start, length, period = known
    high = (4 * period <= tau) & (length >= tau)
    marks = np.bincount(start[high], minlength=len(words) + 1) - np.bincount((start + length - tau + 1)[high], minlength=len(words) + 1)
    places = synchronising_set(hashes, tau, np.cumsum(marks)[: len(hashes)] > 0)
    first, past, period = _proposals(places, twice[places], tau)
    near = past - first + 2 * tau >= 3 * period
    first, past, period = first[near], past[near], period[near]
    first, past = first - _extension(words, first - 1, period, -1, tau), past + _extension(words, past, period, 1, tau)
    long = past - first >= 3 * period
    first, past, period = first[long], past[long], period[long]
    each = ranges(first, past - first)
    if (words[each] != words[each + np.repeat(period, past - first)]).any():  # hashes that were equal by chance
        told = [(s, n, np.full(len(s), q)) for q in np.unique(period) for s, n in [stretches(words, int(q))]]
        first, size, period = (np.concatenate(x) for x in zip(*told))
        past = first + size
    return first, past - first + period, period


def find(words: np.ndarray, sizes: np.ndarray) -> Runs:
    """(start, length, period) of all runs, by start and period. words: of texts of so many words, each followed by a separator."""
    found = []
    for q in range(1, min(SMALL, len(words))):
        start, size = stretches(words, q)
        found.append((start, size + q, np.full(len(start), q)))
    known = smallest(tuple(np.concatenate(x) for x in zip(*found))) if found else (np.empty(0, np.int64),) * 3
    found, origin, tau = [known], np.arange(len(words)), SMALL
    hashes, width = mix(words.astype(np.uint64) * FACTOR + np.uint64(1)), 1
    while (sizes >= 4 * tau).any():
        alive = sizes >= 4 * tau
        if not alive.all():  # shorter texts are through
            kept = np.repeat(alive, sizes + 1)
            place = np.cumsum(kept) - 1
            inside = kept[known[0]]
            known = (place[known[0][inside]], known[1][inside], known[2][inside])
            words, origin, sizes = words[kept], origin[kept], sizes[alive]
            hashes = np.append(hashes, np.zeros(len(kept) - len(hashes), np.uint64))[kept][: len(words) - width + 1]
        while width < tau:
            hashes, width = mix(hashes[:-width] * FACTOR + hashes[width:]), 2 * width
        twice = mix(hashes[:-tau] * FACTOR + hashes[tau:])
        new = _at_scale(words, hashes, twice, tau, known)
        found.append((origin[new[0]], new[1], new[2]))
        known = tuple(np.concatenate(x) for x in zip(known, new))
        hashes, width, tau = twice, 2 * tau, 2 * tau
    return smallest(tuple(np.concatenate(x) for x in zip(*found)))


def smallest(runs: Runs) -> Runs:
    """Of equal stretches the one of smallest period, by start and period: a multiple of a run's period gives the same stretch."""
    start, length, period = runs
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, a negative one of its own after each text; and how many words each has."""
    number = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.empty(sizes.sum() + len(texts), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    out[ends] = -1 - np.arange(len(texts))
    return out, sizes


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1).to_pylist())
            counts, columns, collapsed = [], [], []
            for first, past, _, _ in steps(texts):
                split = [t.split() for t in texts[first:past]]  # at ASCII white space
                words, sizes = _numbered(split)
                start, length, period = find(words, sizes)
                long = length >= least
                start, length, period = start[long], length[long], period[long]
                marks = np.bincount(start + period, minlength=len(words) + 1) - np.bincount(start + length, minlength=len(words) + 1)
                kept = np.cumsum(marks) == 0
                at = np.cumsum(sizes + 1) - sizes - 1
                own = np.searchsorted(at, start, side="right") - 1
                number = np.bincount(own, minlength=len(sizes))
                counts.append(number)
                columns.append((start - at[own], length, period))
                for k, (a, n, has, own_words) in enumerate(zip(at.tolist(), sizes.tolist(), number.tolist(), split)):
                    split[k] = b" ".join(compress(own_words, kept[a : a + n].tolist()) if has else own_words)
                collapsed += split
            start, length, period = (np.concatenate(x) for x in zip(*columns)) if columns else (np.empty(0, np.int64),) * 3
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([c.decode("utf-8", "surrogatepass") for c in collapsed], pa.string())], names=["id", "runs", "collapsed"])

    return run


def find_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6) -> DataFrame:
    """id, runs array<struct<start, length, period>> by start and period, of `least` words and more, and the text without the words
    that stand in a run after its first period, joined by blanks."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    found = docs.mapInArrow(lean(_found(least)), f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def with_repeats(documents: DataFrame) -> DataFrame:
    """doc_id and text, one text in ten (by crc32 of its id) made to repeat its words with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h")).withColumn("g", F.floor(F.col("h") / 10))
    chosen = docs.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    a = F.col("g") % F.col("n")
    left = F.col("n") - F.col("a")
    period = 1 + F.floor(left / (3 + F.col("g") % 8))
    cut = lambda x, start, size: F.slice(x, start.cast("int"), size.cast("int"))
    part = cut(F.col("words"), F.col("a") + 1, period)
    again = cut(F.flatten(F.array_repeat(part, F.ceil(left / period).cast("int"))), F.lit(1), left)
    made = F.array_join(F.concat(cut(F.col("words"), F.lit(1), F.col("a")), again), " ")
    repeats = F.col("n") > 0
    return chosen.withColumn("a", F.when(repeats, a)).select("doc_id", F.when(repeats, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("best.period")
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.expr('1000 * best.length div -best.period').cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
