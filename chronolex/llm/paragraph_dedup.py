"""Substring dedup: near copies of paragraphs by MinHash bands and exact verification, and repeated passages anywhere.

Paragraphs are lines of `least_words` words and more; the least is one shingle, five words. A signature has `bands` x 2 minima
of the 5-word shingle hashes. The number of bands follows from the recall asked for: a pair of similarity t collides in none of
b bands with a probability of (1 - t**2)**b, so 0.999 at 0.75 takes 9. Equal paragraphs (same words) count as one before
anything is compared. Only paragraphs that share a bucket with a different one get their shingle sets fetched. Shingles that no
other of these sets has are in no intersection, so a paragraph with more than a quarter of such shingles is similar to none
and leaves. The others are compared with a central member of their buckets; those that share a bucket and are still apart are
paired by their rarest shingles, as lines with one passage in common share all their buckets' minima (`linking`). Similarity is
exact Jaccard. The paragraphs of a
connected component are one passage: its first place (smallest document, then line) stays and all others are marked for removal.

Passages that lines don't show (inside longer lines, over other line breaks, over short lines) are found verbatim: of every
`passage` words in a row the 25-word gram of smallest hash is taken, the same wherever these words stand. A gram that is met
at several places is repeated, its first place stays. Repeated grams that touch are one run, with the first line, the id and
the places of its smallest gram. A run is drawn out on both sides by the words it has in common with the first place (the first
place itself: with the last one), at most `passage` words, as beyond that another gram would repeat. Grams of fewer than 8
different words are left out, and so are runs inside a line that is reported already.

Words are told apart by 62-bit hashes modulo a prime; Jaccard is exact over these.

Edge cases: null, empty and blank texts have no paragraphs and return no rows; very long texts and lines are treated like
others; repeated rows count as repeated passages, their first place too; different texts under one id or under null are
documents of their own; a null id sorts first; extra columns are ignored; an empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoded, lean, materialise, mix, steps, windows, word_hashes
from .linking import component_links, parities, rare_prefixes, sent_if_small

SEED = np.uint64(0x9E3779B97F4A7C15)
ROWS = 2
GRAM, DISTINCT = 25, 8
UNIT = "doc_id long, row long, line int, last int, start int, stop int, word int, words int, p1 long, p2 long, buckets array<long>"


def bands_for(recall: float, percent: int) -> int:
    """Bands of two rows that find a pair of the given similarity with the given probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - (percent / 100) ** ROWS)))


def _signed(grams: np.ndarray, starts: np.ndarray, bands: int) -> np.ndarray:
    """A row of bucket numbers for each run of grams that begins at one of `starts`."""
    seeds = mix(np.arange(1, bands * ROWS + 1, dtype=np.uint64) * SEED).reshape(bands, ROWS)
    found = np.zeros((len(starts), bands), np.uint64)
    for k in range(bands):
        for seed in seeds[k]:
            found[:, k] = found[:, k] * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(mix(grams ^ seed), starts)
        found[:, k] = mix(found[:, k] + np.uint64(k))
    return found.view(np.int64)


def _sums(hashes: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... hashes modulo 2**64. They stay unsigned: next to signed numbers they would become floats of 53 bits."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes, out=sums[1:])
    return sums


def _winnowed(hashes: np.ndarray, own: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the smallest gram of every `passage` words of one text, each once."""
    n = len(hashes) - passage + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = windows(hashes, GRAM)
    least, width, span = np.arange(len(grams)), 1, passage - GRAM + 1
    while width < span:
        step = min(width, span - width)
        a, b = least[: len(least) - step], least[step:]
        least, width = np.where(grams[b] < grams[a], b, a), width + step
    at = np.unique(least[np.flatnonzero(own[:n] == own[passage - 1 :])])
    # Different words of a gram: those whose last place before is not inside it.
    _, same = np.unique(hashes, return_inverse=True)
    order = np.argsort(same, kind="stable")
    before = np.full(len(hashes), -1)
    again = same[order[1:]] == same[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    place = np.arange(len(hashes))
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, np.maximum(before + 1, np.maximum(place - GRAM + 1, 0)), 1)
    np.add.at(change, place + 1, -1)
    at = at[np.cumsum(change)[at] >= DISTINCT]
    return at, (grams[at] >> np.uint64(1)).astype(np.int64)


def _units(least_words: int, passage: int, bands: int):
    """Lines with their buckets and a 126-bit content hash, and grams (null p2 and buckets); offsets in UTF-8 bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, rows = batch["doc_id"].astype("Int64").reset_index(drop=True), batch["row"].to_numpy()
            for first, past, data, offsets in steps(encoded(batch["text"])):
                hashes, starts, ends, bounds = word_hashes(data, offsets)
                if not len(hashes):
                    continue
                own = np.repeat(np.arange(past - first), np.diff(bounds))
                breaks = np.flatnonzero(data == 10)
                line = np.searchsorted(breaks, starts)
                number = line - np.searchsorted(breaks, offsets[own])

                def frame(a: np.ndarray, b: np.ndarray, **more) -> pd.DataFrame:
                    """Units from word a to word b."""
                    text, base = own[a], offsets[own[a]]
                    columns = {"line": number[a], "last": number[b], "start": starts[a] - base, "stop": ends[b] - base, "word": a - bounds[text], "words": b - a + 1}  # noqa: B023
                    return pd.DataFrame({"doc_id": ids.iloc[first + text].array, "row": rows[first + text], **columns, **more})  # noqa: B023

                heads = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
                sizes = np.diff(np.append(heads, len(line)))
                long = sizes >= least_words
                a, n = heads[long], sizes[long]
                if len(a):
                    inside = np.flatnonzero(line[:-4] == line[4:])
                    inside = inside[np.repeat(long, sizes)[inside]]
                    sums = _sums(hashes)
                    place = mix(hashes + SEED * (np.arange(len(hashes)) - np.repeat(heads, sizes)).astype(np.uint64))
                    other = _sums(place)
                    p1, p2 = ((mix(x[a + n] - x[a] + n.astype(np.uint64)) >> np.uint64(1)).astype(np.int64) for x in (other, sums))
                    buckets = _signed(windows(hashes, 5)[inside], np.searchsorted(inside, a), bands)
                    yield frame(a, a + n - 1, p1=p1, p2=p2, buckets=list(buckets))
                at, gram = _winnowed(hashes, own, passage)
                if len(at):
                    yield frame(at, at + GRAM - 1, p1=gram, p2=pd.array([None] * len(at), "Int64"), buckets=None)

    return run


def _shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingle sets of the lines that `spans` name."""
    for batch in batches:
        cut = [(s["node"], text[s["start"] : s["stop"]]) for text, own in zip(encoded(batch["text"]), batch["spans"]) for s in own]
        for first, past, data, offsets in steps([t for _, t in cut]):
            hashes, _, _, bounds = word_hashes(data, offsets)
            own = np.repeat(np.arange(past - first), np.diff(bounds))
            inside = np.flatnonzero(own[:-4] == own[4:])
            grams = (windows(hashes, 5)[inside] >> np.uint64(1)).astype(np.int64)
            sets = [np.unique(g) for g in np.split(grams, np.searchsorted(own[inside], np.arange(1, past - first)))]
            yield pd.DataFrame({"node": [n for n, _ in cut[first:past]], "n": [len(x) for x in sets], "shingles": sets, "bits": [parities(x) for x in sets]})


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column("sa"), batch.column("sb"))]
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (v[o[i] : o[i + 1]] for o, v in sides)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def _around(passage: int):
    """For each gram that `ends` names the hashes of up to `passage` words before it, or after it, outwards, and where these are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, ends_of = batch["row"].to_numpy(), list(batch["ends"])
            for first, past, data, offsets in steps(encoded(batch["text"])):
                hashes, starts, ends, bounds = word_hashes(data, offsets)
                breaks, out = np.flatnonzero(data == 10), []
                for k in range(past - first):
                    low, high, base = bounds[k], bounds[k + 1], offsets[k]
                    for e in ends_of[first + k]:
                        at = low + e["word"]
                        words = np.arange(at - 1, max(low, at - passage) - 1, -1) if e["left"] else np.arange(at + GRAM, min(high, at + GRAM + passage))
                        place = starts[words] if e["left"] else ends[words]
                        out.append((rows[first + k], e["word"], e["left"], hashes[words].view(np.int64), place - base, np.searchsorted(breaks, starts[words]) - np.searchsorted(breaks, base)))
                yield pd.DataFrame(out, columns=["row", "word", "left", "hashes", "places", "lines"])

    return run


def _repeated_runs(grams: DataFrame, texts: DataFrame, copies: DataFrame, passage: int) -> DataFrame:
    """doc_id, row, line, last, start, stop, words, passage_id, places, remove of each run of repeated grams. texts: row, text, each
    row once. copies: row, copies."""
    counted = materialise(grams.groupBy("p1").agg(F.count("*").alias("places")).where("places > 1"), "repeated")
    again = materialise(grams.join(sent_if_small(counted), "p1"), "again")
    place = F.struct("doc_id", "row", "word")
    ends = again.groupBy("p1").agg(F.min(place).alias("kept"), F.max(place).alias("other"))
    found = again.distinct().join(materialise(ends, "ends"), "p1").withColumn("remove", ~((F.col("row") == F.col("kept.row")) & (F.col("word") == F.col("kept.word"))))
    found = found.withColumn("partner", F.when(F.col("remove"), F.col("kept")).otherwise(F.col("other"))).drop("kept", "other")
    by_row = Window.partitionBy("row", "remove").orderBy("word")
    begins = F.when(F.col("word") <= F.lag("word").over(by_row) + GRAM, 0).otherwise(1)
    outer = lambda f, *columns: f(F.struct(*columns), F.col("word"))
    runs = found.withColumn("begins", begins).withColumn("run", F.sum("begins").over(by_row)).groupBy("row", "remove", "run").agg(
        F.first("doc_id").alias("doc_id"), outer(F.min_by, "word", "line", F.col("start").alias("at"), "partner").alias("left"), outer(F.max_by, "word", F.col("last").alias("line"), F.col("stop").alias("at"), "partner").alias("right"),
        F.min(F.struct("p1", "places")).alias("least"),
    )
    runs = materialise(runs, "runs")
    sides = [(side, F.lit(side == "left").alias("left")) for side in ("left", "right")]
    asked = reduce(DataFrame.union, [runs.select("row", F.col(f"{side}.word"), left).union(runs.select(F.col(f"{side}.partner.row"), F.col(f"{side}.partner.word"), left)) for side, left in sides])
    wanted = asked.groupBy("row").agg(F.collect_set(F.struct("word", "left")).alias("ends"))
    around = materialise(texts.join(materialise(wanted, "wanted"), "row").select("row", "text", "ends").mapInPandas(lean(_around(passage)), "row long, word int, left boolean, hashes array<long>, places array<int>, lines array<int>"), "around")
    for side, _ in sides:
        own = around.where(F.col("left") == (side == "left")).select("row", F.col("word").alias("own_word"), "hashes", "places", "lines")
        theirs = own.select(F.col("row").alias("their_row"), F.col("own_word").alias("their_word"), F.col("hashes").alias("their_hashes"))
        runs = runs.withColumn("own_word", F.col(f"{side}.word")).withColumn("their_row", F.col(f"{side}.partner.row")).withColumn("their_word", F.col(f"{side}.partner.word"))
        runs = runs.join(own, ["row", "own_word"]).join(theirs, ["their_row", "their_word"])
        same = F.array_position(F.zip_with("hashes", "their_hashes", lambda a, b: a.eqNullSafe(b)), F.lit(False))
        n = F.when(same == 0, F.size("hashes")).otherwise(same - 1).cast("int")
        reached = F.struct(F.coalesce(F.get("lines", F.col("n") - 1), f"{side}.line").alias("line"), F.coalesce(F.get("places", F.col("n") - 1), f"{side}.at").alias("at"))
        runs = runs.withColumn("n", n).withColumn(f"{side}_end", reached)
        runs = runs.withColumn(f"{side}_word", F.col(f"{side}.word") + (-F.col("n") if side == "left" else F.col("n"))).drop("own_word", "their_row", "their_word", "hashes", "places", "lines", "their_hashes", "n")
    each = runs.join(copies, "row", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    return each.select(
        "doc_id", "row", F.col("left_end.line").alias("line"), F.col("right_end.line").alias("last"), F.col("left_end.at").alias("start"), F.col("right_end.at").alias("stop"),
        (F.col("right_word") + GRAM - F.col("left_word")).alias("words"), F.col("least.p1").alias("passage_id"), F.col("least.places").alias("places"), "remove",
    )


def repeated_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5, percent: int = 75, recall: float = 0.999, passage: int = 50) -> DataFrame:
    """Every place of every passage that is met more than once: id, line, start, stop (bytes), words, passage_id, places, remove."""
    assert least_words >= 5 and passage >= GRAM
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    units = materialise(docs.mapInPandas(lean(_units(least_words, passage, bands_for(recall, percent))), UNIT), "units")
    places = units.where("p2 is not null")

    # One place of each distinct paragraph stands for all; its text is fetched from there.
    kinds = places.groupBy("p1", "p2").agg(F.count("*").alias("places"), *(F.first(c).alias(c) for c in ("row", "start", "stop")))
    kinds = materialise(kinds.withColumn("node", F.col("p1")), "kinds")

    # Buckets of one paragraph fall away before anything else is moved.
    entries = places.select(F.explode("buckets").alias("t"), F.col("p1").alias("node"))
    shared = materialise(entries.groupBy("t").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("t"), "shared")
    members = materialise(entries.join(sent_if_small(shared), "t").distinct(), "members")
    # An id may come with several texts: rows are told apart by both, and only rows equal in both are one.
    copies = materialise(docs.groupBy("row").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    wanted = kinds.join(sent_if_small(members.select("node").distinct()), "node").groupBy("row").agg(F.collect_list(F.struct("node", "start", "stop")).alias("spans"))
    texts = docs.select("row", "text") if not copies.limit(1).count() else docs.select("row", "text").dropDuplicates(["row"])
    cut = texts.join(materialise(wanted, "wanted"), "row")
    sets = materialise(cut.select("text", "spans").mapInPandas(lean(_shingles), "node long, n int, shingles array<long>, bits array<long>"), "shingles")

    # What a set has for itself alone bounds its similarity to all others.
    tokens = sets.select("node", F.explode("shingles").alias("s"))
    alone = tokens.groupBy("s").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").groupBy("node").agg(F.count("*").alias("own"))
    likely = sets.select("node", "n").join(alone, "node", "left").withColumn("own", F.coalesce("own", F.lit(0))).where(f"100 * (n - own) >= {percent} * n")
    postings = materialise(members.join(materialise(likely, "likely"), "node"), "postings")
    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}"))

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(lean(_similar(percent)), "a long, b long")

    def rarest(apart: DataFrame) -> DataFrame:
        return rare_prefixes(sets.join(sent_if_small(apart), "node").select("node", "n", F.explode("shingles").alias("t")), percent).join(sets.select("node", "bits"), "node")

    roots = component_links(postings, verified, percent, rarest)

    grouped = kinds.select("p1", "p2", "places", "node").join(roots, "node", "left").withColumn("passage_id", F.coalesce("root", "node"))
    totals = grouped.groupBy("passage_id").agg(F.sum("places").alias("places")).where("places > 1")
    member = materialise(grouped.drop("places").join(totals, "passage_id").select("p1", "p2", "passage_id", "places"), "passages")
    found = places.drop("buckets").join(member, ["p1", "p2"])
    first = found.groupBy("passage_id").agg(F.min(F.struct("doc_id", "row", "line")).alias("kept"))
    marked = found.join(first, "passage_id").withColumn("remove", ~((F.col("row") == F.col("kept.row")) & (F.col("line") == F.col("kept.line"))))
    marked = materialise(marked.select("doc_id", "row", "line", "start", "stop", "words", "passage_id", "places", "remove"), "marked")

    # A run inside a line that goes, or that is told of with the same mark, says nothing new.
    runs = _repeated_runs(units.where("p2 is null").select("doc_id", "row", "line", "last", "start", "stop", "word", "p1"), texts, copies, passage)
    told = marked.select(F.col("row").alias("told_row"), F.col("line").alias("told_line"), F.col("remove").alias("told_remove")).distinct()
    new = runs.join(told, (F.col("row") == F.col("told_row")) & (F.col("line") == F.col("told_line")) & (F.col("last") == F.col("told_line")) & (F.col("told_remove") | ~F.col("remove")), "left_anti")
    columns = [F.col("doc_id").alias(id_col), *(F.col(c).cast("long").alias(c) for c in ("line", "start", "stop", "words")), "passage_id", "places", "remove"]
    return marked.select(*columns).union(new.select(*columns))


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
