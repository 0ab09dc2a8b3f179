"""Suffix-array dedup: remove every byte that lies in a 400-byte string occurring elsewhere too.

The same pass counts the bytes of repeated strings of `shorter` bytes, which are not removed. All strings of `shorter` bytes
are dealt out by their minimiser, the smallest hash of their `anchor`-byte substrings (leftmost on ties). Equal strings have
equal minimisers at equal places, so they meet. Consecutive strings with one minimiser form a segment, with as many bytes
after it as its last string of `length` bytes takes; segments are what travels, not the strings. Then, per minimiser:

* Equal segments count as one with a weight: copies are never sorted twice, however many there are. A segment
  of weight two or more repeats as a whole.
* Where a minimiser has several different segments, their suffixes are sorted in two stages (`two_stage`): only
  suffixes smaller than their successor are sorted directly, the others are induced by scans over the buckets
  of first bytes. Strings that share `length`, or `shorter`, bytes with a neighbour in that order repeat.
* A minimiser with over `most` different segments is dealt out anew by longer anchors: the places at which a string can hold
  its minimiser are cut into `parts` ranges, and the strings of one range have more bytes in common, those from the range's last
  place to its first. They are the next anchor. Equal strings stay together, and this goes on until every group is small
  enough to be sorted, or its anchor is the string itself. So no group is too large for its task and none is skipped.

The bytes decide inside a task; across tasks segments are told apart by the hashes of anchor and content, 62 bits each.

Edge cases: null and empty texts return 0 bytes removed and the hash of nothing; texts shorter than `length`
keep everything; very long texts are cut into segments like others; repeated rows with one id count as different places, and
each returns a row; a null id is an id like others; an empty table returns no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoded, equal_hashes, lean, materialise, prefix_sums, steps, substring_hashes

SEGMENT = "key long, content long, row long, start long, run int, at int, size int"
SPANS = "array<struct<start: int, run: int, whole: boolean>>"
#: Bytes of segments that are sorted at a time; minimisers are never split between two such blocks.
BLOCK_BYTES = 3 << 18


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each `width` consecutive values; the leftmost of equal ones."""
    n = len(values)
    keyed = (values & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keyed
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return (np.minimum(right[:count], left[width - 1 : width - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _segments_of(data: np.ndarray, offsets: np.ndarray, length: int, shorter: int, anchor: int):
    """(text, start in the buffer, run, place of the anchor, size, key, content) of every segment in the texts of one step."""
    sums = prefix_sums(data)
    hashes = equal_hashes(sums, anchor)
    least = sliding_argmin(hashes, shorter - anchor + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = offsets[1:] - 1
    where = np.arange(len(least))
    valid = where + shorter <= ends[text[: len(least)]]
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1])
    fresh &= valid
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return (starts,) * 7
    covered = np.concatenate([[0], np.cumsum(valid)])
    stops = np.append(starts[1:], len(least))
    run = covered[stops] - covered[starts]
    size = np.minimum(run + length - 1, ends[text[starts]] - starts)
    keys = hashes[least[starts]].view(np.int64)
    content = substring_hashes(sums, starts, starts + size).view(np.int64)
    return text[starts], starts, run, least[starts] - starts, size, keys, content


def _segments(length: int, shorter: int, anchor: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch["row"].to_numpy()
            for first, _, data, offsets in steps(encoded(batch["text"])):
                if len(data) <= shorter:
                    continue
                text, starts, runs, at, size, keys, content = _segments_of(data, offsets, length, shorter, anchor)
                yield pd.DataFrame({"key": keys, "content": content, "row": rows[first + text], "start": starts - offsets[text], "run": runs, "at": at, "size": size})

    return run


PIECE = "key long, content long, own_key long, own_content long, first int, low int, high int, run int, at int, bytes binary"


def _hash(data: bytes, *more: int) -> int:
    salt = b"".join(m.to_bytes(8, "little") for m in more)
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=salt).digest(), "little", signed=True)


def _dealt_anew(length: int, shorter: int, anchor: int, parts: int):
    """Pieces of segments whose strings hold their minimiser at one of fewer places, by the longer anchor that they share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own_key, own_content, first, low, high, n, at, data in zip(*(batch[c] for c in ("own_key", "own_content", "first", "low", "high", "run", "at", "bytes"))):
                width = -(-(high - low + 1) // parts)
                for a in range(low, high + 1, width):
                    b = min(a + width - 1, high)
                    begin, end = max(0, at - b), min(n - 1, at - a)
                    if begin <= end:
                        piece = data[begin : end + length]
                        shared = data[at - a : at + shorter - b]
                        out.append((_hash(shared, a, b), _hash(piece), own_key, own_content, first + begin, a, b, end - begin + 1, at - begin, piece))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")])

    return run


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(data)]
    return out


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, most: int) -> np.ndarray:
    """Common prefix lengths of the suffixes at a and b, from `low` up to `most`, eight bytes at a time."""
    high = np.minimum(most, len(words) - np.maximum(a, b))
    shared = np.minimum(low, high)
    live = np.flatnonzero(shared < high)
    while len(live):
        differ = words[a[live] + shared[live]] ^ words[b[live] + shared[live]]
        same = differ == 0
        ended, differ = live[~same], differ[~same]
        for byte in range(1, 8):
            shared[ended] += differ < (1 << 8 * byte)  # equal in this byte and those above
        live = live[same]
        shared[live] += 8
        live = live[shared[live] < high[live]]
    return np.minimum(shared, high)


def _sorted_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes `at` by their first `depth` bytes. Ties jump to where their group first differs."""
    order = at[np.argsort(words[at], kind="stable")]
    head = words[order]
    group = np.concatenate([[0], np.cumsum(head[1:] != head[:-1])]) if len(order) else np.empty(0, np.int64)
    place = np.arange(len(order))
    low = np.full(len(order), 8)
    while len(place):
        size = np.bincount(group)
        tied = size[group] > 1
        place, group, low = place[tied], group[tied], low[tied]
        if not len(place):
            break
        group = np.unique(group, return_inverse=True)[1]
        here = order[place]
        next_same = group[1:] == group[:-1]
        shared = np.full(len(place), depth)
        i = np.flatnonzero(next_same)
        shared[i + 1] = _common(words, here[i], here[i + 1], low[i], depth)
        starts = np.flatnonzero(np.concatenate([[True], ~next_same]))
        deep = np.minimum.reduceat(shared, starts)[group]
        live = deep < depth
        place, group, deep, here = place[live], group[live], deep[live], here[live]
        if not len(place):
            break
        past = here + deep
        key = np.where(past < len(words), words[np.minimum(past, len(words) - 1)], 0)
        by = np.lexsort((here, key, group))
        order[place], key, low = here[by], key[by], deep[by]
        group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (group[by][1:] != group[by][:-1]))])
    return order


def two_stage(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of `data`, right to a depth of `depth` bytes, of the positions that are `wanted`.

    Type B suffixes are smaller than their successor, type A suffixes are not. B is sorted directly. Then the
    buckets of first bytes are scanned upwards: whatever precedes a suffix just met and is of type A goes next
    into its own bucket, ahead of the B suffixes there, so A needs no comparison. The end counts as zeros.
    """
    size = len(data)
    data = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    wanted = np.concatenate([wanted, np.zeros(depth + 8, bool)])
    n = len(data)
    last = np.append(np.flatnonzero(data[:-1] != data[1:]), n - 1)  # where runs of equal bytes end
    smaller = np.repeat(np.append(data[last[:-1]] < data[last[:-1] + 1], False), np.diff(last, prepend=-1))
    # A suffix is induced from its successor, so whole chains are needed up to the next type B suffix.
    stops = np.flatnonzero(smaller)
    ends = np.append(stops, n - 1)[np.searchsorted(stops, np.flatnonzero(wanted))]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.flatnonzero(wanted), 1)
    np.add.at(mark, ends + 1, -1)
    needed = np.cumsum(mark)[:n] > 0
    direct = _sorted_directly(np.flatnonzero(needed & smaller), _words(data), depth)
    cuts = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1]:  # nothing follows the last suffix: it is the first of its bucket
        induced[data[n - 1]].append(np.array([n - 1]))
    done = []
    for c in range(256):
        turn = 0
        pending = list(induced[c])
        while True:
            if turn < len(pending):
                met, turn = pending[turn], turn + 1
            elif turn == len(pending):
                met, turn = direct[cuts[c] : cuts[c + 1]], turn + 1
            else:
                break
            if not len(met):
                continue
            done.append(met)
            before = met[met > 0] - 1
            before = before[needed[before] & ~smaller[before]]
            if len(before):
                byte = data[before]
                same = before[byte == c]
                if len(same):
                    pending.append(same) if turn <= len(pending) else None
                above = before[byte > c]
                if len(above):
                    by = np.argsort(data[above], kind="stable")
                    above = above[by]
                    for part in np.split(above, np.flatnonzero(np.diff(data[above])) + 1):
                        induced[data[part[0]]].append(part)
    order = np.concatenate(done) if done else np.empty(0, np.int64)
    return order[order < size]


def _equal_neighbours(order: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Which positions share `length` bytes with a neighbour in suffix order."""
    a, b = order[:-1], order[1:]
    for j in [max(0, length - 8), *range(0, length - 8, 8)]:  # the last bytes first: most pairs that differ at all differ there
        same = words[a + j] == words[b + j]
        a, b = a[same], b[same]
    again = np.zeros(len(words), bool)
    again[a] = again[b] = True
    return again


def repeated_in(texts: list[bytes], runs: np.ndarray, length: int, shorter: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment, which of its first `run` strings of `shorter`, and of `length`, bytes occur again in these segments."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = _words(data)
    mark = np.zeros(len(data) + 1, np.int64)
    np.add.at(mark, offsets[:-1], 1)
    np.add.at(mark, offsets[:-1] + runs, -1)
    wanted = np.cumsum(mark)[:-1] > 0
    order = two_stage(data, wanted, length)
    order = order[wanted[order]]
    # A segment at the end of its text may have no room for strings of `length` bytes.
    room = np.repeat(offsets[1:], sizes) - np.arange(len(data)) >= length
    some, long = _equal_neighbours(order, words, shorter), _equal_neighbours(order[room[order]], words, length)
    return [(some[s : s + r], long[s : s + r]) for s, r in zip(offsets[:-1].tolist(), runs.tolist())]


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    if not flags.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def _sort_groups(length: int, shorter: int):
    """Rows come ordered by key; whole groups are gathered into blocks and each block is sorted at once."""

    def block(group: pd.DataFrame) -> pd.DataFrame:
        flags = repeated_in(list(group["bytes"]), group["run"].to_numpy(np.int64), length, shorter)
        spans = [[{"start": s, "run": e - s, "whole": whole} for whole, f in zip((False, True), both) for s, e in _spans(f)] for both in flags]
        return pd.DataFrame({"key": group["key"].to_numpy(), "content": group["content"].to_numpy(), "spans": spans})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += int(batch["bytes"].map(len).sum())
            if size > BLOCK_BYTES:
                rows = pd.concat(held, ignore_index=True)
                cuts = np.append(np.flatnonzero(np.diff(rows["key"].to_numpy())) + 1, 0)
                ends = rows["bytes"].map(len).cumsum().to_numpy()
                first = 0
                while True:  # as many whole groups as make a block; the last group may go on in the next batch
                    past = [c for c in cuts[:-1][cuts[:-1] > first] if ends[c - 1] - (ends[first - 1] if first else 0) >= BLOCK_BYTES][:1] or [cuts[:-1].max(initial=0)]
                    if past[0] <= first:
                        break
                    yield block(rows.iloc[first : past[0]])
                    first = past[0]
                held = [rows.iloc[first:]]
                size = int(held[0]["bytes"].map(len).sum())
        if held:
            yield block(pd.concat(held, ignore_index=True))

    return run


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(s["key"], s["content"], s["hot"], s["run"], s["at"], text[s["start"] : s["start"] + s["size"]]) for text, spans in zip(encoded(batch["text"]), batch["spans"]) for s in spans]
        yield pd.DataFrame(out, columns=["key", "content", "hot", "run", "at", "bytes"])


def _merged(spans) -> list[list[int]]:
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    return merged


def _removed(length: int, shorter: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"]):
                (text,), spans = encoded([text]), [] if spans is None else spans
                gone = _merged((s["start"], s["start"] + s["run"] + length - 1) for s in spans if s["whole"])
                again = _merged((s["start"], s["start"] + s["run"] + shorter - 1) for s in spans if not s["whole"])
                digest, at = hashlib.sha256(), 0
                for s, e in gone:
                    digest.update(text[at:s])
                    at = e
                digest.update(text[at:])
                out.append((doc_id, len(text), sum(e - s for s, e in gone), len(gone), digest.hexdigest(), sum(e - s for s, e in again), gone))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "removed"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return run


def _whole_spans(length: int, first=0) -> list:
    """The spans of a segment that repeats as a whole: all its strings of either length."""
    long = F.least("run", F.col("size") - (length - 1))
    span = lambda run, whole: F.struct(F.lit(first).cast("int").alias("start"), run.cast("int").alias("run"), F.lit(whole).alias("whole"))
    return F.filter(F.array(span(F.col("run"), False), span(long, True)), lambda s: s["run"] > 0)


def _among_many(hot: DataFrame, length: int, shorter: int, anchor: int, most: int, parts: int) -> DataFrame:
    """(key, content, spans) of the segments of minimisers with over `most` different ones. hot: key, content, run, at, bytes."""
    pieces = hot.select(F.col("key").alias("own_key"), F.col("content").alias("own_content"), F.lit(0).alias("first"), F.lit(0).alias("low"), F.lit(shorter - anchor).alias("high"), "run", "at", "bytes")
    found, width = [], shorter - anchor + 1
    while width > 1:
        width = -(-width // parts)
        dealt = materialise(pieces.mapInPandas(lean(_dealt_anew(length, shorter, anchor, parts)), PIECE), "pieces").withColumn("size", F.length("bytes"))
        kinds = materialise(dealt.groupBy("key", "content").agg(F.count("*").alias("places")), "piece-kinds")
        keys = materialise(kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("places").alias("total")).where("total > 1"), "piece-keys")
        known = dealt.join(kinds, ["key", "content"]).join(keys, "key")
        own = [F.col("own_key").alias("key"), F.col("own_content").alias("content")]
        if width == 1:  # the anchor is the string of `shorter` bytes: all of a group repeat
            repeated = F.filter(_whole_spans(length), lambda s: ~s["whole"] | (F.col("places") > 1))
            found.append(known.select(*own, "first", repeated.alias("spans")))
            break
        found.append(known.where("places > 1").select(*own, "first", _whole_spans(length).alias("spans")))
        # One piece of each kind goes on; those of several places are only there to be compared with.
        rest = known.where("kinds > 1")
        one = rest.where("places = 1").select(*dealt.columns, "kinds").union(rest.where("places > 1").dropDuplicates(["key", "content"]).select(*dealt.columns, "kinds"))
        one = materialise(one, "one-piece")
        small = one.where(F.col("kinds") <= most)
        verdict = small.select("key", "content", "run", "bytes").repartition("key").sortWithinPartitions("key").mapInPandas(lean(_sort_groups(length, shorter)), f"key long, content long, spans {SPANS}")
        found.append(small.join(materialise(verdict.where(F.size("spans") > 0), "piece-verdict"), ["key", "content"]).select(*own, "first", "spans"))
        pieces = one.where(F.col("kinds") > most)
        if not pieces.limit(1).count():
            break
    every = reduce(DataFrame.union, found)
    shifted = F.transform("spans", lambda s: F.struct((s["start"] + F.col("first")).alias("start"), s["run"].alias("run"), s["whole"].alias("whole")))
    return every.select("key", "content", shifted.alias("spans"))


def suffix_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, shorter: int = 256, anchor: int = 64, most: int = 1000, parts: int = 4) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated (bytes in repeated strings of `shorter`
    bytes), removed (arrays of start, end)."""
    assert anchor <= shorter <= length
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows are told apart by id where ids are unique; else by id and content: rows equal in both have equal spans.
    unique = docs.agg(F.count("*") == F.count_distinct("doc_id")).first()[0]
    docs = docs.withColumn("row", F.col("doc_id") if unique else F.xxhash64("doc_id", "text"))
    texts = docs.select("row", "text")
    segments = materialise(texts.mapInPandas(lean(_segments(length, shorter, anchor)), SEGMENT), "segments")

    # Minimisers that are met once are done. Where all segments of one are equal, all of them repeat as a whole. Counts are
    # written out before they are joined, so that Spark can split the rows of a minimiser that has very many.
    met = materialise(segments.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high")).where("n > 1").select("key", (F.col("low") != F.col("high")).alias("mixed")), "met")
    shared = materialise(segments.join(met, "key").select(*segments.columns, "mixed"), "shared")
    mixed = shared.where("mixed")

    # Different segments of one minimiser: one of each kind, with its weight.
    kinds = mixed.groupBy("key", "content").agg(*(F.first(c).alias(c) for c in ("row", "start", "run", "at", "size")), F.count("*").alias("weight"))
    kinds = materialise(kinds, "kinds")
    keys = materialise(kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("weight").alias("least")).where("least = 1").select("key", (F.col("kinds") > most).alias("hot")), "keys")
    chosen = kinds.join(keys, "key")
    per_row = chosen.groupBy("row").agg(F.collect_list(F.struct("key", "content", "hot", "start", "run", "at", "size")).alias("spans"))
    cut = texts.join(per_row, "row").select("text", "spans").mapInPandas(lean(_cut_out), "key long, content long, hot boolean, run int, at int, bytes binary")
    cut = materialise(cut if unique else cut.dropDuplicates(["key", "content"]), "cut")
    ordered = cut.where("not hot").select("key", "content", "run", "bytes").repartition("key").sortWithinPartitions("key")
    verdict = ordered.mapInPandas(lean(_sort_groups(length, shorter)), f"key long, content long, spans {SPANS}").where(F.size("spans") > 0)
    hot = cut.where("hot").drop("hot")
    if hot.limit(1).count():
        verdict = verdict.union(_among_many(hot, length, shorter, anchor, most, parts))
    verdict = materialise(verdict.union(kinds.where("weight > 1").select("key", "content", _whole_spans(length).alias("spans"))), "verdict")
    found = mixed.select("row", "start", "key", "content").join(verdict, ["key", "content"]).select("row", "start", F.explode("spans").alias("s"))
    spans = shared.where("not mixed").select("row", "start", F.explode(_whole_spans(length)).alias("s")).union(found)
    spans = spans.select("row", F.struct((F.col("start") + F.col("s.start")).alias("start"), F.col("s.run").alias("run"), F.col("s.whole").alias("whole")).alias("span"))

    merged = spans.groupBy("row").agg(F.collect_list("span").alias("spans"))
    return (
        docs.join(merged, "row", "left").select("doc_id", "text", "spans")
        .mapInPandas(lean(_removed(length, shorter)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, removed array<array<long>>")
        .withColumnRenamed("doc_id", id_col)
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")
