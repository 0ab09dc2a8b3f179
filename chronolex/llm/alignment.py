"""Cross-tokenizer alignment: groups of tokens of two tokenizers between the byte offsets where tokens of both end.

A document is " " + text. It is cut into units before each single blank between two other characters: there the byte-level
vocabulary's splitter always cuts, and no piece of the other vocabulary goes on, so units tokenise alike wherever they stand, and a
worker keeps what it has met.

A text of at most `chunk` bytes is aligned in one go. A longer one is dealt out to tasks in byte ranges. A range takes the tokens that end in
it, and yields a fragment: an open prefix, which is the tokens up to its first common end, closed groups, and an open suffix, the tokens after
its last common end. Fragments compose: a suffix and the prefix that follows are one group, and a fragment without a common end is open as a
whole. Composition is associative, so that fragments of a document are reduced in a tree, FAN at a time, each level a shuffle.

Tokens that don't spell the document (signs that a vocabulary writes otherwise) leave it without tokens.

Edge cases: null and empty texts have no tokens: zeros, and '' for their groups; rows with equal or null ids are documents of their own; a
stretch without a place to cut is tokenised in one piece, and its ranges are one; groups of many tokens are counted by distinct ids; an
empty table returns no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialise
from .periodic_runs import ranges

CHUNK = 1 << 16
FAN = 8
#: Bytes of text that one vectorised step takes, units that a worker remembers, links of a group that are spelt out token by token.
STEP_BYTES = 1 << 18
REMEMBERED = 400_000
PLAIN_LINKS = 1 << 12
#: Distinct pairs of ids, of 32 bytes each, up to which they are broadcast.
BROADCAST_PAIRS = 2_000_000

#: Units of one word of Latin letters and signs after it: two pieces to the byte-level splitter, which go to the model itself.
PLAIN = re.compile("([A-Za-zªµºÀ-ÖØ-öø-ɏ]+)([.,;:!?]*)")
PROBES = ("word", "Word,", "naïve", "Ñandú", "straße.", "a", "end...", "mañana!?", "ŁÓDŹ;", "x:", "hippopotamus")
CUT = re.compile(r"(?<=\S)(?= \S)")
ODD = re.compile(r"\s\s|\s\Z")
#: Marks the ids of the second vocabulary where those of both are in one list.
SECOND = 1 << 31
#: Bits of an id of the second vocabulary within a pair.
SHIFT = 20

LINKS = "array<struct<a: int, b: int, n: bigint>>"
ALIGNED = f"n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links {LINKS}"
FRAGMENT = "ok boolean, met boolean, counts binary, prefix_a binary, prefix_b binary, suffix_a binary, suffix_b binary, groups string, pairs binary, times binary"

_encoders: dict[tuple[str, str], "Units"] = {}


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones of Latin-1 for themselves, the others from
    U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Units(dict):
    """The little-endian ids of both tokenizers for each unit met so far, or None if they don't spell it. The keys are without blank."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings inside texts are plain text
        letters = byte_letters()
        a_words = {i: w for w, i in self.a.get_vocab().items()}
        special = {i for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [b"" if i in special else bytes(letters[c] for c in a_words.get(i, "")) for i in range(max(a_words) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))]
        if any("▁" in p.lstrip("▁") for p in map(self.b.id_to_piece, range(self.b.vocab_size()))):
            raise ValueError(f"{b_path} has pieces that go on over a blank: texts can't be cut at blanks")
        self.letters = {b: c for c, b in letters.items()}
        self.signs: dict[str, list[int]] = {}
        self.direct = all(self.plain_ids(*PLAIN.fullmatch(p).groups()) == self.a.encode(" " + p, add_special_tokens=False).ids for p in PROBES)
        self.a_size, self.b_size = (np.array([len(w) for w in words], np.int64) for words in (self.a_bytes, self.b_bytes))
        self.a_names = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"]
        self.names = self.a_names + [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]

    def plain_ids(self, word: str, signs: str) -> list[int]:
        """Ids of the first tokenizer for " " + word + signs."""
        written = " " + word
        found = [t.id for t in self.a.model.tokenize("".join([self.letters[b] for b in written.encode()]))]
        if signs:
            if signs not in self.signs:
                self.signs[signs] = [t.id for t in self.a.model.tokenize(signs)]
            found += self.signs[signs]
        return found

    def learn(self, units: list[str]) -> None:
        first = {u: self.plain_ids(*m.groups()) for u in units if (m := PLAIN.fullmatch(u))} if self.direct else {}
        others = [u for u in units if u not in first]
        first |= {u: x.ids for u, x in zip(others, self.a.encode_batch_fast([" " + u for u in others], add_special_tokens=False))}
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        for unit, y in zip(units, self.b.encode(units, num_threads=1) if units else []):
            x, raw = first[unit], (" " + unit).encode()
            spelt = b"".join([a_bytes[i] for i in x]) == raw and b"".join([b_bytes[i] for i in y]) == raw
            self[unit] = array("I", [*x, *[i + SECOND for i in y]]).tobytes() if spelt else None

    def tokens(self, texts: list[str]) -> list[bytes | None]:
        """Ids of both tokenizers for " " + text, unit by unit, those of the second with the bit SECOND; None where they don't spell it."""
        if len(self) > REMEMBERED:  # what came first is what comes most
            for unit in list(self)[REMEMBERED // 2 :]:
                del self[unit]
        split, found, open_ = [units_of(t) for t in texts], [None] * len(texts), range(len(texts))
        for known in (False, True):
            rest = []
            for k in open_:
                try:
                    found[k] = b"".join(map(self.get, split[k]))
                except TypeError:  # a unit is not known, or not spelt
                    rest.append(k)
            if not known:
                self.learn([u for u in dict.fromkeys(chain.from_iterable(split[k] for k in rest)) if u not in self])
            open_ = rest
        return found


def sides(tokens: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of both tokenizers."""
    both = np.frombuffer(tokens, "<u4")
    second = both >= SECOND
    return both[~second], both[second] ^ np.uint32(SECOND)


def units_of(text: str) -> list[str]:
    """The units of " " + text, each without the blank that it begins with."""
    whole = " " + text
    return [u[1:] for u in CUT.split(whole)] if ODD.search(whole) else text.split(" ")


def encoder(a_path: str, b_path: str) -> Units:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if (a_path, b_path) not in _encoders:
        _encoders[a_path, b_path] = Units(a_path, b_path)
    return _encoders[a_path, b_path]


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, times, len(keys)).astype(np.int64)


@dataclass
class Closed:
    """Tokens of consecutive groups: a_group and b_group number each token's, and those from `number` on belong to none yet."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    number: int

    @classmethod
    def of(cls, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> "Closed":
        first = int(min(a_ends.min(initial=1 << 62), b_ends.min(initial=1 << 62)))
        in_a, in_b = (np.zeros(int(max(a_ends.max(initial=0), b_ends.max(initial=0))) - first + 1 if len(a) + len(b) else 0, bool) for _ in range(2))
        in_a[a_ends - first] = in_b[b_ends - first] = True
        a_last, b_last = in_b[a_ends - first], in_a[b_ends - first]
        return cls(a, b, np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last, int(a_last.sum()))

    def cut(self, low: int, high: int) -> "Closed":
        """The groups low to high - 1."""
        i, j = (slice(*np.searchsorted(g, [low, high])) for g in (self.a_group, self.b_group))
        return Closed(self.a[i], self.b[j], self.a_group[i] - low, self.b_group[j] - low, high - low)

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.a_group, minlength=self.number), np.bincount(self.b_group, minlength=self.number)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, pair of ids, how many links) of all groups, pairs repeated; large groups by their distinct ids."""
        n_a, n_b = self.sizes()
        large = n_a * n_b > PLAIN_LINKS
        first = np.cumsum(n_b) - n_b
        own = np.where(large, 0, n_b)[self.a_group]
        group = np.repeat(self.a_group, own)
        keys = (np.repeat(self.a, own).astype(np.int64) << SHIFT) | self.b[ranges(first[self.a_group], own)]
        parts = [(group, keys, np.ones(len(keys), np.int64))]
        for g in np.flatnonzero(large):
            x, y = (np.unique(ids[slice(*np.searchsorted(of, [g, g + 1]))], return_counts=True) for ids, of in ((self.a, self.a_group), (self.b, self.b_group)))
            keys = ((x[0].astype(np.int64) << SHIFT)[:, None] | y[0][None]).ravel()
            parts.append((np.full(len(keys), g), keys, (x[1][:, None] * y[1][None]).ravel()))
        return tuple(np.concatenate(p) for p in zip(*parts))

    def codes(self, a_names: int) -> np.ndarray:
        """The places, in a list of names, of all tokens: by group, those of the first tokenizer before those of the second."""
        n_a, n_b = self.sizes()
        through_a, before_b = np.cumsum(n_a), np.cumsum(n_b) - n_b
        out = np.empty(len(self.a) + len(self.b), np.int64)
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool)
        out[np.arange(len(self.a)) + before_b[self.a_group]] = 2 * self.a.astype(np.int64) + last(self.a_group)
        out[np.arange(len(self.b)) + through_a[self.b_group]] = a_names + 2 * self.b.astype(np.int64) + last(self.b_group)
        return out

    def text(self, units: Units) -> str:
        """a1,a2|b1;a3|b2,b3 without a semicolon at the end."""
        return "".join(map(units.names.__getitem__, self.codes(len(units.a_names)).tolist()))[:-1]


@dataclass
class Fragment:
    """What a byte range of a document knows of its groups. prefix and suffix: ids of both tokenizers; counts: n_a, n_b, n_groups,
    n_links, the latter two of closed groups; groups: their text; pairs and times: their links by pair of ids, in order."""

    ok: bool
    met: bool
    counts: np.ndarray
    prefix: tuple[np.ndarray, np.ndarray]
    suffix: tuple[np.ndarray, np.ndarray]
    groups: str
    pairs: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, units: Units, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> "Fragment":
        """Of the tokens that end in a range, with their ends."""
        every = Closed.of(a, a_ends, b, b_ends)
        opened = lambda low, high: tuple(ids[slice(*np.searchsorted(g, [low, high]))] for ids, g in ((every.a, every.a_group), (every.b, every.b_group)))
        counts, none = np.array([len(a), len(b), 0, 0]), np.empty(0, np.int64)
        if not every.number:
            return cls(True, False, counts, (a, b), (a[:0], b[:0]), "", none, none)
        inside = every.cut(1, every.number)
        n_a, n_b = inside.sizes()
        counts[2:] = inside.number, (n_a * n_b).sum()
        return cls(True, True, counts, opened(0, 1), opened(every.number, every.number + 1), inside.text(units), *summed(*inside.pairs()[1:]))

    @classmethod
    def failed(cls) -> "Fragment":
        none = np.empty(0, np.int64)
        return cls(False, True, np.zeros(4, np.int64), (none, none), (none, none), "", none, none)

    def then(self, other: "Fragment", units: Units) -> "Fragment":
        if not (self.ok and other.ok):
            return self.failed()
        counts, none = self.counts + other.counts, np.empty(0, np.int64)
        joined = lambda x, y: tuple(np.concatenate(z) for z in zip(x, y))
        if not self.met:
            return Fragment(True, other.met, counts, joined(self.prefix, other.prefix), other.suffix, other.groups, other.pairs, other.times)
        if not other.met:
            return Fragment(True, True, counts, self.prefix, joined(self.suffix, other.prefix), self.groups, self.pairs, self.times)
        a, b = joined(self.suffix, other.prefix)
        middle = Closed(a, b, np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), 1)
        pairs, times = (np.concatenate(x) for x in zip((self.pairs, self.times), (other.pairs, other.times), middle.pairs()[1:]))
        counts = counts + np.array([0, 0, 1, len(a) * len(b)])
        return Fragment(True, True, counts, self.prefix, other.suffix, ";".join(filter(None, (self.groups, middle.text(units), other.groups))), *summed(pairs, times))

    def closed(self, units: Units) -> "Fragment":
        """As the whole of a document, which begins and ends at a common end."""
        none = np.empty(0, np.int64)
        return Fragment(True, True, np.zeros(4, np.int64), (none, none), (none, none), "", none, none).then(self, units)

    def row(self) -> dict:
        written = lambda x, kind: np.asarray(x).astype(kind).tobytes()
        return {
            "ok": self.ok, "met": self.met, "counts": written(self.counts, "<i8"), "prefix_a": written(self.prefix[0], "<u4"), "prefix_b": written(self.prefix[1], "<u4"), "suffix_a": written(self.suffix[0], "<u4"),
            "suffix_b": written(self.suffix[1], "<u4"), "groups": self.groups, "pairs": written(self.pairs, "<i8"), "times": written(self.times, "<i8"),
        }

    @classmethod
    def read(cls, row) -> "Fragment":
        array = lambda c, kind: np.frombuffer(row[c], kind)
        return cls(bool(row["ok"]), bool(row["met"]), array("counts", "<i8"), (array("prefix_a", "<u4"), array("prefix_b", "<u4")), (array("suffix_a", "<u4"), array("suffix_b", "<u4")), row["groups"], array("pairs", "<i8"), array("times", "<i8"))


def _rows(ids: pa.Array, counts: np.ndarray, groups: list[str], sizes: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    links = pa.StructArray.from_arrays([pa.array((pairs >> SHIFT).astype(np.int32)), pa.array((pairs & ((1 << SHIFT) - 1)).astype(np.int32)), pa.array(times.astype(np.int64))], ["a", "b", "n"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), links)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c.astype(np.int64)) for c in counts.T), pa.array(groups, pa.string()), lists], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])


def _whole(paths: tuple[str, str]):
    """Aligned rows of (id, text), each text in one go, many texts at a time."""

    def aligned(units: Units, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        known = [k for k, t in enumerate(texts) if t]
        told = [(k, f) for k, f in zip(known, units.tokens([texts[k] for k in known])) if f is not None]
        places, found = np.array([k for k, _ in told], np.int64), [f for _, f in told]
        both = b"".join(found)
        a, b = sides(both)
        past = np.cumsum([len(f) // 4 for f in found], dtype=np.int64)
        second = np.concatenate([[0], np.cumsum(np.frombuffer(both, "<u4") >= SECOND)])
        n_b = np.diff(second[np.concatenate([[0], past])])
        n_a = np.diff(past, prepend=0) - n_b
        every = Closed.of(a, np.cumsum(units.a_size[a]), b, np.cumsum(units.b_size[b]))
        of_a, of_b = every.sizes()
        past = np.cumsum(n_a)
        doc = np.searchsorted(past, np.cumsum(of_a))  # of each group, by its last token of the first tokenizer
        counts = np.zeros((len(texts), 4), np.int64)
        counts[places] = np.column_stack([n_a, n_b, np.bincount(doc, minlength=len(found)), np.bincount(doc, of_a * of_b, len(found)).astype(np.int64)])
        group, pair, times = every.pairs()
        key, times = summed((doc[group] << 2 * SHIFT) | pair, times)
        sizes = np.zeros(len(texts), np.int64)
        sizes[places] = np.bincount(key >> 2 * SHIFT, minlength=len(found))
        names, codes, groups, at = units.names, every.codes(len(units.a_names)).tolist(), [""] * len(texts), 0
        for k, n in zip(places.tolist(), (n_a + n_b).tolist()):
            groups[k] = "".join(map(names.__getitem__, codes[at : at + n]))[:-1]
            at += n
        return _rows(ids, counts, groups, sizes, key & ((1 << 2 * SHIFT) - 1), times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = encoder(*paths)
        for batch in batches:
            texts, first, size = batch.column(1).to_pylist(), 0, 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size > STEP_BYTES or k == len(texts) - 1:
                    yield aligned(units, batch.column(0).slice(first, k + 1 - first), texts[first : k + 1])
                    first, size = k + 1, 0

    return run


def byte_ranges(text: str, chunk: int) -> Iterator[tuple[int, int, int, str]]:
    """(low, high, begin, stretch) of " " + text: ranges of about `chunk` bytes, each with the stretch from the last cut before it, at
    byte `begin`, to the first after it. Ranges between two cuts are one."""
    whole = " " + text
    at = np.array([0, *(m.start() for m in CUT.finditer(whole)), len(whole)])
    place = at if whole.isascii() else np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in whole])])[at]
    size = int(place[-1])
    low = np.arange(0, size, chunk)
    before = np.searchsorted(place, low, side="right") - 1
    new = np.append(True, before[1:] != before[:-1])
    low, before = low[new], before[new]
    high = np.append(low[1:], size)
    after = np.searchsorted(place, high)
    for a, b, i, j in zip(low.tolist(), high.tolist(), before.tolist(), after.tolist()):
        yield a, b, int(place[i]), whole[at[i] : at[j]]


def _chunks(chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                for k, (low, high, begin, stretch) in enumerate(byte_ranges(text, chunk)):
                    yield pd.DataFrame({"row": [row], "k": [k], "low": [low], "high": [high], "begin": [begin], "stretch": [stretch]})

    return run


def _fragments(paths: tuple[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = encoder(*paths)
        for batch in batches:
            for row, k, low, high, begin, stretch in batch[["row", "k", "low", "high", "begin", "stretch"]].itertuples(index=False):
                (found,) = units.tokens([stretch[1:]])
                fragment = Fragment.failed()
                if found is not None:
                    ids = sides(found)
                    ends = [begin + np.cumsum(sizes[i]) for sizes, i in zip((units.a_size, units.b_size), ids)]
                    (a, a_ends), (b, b_ends) = ((i[(e > low) & (e <= high)], e[(e > low) & (e <= high)]) for i, e in zip(ids, ends))
                    fragment = Fragment.of(units, a, a_ends, b, b_ends)
                yield pd.DataFrame([{"row": row, "k": k} | fragment.row()])

    return run


def _composed(paths: tuple[str, str]):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        units, part = encoder(*paths), part.sort_values("k")
        whole = reduce(lambda x, y: x.then(y, units), [Fragment.read(r) for r in part.to_dict("records")])
        return pd.DataFrame([{"row": part["row"].iloc[0], "k": part["k"].iloc[0] // FAN} | whole.row()])

    return run


def _finished(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = encoder(*paths)
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                f = Fragment.read(row)
                f = f.closed(units) if f.ok else f
                yield _rows(batch.column(0).slice(k, 1), f.counts[None], [f.groups], np.array([len(f.pairs)]), f.pairs, f.times)

    return run


def align(documents: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), links array<struct<a, b, n>>: each pair of ids that share a group and
    how many of their tokens do."""
    paths = (a_path, b_path)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    is_long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    short = docs.where(~is_long).mapInArrow(lean(_whole(paths)), f"id {kind}, {ALIGNED}")
    # Rows are told apart by a number that is written out before it is used.
    long = materialise(docs.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long")
    last = (long.agg(F.max(F.octet_length("text"))).first()[0] or 0) // chunk + 1
    chunks = long.select("row", "text").mapInPandas(lean(_chunks(chunk)), "row bigint, k bigint, low bigint, high bigint, begin bigint, stretch string")
    columns = f"row bigint, k bigint, {FRAGMENT}"
    parts = chunks.repartition(F.xxhash64("row", "k")).mapInPandas(lean(_fragments(paths)), columns)
    while last > 0:
        parts = parts.groupBy("row", F.floor(F.col("k") / FAN).alias("part")).applyInPandas(_composed(paths), columns)
        last //= FAN
    done = parts.drop("k").mapInArrow(lean(_finished(paths)), f"row bigint, {ALIGNED}")
    return short.unionByName(long.select("row", "id").join(done, "row").drop("row")).withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, documents (that hold the pair linked), best (whether no other pair of a is in more)."""
    links = aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.count("*").alias("documents"))
    counts = materialise(links, "pairs")
    # One row for each id of the first vocabulary at most.
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, row: str, most: int = BROADCAST_PAIRS) -> DataFrame:
    """row, n_best (links whose pair is the best of its a), count_sum (documents of the pair, over all links), of the rows that have
    links; row: a column that tells rows apart.

    Up to `most` pairs are broadcast. Of more, those that a thousandth of the rows or more hold are, which are a thousand times as many
    as a row has pairs at most; the others are joined, and no key of these has more than a thousandth of the rows."""
    counts, each = pair_counts(aligned), aligned.select(row, F.explode("links").alias("l")).select(row, "l.*")
    if counts.count() <= most:
        found = each.join(F.broadcast(counts), ["a", "b"])
    else:
        hot = F.col("documents") * 1000 >= aligned.count()
        frequent, rare = F.broadcast(counts.where(hot)), counts.where(~hot)
        found = each.join(frequent, ["a", "b"]).unionByName(each.join(frequent, ["a", "b"], "left_anti").join(rare, ["a", "b"]))
    return found.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("documents") * F.col("n")).alias("count_sum"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = materialise(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"), "aligned")
    counted = with_counts(aligned, "row")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return aligned.drop("links").join(counted, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
