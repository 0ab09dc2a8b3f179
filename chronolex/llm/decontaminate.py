"""Benchmark decontamination by templates.

Texts are brought to a template: numbers become <num>, units after a number <unit>, and capitalised words inside a sentence
<name>; the rest is lower-cased and loses its punctuation. Windows of `window` template tokens of the documents are
hash-joined with those of the benchmark items (an item with fewer tokens is one window). A hit counts if the slots agree: within
the window the same value of the benchmark stands for the same value of the document and the other way round, so a
question with new names and numbers is caught while a chance run of numbers is not. A document is contaminated by an item
from `hits` agreeing windows on (all of the item's, if it has fewer).

Windows with few plain literals (under a third: lists of numbers, units and names) would meet by chance under their template, so
they count only with equal values in all slots: verbatim copies of such items are found, re-parameterised ones are not.

Each benchmark window has an anchor, its longest plain literal or, if it has none, its longest value that must be equal; a
document without any anchor cannot hold a window and is not brought to a template at all. Benchmark windows are sent to the tasks
when hashes and anchors take at most `broadcast` bytes; beyond that the documents' windows are joined by shuffling.

Edge cases: null and empty texts, of either side, have no windows; equal items are all reported; repeated rows are reported
as one; a null id is never reported as it names nothing; very long texts are searched whole; an empty benchmark, and an empty table of
documents, find nothing; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, windows

# Units of measure and money that may follow a number.
UNITS = frozenset(
    "m cm mm km kg g mg lb lbs oz l ml s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mile miles foot feet inch inches yard yards meter meters metre metres gram grams litre litres liter liters dollar dollars cent cents euro "
    "euros pound pounds percent degree degrees kmh mph hz khz mhz kb mb gb tb w kw v".split()
)
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|\S")
WORD = re.compile(r"[^\W\d_]+")
WORD_OR_NUMBER = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*")
WINDOW = "h long, doc long, at long, slots string"
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"

_hashed: dict[str, int] = {}


def _hash(token: str) -> int:
    if token not in _hashed:
        if len(_hashed) > 500_000:
            _hashed.clear()
        value = 0xCBF29CE484222325
        for byte in token.encode():
            value = (value ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        _hashed[token] = value
    return _hashed[token]


def template(text: str) -> tuple[list[str], list[str]]:
    """Template tokens and, for each, the value in its slot ('' for a literal)."""
    tokens, values = [], []
    fresh, after_number = True, False
    for token in TOKEN.findall(text):
        first = token[0]
        if first.isdigit():
            tokens.append(NUMBER)
            values.append(token)
            fresh, after_number = False, True
        elif first.isalpha():
            lower = token.lower()
            if after_number and lower in UNITS:
                tokens.append(UNIT)
                values.append(lower)
            elif token != lower and not fresh and len(token) > 1 and token[1:].islower():
                tokens.append(NAME)
                values.append(token)
            else:
                tokens.append(lower)
                values.append("")
            fresh = after_number = False
        else:
            fresh = fresh or first in ".!?:"
    return tokens, values


def _windows_of(text: str, size: int):
    """(hashes, whether few literals are in it, tokens, values, tokens of a window) of all windows of a text."""
    tokens, values = template(text)
    n = min(size, len(tokens))
    if not n:
        return np.empty(0, np.uint64), np.empty(0, bool), tokens, values, 0
    hashes = windows(np.fromiter(map(_hash, tokens), np.uint64, len(tokens)), n)
    literal = np.concatenate([[0], np.cumsum([v == "" for v in values])])
    return hashes, literal[n:] - literal[:-n] < max(1, n // 3), tokens, values, n


def slots_agree(ours: list[str], theirs: list[str]) -> bool:
    """Whether values stand for each other one to one; literals are empty on both sides."""
    there, back = {}, {}
    return all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in zip(ours, theirs))


def _anchor(tokens: list[str], values: list[str], poor: bool) -> str:
    """The longest literal of ASCII letters, whose lower case is the same in any text; else, where values must be equal, the longest
    of these; empty without any."""
    literal = [t for t, v in zip(tokens, values) if v == "" and t.isascii()]
    return max(literal or [v.lower() for v in values if poor and v.isascii()], key=lambda t: (len(t), t), default="")


def _document_windows(size: int, wanted: dict[int, np.ndarray] | None, anchors: frozenset[str] = frozenset()):
    """Windows of the sizes in use; with `wanted`, sorted hashes by size, only those. No anchors: every text is looked at."""

    anchored = WORD_OR_NUMBER if any(a[:1].isdigit() for a in anchors) else WORD

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc"], batch["text"]):
                text = text if isinstance(text, str) else ""
                if anchors and anchors.isdisjoint(anchored.findall(text.lower())):
                    continue
                tokens, values = template(text)
                if not tokens:
                    continue
                base = np.fromiter(map(_hash, tokens), np.uint64, len(tokens))
                for n, known in (wanted or {size: None}).items():
                    if n > len(tokens):
                        continue
                    hashes = windows(base, n)
                    if known is not None:
                        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                        starts = np.flatnonzero(known[place] == hashes)
                    else:
                        starts = np.arange(len(hashes))
                    out += [(int(hashes[s].astype(np.int64)), doc, int(s), "\t".join(values[s : s + n])) for s in starts.tolist()]
            yield pd.DataFrame(out, columns=["h", "doc", "at", "slots"])

    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 12, hits: int = 2, broadcast: int = 64_000_000) -> DataFrame:
    """Pairs of id and item_id with the number of agreeing windows (`matched`) and the document's share of the item (`share`)."""

    def item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"]):
                hashes, poor, tokens, values, n = _windows_of(text if isinstance(text, str) else "", window)
                if len(hashes):
                    cut = [(tokens[s : s + n], values[s : s + n]) for s in range(len(hashes))]
                    yield pd.DataFrame({"h": hashes.view(np.int64), "size": n, "item_id": item, "item_at": np.arange(len(hashes)), "item_slots": ["\t".join(v) for _, v in cut], "poor": poor, "windows": len(hashes), "anchor": [_anchor(*c, p) for c, p in zip(cut, poor)]})

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    items = materialise(items.mapInPandas(item_windows, "h long, size int, item_id long, item_at long, item_slots string, poor boolean, windows long, anchor string"), "benchmark")
    docs = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    # 24 bytes for a hash with its size, and the anchors, each once.
    sent = items.agg((24 * F.count("*")).alias("n")).first()["n"] + (items.select("anchor").distinct().agg(F.sum(64 + F.length("anchor"))).first()[0] or 0)
    if sent <= broadcast:
        known = items.select("size", "h").distinct().toPandas()
        anchors = frozenset(r["anchor"] for r in items.select("anchor").distinct().collect())
        anchors = anchors if "" not in anchors else frozenset()
        wanted = {int(n): np.sort(g["h"].to_numpy().view(np.uint64)) for n, g in known.groupby("size")}
        if not wanted:
            return docs.limit(0).select(F.col("doc").alias(id_col), F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("matched"), F.lit(0.0).alias("share"))
        met = docs.mapInPandas(_document_windows(window, wanted, anchors), WINDOW)
    else:
        sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most `window` numbers
        met = docs.mapInPandas(_document_windows(window, dict.fromkeys(sizes)), WINDOW)

    def agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [a == b if poor else slots_agree(a.split("\t"), b.split("\t")) for a, b, poor in zip(batch["item_slots"], batch["slots"], batch["poor"])]
            yield batch.loc[keep, ["doc", "item_id", "item_at", "windows"]]

    # Of a document's windows with one hash and the same slots, one is as good as all.
    distinct = met.groupBy("h", "doc", "slots").agg(F.min("at").alias("at"))
    agreed = distinct.join(items, "h").select("doc", "item_id", "item_at", "windows", "item_slots", "poor", "slots").mapInPandas(agreeing, "doc long, item_id long, item_at long, windows long")
    found = agreed.groupBy("doc", "item_id").agg(F.count_distinct("item_at").alias("matched"), F.max("windows").alias("windows"))
    return found.where(F.col("matched") >= F.least(F.lit(hits), F.col("windows"))).select(F.col("doc").alias(id_col), "item_id", "matched", (F.col("matched") / F.col("windows")).alias("share"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
