"""Token files: frequency-ranked ids in a byte-aligned variable-length code, read by numpy table lookups.

The format, a folder of two Parquet tables (so that any file system, commit protocol and lost executor is
Spark's business):

* `ranks`: token id and its rank, 0 for the most frequent id of all documents.
* `blocks`: consecutive documents in ascending id order. `control` holds two bits for each id, four to a byte,
  lowest bits first: the number of bytes of its rank less one. `data` holds the ranks, little-endian, in that
  many bytes. `doc_ids` and `counts` say which documents the block holds; `part` and `block` order the blocks.

Texts are tokenised once. A chunk between blanks encodes alike wherever it stands, because the tokenizer drops
white space and never merges across it; so each worker keeps the ids of the chunks it has met. Chunks of
plain letters, digits and punctuation are put together of their pieces, which go in lower case to the tokenizer's model
itself; whether a tokenizer works that way is tested on a few chunks when it is loaded.

Edge cases: null and empty texts hold the end id alone; a null doc_id sorts first; rows with equal ids follow
each other, ordered by text hash; an empty table gives empty files; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_folder

#: Ids in a block, unless a single document has more, and chunks that a worker remembers.
BLOCK_IDS = 1 << 19
REMEMBERED = 1_500_000
BLOCKS = "part int, block int, doc_ids array<long>, counts array<long>, control binary, data binary"

#: Byte lengths of the four ids of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1

_encoders: dict[str, "ChunkEncoder"] = {}


#: Chunks of ASCII and of Latin letters whose lower case is one letter whatever stands around them, and their pieces: words,
#: single digits, runs of punctuation. The apostrophe is left out as it begins pieces of its own.
PLAIN = re.compile(r"[!-&(-~ªµºÀ-ÖØ-öø-į]+")
PIECE = re.compile(r"[A-Za-zªµºÀ-ÖØ-öø-į]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
MARKS = frozenset(".,;:!?")
PROBES = ("word", "Word", "WORD", "naïve", "Ñandú", "straße", "éàü", "a", "word,", "Élan.", "mañana!", "a1b22", "x_y", "...", "12.5%", "$$$", "ab###")
#: Byte-level vocabularies write bytes as characters: the printable ones of Latin-1 as themselves, the others from U+0100 on.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
OTHERS = [b for b in range(256) if b not in PRINTABLE]
BYTE_LETTERS = [chr(b if b in PRINTABLE else 0x100 + OTHERS.index(b)) for b in range(256)]


class PieceEncoder(dict):
    """Ids of each lower-case piece met so far, straight from the tokenizer's model."""

    def __init__(self, tokenizer):
        self.tokenize = tokenizer.model.tokenize
        width = int(id_type(tokenizer)[-1])
        self.written = [i.to_bytes(width, "little") for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        written, letters = self.written, piece if piece.isascii() else "".join([BYTE_LETTERS[b] for b in piece.encode()])
        self[piece] = found = b"".join([written[t.id] for t in self.tokenize(letters)])
        return found


class ChunkEncoder(dict):
    """Little-endian ids of each chunk met so far, in two bytes each where the vocabulary allows it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = id_type(self.tokenizer)
        self.pieces = PieceEncoder(self.tokenizer)
        # Pieces go to the model itself, without normaliser and splitter, if the tokenizer treats the probes that way.
        # Added tokens are found anywhere in a text: chunks that hold a mark which all of these have are encoded whole.
        added = [set(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        marks = {c for c in set.intersection(*added) if not c.isalnum() and c not in MARKS} if added else {"\n"}
        self.direct, self.guard = bool(marks), min(marks, default="")
        self.direct = self.direct and all(self[c] == self._whole(c) for c in PROBES)
        self.clear()

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if not self.direct or not PLAIN.fullmatch(chunk):
            found = self._whole(chunk)
        elif chunk.isalpha():
            found = self.pieces[chunk.lower()]
        elif chunk[-1] in MARKS and chunk[:-1].isalpha():
            found = self.pieces[chunk[:-1].lower()] + self.pieces[chunk[-1]]
        elif self.guard in chunk:
            found = self._whole(chunk)
        else:
            found = b"".join(map(self.pieces.__getitem__, PIECE.findall(chunk.lower())))
        self[chunk] = found
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for known in (self, self.pieces):  # what came first is what comes most
            if len(known) > REMEMBERED:
                for c in list(known)[REMEMBERED // 2 :]:
                    del known[c]
        for t in texts:
            yield b"".join(map(self.__getitem__, t.replace("\n", " ").split(" ")))


def id_type(tokenizer) -> str:
    return "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _tokenised(path: str, end_id: int):
    """Ids of every document; and, as a row of its own, how often a task has met each id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _encoders:
            _encoders[path] = ChunkEncoder(path)
        encoder = _encoders[path]
        end = np.array([end_id], encoder.kind).tobytes()
        total = np.zeros(max(end_id + 1, encoder.tokenizer.get_vocab_size()), np.int64)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                ids = [i + end for i in encoder.encode([t if isinstance(t, str) else "" for t in part["text"]])]
                total += np.bincount(np.frombuffer(b"".join(ids), encoder.kind), minlength=len(total))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "tie": part["tie"], "ids": ids, "met": None, "counts": None})
        if total.any():
            met = np.flatnonzero(total)
            yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "tie": [0], "ids": [None], "met": [met], "counts": [total[met]]})

    return run


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of an array of ranks below 2**32."""
    size, most = np.ones(len(ranks), np.uint8), 1
    while most < 4 and (more := ranks >= 1 << 8 * most).any():
        size += more
        most += 1
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :most]
    return control.astype(np.uint8).tobytes(), raw[np.arange(most) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks back, by looking the lengths up and gathering the bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[starts].astype(np.uint32)
    for j in range(1, size.max(initial=1)):
        more = np.flatnonzero(size > j)
        out[more] |= raw[starts[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def _blocks(rank_of: np.ndarray, kind: str):
    width = np.dtype(kind).itemsize

    def block(part: int, number: int, doc_ids: list, texts: list[bytes]) -> dict:
        control, data = pack(rank_of[np.frombuffer(b"".join(texts), kind)])
        return {"part": part, "block": number, "doc_ids": doc_ids, "counts": [len(t) // width for t in texts], "control": control, "data": data}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, doc_ids, texts, size = 0, 0, [], [], 0
        for batch in batches:
            for part, doc_id, ids in zip(batch["part"], batch["doc_id"], batch["ids"]):
                if texts and size + len(ids) > width * BLOCK_IDS:
                    yield pd.DataFrame([block(part, number, doc_ids, texts)])
                    number, doc_ids, texts, size = number + 1, [], [], 0
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(ids)
                size += len(ids)
        if texts:
            yield pd.DataFrame([block(part, number, doc_ids, texts)])

    return run


def write_token_files(documents: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    from tokenizers import Tokenizer

    kind = id_type(Tokenizer.from_file(tokenizer))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    found = materialise(docs.mapInPandas(_tokenised(tokenizer, end_id), "doc_id long, tie long, ids binary, met array<long>, counts array<long>"), "tokens")
    tokens = found.where("ids is not null").select("doc_id", "tie", "ids")
    counts = found.where("met is not null").select(F.explode(F.arrays_zip("met", "counts")).alias("m")).groupBy(F.col("m.met").alias("id")).agg(F.sum("m.counts").alias("count"))
    # One row for each id of the vocabulary at most: what reaches the driver doesn't grow with the documents.
    by_rank = [r["id"] for r in counts.orderBy(F.desc("count"), "id").collect()]
    spark = documents.sparkSession
    spark.createDataFrame([(i, k) for k, i in enumerate(by_rank)], "id long, rank long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank_of[np.array(by_rank, np.int64)] = np.arange(len(by_rank))
    ordered = tokens.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "tie").select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    ordered.mapInPandas(_blocks(rank_of, kind), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian 32-bit) of every document, from the files."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in ranks], "<u4")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.select("part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))
    # One total for each file reaches one task; the blocks of a file are summed within it.
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inside = sizes.select("part", "block", (F.sum("ids").over(Window.partitionBy("part").orderBy("block")) - F.col("ids")).alias("within"))
    starts = inside.join(parts, "part").select("part", "block", (F.col("before") + F.col("within")).alias("start"))

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_ids, counts, control, data, start in zip(batch["doc_ids"], batch["counts"], batch["control"], batch["data"], batch["start"]):
                counts = np.asarray(counts, np.int64)
                ends = np.cumsum(counts)
                ids = id_of[unpack(control, data, int(ends[-1]))]
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(d) else int(d) for d in doc_ids], "Int64"), "start": start + ends - counts, "ids": [ids[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist())]})

    return blocks.join(starts, ["part", "block"]).select("doc_ids", "counts", "control", "data", "start").mapInPandas(decoded, "doc_id long, start long, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)

    read = read_token_files(spark, path)
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
