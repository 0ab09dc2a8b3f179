"""Shared helpers of the training-data operators.

Hashing of byte strings is vectorised: with S[i] the sum of code(byte j) * B**j for j < i, the hash of bytes a..b is
(S[b] - S[a]) * B**-a modulo the prime 2**31 - 1, so any number of substrings costs one pass. Two bases give 62 bits.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
BASES = (0x2545F491, 0x4F6CDD1D)
CODES = np.random.default_rng(7).integers(1, PRIME, 256, dtype=np.uint64)
#: ASCII white space as the contracts of the word shingles define it: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one vectorised step takes; a longer single text is a step of its own.
STEP_BYTES = 1 << 19

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS_PER_BATCH = 1000
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_powers: dict[int, np.ndarray] = {}


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task, which hands its memory back when its partition ends: Spark keeps Python workers for later stages."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        _powers.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def modulo(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    prime, shift = np.uint64(PRIME), np.uint64(31)
    high = x >> shift
    x = x & prime
    x += high
    # Now at most twice the prime; below it a difference wraps round and is the larger one.
    for _ in range(2):
        np.subtract(x, prime, out=high)
        np.minimum(x, high, out=x)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**i for i < n, grown on demand and kept per process."""
    if len(_powers.get(base, ())) < n:
        out = np.ones(1, np.uint64)
        while len(out) < max(n, STEP_BYTES + (1 << 16)):
            out = np.concatenate([out, modulo(out * np.uint64(pow(base, len(out), PRIME)))])
        _powers[base] = out
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    shifted = h >> np.uint64(33)
    h = h ^ shifted
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h *= np.uint64(factor)
        h ^= np.right_shift(h, np.uint64(33), out=shifted)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """One row for each base."""
    codes, sums = CODES[data], np.zeros((2, len(data) + 1), np.uint64)
    for own, base in zip(sums, BASES):
        np.cumsum(modulo(codes * powers(base, len(data))), out=own[1:])
    return sums


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    both = np.zeros(len(starts), np.uint64)
    for own, base in zip(sums, BASES):
        down = powers(pow(base, -1, PRIME), sums.shape[1])
        both = (both << np.uint64(31)) | modulo(modulo(own[ends] - own[starts]) * down[starts])
    return mix(both ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def equal_hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """`substring_hashes` of all substrings of `length` bytes."""
    n = max(0, sums.shape[1] - length)
    both = np.zeros(n, np.uint64)
    for own, base in zip(sums, BASES):
        part = modulo(own[length:] - own[:n])
        part *= powers(pow(base, -1, PRIME), sums.shape[1])[:n]
        both <<= np.uint64(31)
        both |= modulo(part)
    both ^= np.uint64(length << 40)
    return mix(both)


def steps(texts, most: int = STEP_BYTES):
    """Split a list of encoded texts into runs (first, past, buffer, offsets); a NUL-free newline ends each text."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        if held and total + len(t) + 1 > most:
            yield _step(first, held)
            first, held, total = i, [], 0
        held.append(t)
        total += len(t) + 1
    if held:
        yield _step(first, held)


def _step(first: int, held: list[bytes]):
    data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
    offsets = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in held], out=offsets[1:])
    return first, first + len(held), data, offsets


def encoded(column) -> list[bytes]:
    """The texts of a pandas column as UTF-8; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in column]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Hash, start and end of every white-space separated word, and for each text the range of its words."""
    if lower:
        data = LOWER[data]
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    hashes = substring_hashes(prefix_sums(data), starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n consecutive word hashes."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + len(out)]
    return mix(out)


def shingle_sets(texts: list[bytes], n: int = 5):
    """For each text the sorted distinct hashes of its word n-grams; shorter texts are one n-gram, empty ones none."""
    for _, _, data, offsets in steps(texts):
        hashes, _, _, bounds = word_hashes(data, offsets)
        grams = windows(hashes, n)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield windows(hashes[a:b], b - a)
            else:
                yield np.empty(0, np.uint64)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one is made only where all of Spark is this one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir names no folder, and with master {master} executors don't share local ones")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. Lost executors lose none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    # For the session, from the first job on: smaller batches between Spark and Python, as rows are texts and token lists here; and
    # Spark drops the shuffle files of each query when it ends, since what is used again is written out.
    if not 0 < int(spark.conf.get(BATCH)) <= ROWS_PER_BATCH:
        spark.conf.set(BATCH, str(ROWS_PER_BATCH))
    if spark.conf.get(CLEAN_UP, "false") != "true":
        spark.conf.set(CLEAN_UP, "true")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sampled(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """About `rows` rows, those of low key hash, or all if there are no more: the same at any partitioning, and no sort."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int((1 << 30) * rows / total))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a long, b long): (node, root) with the smallest node of each component.

    Alternates hooking every node's neighbours onto the smallest one with shortcutting, both by a grouped
    minimum, so neither a node nor a component is gathered in one place. Each round is written out.
    """
    known = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    current = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = known(current)
    for _ in range(rounds):
        # Edges go from the larger node to the smaller. Large star: every neighbour above a node goes to the smallest of its
        # neighbourhood, which is below it or the node itself.
        least = current.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b")
        large = current.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        # Small star: a node and the neighbours below it go to the smallest of these.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        new = large.join(down, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        current = materialise(new, "edges")
        before, state = state, known(current)
        if state == before:  # the same set of edges, by its size and the hashes of all
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["a"], "left").select("node", F.coalesce("root", "node").alias("root"))
