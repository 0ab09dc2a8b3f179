"""Token alignment against whole-text tokenisation and counting by brute force, and the algebra of its fragments."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import reduce

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from chronolex.llm import alignment
from chronolex.llm.registry import QUERIES

TABLES = "/root/testdata/sf0.001"
PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
NOTHING = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": "", "links": {}}
#: Characters and strings that splitters, normalisers and control tokens stumble over.
ODD = [*"abcde ABC123 .,!?'\n\t", "　", " ", *"éüßñ漢字☃▁", "́", "\x1c", "​", "\x85", "  ", " the", "'s", " 's", "<|endoftext|>", "</s>", "<unk>", "<0x41>", "😀", " 12"]


@pytest.fixture(scope="module")
def units():
    return alignment.encoder(*PATHS)


@pytest.fixture(scope="module")
def brute(units):
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True

    def aligned(text):
        """The whole text, tokenised at once."""
        if not text:
            return NOTHING
        x, y, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        words = [units.a_bytes[i] for i in x], [units.b_bytes[i] for i in y]
        if any(b"".join(w) != raw for w in words):
            return NOTHING
        ends = [np.cumsum([len(z) for z in w]) for w in words]
        common = sorted({*ends[0].tolist()} & {*ends[1].tolist()})
        groups = defaultdict(lambda: ([], []))
        for side, (ids, end) in enumerate(zip((x, y), ends)):
            for i, g in zip(ids, np.searchsorted(common, end).tolist()):
                groups[g][side].append(i)
        links = Counter((p, q) for xs, ys in groups.values() for p in xs for q in ys)
        text = ";".join("|".join(",".join(map(str, ids)) for ids in groups[g]) for g in range(len(common)))
        return {"n_a": len(x), "n_b": len(y), "n_groups": len(common), "n_links": sum(links.values()), "groups": text, "links": dict(links)}

    return aligned


def plain(row):
    return {k: row[k] for k in ("n_a", "n_b", "n_groups", "n_links", "groups")} | {"links": {(x["a"], x["b"]): x["n"] for x in row["links"]}}


def made_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_units_tokenise_as_the_whole(units, brute):
    texts = made_texts(4000, 1)
    for text, found in zip(texts, units.tokens(texts)):
        wanted = brute(text)
        assert (found is None) == (wanted["n_a"] == 0), repr(text)
        if found is not None:
            ids = "|".join(",".join(map(str, f.tolist())) for f in alignment.sides(found))
            of = [",".join(filter(None, (g.split("|")[k] for g in wanted["groups"].split(";")))) for k in (0, 1)]
            assert ids == "|".join(of), repr(text)


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_align(spark, brute, chunk):
    """The same rows in one go and from fragments of a few bytes, over several levels of the tree."""
    rng = random.Random(2)
    texts = [None, "", " ", "a", *made_texts(60, 3), "word " * 300, "x" * 500, " lead and trail ", "漢字" * 90, "tab\tin " * 40, "".join(rng.choice("ab ") for _ in range(900)), "ok " * 50 + "▁" + " ok" * 50]
    rows = [(k % 50 if k else None, t, "x") for k, t in enumerate(texts)] + [(7, texts[5], "x")]
    found = alignment.align(spark.createDataFrame(rows, "doc_id long, text string, n_a string"), *PATHS, chunk=chunk).collect()
    key = lambda r: repr(sorted((r | {"links": sorted(r["links"].items())}).items()))
    assert sorted((key(plain(r)) for r in found)) == sorted(key(brute(t)) for _, t, _ in rows)
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)


def test_fragments_are_a_monoid(units):
    """However the ranges are dealt and composed, the whole is the same."""
    rng, text = random.Random(5), "An unusual alignment: naïve café, 漢字, 12345 and hippopotamus. " * 4
    a, b = alignment.sides(units.tokens([text])[0])
    ends = [np.cumsum(sizes[ids]) for sizes, ids in zip((units.a_size, units.b_size), (a, b))]
    size = int(ends[0][-1])

    def part(low, high):
        return alignment.Fragment.of(units, *(x[(e > low) & (e <= high)] for ids, e in zip((a, b), ends) for x in (ids, e)))

    whole = part(0, size).closed(units).row()
    for _ in range(40):
        cuts = sorted({0, size, *(rng.randrange(size) for _ in range(rng.randint(1, 60)))})
        parts = [part(low, high) for low, high in zip(cuts, cuts[1:])]
        assert reduce(lambda x, y: x.then(y, units), parts).closed(units).row() == whole
        while len(parts) > 1:  # any order of composition
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k].then(parts[k + 1], units)]
        assert alignment.Fragment.read(parts[0].row()).closed(units).row() == whole


def test_large_groups_are_counted_by_distinct_ids(units):
    a, b = np.array([5, 5, 6] * 60, np.uint32), np.array([8, 9] * 70, np.uint32)
    group = alignment.Closed(a, b, np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), 1)
    _, pairs, times = group.pairs()
    assert len(a) * len(b) > alignment.PLAIN_LINKS and len(pairs) == 4 and times.sum() == len(a) * len(b)


def test_byte_ranges_cover_the_text_and_meet_at_cuts():
    text = "ab cdé  f " * 30 + "x" * 200 + " y" * 60 + "z  "
    whole, found = (" " + text).encode(), list(alignment.byte_ranges(text, 16))
    assert [f[0] for f in found] == [0, *(f[1] for f in found[:-1])] and found[-1][1] == len(whole)
    for low, high, begin, stretch in found:
        assert begin <= low and begin + len(stretch.encode()) >= high and stretch[0] == " "
        assert whole[begin : begin + len(stretch.encode())] == stretch.encode()
    assert sum(len(f[3]) for f in found) < 3 * len(whole)


def counted(rows, brute):
    """doc_id to what op12 returns, from all documents."""
    aligned = {i: brute(t) for i, t in rows}
    documents = Counter(p for r in aligned.values() for p in r["links"])
    best = defaultdict(int)
    for (a, _), n in documents.items():
        best[a] = max(best[a], n)
    for i, r in aligned.items():
        links, groups = r.pop("links"), r.pop("groups")
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        r |= {"doc_id": i, "groups_sha256": digest, "n_best": sum(n for p, n in links.items() if documents[p] == best[p[0]]), "count_sum": sum(documents[p] * n for p, n in links.items())}
    return aligned


def test_op12_over_the_smallest_table(spark, brute):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{TABLES}/documents.parquet'").fetchall()
    found = {r["doc_id"]: r.asDict() for r in QUERIES["op12_token_alignment"](spark, TABLES).collect()}
    assert found == counted([(i, t) for i, t in rows], lambda t: dict(brute(t)))


def test_counts_without_a_broadcast_of_all_pairs(spark):
    docs = spark.createDataFrame([(i, f"the word {'abc'[i % 3]}{i % 7} of") for i in range(40)] + [(99, "")], "doc_id long, text string")
    aligned = alignment.align(docs, *PATHS).cache()
    a, b = (sorted(map(tuple, alignment.with_counts(aligned, "doc_id", most).collect())) for most in (10**6, 0))
    assert a == b and len(a) == 40


def test_op12_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    aligned = alignment.align(docs, *PATHS)
    assert aligned.count() == 0 and alignment.with_counts(aligned, "doc_id").count() == 0
