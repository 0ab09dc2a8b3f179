"""The operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns; brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.llm import chat_tree, common, decontaminate, linking, ngram_join, packing, paragraph_dedup, pii, suffix_dedup, token_files, toxicity, vector_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, row long, node long, n long, t long, id long"
WORDS = ["".join(random.Random(i).choices("abcdefghij", k=6)) for i in range(400)]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = text(1, 120)
LONG = text(9, 9000)
TEXTS = {
    0: BASE, 1: BASE, 2: BASE.replace(BASE.split()[60], "changed"), 3: text(2, 90) + " " + BASE, 4: None, 5: "", 6: "  \n ", 7: "one two", 8: "one two", 9: LONG, 10: LONG + " end",
    11: text(3, 200), 12: "word " * 400, 13: "\n".join([text(4, 60), text(5, 70), text(6, 30)]), 14: "\n".join([text(7, 40), text(5, 70)]), 15: "é中\U0001f600 " * 200,
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, 3, 4, 5, 6) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, [*TEXTS.items(), (0, BASE), (None, BASE)])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [(1, "x")]).limit(0)


def test_components(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in common.components(pairs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 5: 5}


def test_two_stage():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, depth = int(rng.integers(1, 150)), int(rng.integers(8, 30))
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        order = suffix_dedup.two_stage(data, np.ones(n, bool), depth)
        padded = data.tobytes() + bytes(depth)
        assert sorted(order) == list(range(n))
        strings = [padded[i : i + depth] for i in order]
        assert strings == sorted(strings)


def covered(rows, length):
    """Per row, which bytes lie in a string of this length that starts at two places."""
    seen: dict = {}
    for _, b in rows:
        for i in range(len(b) - length + 1):
            seen[hash(b[i : i + length])] = seen.get(hash(b[i : i + length]), 0) + 1
    found = []
    for _, b in rows:
        gone = np.zeros(len(b), int)
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                gone[i : i + length] = 1
        found.append(gone)
    return found


@pytest.fixture(scope="module")
def contexts(spark):
    """A passage of 90 words that many texts hold, at all distances from either end, and some of these texts twice."""
    passage = text(60, 90)
    found = [(i, f"{text(100 + i, i % 7 * 9)} {passage} {text(300 + i, i % 5 * 11)}") for i in range(40)]
    return frame(spark, [*found, *((100 + i, t) for i, t in found[:4]), (200, passage[:380]), (201, passage[150:])])


@pytest.mark.parametrize("most", [2000, 1])
@pytest.mark.parametrize("table", ["docs", "contexts"])
def test_suffix_dedup(request, empty, table, most):
    """most=1: every minimiser of several segments is dealt out by longer anchors down to single strings."""
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    expected = []
    for (doc_id, b), gone, again in zip(rows, covered(rows, 400), covered(rows, 256)):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        expected.append((doc_id or -1, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest(), int(again.sum())))
    got = suffix_dedup.suffix_dedup(docs, most=most).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_repeated) for r in got) == sorted(expected)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_sorting_compares_bytes(monkeypatch):
    """Suffixes are sorted, and neighbours compared, by their bytes: equal hashes change nothing. All hashes of one length at once are those of one by one."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 99, n).astype(np.uint8).tobytes() * 2 for n in (40, 25, 60, 31)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.arange(200)
    sums = common.prefix_sums(data)
    assert (common.equal_hashes(sums, 64)[:200] == common.substring_hashes(sums, at, at + 64)).all() and len(common.equal_hashes(sums, 64)) == len(data) - 63
    monkeypatch.setattr(suffix_dedup, "substring_hashes", lambda sums, a, b: np.zeros(len(a), np.uint64))
    padded = data.tobytes() + bytes(40)
    strings = [padded[i : i + 40] for i in suffix_dedup.two_stage(data, np.ones(len(data), bool), 40)]
    assert strings == sorted(strings)
    runs = np.array([len(t) - 19 for t in texts])
    every = [t[i : i + 12] for t, n in zip(texts, runs) for i in range(n)]
    assert [f.tolist() for f, _ in suffix_dedup.repeated_in(texts, runs, 20, 12)] == [[every.count(t[i : i + 12]) > 1 for i in range(n)] for t, n in zip(texts, runs)]


def test_hashes_of_built_collisions():
    """Thue-Morse words and their complements collide under any base modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    words = [bytes(97 + (b ^ flip) for b in bits) for flip in (0, 1)]
    data = np.frombuffer(b" ".join(words) + b"\n", np.uint8)
    hashes, starts, ends, _ = common.word_hashes(data, np.array([0, len(data)]))
    assert len(hashes) == 2 and hashes[0] != hashes[1]
    again = common.word_hashes(np.frombuffer(b"xx " + words[0] + b"\n", np.uint8), np.array([0, 2052]))[0]
    assert again[1] == hashes[0]


def shingles(t):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def test_ngram_join(spark, docs, empty):
    r = random.Random(3)
    family = BASE.split()
    rows = []
    for i in range(100, 160):  # variants around the threshold
        words = list(family)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = f"new{r.randrange(40)}"
        rows.append((i, " ".join(words)))
    both = docs.union(frame(spark, rows))
    sets = {}
    for row in both.where("doc_id is not null").collect():
        sets[row.doc_id] = shingles(row.text)
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 75 * len(x | y) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_jaccard_join(both).where("doc_id is not null").collect()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}
    assert ngram_join.ngram_jaccard_join(both).count() == both.count()
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def test_paragraphs(docs, empty):
    found = paragraph_dedup.repeated_passages(docs).collect()
    shared = [(r.doc_id, r.line, r.remove) for r in found if r.words == 70]
    assert sorted(shared) == [(13, 1, False), (14, 1, True)]
    copies = {r.doc_id for r in found if r.words in (120,)}
    assert {None, 0, 1, 2} <= copies
    assert not {11, 7, 8, 15} & {r.doc_id for r in found}
    assert paragraph_dedup.repeated_passages(empty).count() == 0


def test_equal_lines_have_equal_hashes_wherever_they_stand():
    """Also late in long texts, where sums of hashes are beyond what a float holds; and parities never differ by more than sets do."""
    lines = [text(40 + i % 3, 12) for i in range(60)]
    batch = paragraph_dedup.pd.DataFrame({"doc_id": [1, 2], "row": [1, 2], "text": ["\n".join(lines), text(9, 30) + "\n" + "\n".join(lines[:7])]})
    units = paragraph_dedup.pd.concat(list(paragraph_dedup._units(5, 50, 9)(iter([batch]))))
    found = units[units["p2"].notna()]
    assert len(found) == 68 and len(found[["p1", "p2"]].drop_duplicates()) == 4 and found["p1"].nunique() == 4
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 1 << 60, 100)[: rng.integers(1, 100)]) for _ in range(2))
        y = np.union1d(y, x[: len(x) // 2])
        differ = sum(int(a ^ b).bit_count() for a, b in zip(linking.parities(x).view(np.uint64), linking.parities(y).view(np.uint64)))
        assert differ <= len(np.setxor1d(x, y)) and (differ - len(np.setxor1d(x, y))) % 2 == 0


def test_passages_without_lines(spark):
    """Short lines, and passages inside long lines, over other line breaks and over short lines: words by brute force."""
    short, shared = text(70, 8), text(71, 60)
    words = shared.split()
    broken = "\n".join(" ".join(words[i : i + 4]) for i in range(0, 60, 4))
    rows = [(1, text(72, 40) + "\n" + short), (2, short + "\n" + text(73, 30)), (3, text(74, 900) + " " + shared + " " + text(75, 900)), (4, text(76, 30) + "\n" + broken), (5, text(77, 20) + " " + shared.upper() + "\n" + text(78, 20))]
    found = paragraph_dedup.repeated_passages(frame(spark, rows)).collect()
    got = sorted((r.doc_id, r.line, r.words, r.places, r.remove) for r in found)
    assert got == [(1, 1, 8, 2, False), (2, 0, 8, 2, True), (3, 0, 60, 3, False), (4, 1, 60, 3, True), (5, 0, 60, 3, True)]
    cut = {r.doc_id: dict(rows)[r.doc_id].encode()[r.start : r.stop].decode().lower().split() for r in found}
    assert cut == {1: short.split(), 2: short.split(), 3: words, 4: words, 5: words} and len({r.passage_id for r in found}) == 2


@pytest.mark.parametrize("shared_id", [1, None])
def test_texts_under_one_id(spark, shared_id):
    """Different texts that share an id (or have none) keep their own links."""
    one, other = text(60, 90), text(61, 50)
    rows = frame(spark, [(shared_id, one), (shared_id, other), (shared_id, text(62, 8)), (20, one + " end"), (30, other + " end")])
    found = paragraph_dedup.repeated_passages(rows).collect()
    assert sorted((r.doc_id or 0, r.words) for r in found if r.words > 45) == sorted([(shared_id or 0, 90), (shared_id or 0, 50), (20, 91), (30, 51)])
    assert {r.doc_id for r in found if r.remove} == {20, 30} and len({r.passage_id for r in found if r.words > 45}) == 2
    joined = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.ngram_jaccard_join(rows).collect()}
    first = {86: shared_id or 20, 46: shared_id or 30}
    assert joined[20, 87] == first[86] and joined[30, 47] == first[46] and joined[shared_id, 86] == first[86] and joined[shared_id, 46] == first[46] and joined[shared_id, 4] == shared_id


def test_decontamination(spark, docs, empty):
    item = "Yesterday Tom gave 12 apples and 3 pears to the old man at the gate, and Tom kept 5 kg of flour for the winter days ahead."
    other = item.replace("Tom", "Ann").replace("12", "40").replace("3 pears", "9 pears").replace("5 kg", "8 lb")
    mixed = item.replace("and Tom kept", "and Bob kept")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item)], "item_id long, text string")
    more = frame(spark, [(50, "Before. " + item + " After."), (51, "Well now: " + other), (52, mixed), (53, item.upper())])
    rows = decontaminate.contaminated(docs.union(more), bench).collect()
    assert {r.doc_id for r in rows} >= {50, 51} and not {r.doc_id for r in rows} & set(TEXTS)
    # Over the whole item Tom must stand for one name: the mixed one is rejected, the consistent one is not.
    whole = decontaminate.contaminated(docs.union(more), bench, window=26)
    assert {r.doc_id for r in whole.collect()} >= {50, 51} and 52 not in {r.doc_id for r in whole.collect()}
    far = decontaminate.contaminated(docs.union(more), bench, broadcast=0)
    assert {(r.doc_id, r.item_id, r.matched) for r in rows} == {(r.doc_id, r.item_id, r.matched) for r in far.collect()}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert not decontaminate.slots_agree(["Tom", "", "Tom"], ["Ann", "", "Bob"]) and not decontaminate.slots_agree(["1", "2"], ["3", "3"])


def test_decontamination_brute_force(spark):
    """All pairs of windows; literal-poor windows only with equal values."""
    r = random.Random(8)
    names, units = ["Tom", "Ann", "Bob", "Eve"], ["kg", "miles", "dollars"]

    def sentence(n):
        parts = [r.choice([r.choice(WORDS[:12]), str(r.randint(1, 30)), f"{r.randint(1, 9)} {r.choice(units)}", f"and {r.choice(names)}"]) for _ in range(n)]
        return "so " + " ".join(parts)

    items = [sentence(16) for _ in range(12)] + ["so and Tom 1 2 3 4 5 6 7 8 9 10 11 12 13 14", "1 2 3 4 5 6 7 8 9 10 11 12 13", "5 kg"]
    change = lambda s: " ".join(str(int(w) + 1) if w.isdigit() else {"Tom": "Ann", "Ann": "Bob", "Bob": "Tom"}.get(w, w) for w in s.split())
    texts = [f"{sentence(5)} {i} {sentence(6)}" for i in items] + [f"{sentence(5)} {change(i)}" for i in items] + [sentence(30) for _ in range(20)] + ["x 5 kg y", "x 6 kg y"]

    def cut(text, size):
        tokens, values = decontaminate.template(text)
        n = min(size, len(tokens))
        return [(tuple(tokens[k : k + n]), values[k : k + n]) for k in range(len(tokens) - n + 1)] if n else []

    wanted = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            own, matched = cut(item, 12), 0
            theirs = cut(text, len(own[0][0]))
            for tokens, values in own:
                poor = values.count("") < max(1, len(values) // 3)
                matched += any(t == tokens and (v == values if poor else decontaminate.slots_agree(values, v)) for t, v in theirs)
            if matched >= min(2, len(own)):
                wanted.add((d, i, matched))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for broadcast in (64_000_000, 0):
        found = decontaminate.contaminated(frame(spark, list(enumerate(texts))), bench, broadcast=broadcast).collect()
        assert {(x.doc_id, x.item_id, x.matched) for x in found} == wanted
    assert {13, 14} <= {i for _, i, _ in wanted} and (len(texts) - 1, 14, 1) not in wanted


def test_packing(docs, empty):
    rows = packing.pack(docs, longest=100, buckets=4, budget=500, lane=10).collect()
    total = sum(len((r.text or "").split()) for r in docs.collect())
    assert sum(r.n_words for r in rows) == total and all(r.n_words <= r.bucket for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket, r.lane, r.batch), []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) and len(s) * max(k[0], 1) <= max(500, k[0]) for k, s in batches.items())
    assert packing.pack(empty).count() == 0
    counts = np.zeros(13, int)
    counts[[1, 2, 5, 9, 12]] = [3, 1, 4, 2, 1]
    cost = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in enumerate(counts) if c)
    from itertools import combinations

    best = min(cost((*c, 12)) for c in combinations([1, 2, 5, 9], 2))
    assert cost(packing.optimal_bounds(counts, 3)) == best


def test_toxicity(spark, docs, empty):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(1000, 1400):
        words = [r.choice(WORDS) for _ in range(60)]
        if i % 5 == 0:
            words[10:12] = r.sample(["zzfoulx", "zzfouly", "zzfoulz"], 2) if i % 10 else ["idiot", "moron"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    known = spark.createDataFrame([*labels, (None, 1, 1), (1001, 1, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(frame(spark, rows).union(docs), known).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and np.mean([got[i].predicted == int(i % 5 == 0) for i in held]) > 0.97
    assert all(0 <= x.score <= 1 for x in got.values()) and not any(got[i].predicted for i in TEXTS)
    assert toxicity.score_toxicity(empty, known.limit(0)).count() == 0
    assert toxicity.score_toxicity(docs, known.limit(0)).count() == docs.count()


def test_token_files(spark, docs, empty, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    extra = frame(spark, [(60, "O'Neil's don't İ ΣΑΣ, x\tyé <|endoftext|> 12.5 naïve, a..b")])
    token_files.write_token_files(docs.union(extra), str(tmp_path / "f"), path, 2)
    rows = token_files.read_token_files(spark, str(tmp_path / "f")).orderBy("start").collect()
    one = Tokenizer.from_file(path)
    wanted = {r.doc_id: [*one.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.union(extra).collect()}
    at = 0
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and ids == wanted[r.doc_id]
        at += len(ids)
    assert [r.doc_id for r in rows] == [None, 0, 0, *range(1, 16), 60]
    token_files.write_token_files(empty, str(tmp_path / "e"), path, 2)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, 7], np.uint32)
    assert token_files.unpack(*token_files.pack(ranks), len(ranks)).tolist() == ranks.tolist()


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, found):
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii(spark, docs, empty):
    samples = ["a@b.c_d@e.f.g x@y", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.4", "4111 1111-1111 1111 and 4111111111111112", "+1 (017) 555-7713 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "\U0001f600é me@x.org \U0001f600 10.0.0.1", "9" * 3000, "a" * 5000 + "@", "1.2.3.4@5.6.7.8"]
    rows = frame(spark, [*enumerate(samples, 100)]).union(docs)
    found = {r.id: r for r in pii.find_pii(rows.where("doc_id is not null")).select(F.col("doc_id").alias("id"), pii.joined(F.col("base")).alias("base"), pii.joined(F.col("spans")).alias("spans")).collect()}
    for row in rows.where("doc_id is not null").collect():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, row.text or "") if holds(k, m[0])]
        assert found[row.doc_id].base == ",".join(spans)
        assert found[row.doc_id].spans.startswith(found[row.doc_id].base)
    assert pii.find_pii(rows).count() == rows.count() and pii.find_pii(empty).count() == 0
    # A context that introduces seeds introduces an identifier of the same shape that no pattern takes.
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220", "4000056655665556"]
    lines = [(i, f"note number {i} my bank card {cards[i % 6][:12]}{cards[i % 6][12:]} thanks") for i in range(6)] + [(90, "pay by my bank card 4111111111111112 today")]
    learned = {r.doc_id: r.s for r in pii.find_pii(frame(spark, lines), support=4, confidence=0.7).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()}
    assert learned[90] == "context:20:36" and all("context" not in s for i, s in learned.items() if i != 90)
    # As many seeds as the support of the defaults; long words before, the start of a text, and clashing columns.
    cards = [c for n in range(4000000000000000, 4000000000000300) for c in [str(n)] if holds("card", c)][:10]
    lines = [*((i, f"{'x' * 90} {c}") for i, c in enumerate(cards)), (90, f"{'x' * 90} 4111111111111112"), (91, f"y {'x' * 90} 4111111111111112")]
    rows = frame(spark, lines).withColumns({"spans": F.lit(1), "base": F.lit(2)})
    learned = {r.doc_id: [(s.kind, s.start) for s in r.spans] for r in pii.find_pii(rows, keep_text=True).where("row = 2 and key = 1").collect()}
    assert learned[90] == [("context", 91)] and learned[91] == [] and all(learned[i] == [("card", 91)] for i in range(10))
    many = " ".join(f"me{i}@x.org" for i in range(1000))
    placed = pii.find_pii(frame(spark, [(1, many)])).first().base
    assert [(s.start, s.stop) for s in placed] == [m.span() for m in re.finditer(r"\S+", many)]
    masked = pii.find_pii(frame(spark, [(1, "to me@x.org now"), (2, None)]), keep_text=True).select("doc_id", pii.mask(F.col("text"), F.col("spans")).alias("m")).orderBy("doc_id").collect()
    assert [r.m for r in masked] == ["to <email> now", None]


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", said), (2, 0, "user", "hi"), (2, 1, "assistant", None), (2, 2, "assistant", "<\\>"), (3, None, None, ""), (None, 0, "user", "x"), (4, 0, "user", "hi"), (4, 0, "user", "hi")]
    frame_ = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, shard long")
    for most in (500, 1):
        sequences = chat_tree.format_chats(frame_, most=most)
        got = {r.conv_id: r for r in chat_tree.read_chats(sequences).collect()}
        assert set(got) == {1, 2, 3, 4, None}
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[1].turns_sha256 == digest(f"user\nhi\nassistant\n{said}\n") and got[1].loss_sha256 == digest(said) and got[1].loss_chars == len(said)
        assert got[2].turns_sha256 == digest("user\nhi\nassistant\n\nassistant\n<\\>\n") and got[2].loss_chars == 3 and got[4].n_turns == 2 and got[3].n_turns == 1
    # However many share it, and however deep, a shared turn is written once.
    many = [(i, k, "user", t) for i in range(60) for k, t in enumerate(["hot", "warm", "same" if i < 20 else f"own {i}", f"end {i % 30}"][: 2 if i >= 50 else 4])]
    hot = spark.createDataFrame([(*r, 7) for r in many], frame_.schema)
    sequences = chat_tree.format_chats(hot, most=8).collect()
    everything = "".join(r.text for r in sequences)
    assert all(everything.count(f">{t}<") == 1 for t in ("hot", "warm", "same", "own 30")) and max(len(r.leaves) for r in sequences) <= 8
    digests = {r.conv_id: r.turns_sha256 for r in chat_tree.read_chats(chat_tree.format_chats(hot, most=8)).collect()}
    assert digests == {i: digest("".join(f"user\n{t}\n" for j, _, _, t in many if j == i)) for i in range(60)}
    begins = {r.sequence: (r.nodes[0].position, len(r.text)) for r in sequences if r.nodes}
    assert all(r.nodes[0].position == sum(begins[k][1] for k in r.path) for r in sequences if r.nodes)
    long = spark.createDataFrame([(1, k, "user", "x", 7) for k in range(3000)], frame_.schema)
    assert max(len(n.attends) for n in chat_tree.format_chats(long).first().nodes) == 1
    one = [r for r in chat_tree.format_chats(frame_).collect() if "hi" in r.text]
    assert len(one) == 1 and one[0].text.count("<turn user>hi</turn>") == 2  # the shared start once, and the second turn of 4
    for n in one[0].nodes:
        assert n.position == sum(b - a for a, b in n.attends)
    assert chat_tree.format_chats(frame_.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat_tree.parse("x")


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 20)).astype(np.float32)
    x[7] = x[5]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(9001, None, 1), (9002, [0.0] * 20, 1), (9003, [float("nan")] * 20, 1), (9004, [1.0, None] * 10, 1), (None, [1.0] * 20, 1), (5, x[5].tolist(), 1)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, id int")
    got = vector_search.nearest_neighbours(table, table.where("vec_id % 20 = 0 or vec_id in (5, 9001)"), sample=2000, block=40).collect()
    hits = total = 0
    for q in {r.query_id for r in got}:
        distance = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        distance[q] = np.inf
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(abs(distance[r.vec_id] - r.score) < 1e-9 for r in own)
        hits += len(set(np.lexsort((np.arange(len(x)), distance))[:10]) & {r.vec_id for r in own})
        total += 10
    assert hits / total >= 0.9 and 9001 not in {r.query_id for r in got}
    assert next(r.vec_id for r in got if r.query_id == 5 and r.rank == 1) == 7
    few = table.where("vec_id < 4")
    assert vector_search.nearest_neighbours(few, few).count() == 12
    assert vector_search.nearest_neighbours(few.limit(0), few.limit(0)).count() == 0


def test_nearest_neighbours_of_equal_vectors_and_uneven_norms(spark):
    """Ties go to smaller ids though more rows tie than are reranked; norms of all sizes are met alike."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= rng.lognormal(sigma=1.5, size=(3000, 1))
    x[::2] = x[0]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(5)
    asked = [5, 100, 1001, 2500, 2999]
    found = {}
    for r in vector_search.nearest_neighbours(table, table.where(F.col("vec_id").isin(asked)), sample=1000).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hits = 0
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10].tolist()
        if q % 2 == 0:
            assert [found[q][k] for k in range(1, 11)] == best
        hits += len({*found[q].values()} & {*best})
    assert hits >= 47


@pytest.mark.parametrize("size", [1.0, 1e200])
def test_nearest_neighbours_are_those_of_all_pairs(spark, size):
    """However many rows have nearly the same vector, and so the same codes; also where squares overflow."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2400, 16))
    x[::2] = x[0] + 1e-3 * rng.normal(size=(1200, 16))
    x[1:900:2] += 50
    x[:6] *= size
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(5)
    got = vector_search.nearest_neighbours(table, table.where("vec_id % 100 = 0 or vec_id = 3"), sample=1000, rerank=50, block=10).collect()
    asked = [3, *range(0, 2400, 100)]
    assert {r["query_id"] for r in got} == {*asked} and len(got) == 10 * len(asked)
    for q in asked:
        with np.errstate(over="ignore"):
            d = np.sqrt(sum((x[:, j] - x[q, j]) ** 2 for j in range(16)))
        best = [(int(i), float(d[i])) for i in np.lexsort((np.arange(2400), d)) if i != q][:10]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == best


def test_seeds_of_long_texts_are_those_of_short_ones(spark, monkeypatch):
    """Marked in one order of mentions and finds, as by looking at all pairs; tens of thousands of finds in one text are no trouble."""
    rng = random.Random(12)
    pieces = ["a@b.org", "call", "+49 171 2345678", "id", "99123455", "4111 1111 1111 1111", "x9999y", "10.1.2.3", "user@", "1234-5678", "and", "\n"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], None])], "doc_id long, text string")
    looked = docs.select(F.xxhash64("doc_id", "text").alias("row"), pii.base_spans(F.coalesce("text", F.lit(""))).alias("base"), pii._mentions(F.coalesce("text", F.lit(""))).alias("mentions"))
    rows = lambda: sorted((r["row"], r["t"]["start"], r["seed"]) for r in pii.with_seeds(looked).collect())
    plain = rows()
    monkeypatch.setattr(pii, "PAIRS", -1)
    assert rows() == plain and {s for _, _, s in plain} == {True, False}
    monkeypatch.undo()
    long = " ".join(f"mail u{k}@h{k % 97}.org now" for k in range(20_000)) + " mail badge@night"
    found = pii.find_pii(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert len(found["base"]) == 20_000 and [(s["kind"], s["stop"]) for s in found["spans"][20_000:]] in ([], [("context", len(long))])


def test_packing_by_token_counts(spark):
    """Lengths from a column: the same words, other pieces; a null counts as none."""
    docs = spark.createDataFrame([(1, "a b", 250), (2, "a b", 7), (3, None, None), (4, "a b c", -1)], "doc_id long, text string, n_tokens long")
    rows = packing.pack(docs, longest=100, buckets=3, budget=200, length_col="n_tokens").collect()
    assert sorted((r["doc_id"], r["piece"], r["n_words"]) for r in rows) == [(1, 0, 100), (1, 1, 100), (1, 2, 50), (2, 0, 7), (3, 0, 0), (4, 0, 0)]
    assert all(r["n_words"] <= r["bucket"] for r in rows)
