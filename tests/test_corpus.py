"""A small corpus end to end: XML to tables, diffs, graph, rulings, raw zone, stream."""

import time
from datetime import date

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronolex import schemas
from chronolex.functions import tree
from chronolex.operators import graph, retrieval, risk
from chronolex.operators import versions as V
from chronolex.operators.text_index import TrigramIndex
from chronolex.plans import corpus
from chronolex.sources import law_xml, raw_zone
from chronolex.sources.keyed_table import KeyedTable
from chronolex.streaming.ingest import ingest_stream


def snapshot(mst, day, clause, extra=""):
    return f"""<법령><기본정보><법령ID>001</법령ID><법령명_한글><![CDATA[소득세법]]></법령명_한글><법종구분 법종구분코드="A">법률</법종구분><소관부처 소관부처코드="105">부</소관부처>
<공포일자>{day}</공포일자><공포번호>00077</공포번호><시행일자>{day}</시행일자></기본정보><조문><조문단위 조문키="0"><조문번호>1</조문번호><조문여부>전문</조문여부><조문내용>제1장 총칙 &lt;개정 2020&gt;</조문내용></조문단위>
<조문단위 조문키="1"><조문번호>1</조문번호><조문여부>조문</조문여부><조문제목>정의</조문제목><조문내용>"국세"란 세금</조문내용><조문시행일자>{day}</조문시행일자><항><항번호>①</항번호><항내용><![CDATA[{clause}]]></항내용>
<호><호번호>1.</호번호><호내용>가호</호내용><목><목번호>가.</목번호><목내용>가목</목내용></목></호></항></조문단위>
<조문단위 조문키="2"><조문번호>2</조문번호><조문가지번호>3</조문가지번호><조문여부>조문</조문여부><조문내용>날짜 없음</조문내용></조문단위>{extra}</조문>
<부칙><부칙단위 부칙키="9"><부칙공포번호>77</부칙공포번호><부칙내용>①(시행일) 2020년 1월 1일부터 ②(동전) 나</부칙내용></부칙단위></부칙></법령>"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    (folder / "11.xml").write_text(snapshot("11", "20210101", "100분의 30 이상"), encoding="utf-8")
    (folder / "10.xml").write_text(snapshot("10", "20200101", "없음"), encoding="utf-8")
    docs = raw_zone.read_documents(spark, str(folder))
    shots = law_xml.snapshots(docs).withColumn("seq", F.when(F.col("mst") == "11", 0).otherwise(1)).withColumn("is_current", F.col("mst") == "11")
    return shots, corpus.ingest_statutes(shots), folder


def test_ingest(tables):
    shots, t, _ = tables
    s = t["statute"].first()
    assert (s.statute_id, s.name, s.law_type, s.ministry_code, s.current_mst, s.enforced_on) == (1, "소득세법", "법률", "105", "11", date(2021, 1, 1))
    assert [(r.art_no, r.branch_no, r.chapter_title) for r in t["article"].collect()] == [(1, 0, "제1장 총칙")]
    rows = t["article_version"].orderBy("valid_from").collect()
    assert [(r.valid_from, r.valid_to, r.moleg_article_key, r.promulgation_no) for r in rows] == [(date(2020, 1, 1), date(2021, 1, 1), "10:1", 77), (date(2021, 1, 1), None, "11:1", 77)]
    assert rows[0].tree.clauses[0].sub_clauses[0].items[0].text == "가목"
    added = corpus.ingest_addenda(shots).collect()
    assert sorted((a.clause_no, a.kind, a.applies_from) for a in added) == [("1", "시행일", date(2020, 1, 1)), ("2", "시행일", None)]
    V.require_empty(V.overlaps(t["article_version"]), "overlap")
    with pytest.raises(ValueError):
        V.require_empty(t["statute"], "any")


def test_diffs_and_chunks(spark, tables):
    _, t, _ = tables
    d = corpus.build_diffs(t["article_version"])
    row = d.first()
    assert row.diff.changed["제1항"]["to"] == "100분의 30 이상" and not row.diff.added and not row.diff.removed
    assert [(x.kind, x.value) for x in row.added_thresholds] == [("ratio", 30.0)]
    assert corpus.build_diffs(t["article_version"], d).count() == 0
    assert corpus.find_thresholds(d, t["article_version"]).count() == 1
    chunks = corpus.embedding_chunks(t["article_version"]).collect()
    assert [(c.chunk_path, c.text) for c in chunks] == [("제1항", "100분의 30 이상\n가호\n가목")]
    twice = spark.sql("select array(named_struct('key', 'a', 'value', '1'), named_struct('key', 'b', 'value', '2'), named_struct('key', 'a', 'value', '3')) as e")
    assert list(twice.select(tree.as_map(F.col("e"))).first()[0].items()) == [("a", "3"), ("b", "2")]


def test_delegations_and_graph(spark, tables):
    _, t, _ = tables
    xml = """<x><위임조문정보><조정보><조문번호>1</조문번호><조문제목>준용 규정</조문제목></조정보><위임정보><위임법령제목>앞</위임법령제목><위임구분>인용법령</위임구분><위임법령일련번호>11</위임법령일련번호>
<위임법령제목><![CDATA[가 & 나]]></위임법령제목><위임법령조문정보><조항호목>①</조항호목><위임법령조문번호>1</위임법령조문번호></위임법령조문정보><위임구분>행정규칙</위임구분><위임법령조문정보/></위임정보></위임조문정보></x>"""
    edges = law_xml.delegations(spark.createDataFrame([("11", xml)], "key string, xml string"))
    e = edges.collect()
    assert [(x.source_art_no, x.edge_type, x.target_law_mst, x.target_law_title, x.target_art_no, x.source_johang) for x in e] == [(1, "MUTATIS", "11", "가 & 나", 1, "①")]
    assert graph.reference_edges(edges, t["statute"], t["article"]).count() == 1
    assert [r.term for r in graph.defines_edges(t["article_version"]).collect()] == ["국세"]
    assert graph.supersedes_edges(t["article_version"]).count() == 1


def test_graph_job(spark, tables, tmp_path):
    _, t, _ = tables
    xml = "<x><위임조문정보><조정보><조문번호>1</조문번호></조정보><위임정보><위임구분>인용법령</위임구분><위임법령일련번호>11</위임법령일련번호><위임법령조문정보><위임법령조문번호>1</위임법령조문번호></위임법령조문정보></위임정보></위임조문정보></x>"
    delegations = law_xml.delegations(spark.createDataFrame([("11", xml)], "key string, xml string"))
    ruling = spark.createDataFrame([("r", [t["article"].first().article_id, 5])], "ruling_id string, cited_article_ids array<long>")
    patterns = spark.createDataFrame([("P1", "n", "d"), ("P1", "n", "d")], "code string, name string, description string")
    for _ in range(2):  # a second run replaces the first
        found = corpus.build_graph(t["statute"], t["article"], t["article_version"], ruling, delegations, patterns, str(tmp_path / "graph"))
    assert {k: v.count() for k, v in found.items()} == {"PATTERN": 1, "DELEGATES_TO": 0, "HAS_VERSION": 2, "SUPERSEDES": 1, "REFERENCES": 1, "DEFINES": 1, "CITES": 1}


def test_diff_of_any_pair(spark, tables):
    _, t, _ = tables
    version = t["article_version"].withColumn("revision_reason", F.lit(""))
    first, last = (r.article_key for r in version.orderBy("valid_from").collect())
    stored = corpus.build_diffs(version).withColumns({"reason_text": F.lit("kept"), "reason_source": F.lit("s")})
    pairs = spark.createDataFrame([(first, last), (last, first)], "from_version long, to_version long")
    rows = {r.from_version: r for r in corpus.diff_articles(pairs, stored, version).collect()}
    assert rows[first].reason_text == "kept" and rows[last].reason_text is None and rows[last].reason_source is None
    assert rows[last].diff.changed["제1항"]["from"] == "100분의 30 이상" and rows[last].added_thresholds == []
    with pytest.raises(Exception, match="unknown article key"):
        corpus.diff_articles(spark.createDataFrame([(first, 7)], "from_version long, to_version long"), stored, version).collect()


def test_keys_of_neighbours_are_found_without_their_trees(spark, tables, tmp_path):
    # diff_articles reads the keys of stored diffs beside the diffs: that must not work these out once more.
    _, t, _ = tables
    t["article_version"].write.parquet(str(tmp_path / "versions"))
    keys = corpus.build_diffs(spark.read.parquet(str(tmp_path / "versions"))).select("from_version", "to_version")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "article_key" in plan and "tree" not in plan and "clauses" not in plan
    assert keys.count() == 1


def test_large_trees_take_time_in_line_with_their_size(spark):
    # Every number stands twice, and the second text counts; one text is changed, one goes, one is null and one more comes.
    n = 10_000
    clause = "named_struct('no', cast(i % {n} as string), 'text', if(i < {n}, 'first', concat('t', i)), 'sub_clauses', cast(array() as array<{kind}>))"
    clauses = F.expr(f"transform(sequence(0, {2 * n - 1}), i -> {clause.format(n=n, kind=schemas.SUB_CLAUSE)})")
    began = time.monotonic()
    old = spark.range(1).select(tree.flatten_tree(clauses).alias("m")).select("m", F.map_from_entries(F.expr("filter(map_entries(m), e -> e.key <> '제7항')")).alias("less"))
    new = F.map_concat(F.transform_values("less", lambda k, v: F.when(k == "제5항", "new").when(k != "제6항", v)), F.create_map(F.lit("more"), F.lit(None).cast("string")))
    row = old.select(F.map_entries("m").alias("m"), tree.diff(F.col("m"), new).alias("d")).first()
    assert time.monotonic() - began < 60
    assert row.m == [(f"제{i}항", f"t{n + i}") for i in range(n)]
    assert row.d.added == {"more": None} and row.d.removed == {"제7항": f"t{n + 7}"}
    assert {k: tuple(v) for k, v in row.d.changed.items()} == {"제5항": (f"t{n + 5}", "new"), "제6항": (f"t{n + 6}", None)}


def test_readers_of_a_text_index_decode_few_shards_at_once(spark, tmp_path):
    # Spark's reader decodes a row group whole: of a file's shards, only a few may be in one.
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.sha2(F.concat_ws("-", "id", i).cast("string"), 256)), "")
    texts = spark.range(20_000).select(F.col("id").alias("chunk_id"), text.alias("text"))
    index = TrigramIndex.build(texts, str(tmp_path / "index"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "index" / "shards").glob("*.parquet")]
    assert max(m.num_rows for m in files) > 4
    assert max(m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)) <= 4
    asked = texts.where("chunk_id in (5, 11000)").withColumnRenamed("chunk_id", "query_id")
    assert sorted((r.query_id, r.chunk_id) for r in index.hits(asked, 0.9).collect()) == [(5, 5), (11000, 11000)]


def test_small_jobs(spark, tables):
    _, t, _ = tables
    row = corpus.embed(corpus.embedding_chunks(t["article_version"]), lambda: lambda texts: [[len(x)] for x in texts], 1).first()
    assert row.embedding == [float(len(row.text))] and row.is_current
    statute = spark.createDataFrame([(1, "소득세법", ["소법", "소득세법"]), (2, None, None)], "statute_id long, name string, abbreviations array<string>")
    assert {r.name for r in corpus.law_names(statute).collect()} == {"소득세법", "소법", "조특법", "국기법"}
    article = spark.createDataFrame([(7, 1, 3, 0), (8, 1, 4, 2)], "article_id long, statute_id long, art_no int, branch_no int")
    rows = spark.createDataFrame([("소득세법", 3, 0, 4, 2, "b"), ("소득세법", 3, 0, 4, 2, "a"), ("소득세법", 3, 0, 9, 0, "")], "statute_name string, from_art_no int, from_branch_no int, to_art_no int, to_branch_no int, note string")
    new, unknown = corpus.load_rewrite_map(rows, statute, article)
    assert [tuple(r) for r in new.collect()] == [(7, 8, "a")] and unknown.count() == 1
    assert corpus.load_rewrite_map(rows, statute, article, new)[0].count() == 0


def test_embedding_backfill(spark, tmp_path):
    """The model is loaded once in a task and gets like lengths together; a run that dies goes on where it was; closed versions expire."""
    clause = lambda t: [(None, t, [])]
    kind = "article_key long, valid_to date, tree struct<clauses: array<struct<no: string, text: string, sub_clauses: array<struct<no: string, text: string, items: array<struct<no: string, text: string>>>>>>>"
    rows = [(k, None, (clause("x" * (1 + k * 7 % 90)),)) for k in range(120)]
    version = spark.createDataFrame(rows, kind).coalesce(2)
    store, log = corpus.embedding_store(spark, str(tmp_path / "e"), buckets=4), tmp_path / "log"
    log.mkdir()

    def load(broken=False):
        import uuid

        def model(texts):
            (log / uuid.uuid4().hex).write_text(f"{max(map(len, texts)) - min(map(len, texts))}")
            if broken and any(len(t) == 89 for t in texts):
                raise RuntimeError("out of memory")
            return np.array([[len(t), 1.0] for t in texts])

        (log / f"load-{uuid.uuid4().hex}").write_text("")
        return model

    with pytest.raises(Exception, match="out of memory"):
        corpus.embed_backfill(version, store, lambda: load(True), 2, turns=12, batch=8)
    done = {r.article_key for r in store.read().collect()}
    assert 0 < len(done) < 120
    for f in log.iterdir():
        f.unlink()
    corpus.embed_backfill(version, store, load, 2, turns=1, batch=8)
    spans, loads = [int(f.read_text()) for f in log.iterdir() if f.stem[:5] != "load-"], [f for f in log.iterdir() if f.stem[:5] == "load-"]
    assert len(loads) <= 2 and len(spans) == pytest.approx((120 - len(done)) / 8, abs=2) and max(spans) < 40  # nothing is made twice
    assert {r.article_key: (r.embedding, r.is_current) for r in store.read().collect()} == {k: ([float(1 + k * 7 % 90), 1.0], True) for k in range(120)}
    closed = version.withColumn("valid_to", F.when(F.col("article_key") == 5, F.lit(date(2020, 1, 1))))
    corpus.embed_backfill(closed, store, load, 2)
    assert [r.article_key for r in store.read().where("not is_current").collect()] == [5] and store.read().count() == 120
    with pytest.raises(Exception, match="vectors of 3"):
        corpus.embed(corpus.embedding_chunks(version), load, 3).collect()


def test_keyword_search_brute_force(spark):
    """Every pair at every threshold, at rounding's edge too."""
    import random

    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcd", k=r.randint(1, 5))) for _ in range(r.randint(0, 6))) for _ in range(120)]
    grams = lambda s: {f"  {w} "[i : i + 3] for w in s.split() for i in range(len(w) + 1)}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for threshold in (0.3, 0.5, 1.0):
        found = retrieval.keyword_search(rows.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "chunk_id"), top=1000, threshold=threshold).collect()
        sets = [grams(t) for t in texts]
        wanted = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and len(a & b) / len(a | b) >= threshold}
        assert {(x.query_id, x.chunk_id) for x in found} == wanted


def test_text_index(spark, tmp_path):
    """One index for many searches: in blocks, of small shards, restricted to some chunks, with odd texts; rows as by brute force."""
    import random
    import re

    from chronolex.operators.text_index import TrigramIndex

    r = random.Random(8)
    texts = [None, "", "  .,;", "a", "É ü_x 漢字", "same words here", "same words here", *(" ".join("".join(r.choices("abcde", k=r.randint(1, 6))) for _ in range(r.choice([1, 3, 8, 60]))) for _ in range(200))]
    words = lambda t: [w for w in re.findall(r"[^\W_]+", (t or "").lower())]
    sets = [{f"  {w} "[i : i + 3] for w in words(t) for i in range(len(w) + 1)} for t in texts]
    score = lambda a, b: len(a & b) / len(a | b)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    queries, chunks = rows.where("id % 3 = 0 or id < 9").withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "chunk_id")
    index = TrigramIndex.build(chunks, str(tmp_path / "index"))
    asked = [i for i in range(len(texts)) if (i % 3 == 0 or i < 9) and sets[i]]
    for threshold in (0.1, 0.3, 2 / 3, 1.0):
        wanted = {(i, j): score(sets[i], b) for i in asked for j, b in enumerate(sets) if b and score(sets[i], b) >= threshold}
        for block in (1000, 7):
            found = {(x.query_id, x.chunk_id): x.score for x in index.hits(queries, threshold, block=block).collect()}
            assert found == pytest.approx(wanted)
    some = chunks.where("chunk_id % 2 = 1")
    best = lambda i: sorted((j for j, b in enumerate(sets) if j % 2 and b and score(sets[i], b) >= 0.3), key=lambda j: (-score(sets[i], sets[j]), j))[:4]
    ranked = {(x.query_id, x.rank): x.chunk_id for x in retrieval.keyword_search(queries, some, top=4, index=TrigramIndex(spark, str(tmp_path / "index"))).collect()}
    assert ranked == {(i, k + 1): j for i in asked for k, j in enumerate(best(i))}
    assert {(x.query_id, x.rank): x.chunk_id for x in retrieval.keyword_search(queries, some, top=4).collect()} == ranked
    none = TrigramIndex.build(chunks.limit(0))
    assert none.hits(queries).count() == 0 and index.hits(queries.limit(0)).count() == 0
    with pytest.raises(ValueError):
        index.hits(queries, 0.0)


@pytest.mark.parametrize("counted", [50, 3000, 1 << 21])
def test_shard_counts_in_turns(monkeypatch, counted):
    """Queries of one shard in many turns or in one, with trigrams that the shard lacks; rare trigrams first, in any order of rarity."""
    import random

    import pyarrow as pa

    from chronolex.operators import text_index

    monkeypatch.setattr(text_index, "COUNTED", counted)
    r = random.Random(3)
    texts = ["".join("  " + "".join(r.choices("abcd", k=r.randint(1, 5))) for _ in range(r.choice([1, 2, 6, 20]))) + " " for _ in range(150)]
    grams, sizes = text_index.gram_sets(texts)
    sets = [set(x) for x in np.split(grams, np.cumsum(sizes)[:-1])]
    assert sets[0] == {(ord(a) << 42) | (ord(b) << 21) | ord(c) for a, b, c in zip(texts[0], texts[0][1:], texts[0][2:]) if (b, c) != (" ", " ")}
    shard = text_index._shard([(pa.array(range(100)), sizes[:100], grams[: sizes[:100].sum()]), (pa.array(range(100, 150)), sizes[100:], grams[sizes[:100].sum() :])])
    keys, *columns = (shard.column(c)[0].values.to_numpy() for c in range(5))
    own = [r.sample(sorted(s), len(s)) + [7] * (k % 2) for k, s in enumerate(sets[:40])]
    for threshold in (0.15, 0.3, 1.0):
        asked = text_index.Asked(np.array([len(x) for x in own]), np.concatenate(own).astype(np.int64), threshold)
        found = {(int(q), int(keys[t])): s for part in asked.near(*(c.astype(np.int64) for c in columns)) for q, t, s in zip(*part)}
        score = lambda x, b: len(set(x) & b) / len(set(x) | b)
        assert found == pytest.approx({(i, j): score(x, b) for i, x in enumerate(own) for j, b in enumerate(sets) if score(x, b) >= threshold})


def test_rulings(spark, tables):
    _, t, _ = tables
    named = t["article_version"].join(t["article"], "article_id").join(t["statute"].select("statute_id", F.col("name").alias("law")), "statute_id")
    xml = "<PrecService><판례정보일련번호>5</판례정보일련번호><법원명></법원명><사건번호>2020두1</사건번호><선고일자>20200601</선고일자><판시사항>실질과세</판시사항><판례내용>피고의 상고를 기각한다&lt;br/&gt;</판례내용><참조조문>소득세법 제1조, 소득세법 제1조</참조조문></PrecService>"
    details = law_xml.ruling_details(spark.createDataFrame([("5", "", xml)], "key string, raw_uri string, xml string"), "prec")
    listed = spark.createDataFrame([("5", "법원", "x", "t", "2020.06.01"), ("6", "법원", "y", "t", "2020.06.02"), ("7", "법원", "", "t", "")], "ruling_id string, source string, case_no string, title string, decided_at string")
    r = corpus.ingest_rulings(listed, details).orderBy("ruling_id").collect()
    assert [(x.ruling_id, x.outcome, x.body_available, x.anti_avoidance) for x in r] == [("5", "납세자승", True, ["실질과세"]), ("6", None, False, None)]
    full = corpus.resolve_references(corpus.map_rulings(details), named, ["소득세법"], date(2022, 1, 1))
    key = t["article"].first().article_id
    assert full.first().cited_article_ids == [key, key]
    found = corpus.find_unpatched(full, t["article"], t["article_version"].withColumn("valid_to", F.lit(None).cast("date")).where("valid_from < '2021-01-01'"), spark.createDataFrame([], "article_id long, origin_ruling string"), date(2020, 1, 1))
    assert [(x.origin_ruling, float(x.risk_score)) for x in found.collect()] == [("5", 1.0)]
    rates = risk.anti_avoidance_rate(spark.createDataFrame([(1,)], "article_id long"), full).first()
    assert (rates.total, rates.rate) == (0, 0.0)


def test_settings(spark):
    from chronolex.settings import PREFIX, Settings, settings

    assert settings(spark) == Settings()
    spark.conf.set(PREFIX + "rrf_k", "10")
    try:
        assert settings(spark).rrf_k == 10 and settings(spark).rerank_top_k == 5
        spark.conf.set(PREFIX + "rrf_k", "ten")
        with pytest.raises(ValueError):
            settings(spark)
    finally:
        spark.conf.unset(PREFIX + "rrf_k")


def test_schema(spark):
    """Tables are created once, and dropped only when that is confirmed."""
    for drop in (False, True):
        corpus.apply_schema(spark, "made", drop=drop, confirmed=drop)
        tables = {t.name for t in spark.catalog.listTables("made")}
        assert len(tables) == 10 and spark.table("made.ruling").count() == 0
        if not drop:
            spark.sql("INSERT INTO made.pattern_type VALUES ('a', 'b', 'c')")
            corpus.apply_schema(spark, "made")
            assert spark.table("made.pattern_type").count() == 1
    assert spark.table("made.pattern_type").count() == 0
    spark.sql("DROP DATABASE made CASCADE")


def test_fusion(spark):
    rows = lambda *r: spark.createDataFrame([(1, *x) for x in r], "query_id int, chunk_id long, rank int")
    a, b = rows((10, 1), (20, 2), (10, 3)), rows((20, 1), (30, 2))
    got = [(r.chunk_id, round(r.score, 9)) for r in retrieval.rrf_fuse(a, b).orderBy("rank").collect()]
    score = lambda *ranks: round(sum(1 / (60 + x) for x in ranks), 9)
    assert got == [(20, score(2, 1)), (10, score(3, 3)), (30, score(4, 2))] or got[0] == (20, score(2, 1))
    assert retrieval.rerank(a, 2).count() == 2


def test_raw_zone_and_stream(spark, tables, tmp_path):
    _, _, folder = tables
    root = str(tmp_path / "zone")
    rows = spark.createDataFrame([("k", bytearray(b"1"))], "key string, content binary")
    uri = raw_zone.put_raw(rows, root).first().raw_uri
    raw_zone.put_raw(rows, root)
    assert [bytes(r.content) for r in raw_zone.get_raw(spark, uri).collect()] == [b"1"]
    with pytest.raises(ValueError):
        raw_zone.get_raw(spark, "ftp://x/y")
    (tmp_path / "list.txt").write_text("# c\n\nx\n")
    assert [r.value for r in raw_zone.read_lines(spark, str(tmp_path / "list.txt")).collect()] == ["x"]
    spark.dataSource.register(raw_zone.paged_source("listing", "page int, v string", raw_zone.with_retries(lambda page: [(page, "r")] if page < 3 else [])))
    assert spark.read.format("listing").option("pages", "4").load().count() == 2
    with pytest.raises(Exception, match="goes on"):
        spark.read.format("listing").option("pages", "1").load().count()
    spark.dataSource.register(raw_zone.paged_source("whole", "page int, v string", lambda page: [(page, "r")] * (2 if page < 3 else 1), total=lambda: 5, page_size=2))
    assert spark.read.format("whole").load().count() == 5
    waits, calls = [], []

    def failing(page):
        calls.append(page)
        raise TimeoutError("x" * 500)

    with pytest.raises(OSError, match="page 7: x{200}$"):
        raw_zone.with_retries(failing, tries=3, wait=waits.append, pause=0.5)(7)
    assert calls == [7, 7, 7] and waits == [0.5, 1.0, 0.5, 2.0, 0.5]
    keys = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    zone = str(tmp_path / "fetched")
    for _ in range(2):
        assert raw_zone.fetch_documents(keys, lambda k: k.encode() * 2, zone).count() == 3
    assert sorted(bytes(r.content) for r in spark.read.parquet(zone).collect()) == [b"aa", b"bb"]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception):  # a damaged table is not a missing one
        raw_zone.put_raw(rows, str(tmp_path / "broken"))
    with pytest.raises(ValueError):
        corpus.apply_schema(spark, "db", drop=True)


@pytest.mark.parametrize("split", [None, 1000, 10**9])
def test_as_of_lookup_of_very_many_versions(spark, split):
    """One entity with most of the versions, gaps between some, requests on and between their days; as by binary search."""
    n = 60_000
    rng = np.random.default_rng(2)
    starts = np.sort(rng.choice(3 * n, n, replace=False))
    ends = np.where(rng.random(n) < 0.2, np.minimum(np.append(starts[1:], 4 * n), starts + 1), np.append(starts[1:], 4 * n))
    day = lambda x: F.expr(f"date_add(date'1900-01-01', cast({x} as int))")
    table = spark.createDataFrame([(1, k, int(s), int(e)) for k, (s, e) in enumerate(zip(starts, ends))] + [(2, n, 5, 7), (2, n + 1, 7, None), (None, n + 2, 0, None)], "k long, version long, s long, e long")
    versions = table.select("k", "version", day("s").alias("valid_from"), day("e").alias("valid_to"))
    asked = [(i, int(k), int(d)) for i, (k, d) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], 4000), rng.integers(0, 4 * n, 4000)))] + [(9000, 2, 6), (9001, 2, 7), (9002, 2, 4), (9003, None, 5), (9004, 1, None)]
    requests = spark.createDataFrame(asked, "id long, k long, d long").select("id", "k", day("d").alias("day"))
    found = {r.id: r.version for r in V.as_of_lookup(requests, versions, ["k"], "day", split).collect()}
    wanted = {}
    for i, k, d in asked:
        if k == 1 and d is not None:
            at = np.searchsorted(starts, d, side="right") - 1
            if at >= 0 and ends[at] > d:
                wanted[i] = at
        elif k == 2:
            wanted |= {i: n if d < 7 else n + 1} if d >= 5 else {}
    assert found == wanted and len(wanted) > 2000


def test_listings_go_on_where_they_stopped(spark, tmp_path):
    """A listing that is killed goes on with the pages it lacks; no committed page is fetched twice; pages are capped where asked."""
    from chronolex.settings import PREFIX
    from chronolex.sources.listings import fetch_listings, listing_archive

    sizes, log = {"a": 45, "b": 7, "c": 0}, tmp_path / "calls"
    log.mkdir()

    def fetch(target, query, page, broken=False):
        import uuid

        (log / uuid.uuid4().hex).write_text(f"{query} {page}")
        if broken and page == 3:
            raise OSError("gone")
        rows = "".join(f"<law>{query}{k}</law>" for k in range((page - 1) * 10, min(page * 10, sizes[query])))
        return f"<l><totalCnt>{sizes[query]}</totalCnt>{rows}</l>"

    measure = lambda xml: (xml.count("<law>"), int(xml.split("totalCnt>")[1].split("<")[0]))
    calls = lambda: sorted(f.read_text() for f in log.iterdir())
    listings, archive = spark.createDataFrame([("t", q) for q in sizes], "target string, query string"), listing_archive(spark, str(tmp_path / "pages"), buckets=3)
    spark.conf.set(PREFIX + "tries", "1")
    try:
        with pytest.raises(Exception, match="gone"):
            fetch_listings(listings, lambda t, q, n: fetch(t, q, n, True), measure, archive, page_size=10, at_a_time=2)
    finally:
        spark.conf.unset(PREFIX + "tries")
    assert calls().count("a 3") == 1 and archive.read().where("query = 'a'").count() == 2
    for f in log.iterdir():
        f.unlink()
    pages = fetch_listings(listings, fetch, measure, archive, page_size=10, at_a_time=2, slots=2)
    assert calls() == ["a 3", "a 4", "a 5"] and sorted((r.query, r.page, r.items) for r in pages.collect()) == [("a", 1, 10), ("a", 2, 10), ("a", 3, 10), ("a", 4, 10), ("a", 5, 5), ("b", 1, 7), ("c", 1, 0)]
    fetch_listings(listings, fetch, measure, archive, page_size=10)
    assert len(calls()) == 3
    capped = listing_archive(spark, str(tmp_path / "capped"), buckets=3)
    assert fetch_listings(listings, fetch, measure, capped, page_size=10, max_pages=2).count() == 4


def test_keyed_table(spark, tmp_path):
    """A write reads and replaces the buckets of its keys; one that dies leaves the table as it was; a label is written once."""
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], buckets=50)
    assert table.read().count() == 0 and table.version() == 0
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k long, v string")
    assert len(table.upsert(rows(*((k, "a") for k in range(1000))))) == 50
    before = table.places()
    touched = table.upsert(rows(*((k, "b") for k in range(995, 1005))))
    assert 1 < len(touched) <= 10 and {b for b, f in table.places().items() if f != before[b]} == set(touched)
    state = {r.k: r.v for r in table.read().collect()}
    assert state == {k: "b" if k >= 995 else "a" for k in range(1005)} and table.read().count() == 1005
    assert {r.k for r in table.read(touched).collect()} >= set(range(995, 1005))

    def dies(old, new):
        return old.unionByName(new).withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("v")))

    with pytest.raises(Exception, match="killed"):
        table.merge(rows((3, "x"), (4, "x")), dies)
    assert {r.k: r.v for r in table.read().collect()} == state and table.version() == 2
    for _ in range(2):
        table.insert_ignore(rows((3, "c"), (2000, "c"), (2000, "d"), (None, "n"), (None, "n")), ["v"], label="once")
    found = [(r.k, r.v) for r in table.read().where("k is null or k in (3, 2000)").collect()]
    assert sorted(found, key=str) == sorted([(3, "a"), (2000, "c"), (None, "n"), (None, "n")], key=str) and table.version() == 3
    assert table.upsert(rows().limit(0), label="empty") == [] and table.version() == 4
    stale = KeyedTable(spark, table.folder, table.schema, ["k"], buckets=50)
    stale.version = lambda: 3  # it has not seen the last write
    with pytest.raises(Exception, match="(?i)exist"):
        stale.upsert(rows((1, "z")))
    assert {r.k: r.v for r in table.read().where("k = 1").collect()} == {1: "a"}


def test_stream_goes_on_after_a_failed_batch(spark, tables, tmp_path):
    """A batch fails after the first is in; the restarted stream adds the rest, and nothing twice."""
    _, _, folder = tables
    table = KeyedTable(spark, str(tmp_path / "out"), "mst string, law_name string", ["mst"], buckets=4)
    healthy = lambda d: law_xml.snapshots(d).select("mst", "law_name")
    whole = table.insert_ignore

    def fails_once(batch, order=None, label=None):
        if label == "batch-1":
            raise RuntimeError("lost")
        return whole(batch, order, label)

    table.insert_ignore = fails_once
    with pytest.raises(Exception, match="lost"):
        ingest_stream(spark, str(folder), healthy, table, str(tmp_path / "cp"), files_at_a_time=1).awaitTermination(120)
    assert table.read().count() == 1
    table.insert_ignore = whole
    for _ in range(2):
        ingest_stream(spark, str(folder), healthy, table, str(tmp_path / "cp"), files_at_a_time=1).awaitTermination(120)
    assert sorted(r.mst for r in table.read().collect()) == ["10", "11"]
    table.insert_ignore(table.read(), label="batch-1")  # as if the batch had been committed, but not its checkpoint
    assert table.read().count() == 2 and table.entries().where("label = 'batch-1'").count() >= 1


def test_incremental_statutes(spark, tables, tmp_path):
    """Snapshots that come one after the other give the tables that all of them at once give."""
    shots, t, _ = tables
    stores = corpus.statute_store(spark, str(tmp_path / "store"), buckets=5)
    for mst in ("11", "10", "10"):
        corpus.store_statutes(stores, shots.where(F.col("mst") == mst))
    for name in ("article", "article_version"):
        columns = [c for c in stores[name].schema.names if c in t[name].columns]
        assert len(columns) > 3
        assert sorted(map(str, stores[name].read().select(*columns).collect())) == sorted(map(str, t[name].select(*columns).collect()))
    statute = stores["statute"].read().first()
    assert (statute.current_mst, statute.name, statute.enforced_on) == ("11", "소득세법", date(2021, 1, 1))


def test_search(spark):
    day, old = date(2021, 1, 1), date(2000, 1, 1)
    chunk = "chunk_id long, article_id long, text string, embedding array<float>, is_current boolean, valid_from date, valid_to date"
    chunks = spark.createDataFrame([(1, 10, "alpha beta gamma", [1.0, 0.0], True, old, None), (2, 20, "alpha beta delta", [0.9, 0.1], True, old, None), (3, 30, "omega", [0.0, 1.0], True, old, None), (4, 40, "alpha beta gamma", [1.0, 0.0], False, old, date(2010, 1, 1))], chunk)
    versions = spark.createDataFrame([(a, a + 1, "LAW", a, 0, "b", old, None) for a in (10, 20, 30)], "article_id long, article_key long, law string, art_no int, branch_no int, body string, valid_from date, valid_to date")
    edges = spark.createDataFrame([(10, 30, "REFERS_TO", None, None), (10, 20, "OTHER", None, None)], "src long, dst long, type string, valid_from date, valid_to date")
    rulings = spark.createDataFrame([("r1", [10, 10]), ("r2", [30])], "ruling_id string, cited_article_ids array<long>")
    addenda = spark.createDataFrame([(2, "later", [10, 30]), (1, "sooner", [10, 10]), (3, "none", [])], "addendum_id long, body string, target_articles array<long>")
    queries = spark.createDataFrame([(1, "alpha beta gamma", [1.0, 0.0]), (2, "see LAW 제30조", [0.0, 1.0])], "query_id int, text string, embedding array<float>")
    got = {(r.query_id, r.article_id): r for r in retrieval.search(queries, chunks, versions, edges, rulings, addenda, ["LAW"], day, day).collect()}
    assert set(got) == {(1, 10), (1, 20), (1, 30), (2, 30)}  # closed versions are out; the second query is routed
    first = got[1, 10]
    assert first.rank == 1 and [(v.article_id, v.article_key, v.body) for v in first.related] == [(30, 31, "b")] and first.rulings == ["r1"] and first.addenda == ["sooner", "later"]
    assert got[1, 20].addenda == [] and got[1, 20].related == [] and got[2, 30].addenda == ["later"]
    assert [got[1, a].rank for a in (10, 20, 30)] == [1, 2, 3] and got[2, 30].rulings == ["r2"]
    assert retrieval.vector_search(queries, chunks, day, day, block=1).count() == 6
    past = retrieval.vector_search(queries.where("query_id = 1"), chunks, date(2005, 1, 1), day).collect()
    assert {r.chunk_id for r in past} == {1, 2, 3, 4}


def test_vector_search_blocks(spark):
    """Every query of every block against brute force; ties by key, chunks without a usable vector last."""
    day, rng = date(2021, 1, 1), np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[200:220] = x[7]
    bad = [(900, None), (901, [0.0] * 8), (902, [1.0, None] * 4), (903, [1.0])]
    rows = [*enumerate(x.tolist()), *bad]
    chunks = spark.createDataFrame([(i, v, True) for i, v in rows], "chunk_id long, embedding array<float>, is_current boolean").repartition(5)
    asked = chunks.where("chunk_id % 20 = 0 or chunk_id = 901").select(F.col("chunk_id").alias("query_id"), "embedding")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for block in (1000, 4):
        got = {}
        for r in retrieval.vector_search(asked, chunks, day, day, top=302, block=block).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.chunk_id, r.score)
        assert set(got) == {*range(0, 300, 20), 900, 901}
        for q in range(0, 300, 20):
            score = np.round(unit @ unit[q], 9)
            order = np.lexsort((np.arange(300), -score))
            assert [got[q][k + 1][0] for k in range(302)] == [*order, 900, 901] and got[q][301][1] is None
            assert all(abs(got[q][k + 1][1] - score[order[k]]) < 1e-8 for k in range(300))
        assert all(s is None for _, s in got[901].values())


def test_traversal_over_laid_out_edges(spark):
    """A hub in many lists, hops and edges that repeat or have ended; the edges are not shuffled again by a hop."""
    from chronolex.operators.adjacency import Adjacency

    day, old = date(2021, 1, 1), date(2000, 1, 1)
    rows = [(0, k, "REFERS_TO", None, None) for k in range(1, 301)] + [(k, k + 300, "MUTATIS", old, None) for k in range(1, 301)]
    rows += [(0, 5, "REFERS_TO", old, None), (7, 900, "DELEGATES", None, date(2020, 1, 1)), (8, 901, "OTHER", None, None), (None, 3, "MUTATIS", None, None), (350, 0, "DELEGATES", date(2022, 1, 1), None)]
    edges = spark.createDataFrame(rows, "src long, dst long, type string, valid_from date, valid_to date")
    starts = spark.createDataFrame([(0,), (9,), (777,)], "start long")
    for graph_ in (edges, Adjacency.build(edges), Adjacency.build(edges, hub=10, buckets=3)):
        nodes, walked = graph.expand_refs(starts, graph_, day)
        want = {(0, 0, 0), (9, 9, 0), (777, 777, 0), (9, 309, 1)} | {(0, k, 1) for k in range(1, 301)} | {(0, k + 300, 2) for k in range(1, 301)}
        assert {tuple(r) for r in nodes.select("start", "node", "hop").collect()} == want
        assert sorted(tuple(r) for r in walked.collect()) == sorted([(0, 0, k, "REFERS_TO") for k in range(1, 301)] + [(0, k, k + 300, "MUTATIS") for k in range(1, 301)] + [(9, 9, 309, "MUTATIS")])
        assert {tuple(r) for r in graph.terminals(starts, graph_).collect()} == {(9, 309)}
        assert [tuple(r) for r in graph.delegation_chains(spark.createDataFrame([(350,)], "start long"), graph_).collect()] == [(350, [350, 0])]
    laid = Adjacency.build(edges, hub=10, buckets=3)
    assert [tuple(r) for r in laid.hubs.collect()] == [(0, 31)] and laid.lists.where("src = 0").count() > 20
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = laid.step(starts.withColumnRenamed("start", "node"), ("REFERS_TO",), day)
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # that of the frontier
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vector_index(spark):
    """The index returns what the full scan does, odd vectors and queries included, and reads a part of clustered vectors only."""
    from chronolex.operators.vector_index import VectorIndex

    day, rng = date(2021, 1, 1), np.random.default_rng(6)
    middle = rng.normal(size=(40, 8))
    x = (middle[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 8)) * 0.01).astype(np.float32) * rng.lognormal(size=(2000, 1)).astype(np.float32)
    x[500:520] = x[7]
    odd = [(9000, None), (9001, [0.0] * 8), (9002, [1.0, None] * 4), (9003, [1.0]), (9004, [float("nan")] * 8)]
    chunks = spark.createDataFrame([(i, v, True) for i, v in [*enumerate(x.tolist()), *odd]], "chunk_id long, embedding array<float>, is_current boolean").repartition(3)
    asked = chunks.where("chunk_id % 100 = 0 or chunk_id in (7, 9000, 9001, 9003)").select(F.col("chunk_id").alias("query_id"), "embedding")
    index, rows = VectorIndex.build(chunks), lambda df: sorted((r.query_id, r.rank, r.chunk_id, None if r.score is None else repr(round(r.score, 8))) for r in df.collect())
    for top, block in ((12, 1000), (12, 5), (2004, 1000)):
        read = []
        assert rows(index.nearest(asked, top, block, read)) == rows(retrieval.vector_search(asked, chunks, day, day, top=top))
        compared, total = map(sum, zip(*read))
        assert compared <= total and (top > 100 or compared < 0.45 * total)
    assert index.nearest(asked.limit(0)).count() == 0
    empty = VectorIndex.build(chunks.limit(0))
    assert empty.nearest(asked, 5).count() == 0


def test_whole_query_set(spark):
    from chronolex.plans import registry

    folder = "/root/testdata/sf0.001"
    wanted = {r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    assert {r.query_id for r in registry.QUERIES["rt_02_vector_search"](spark, folder).collect()} == wanted and len(wanted) > 5
    keyword = {r.query_id for r in registry.QUERIES["rt_01_keyword_search"](spark, folder).collect()}
    assert {r.query_id for r in registry.QUERIES["rt_03_rrf_fuse"](spark, folder).collect()} == wanted | keyword
