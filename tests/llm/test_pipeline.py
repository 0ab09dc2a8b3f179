import corpus_pipeline

from tests.llm.test_operators import BASE, frame, text


def test_stages(spark, tmp_path):
    item = "The quick brown fox of the north jumped over 3 lazy dogs and ran 12 miles home before the storm had come to its end."
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1000, 1100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, BASE), (2, BASE + " end"), (3, text(40, 80) + " " + item), (4, text(41, 50) + " me@x.org"), (5, None), (6, ""), (4, text(41, 50) + " me@x.org"), (None, "x"), (7, text(42, 30) + " you idiot you stupid moron")]
    rows += [(i, text(i, 60) + (" idiot and moron" if i % 5 == 0 else "")) for i in range(1000, 1100)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
        left[name] = sorted(r.doc_id or 0 for r in docs.where("coalesce(doc_id, 0) < 1000").collect())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "personal_data":
            assert next(r.text for r in docs.collect() if r.doc_id == 4).endswith("<email>")
    assert left["toxicity"] == [0, 1, 2, 3, 4, 4, 5, 6]
    assert left["near_duplicates"] == [0, 1, 3, 4, 5, 6]
    assert left["decontamination"] == left["personal_data"] == left["packing"] == [0, 1, 4, 5, 6]


def test_edges(spark, tmp_path):
    """Empty tables, one very long text, and columns named like those the stages use inside."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    more = {c: [1] for c in ("row", "spans", "base", "root", "copies", "h", "doc", "votes", "features", "bucket", "given", "tie", "n", "piece")}
    long = text(50, 30_000)
    clashing = frame(spark, [(1, long), (2, long + " end"), (3, None), (4, ""), (None, "x y"), (5, "mail me@x.org")])
    from pyspark.sql import functions as F

    clashing = clashing.drop("row", "n").withColumns({c: F.lit(7) for c in more})
    for rows, wanted in ((clashing, [0, 1, 3, 4, 5]), (clashing.limit(0), [])):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
        assert sorted({r.doc_id or 0 for r in docs.collect()}) == wanted
    assert docs.columns == ["doc_id", "piece", "n_words", "bucket", "lane", "batch", "slot"]


def test_near_duplicates_share_an_id(spark):
    """A document that only shares its id with a copy stays, and so does the first of several copies under one id."""
    one, other = text(60, 90), text(61, 50)
    docs = frame(spark, [(3, one), (5, one + " end"), (5, other), (5, other), (7, other + " end"), (5, other + " and end"), (6, ""), (6, None), (None, one)])
    docs = docs.select(*corpus_pipeline.COLUMNS)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted((i or 0, len((t or "").split())) for i, t in left if i != 5) == [(0, 90), (3, 90), (6, 0), (6, 0)]
    assert len([t for i, t in left if i == 5]) == 1 and next(t for i, t in left if i == 5).startswith(other)
