"""Batch jobs: from parsed documents to the versioned tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import text as T
from ..functions import tree
from ..operators import graph, risk
from ..operators.versions import adjacent_pairs, as_of_lookup, carry_forward, close_versions, first_write, insert_ignore, merge_articles, merge_statutes
from ..scratch import written
from ..sources.keyed_table import KeyedTable

# Names that the golden set is parsed with.
GOLDEN_NAMES = ["국세기본법", "국세기본법 시행령", "소득세법", "법인세법", "부가가치세법", "상속세 및 증여세법", "상속세 및 증여세법 시행령", "조세특례제한법", "조세특례제한법 시행령", "조특법", "국기법"]


def apply_schema(spark: SparkSession, database: str, drop: bool = False, confirmed: bool = False) -> None:
    """Create all tables that are missing; dropping them first takes a second flag."""
    if drop and not confirmed:
        raise ValueError("dropping tables needs confirmation")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in schemas.TABLES.items():
        if drop:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def map_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row per article version of the snapshots (mst, seq, law_id, ..., articles): headings carried on, headings and
    articles without an effective date left out."""
    units = snapshots.select("mst", "seq", "law_id", "promulgated_on", "promulgation_no", "revision_reason", F.posexplode("articles").alias("pos", "u"))
    chapter = F.when(F.col("u.is_heading"), F.nullif(T.heading(F.col("u.body")), F.lit("")))
    headed = carry_forward(units, ["mst"], ["pos"], chapter, "chapter_title").where("not u.is_heading and u.effective_from <> ''")
    start = T.strict_date(F.col("u.effective_from"))
    return headed.select(
        "seq", F.col("law_id").cast("long").alias("statute_id"), "u.art_no", "u.branch_no", "chapter_title", "u.title", "u.body", F.struct(F.col("u.clauses").alias("clauses")).alias("tree"), start.alias("valid_from"),
        F.coalesce(F.when(F.col("promulgated_on") != "", T.strict_date(F.col("promulgated_on"))), start).alias("promulgated_on"), T.promulgation_number(F.col("promulgation_no")).alias("promulgation_no"), "u.revision_type",
        (F.col("u.revision_type") == "전부개정").alias("is_full_rewrite"), "revision_reason", F.concat_ws(":", "mst", "u.jomun_key").alias("moleg_article_key"),
    )


def ingest_statutes(snapshots: DataFrame, parents: DataFrame | None = None) -> dict[str, DataFrame]:
    """statute, article and article_version of snapshots; seq orders them (the current one first), first write wins."""
    heads = snapshots.select(F.col("law_id").cast("long").alias("statute_id"), F.col("law_name").alias("name"), "law_type", "ministry_code", F.col("mst").alias("current_mst"), T.lenient_date(F.col("enforced_on")).alias("enforced_on"), "seq", "is_current")
    heads = heads.join(parents, "statute_id", "left") if parents is not None else heads.withColumn("parent_id", F.lit(None).cast("long"))
    mapped = map_snapshots(snapshots)
    natural = ["statute_id", "art_no", "branch_no"]
    article = merge_articles(mapped, natural)
    kept = first_write(mapped.drop("chapter_title").withColumn("article_id", F.xxhash64(*natural)), ["article_id", "valid_from"], ["seq", "moleg_article_key"])
    version = close_versions(kept).withColumn("article_key", F.xxhash64("article_id", "valid_from")).drop(*natural, "seq")
    return {"statute": merge_statutes(heads), "article": article, "article_version": version}


STATUTE = "statute_id long, name string, law_type string, ministry_code string, current_mst string, enforced_on date, parent_id long, seen_current boolean"


def statute_store(spark: SparkSession, folder: str, buckets: int = 64) -> dict[str, KeyedTable]:
    """Tables for snapshots that come over time. All versions of an article are in one bucket, so that their intervals close there."""
    version = StructType([f for f in schemas.struct("article_version").fields if f.name != "ingested_at"])
    made = lambda name, schema, keys, by=(): KeyedTable(spark, f"{folder}/{name}", schema, keys, list(by), buckets)
    return {"statute": made("statute", STATUTE, ["statute_id"]), "article": made("article", schemas.ARTICLE, ["article_id"]), "article_version": made("article_version", version, ["article_id", "valid_from"], ["article_id"])}


def store_statutes(stores: dict[str, KeyedTable], snapshots: DataFrame, parents: DataFrame | None = None, label: str | None = None) -> None:
    """Add snapshots to the store. A statute's current_mst and enforced_on change with current snapshots only, its parent stays known;
    an article is made once and keeps the first chapter that is known; of versions from one day the first written stays, and the
    intervals of the articles at hand are closed anew. A label makes a call that is run again do nothing."""
    new = ingest_statutes(snapshots, parents)
    current = snapshots.groupBy(F.col("law_id").cast("long").alias("statute_id")).agg(F.max("is_current").alias("seen_current"))

    def statutes(old: DataFrame, rows: DataFrame) -> DataFrame:
        both = old.alias("o").join(rows.alias("n"), "statute_id", "full")
        kept = lambda c: F.when(F.col("n.seen_current") | F.col("o.statute_id").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        latest = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
        return both.select("statute_id", *map(latest, ("name", "law_type", "ministry_code")), kept("current_mst"), kept("enforced_on"), latest("parent_id"), F.coalesce(F.col("o.seen_current") | F.col("n.seen_current"), "n.seen_current", "o.seen_current").alias("seen_current"))

    def articles(old: DataFrame, rows: DataFrame) -> DataFrame:
        both = old.alias("o").join(rows.alias("n"), "article_id", "full")
        return both.select("article_id", *(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("statute_id", "art_no", "branch_no", "chapter_title")))

    def versions(old: DataFrame, rows: DataFrame) -> DataFrame:
        both = old.withColumn("_late", F.lit(0)).unionByName(rows.select(*old.columns).withColumn("_late", F.lit(1)))
        return close_versions(first_write(both, ["article_id", "valid_from"], ["_late", "moleg_article_key"]).drop("_late"))

    stores["statute"].merge(new["statute"].join(current, "statute_id"), statutes, label)
    stores["article"].merge(new["article"], articles, label)
    stores["article_version"].merge(new["article_version"].select(*stores["article_version"].schema.names), versions, label)


def ingest_addenda(snapshots: DataFrame) -> DataFrame:
    """Addendum items with their kinds, "as before" taken from the item before; first write wins, items without a number never clash."""
    units = snapshots.select("seq", F.col("law_id").cast("long").alias("statute_id"), F.posexplode("addenda").alias("unit_no", "u"))
    items = units.select("seq", "statute_id", "unit_no", T.promulgation_number(F.col("u.promulgation_no")).alias("promulgation_no"), F.posexplode(T.addendum_items(F.col("u.body"))).alias("pos", "i"))
    kinds = carry_forward(items, ["seq", "statute_id", "unit_no"], ["pos"], T.addendum_kind(F.col("i.label")), "kind", "특례")
    rows = kinds.select("seq", "unit_no", "pos", "statute_id", "promulgation_no", "i.clause_no", "kind", F.when(F.col("kind") == "시행일", T.korean_date(F.col("i.text"))).alias("applies_from"), F.col("i.text").alias("body"), F.array().cast("array<long>").alias("target_articles"))
    return first_write(rows, ["statute_id", "promulgation_no", "clause_no"], ["seq", "unit_no", "pos"]).drop("seq", "unit_no", "pos")


def build_diffs(version: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Tree diff and new thresholds of adjacent versions; pairs that exist are left as they are."""
    flat = version.select("article_id", "valid_from", "article_key", tree.flatten_tree(F.col("tree.clauses")).alias("paths"))
    pairs = adjacent_pairs(flat, "article_id", "valid_from", ["article_key", "paths"])
    rows = pairs.select(F.col("article_key").alias("from_version"), F.col("next_article_key").alias("to_version"), tree.diff(F.col("paths"), F.col("next_paths")).alias("diff")).withColumn("added_thresholds", tree.added_thresholds(F.col("diff")))
    return rows if existing is None else insert_ignore(existing, rows, ["from_version", "to_version"])


def diff_articles(pairs: DataFrame, diffs: DataFrame, version: DataFrame) -> DataFrame:
    """Diff and new thresholds of any pairs (from_version, to_version): as stored in `diffs`, else made on the fly, with the reason
    that the later version states and "법제처" as its source. A key that no version has is an error, in the job that reads it.

    diffs: as `build_diffs` returns them, with reason_text and reason_source. version: article_key, tree, revision_reason.
    """
    asked = pairs.select("from_version", "to_version").distinct()
    stored = asked.join(diffs.select("from_version", "to_version", "diff", "added_thresholds", "reason_text", "reason_source"), ["from_version", "to_version"])
    rest = asked.join(diffs, ["from_version", "to_version"], "left_anti")
    # Both ends are looked up in one join, and only trees that are asked for are flattened.
    end = lambda k: F.struct(F.col(f"{k}_version").alias("article_key"), F.lit(k).alias("end"))
    ends = rest.select("from_version", "to_version", F.explode(F.array(end("from"), end("to"))).alias("e")).select("from_version", "to_version", "e.*")
    found = ends.join(version.select("article_key", F.col("tree.clauses").alias("clauses"), "revision_reason"), "article_key", "left")
    of = lambda k, c: F.first(F.when(F.col("end") == k, F.col(c)), ignorenulls=True)
    both = found.groupBy("from_version", "to_version").agg(of("from", "clauses").alias("a"), of("to", "clauses").alias("b"), of("to", "revision_reason").alias("reason_text"))
    both = both.withColumns({"from": tree.flatten_tree(F.col("a")), "to": tree.flatten_tree(F.col("b"))})
    missing = F.raise_error(F.concat(F.lit("unknown article key in "), F.col("from_version").cast("string"), F.lit(" -> "), F.col("to_version").cast("string")))
    change = F.when(F.col("from").isNull() | F.col("to").isNull(), missing.cast(schemas.DIFF)).otherwise(tree.diff(F.col("from"), F.col("to")))
    made = both.select("from_version", "to_version", change.alias("diff"), F.nullif("reason_text", F.lit("")).alias("reason_text"))
    made = made.select("from_version", "to_version", "diff", tree.added_thresholds(F.col("diff")).alias("added_thresholds"), "reason_text", F.when(F.col("reason_text").isNotNull(), "법제처").alias("reason_source"))
    return stored.unionByName(made)


def find_thresholds(diffs: DataFrame, version: DataFrame) -> DataFrame:
    """Thresholds along the history of each article, with the date of the version that brought them and their place in it, which order them."""
    dated = diffs.join(version.select(F.col("article_key").alias("to_version"), "article_id", "valid_from"), "to_version")
    return dated.select("article_id", "valid_from", F.posexplode("added_thresholds").alias("pos", "t")).select("article_id", "valid_from", "pos", "t.*")


def map_rulings(details: DataFrame) -> DataFrame:
    """Classified rulings; those without a date are left out."""
    both = F.concat_ws("\n", "gist", "body")
    outcome = F.when(F.col("source") == "헌법재판소", T.constitutional_outcome(F.col("body"))).when(~F.col("source").isin("법제처", "행정규칙"), T.court_outcome(both))
    return details.withColumn("decided_on", T.lenient_date(F.col("decided_at"))).where("decided_on is not null").select(
        "ruling_id", "source", F.nullif("case_no", F.lit("")).alias("case_no"), "decided_on", outcome.alias("outcome"), "gist", "body", (T.stripped(F.col("body")) != "").alias("body_available"), T.keyword_flags(both).alias("anti_avoidance"), "ref_articles", "raw_uri"
    )


def ingest_rulings(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Mapped details, and for listed rulings without one a row of the listing alone, where that has a date."""
    mapped = map_rulings(details)
    rest = listed.join(mapped.select("ruling_id"), "ruling_id", "left_anti").withColumn("decided_on", T.listed_date(F.col("decided_at"))).where("decided_on is not null")
    rest = rest.select("ruling_id", "source", F.nullif("case_no", F.lit("")).alias("case_no"), "decided_on", F.col("title").alias("gist"), F.lit(False).alias("body_available"))
    return first_write(mapped.unionByName(rest, allowMissingColumns=True), ["ruling_id"], [F.desc("body_available"), "source"])


def law_names(statute: DataFrame) -> DataFrame:
    """(name): names and abbreviations of all statutes, and the abbreviations that are known anyway, each once."""
    known = statute.sparkSession.createDataFrame([(n,) for n in T.ABBREVIATIONS], "name string")
    return statute.select("name").union(statute.select(F.explode("abbreviations"))).union(known).where("name is not null and name <> ''").distinct()


def resolve_citations(requests: DataFrame, versions: DataFrame, names: list[str] | DataFrame, today: date, **patterns) -> DataFrame:
    """requests (text, decided_on, ...) whose text cites an article, beside its version in force on the date the text states, else on
    the day of the decision, else today. versions: law, art_no, branch_no, article_id, valid_from, valid_to."""
    parsed = requests.withColumn("c", T.citation(F.col("text"), names, **patterns)).where("c is not null")
    asked = parsed.select(*requests.columns, "c.law", "c.art_no", "c.branch_no", F.coalesce("c.historical_date", "decided_on", F.lit(today)).alias("anchor"))
    return as_of_lookup(asked, versions, ["law", "art_no", "branch_no"], "anchor")


def resolve_references(rulings: DataFrame, versions: DataFrame, names: list[str] | DataFrame, today: date, **patterns) -> DataFrame:
    """Articles that the fragments of each ruling cite, in their order, repeats kept."""
    each = rulings.select("ruling_id", "decided_on", F.posexplode("ref_articles").alias("pos", "text"))
    found = resolve_citations(each, versions, names, today, **patterns)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text", "article_id")))
    lists = found.groupBy("ruling_id").agg(ordered.alias("r")).select("ruling_id", F.col("r.text").alias("cited_articles"), F.col("r.article_id").alias("cited_article_ids"))
    return rulings.join(lists, "ruling_id", "left")


def evaluate_citations(cases: DataFrame, names: list[str] | DataFrame = GOLDEN_NAMES) -> DataFrame:
    """Confusion counts, precision and recall of (text, expected struct(law, art_no, branch_no)); a wrong answer counts as both
    a false positive and a false negative."""
    c = T.citation(F.col("text"), names)
    answer = F.when(c.isNotNull(), F.struct(c["law"].alias("law"), c["art_no"].alias("art_no"), c["branch_no"].alias("branch_no")))
    rows = cases.select("expected", answer.alias("answer"))
    return confusion(rows, F.col("expected").isNotNull(), F.col("answer").isNotNull(), F.col("expected") == F.col("answer"))


def confusion(rows: DataFrame, positive, predicted, right) -> DataFrame:
    wrong = positive & predicted & ~F.coalesce(right, F.lit(False))
    counts = rows.agg(
        F.count_if(positive & predicted & ~wrong).alias("tp"), F.count_if((~positive & predicted) | wrong).alias("fp"), F.count_if((positive & ~predicted) | wrong).alias("fn"), F.count_if(~positive & ~predicted).alias("tn")
    )
    share = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(0.0)
    return counts.withColumn("precision", share("fp")).withColumn("recall", share("fn"))


def load_rewrite_map(rows: DataFrame, statute: DataFrame, article: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(article pairs that do not exist yet, rows whose articles are unknown) of statute_name, from_art_no, from_branch_no, to_art_no, to_branch_no, note."""
    named = article.join(statute.select("statute_id", F.col("name").alias("statute_name")), "statute_id")
    end = lambda k: named.select("statute_name", F.col("art_no").alias(f"{k}_art_no"), F.col("branch_no").alias(f"{k}_branch_no"), F.col("article_id").alias(f"{k}_article_id"))
    joined = rows.join(end("from"), ["statute_name", "from_art_no", "from_branch_no"], "left").join(end("to"), ["statute_name", "to_art_no", "to_branch_no"], "left")
    known = F.col("from_article_id").isNotNull() & F.col("to_article_id").isNotNull()
    pair = ["from_article_id", "to_article_id"]
    new = joined.where(known).select(*pair, "note").groupBy(*pair).agg(F.min("note").alias("note"))
    return new if existing is None else insert_ignore(existing, new, pair), joined.where(~known).select(*rows.columns)


def build_graph(statute: DataFrame, article: DataFrame, version: DataFrame, ruling: DataFrame, delegations: DataFrame, pattern_type: DataFrame, folder: str) -> dict[str, DataFrame]:
    """The whole graph, written anew under a folder and read back."""
    tables = graph.build_graph(statute, article, version, ruling, delegations, pattern_type)
    graph.write_graph(tables, folder)
    return {name: statute.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name.lower()}") for name, df in tables.items()}


Model = Callable[[list[str]], "list[list[float]] | np.ndarray"]


def embed(chunks: DataFrame, load: Callable[[], Model], dimension: int, batch: int = 64, profile: ResourceProfile | None = None) -> DataFrame:
    """Chunks with the vectors of their texts; current, as they are new.

    `load` makes the model, once in a task, whatever the number of its batches. The model gets `batch` texts of like length at a time,
    as it pads them to the longest. A vector of another length than `dimension` is an error, and so is another number of vectors.
    profile: what the stage's executors must have, such as an accelerator.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for rows in batches:
            model = model or load()
            texts, vectors = rows["text"].tolist(), [None] * len(rows)
            order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                made = model([texts[k] for k in part])
                if len(made) != len(part) or any(len(v) != dimension for v in made):
                    raise ValueError(f"{len(part)} texts need {len(part)} vectors of {dimension} numbers")
                for k, v in zip(part, made):
                    vectors[k] = list(map(float, v))
            yield rows.assign(embedding=vectors, is_current=True)

    return chunks.mapInPandas(run, StructType([*chunks.schema.fields, *StructType.fromDDL("embedding array<float>, is_current boolean").fields]), profile=profile)


def embedding_store(spark: SparkSession, folder: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, folder, schemas.EMBEDDING, ["article_key", "chunk_path"], buckets=buckets)


def embed_backfill(version: DataFrame, store: KeyedTable, load: Callable[[], Model], dimension: int, turns: int = 1, **how) -> None:
    """Embed the chunks of open versions that the store lacks, a part of them in each turn, and expire those of closed ones.

    What a turn has made is committed at its end: a run that is stopped has lost one turn, and the next one goes on with what is missing."""
    pending = written(embedding_chunks(version, store.read()).select("chunk_id", "article_key", "chunk_path", "text"), "pending")
    for turn in range(turns):
        store.upsert(embed(pending.where(F.pmod(F.xxhash64("chunk_id"), F.lit(turns)) == turn), load, dimension, **how))
    stale = store.read().where("is_current").join(version.where("valid_to is not null").select("article_key").distinct(), "article_key", "left_semi")
    store.upsert(stale.withColumn("is_current", F.lit(False)))


def embedding_chunks(version: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Chunks of open versions that have no vector yet; the vectors come from outside."""
    each = version.where("valid_to is null").select("article_key", F.explode(tree.chunks(F.col("tree.clauses"))).alias("c")).select("article_key", "c.*").where(T.stripped(F.col("text")) != "")
    keyed = each.withColumn("chunk_id", F.xxhash64("article_key", "chunk_path"))
    return keyed if existing is None else insert_ignore(existing, keyed, ["article_key", "chunk_path"])


def expire_chunks(embedding: DataFrame, version: DataFrame) -> DataFrame:
    """Chunks of closed versions are no longer current."""
    closed = version.where("valid_to is not null").select("article_key", F.lit(True).alias("_closed"))
    return embedding.join(closed, "article_key", "left").withColumn("is_current", F.col("is_current") & F.col("_closed").isNull()).drop("_closed")


def find_unpatched(ruling: DataFrame, article: DataFrame, version: DataFrame, existing: DataFrame, since: date) -> DataFrame:
    """New loophole candidates with their scores."""
    cites = graph.cites_edges(ruling, article)
    candidates = graph.unpatched(ruling, cites, version, since, T.WON)
    return graph.materialise_unpatched(candidates, risk.anti_avoidance_rate(candidates, ruling), existing)


def parents_of(hierarchy: DataFrame) -> DataFrame:
    """(statute_id, parent_id) of hierarchy rows: act, decree, rule."""
    window = Window.partitionBy("mst").orderBy("level")
    rows = hierarchy.withColumn("parent_id", F.lag(F.col("law_id").cast("long")).over(window))
    return rows.select(F.col("law_id").cast("long").alias("statute_id"), "parent_id").dropDuplicates(["statute_id"])
