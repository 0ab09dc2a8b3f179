"""Versioned relations: first write wins, closing of intervals, look-ups by date, incremental sinks and their checks."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.temporal import in_force, require_as_of
from ..scratch import written


def first_write(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Of rows with equal keys the first in order; rows with a null in a key never clash, as in a unique index."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    anyone = F.lit(False)
    for k in keys:
        anyone = anyone | F.col(k).isNull()
    return df.withColumn("_n", number).where((F.col("_n") == 1) | anyone).drop("_n")


def latest_write(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key does not exist yet; to be appended."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows after a replace on conflict; to be overwritten."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_write(both, keys, [F.desc("_new")]).drop("_new")


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where there is none yet. Any other failure is raised: taking it for a missing table would
    append everything a second time."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def merge_statutes(snapshots: DataFrame) -> DataFrame:
    """One row per statute of (statute_id, seq, is_current, ...): current_mst and enforced_on of the last current snapshot,
    else of the first one seen; the last parent that is known; other columns of the last snapshot."""
    last = lambda c, where=None: F.max_by(c, F.when(where, F.col("seq")) if where is not None else F.col("seq"))
    current = F.col("is_current")
    kept = lambda c: F.coalesce(last(c, current), F.min_by(c, "seq")).alias(c)
    return snapshots.groupBy("statute_id").agg(
        *(last(c).alias(c) for c in ("name", "law_type", "ministry_code")), kept("current_mst"), kept("enforced_on"), F.max_by("parent_id", F.when(F.col("parent_id").isNotNull(), F.col("seq"))).alias("parent_id")
    )


def merge_articles(rows: DataFrame, natural: list[str], seq: str = "seq", chapter: str = "chapter_title") -> DataFrame:
    """One row per natural key, with a key made of it and the first chapter that is known."""
    merged = rows.groupBy(*natural).agg(F.min_by(chapter, F.when(F.col(chapter).isNotNull(), F.col(seq))).alias(chapter))
    return merged.withColumn("article_id", F.xxhash64(*natural))


def close_versions(df: DataFrame, entity: str = "article_id", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Every version ends where the next one begins; the last stays open."""
    return df.withColumn(end, F.lead(start).over(Window.partitionBy(entity).orderBy(start)))


def changed_ends(df: DataFrame, entity: str = "article_id", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Only the versions whose end has to be written anew."""
    return close_versions(df, entity, start, "_end").where(~F.col("_end").eqNullSafe(F.col(end))).withColumn(end, F.col("_end")).drop("_end")


def adjacent_pairs(df: DataFrame, entity: str, start: str, columns: list[str]) -> DataFrame:
    """Each version but the last beside its successor, in columns `next_...`. What is not read of these is not carried along."""
    window = Window.partitionBy(entity).orderBy(start)
    following = {f"next_{c}": F.lead(c).over(window) for c in columns}
    return df.withColumns(following | {"_there": F.lead(F.lit(True)).over(window)}).where("_there").drop("_there")


def supersedes(df: DataFrame, entity: str, start: str, key: str) -> DataFrame:
    """Edges from each version to the one before it."""
    return df.select(F.col(key).alias("src"), F.lag(key).over(Window.partitionBy(entity).orderBy(start)).alias("dst")).where("dst is not null")


def timeline(versions: DataFrame, entity: str = "article_id", start: str = "valid_from") -> DataFrame:
    """Every version with its `position` in the history of its entity, oldest first."""
    return versions.withColumn("position", F.row_number().over(Window.partitionBy(entity).orderBy(start)))


def latest_open(versions: DataFrame, entity: str = "article_id", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Of each entity's open versions the one that began last."""
    return latest_write(versions.where(F.col(end).isNull()), [entity], [F.desc(start)])


def effective_at(versions: DataFrame, as_of: date) -> DataFrame:
    return versions.where(in_force(require_as_of(as_of)))


def effective_law(versions: DataFrame, article: DataFrame, as_of: date) -> DataFrame:
    """The versions in force of every statute with their `position` in it, by article and branch number."""
    rows = effective_at(versions, as_of).join(article.select("article_id", "statute_id", "art_no", "branch_no"), "article_id")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("statute_id").orderBy("art_no", "branch_no", "article_id")))


def as_of_lookup(requests: DataFrame, versions: DataFrame, keys: list[str], day: str, split_above: int | None = None) -> DataFrame:
    """Each request beside the version of its key that was in force on its day; requests without one are left out. The versions of a key
    don't overlap.

    Requests and versions of a key are put in the order of their days, and each request takes the last version before it: no
    request is compared with a key's other versions, of which there may be any number. Keys with more than `split_above` versions are
    dealt out by ranges of days, where every range begins with the version that the ones before leave.
    """
    asked, known = [c for c in requests.columns if c not in keys], [c for c in versions.columns if c not in keys]
    usable = lambda df: df.dropna(subset=keys)
    none = lambda df, columns: F.lit(None).cast(df.select(F.struct(*columns)).schema[0].dataType)
    rows = usable(versions).where("valid_from is not null").select(*keys, F.col("valid_from").alias("_at"), F.lit(0).alias("_side"), F.struct(*known).alias("_v"), none(requests, asked).alias("_r"))
    rows = rows.unionByName(usable(requests).where(F.col(day).isNotNull()).select(*keys, F.col(day).alias("_at"), F.lit(1).alias("_side"), none(versions, known).alias("_v"), F.struct(*asked).alias("_r")))
    rows = rows.withColumn("_range", F.lit(0)) if split_above is None else _in_ranges(rows, keys, split_above)
    before = Window.partitionBy(*keys, "_range").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(before)).where((F.col("_side") == 1) & F.col("_v").isNotNull())
    return found.where(F.col("_v.valid_to").isNull() | (F.col("_v.valid_to") > F.col("_at"))).select(*keys, "_r.*", "_v.*")


def _in_ranges(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows with the number of their range of days, for keys with more than `most` versions, and with the version that each range of these
    begins with. There are at most as many such keys and ranges as `most` goes into the number of versions."""
    large = rows.where("_side = 0").groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(F.unix_date("_at"), F.lit([k / 32 for k in range(1, 32)]), F.lit(1000)).alias("_cuts")).where(F.col("_n") > most)
    cuts = written(large.select(*keys, "_cuts"), "cuts")
    number = F.coalesce(F.size(F.filter(F.array_distinct("_cuts"), lambda c: c <= F.unix_date("_at"))), F.lit(0))
    dealt = rows.join(F.broadcast(cuts), keys, "left").withColumn("_range", number).drop("_cuts")
    last = dealt.join(F.broadcast(cuts), keys, "left_semi").where("_side = 0").groupBy(*keys, "_range").agg(F.max_by("_v", "_at").alias("_v"))
    # Ranges without versions hand on what they were handed.
    every = cuts.select(*keys, F.explode(F.sequence(F.lit(0), F.size(F.array_distinct("_cuts")))).alias("_range")).join(last, [*keys, "_range"], "left")
    handed = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    first = every.withColumn("_v", handed).where("_v is not null").select(*keys, F.col("_v.valid_from").alias("_at"), F.lit(-1).alias("_side"), "_v", F.lit(None).cast(rows.schema["_r"].dataType).alias("_r"), "_range")
    return dealt.unionByName(first)


def carry_forward(df: DataFrame, partition: list[str], order: list[str], value: str | Column, name: str, default=None) -> DataFrame:
    """The last value that is not null, up to and with the row."""
    seen = F.last(value, ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, F.coalesce(seen, F.lit(default)) if default is not None else seen)


def group_runs(df: DataFrame, partition: list[str], order: list[str], starts: Column, name: str = "group_no") -> DataFrame:
    """Number of the group each row belongs to, as flat rows open new groups; rows before the first group go."""
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(window)).where(F.col(name) > 0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of a unique key; nulls never clash."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def overlaps(versions: DataFrame, entity: str = "article_id") -> DataFrame:
    """Versions that begin before their predecessor has ended."""
    window = Window.partitionBy(entity).orderBy("valid_from")
    return versions.withColumn("next_from", F.lead("valid_from").over(window)).where(F.col("next_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("next_from") < F.col("valid_to"))))


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Violations of a foreign key."""
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def require_empty(violations: DataFrame, what: str) -> None:
    if violations.limit(1).count():
        raise ValueError(f"{what}: {violations.limit(3).collect()}")
