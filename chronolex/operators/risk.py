"""Rulings and risk."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookback


def rulings_for(rulings: DataFrame, articles: DataFrame, outcome: str | None = None, cited: str = "cited_article_ids") -> DataFrame:
    """Rulings that cite each of the articles (article_id), newest first."""
    rows = rulings if outcome is None else rulings.where(F.col("outcome") == outcome)
    each = rows.withColumn("article_id", F.explode(F.array_distinct(cited)))
    return each.join(articles.select("article_id").distinct(), "article_id", "left_semi").orderBy("article_id", F.desc("decided_on"), "ruling_id")


def anti_avoidance_rate(articles: DataFrame, rulings: DataFrame, cited: str = "cited_article_ids", flags: str = "anti_avoidance") -> DataFrame:
    """Share of citing rulings with a flag; 0.0 where nothing cites the article. (article_id, total, flagged, rate)"""
    each = rulings.select(F.explode(F.array_distinct(cited)).alias("article_id"), (F.size(F.coalesce(flags, F.array().cast("array<string>"))) > 0).alias("flag"))
    counts = each.groupBy("article_id").agg(F.count("*").alias("total"), F.count_if("flag").alias("flagged"))
    joined = articles.select("article_id").distinct().join(counts, "article_id", "left").fillna(0, ["total", "flagged"])
    return joined.withColumn("rate", F.when(F.col("total") > 0, F.col("flagged") / F.col("total")).otherwise(0.0))


def find_claimable(candidates: DataFrame, today: date, article_ids: list[int] | None = None, lookback_years: int = 5) -> DataFrame:
    """Candidates alive or patched within the look-back, whose deadline is open; an empty list of articles means all."""
    rows = candidates.where(F.col("article_id").isin(*article_ids)) if article_ids else candidates
    return rows.where(
        F.col("status").isin("alive", "patched")
        & (F.col("patched_on").isNull() | (F.col("patched_on") >= lookback(today, lookback_years)))
        & (F.col("claim_deadline").isNull() | (F.col("claim_deadline") >= F.lit(today)))
    )
