"""Paged listings, fetched a stretch of pages at a time into an archive that says where to go on."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import settings
from .keyed_table import KeyedTable
from .raw_zone import with_retries

PAGES = "target string, query string, page int, xml string, items int, total int"
FetchPage = Callable[[str, str, int], str]


def listing_archive(spark: SparkSession, folder: str, buckets: int = 16) -> KeyedTable:
    """Pages as fetched, with how many rows each holds and how many its listing reports."""
    return KeyedTable(spark, folder, PAGES, ["target", "query", "page"], buckets=buckets)


def missing_pages(listings: DataFrame, archive: KeyedTable, page_size: int, max_pages: int | None = None) -> DataFrame:
    """target, query, page: of listings (target, query) the pages that the archive lacks. The first page tells how many there are."""
    had = archive.read().select("target", "query", "page", "total")
    last = F.ceil(F.greatest(F.coalesce("total", F.lit(1)), F.lit(1)) / page_size)
    last = last if max_pages is None else F.least(last, F.lit(max_pages))
    reported = had.groupBy("target", "query").agg(F.max_by("total", "page").alias("total"))
    wanted = listings.select("target", "query").distinct().join(reported, ["target", "query"], "left").select("target", "query", F.explode(F.sequence(F.lit(1), last.cast("int"))).alias("page"))
    return wanted.join(had.select("target", "query", "page"), ["target", "query", "page"], "left_anti")


def fetch_listings(
    listings: DataFrame, fetch: FetchPage, measure: Callable[[str], tuple[int, int]], archive: KeyedTable, page_size: int = 20, max_pages: int | None = None, at_a_time: int = 1000, slots: int = 1
) -> DataFrame:
    """All pages of the listings (target, query), from the archive. At most `max_pages` of each are fetched (None: all).

    Pages are fetched `at_a_time`, by `slots` tasks at once, each of which pauses between its calls, so that the source sees at most
    slots / pause calls a second; tries and pause are the session's settings. Each stretch is committed when it ends: a run that is
    stopped goes on with the pages that are missing, and fetches none twice that was committed. `measure` tells of a page how many rows
    it holds and how many the listing has."""
    knobs = settings(archive.spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for target, query, page in rows[["target", "query", "page"]].itertuples(index=False):
                one = with_retries(lambda n, t=target, q=query: fetch(t, q, n), tries=knobs.tries, wait=time.sleep, pause=knobs.pause_seconds)
                xml = one(int(page))
                items, total = measure(xml)
                yield pd.DataFrame({"target": [target], "query": [query], "page": [page], "xml": [xml], "items": [items], "total": [total]})

    while True:
        stretch = missing_pages(listings, archive, page_size, max_pages).orderBy("page", "target", "query").limit(at_a_time)
        fetched = stretch.repartition(slots).mapInPandas(run, PAGES)
        if not archive.insert_ignore(fetched):
            return archive.read().join(listings.select("target", "query").distinct(), ["target", "query"], "left_semi")
