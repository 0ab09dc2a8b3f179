"""Knobs of retrieval and of the raw zone, taken from the Spark session's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.chronolex."


@dataclass(frozen=True)
class Settings:
    retrieve_top_k: int = 30
    rerank_top_k: int = 5
    rrf_k: int = 60
    raw_root: str = ""
    pause_seconds: float = 0.0
    tries: int = 3


def settings(spark: SparkSession) -> Settings:
    """Each knob as `spark.chronolex.<name>` says, else its default; a value of another type is an error."""
    defaults = Settings()
    given = {f.name: spark.conf.get(PREFIX + f.name, None) for f in fields(Settings)}
    return Settings(**{k: type(getattr(defaults, k))(v) for k, v in given.items() if v is not None})
