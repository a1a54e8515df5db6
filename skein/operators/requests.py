"""Checks of request columns; a bad request is a row with error_kind client and the fields at fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.urls import host, is_web

# Bounds of requests.
DEPTH, PAGES, RESULTS = (0, 10), (1, 500), (1, 20)
DEFAULTS = {"max_depth": 2, "max_pages": 50, "same_domain_only": True, "ignore_robots_txt": False, "limit": 10}


def _report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return df.withColumn("at_fault", bad).withColumn("error_kind", F.when(F.size("at_fault") > 0, "client"))


def defaults(df: DataFrame) -> DataFrame:
    """NULLs of the known request columns filled with their defaults."""
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in df.columns})


def scrapes(df: DataFrame) -> DataFrame:
    return _report(df, {"url": is_web(F.col("url")) & host(F.col("url")).isNotNull()})


def crawls(df: DataFrame, url: str = "root_url") -> DataFrame:
    return _report(df, {url: is_web(F.col(url)) & host(F.col(url)).isNotNull(), "max_depth": F.col("max_depth").between(*DEPTH), "max_pages": F.col("max_pages").between(*PAGES)})


def searches(df: DataFrame) -> DataFrame:
    return _report(df, {"query": F.trim("query") != "", "limit": F.col("limit").between(*RESULTS)})
