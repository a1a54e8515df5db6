"""Replays compared with what was captured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGED = ("final_url", "status_code", "tier_used")


def sha256(c):
    return F.sha2(c, 256)


def differences(captured: DataFrame, replayed: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, reproduced, differences, html_sha256, markdown_sha256) of captures that were replayed.

    Differences come in a fixed order: address, status, tier, page source; markdown is
    hashed but not compared. NULL equals NULL.
    """
    cols = [*CHANGED, "html", "markdown"]
    a = captured.select(key, *[F.col(c).alias(f"was_{c}") for c in cols])
    b = replayed.select(key, *[F.col(c).alias(f"is_{c}") for c in cols])
    j = a.join(b, key)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    found = [F.when(~F.col(f"was_{c}").eqNullSafe(F.col(f"is_{c}")), F.concat(F.lit(f"{c} changed ("), text(f"was_{c}"), F.lit(" -> "), text(f"is_{c}"), F.lit(")"))) for c in CHANGED]
    found.append(F.when(~sha256("was_html").eqNullSafe(sha256("is_html")), F.lit("source page content changed (html differs)")))
    return j.select(key, F.array_compact(F.array(*found)).alias("differences"), sha256("is_html").alias("html_sha256"), sha256("is_markdown").alias("markdown_sha256")).withColumn("reproduced", F.size("differences") == 0)


def extraction_differences(captured: DataFrame, replayed: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, data_differs, notes) comparing data as serialised text (key order counts) and the model's name."""
    a = captured.select(key, F.col("data").alias("was"), F.col("model").alias("was_model"))
    b = replayed.select(key, F.col("data").alias("is_"), F.col("model").alias("is_model"))
    differs = ~F.col("was").eqNullSafe(F.col("is_"))
    model = F.when((F.col("was_model") != "") & (F.col("was_model") != F.col("is_model")), F.concat(F.lit("extraction model changed ("), "was_model", F.lit(" -> "), "is_model", F.lit(")")))
    return a.join(b, key).select(key, differs.alias("data_differs"), F.array_compact(F.array(model, F.when(differs, F.lit("extraction_llm_nondeterministic")))).alias("notes"))


def replayable(request_ids: DataFrame, captured: DataFrame, crawl_pages: DataFrame) -> DataFrame:
    """request_ids with error_kind: not_found without a capture, crawl_page for a page of a crawl (only requests of their own can be replayed)."""
    there = captured.select("request_id").distinct().withColumn("_there", F.lit(True))
    of_crawl = crawl_pages.where("request_id is not null").select("request_id").distinct().withColumn("_crawl", F.lit(True))
    j = request_ids.select("request_id").distinct().join(there, "request_id", "left").join(of_crawl, "request_id", "left")
    return j.select("request_id", F.when(F.col("_there").isNull(), "not_found").when(F.col("_crawl"), "crawl_page").alias("error_kind"))
