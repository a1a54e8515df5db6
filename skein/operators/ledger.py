"""The ledger of fetch attempts and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def attempts(results: DataFrame) -> DataFrame:
    """(result_id, attempt, tier, success): one row per recorded attempt, in order; NULL or empty lists give none."""
    return results.select("result_id", F.posexplode("attempts").alias("attempt", "a")).select("result_id", "attempt", "a.tier", "a.success")


def valid_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows need a request id and whole, finite cents; tier and success have defaults."""
    c = F.col("cents").cast("double")
    fine = F.coalesce((F.col("request_id") != "") & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e15) & (c == F.floor(c)), F.lit(False))
    out = events.withColumns({"tier": F.coalesce("tier", F.lit("static")), "success": F.coalesce("success", F.lit(True))})
    return out.where(fine), events.where(~fine)


def once(events: DataFrame, key: str = "id") -> DataFrame:
    """Events without second deliveries."""
    return events.dropDuplicates([key])


def request_costs(requests: DataFrame, events: DataFrame) -> DataFrame:
    """requests with cost_cents: the sum over their events, 0 without any; events without request never count."""
    sums = events.where("request_id is not null").groupBy("request_id").agg(F.sum("cents").alias("cost_cents"))
    return requests.drop("cost_cents").join(sums, "request_id", "left").fillna({"cost_cents": 0})


def with_events(requests: DataFrame, events: DataFrame) -> DataFrame:
    return requests.join(events.select("request_id"), "request_id", "left_semi")


def daily(events: DataFrame) -> DataFrame:
    """Cents and successes per UTC day and tier."""
    return events.groupBy(F.to_date("created_at").cast("string").alias("day"), "tier").agg(F.count(F.lit(1)).alias("events"), F.count_if("success").alias("successes"), F.sum("cents").alias("cents"))
