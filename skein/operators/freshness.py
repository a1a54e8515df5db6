"""Freshness of scraped pages: serving decisions, watched tiers, due pages, stored records.

Requests are rows (url, seq, ts, tier, ok). A serving decision depends on when the page was
last fetched, so the requests of a URL are folded one after another in the order of (ts,
seq), in batch and stream alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.stores import Blobs, freshness_key

# Seconds a page of a tier may be old, and whether it is fetched again unasked.
TIERS = {"news": (3600, True), "standard": (86400, False)}


def tier_column(tier: Column, part: int) -> Column:
    """The tier's seconds (part 0) or proactive flag (part 1); NULL for an unknown tier."""
    out = F.lit(None).cast("bigint" if part == 0 else "boolean")
    for name, values in TIERS.items():
        out = F.when(tier == name, F.lit(values[part])).otherwise(out)
    return out


def within_sla(crawled_at: Column, now: Column, max_seconds: Column) -> Column:
    """Whether an age in milliseconds is at most the tier's; exactly the limit is fresh."""
    return F.unix_millis(now) - F.unix_millis(crawled_at) <= max_seconds * 1000


#: A refetch of a stale page that takes longer is not waited for.
RACE_MS = 15_000
_STEP = "url string, seq bigint, decision string, crawled_ms bigint"


def decide(crawled: int | None, landing: list[int], at: int, limit: int | None, ok: bool, latency: int = 0) -> tuple[str, int | None, list[int]]:
    """One step of the fold: (decision, when the copy was crawled, refetches under way); times in milliseconds."""
    landed = [x for x in landing if x <= at]
    if landed:
        crawled, landing = max(landed), [x for x in landing if x > at]
    if limit is None:
        return "unknown", crawled, landing
    if crawled is not None and at - crawled <= limit * 1000:
        return "hit", crawled, landing
    if crawled is not None and latency > RACE_MS:
        return "stale", crawled, [*landing, at + latency] if ok else landing
    if ok:
        return "fetch", at, landing
    return ("stale" if crawled is not None else "error"), crawled, landing


def fold_columns(requests: DataFrame) -> DataFrame:
    """(url, seq, at, limit, ok, latency) of requests; latency_ms is optional."""
    late = F.coalesce(F.col("latency_ms"), F.lit(0)) if "latency_ms" in requests.columns else F.lit(0)
    return requests.select("url", F.col("seq").cast("bigint").alias("seq"), F.unix_millis(F.col("ts")).alias("at"), F.col("max_seconds").cast("bigint").alias("limit"), F.coalesce(F.col("ok"), F.lit(False)).alias("ok"), late.cast("bigint").alias("latency"))


def replay(requests: DataFrame) -> DataFrame:
    """(url, seq, decision, crawled_at): what each request is served.

    requests: url, seq, ts, max_seconds, ok, and latency_ms of the fetch or none. hit: cached
    and fresh for the requested tier, nothing is fetched. fetch: fetched (cache missing or
    stale). stale: the fetch failed or took more than 15 s, the old copy is served; a slow
    fetch that succeeds is written back when it ends. error: the fetch failed and nothing
    was cached. unknown: no such tier (max_seconds NULL); changes nothing. A URL's requests
    lie sorted in one partition and are read one after another, so a hot URL costs time in
    its task but no memory.
    """

    def run(batches):
        import pandas as pd

        last, crawled, landing = None, None, []
        for b in batches:
            out = []
            for url, seq, at, limit, ok, late in zip(b["url"], b["seq"], b["at"], b["limit"], b["ok"], b["latency"], strict=True):
                if url != last:
                    last, crawled, landing = url, None, []
                kind, crawled, landing = decide(crawled, landing, int(at), None if pd.isna(limit) else int(limit), bool(ok), int(late))
                out.append((url, seq, kind, crawled))
            yield pd.DataFrame(out, columns=["url", "seq", "decision", "crawled_ms"]).astype({"crawled_ms": "Int64"})

    cols = fold_columns(requests).where("url is not null and at is not null")
    return cols.repartition("url").sortWithinPartitions("url", "at", "seq").mapInPandas(run, _STEP).select("url", "seq", "decision", F.timestamp_millis("crawled_ms").alias("crawled_at"))


def tighten(records: DataFrame) -> DataFrame:
    """State per URL after recorded fetches (url, seq, tier, crawled_at, content).

    The strictest tier ever asked for is kept (the first of equal ones), content and
    crawled_at come from the last record; next_due_at follows from both.
    """
    limit = tier_column(F.col("tier"), 0)
    rec = records.withColumn("limit", limit).where("limit is not null")
    strict = F.min(F.struct("limit", "seq", "tier"))
    last = F.max(F.struct("seq", "crawled_at", "content"))
    state = rec.groupBy("url").agg(strict.alias("s"), last.alias("l"))
    out = state.select("url", F.col("s.tier").alias("watched_tier"), F.col("s.limit").alias("max_staleness_seconds"), tier_column(F.col("s.tier"), 1).alias("proactive"), F.col("l.crawled_at").alias("crawled_at"), F.col("l.content").alias("content"))
    return out.withColumn("next_due_at", F.timestamp_millis(F.unix_millis("crawled_at") + F.col("max_staleness_seconds") * 1000))


def merge_state(state: DataFrame, records: DataFrame) -> DataFrame:
    """Upsert of recorded fetches into a stored state with the same rules."""
    new = tighten(records)
    old = state.select("url", *[F.col(c).alias(f"old_{c}") for c in ("watched_tier", "max_staleness_seconds", "proactive", "crawled_at", "content")])
    j = new.join(old, "url", "full")
    adopt = F.col("old_max_staleness_seconds").isNull() | (F.col("max_staleness_seconds") < F.col("old_max_staleness_seconds"))
    pick = lambda c: F.when(adopt, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    late = lambda c: F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c)
    out = j.select("url", pick("watched_tier"), pick("max_staleness_seconds"), pick("proactive"), late("crawled_at"), late("content"))
    return out.withColumn("next_due_at", F.timestamp_millis(F.unix_millis("crawled_at") + F.col("max_staleness_seconds") * 1000))


def due(state: DataFrame, now: Column) -> DataFrame:
    return state.where(F.col("proactive") & (F.col("next_due_at") <= now)).select("url", "watched_tier", "next_due_at")


def lookup(requests: DataFrame, state: DataFrame) -> DataFrame:
    """requests with the cached record; content that is no JSON object with a string markdown is a miss."""
    ok = F.schema_of_variant(F.try_variant_get(F.try_parse_json("content"), "$.markdown", "variant")) == "STRING"
    return requests.join(state.where(ok), "url", "left")


def delete(state: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state without urls, urls with existed)."""
    u = urls.select("url").distinct()
    there = state.select("url").distinct().withColumn("existed", F.lit(True))
    return state.join(u, "url", "left_anti"), u.join(there, "url", "left").fillna({"existed": False})


def record_composite(bodies: Blobs, state: DataFrame, records: DataFrame) -> DataFrame:
    """The metadata after recorded fetches whose bodies are stored apart, body first.

    records: as for tighten(), content being the page as JSON. The body is there before any
    metadata names it; a failure between both leaves a body that nothing names.
    """
    last = records.where(tier_column(F.col("tier"), 0).isNotNull()).groupBy("url").agg(F.max_by("content", "seq").alias("body"))
    bodies.put(last.select(freshness_key(F.col("url")).alias("key"), "body"))
    return merge_state(state, records).withColumn("content", F.lit(None).cast("string"))


def lookup_composite(bodies: Blobs, requests: DataFrame, state: DataFrame) -> DataFrame:
    """lookup() over metadata and bodies: a missing body is a miss, as is one that is no page."""
    keys = state.select(freshness_key(F.col("url")).alias("key"))
    found = state.drop("content").withColumn("key", freshness_key(F.col("url"))).join(bodies.get(keys).withColumnRenamed("body", "content"), "key").drop("key")
    return lookup(requests, found)


def delete_composite(bodies: Blobs, state: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """delete() with the bodies going first, so that a failure can be repeated; bodies without metadata go too."""
    bodies.delete(urls.select(freshness_key(F.col("url")).alias("key")))
    return delete(state, urls)
