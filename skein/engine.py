"""One object that composes the operators; every outside concern is a port without default provider."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import html as H
from skein.functions import robots as R
from skein.functions import urls
from skein.functions.jsonschema import Validator, tool_schema
from skein.functions.text import utf16_length
from skein.operators import extraction, freshness, frontier, replay, search, verify
from skein.sources import stores


class NotConfigured(RuntimeError):
    """A port that the call needs has no provider."""

    kind = "not_configured"


@dataclass
class Engine:
    """Set-oriented scrape, crawl, extract and search over DataFrames.

    corpus: plain fetches (url, final_url, status_code, html); rendered: pages after their
    scripts ran, or None where no renderer is there; robots: rules by origin; extractor(page
    text, schema) -> (status, answer) calls a model; searcher(query, limit) -> DataFrame;
    cache: freshness records (see operators.freshness.tighten), or None; clock: the time.
    Any of them is replaced by naming it: Engine(spark, corpus=..., clock=...).

    Failures are rows with an error_kind: client, robots_disallowed, all_tiers_failed,
    internal, upstream, unknown_tier.
    """

    spark: SparkSession
    corpus: DataFrame | None = None
    rendered: DataFrame | None = None
    robots: DataFrame | None = None
    extractor: Callable[[str, dict], tuple[int, str]] | None = None
    searcher: Callable[[str, int], DataFrame] | None = None
    cache: DataFrame | None = None
    clock: Callable[[], dt.datetime] = field(default=lambda: dt.datetime.now(dt.UTC))

    def _need(self, value, name: str):
        if value is None:
            raise NotConfigured(f"no {name} is configured")
        return value

    def _now(self):
        return F.lit(self.clock()).cast("timestamp")

    def _gate(self, asked: DataFrame) -> DataFrame:
        """asked (url, skip_robots, ...) with error_kind of requests that must not be fetched."""
        own = asked.withColumn("origin", urls.origin(F.col("url"))).withColumn("path", urls.path(F.col("url")))
        own = R.decide(own, self.robots) if self.robots is not None else own.withColumn("robots_allowed", F.lit(True))
        shut = ~F.col("robots_allowed") & ~F.coalesce("skip_robots", F.lit(False))
        return own.withColumn("error_kind", F.when(~urls.is_web(F.col("url")), "client").when(shut, "robots_disallowed")).drop("origin", "path", "robots_allowed")

    def scrape(self, requests: DataFrame) -> DataFrame:
        """requests (request_id, url, skip_robots, and session or none) with one page's title, markdown, text, html, final_url and status_code, tier and attempts.

        Pages come whole from one tier. Statuses outside 2xx count as failed fetches. A
        repeated request_id is served once per row.
        """
        corpus = self._need(self.corpus, "corpus")
        cols = ["session"] if "session" in requests.columns else []
        asked = self._gate(requests.select("request_id", "url", "skip_robots", *cols))
        shut = asked.where("error_kind is not null").select("request_id", "url", "error_kind")
        todo = asked.where("error_kind is null").select("request_id", "url", *cols)
        wanted = todo.select("url").distinct()

        def read(pages: DataFrame, of: DataFrame) -> DataFrame:
            own = stores.fetched(pages.select("url", "final_url", "status_code", "html").join(of, "url", "left_semi"))
            return own.withColumn("c", H.content(F.col("html"))).select("url", "final_url", "status_code", "html", "c.title", "c.markdown", "c.text")

        plain = stores.materialize(read(corpus, wanted), "scrape-plain")
        shown = None
        if self.rendered is not None:
            # only pages that may be needed are taken apart: under a session, missing or thin ones
            thick = plain.where(utf16_length(F.col("text")) >= stores.THIN).select("url")
            under = todo.where("session").select("url") if cols else todo.where(F.lit(False)).select("url")
            shown = stores.materialize(read(self.rendered, wanted.join(thick, "url", "left_anti").unionByName(under).distinct()), "scrape-rendered")
        return stores.scrape_tiers(todo, plain, shown).drop("session").unionByName(shut, allowMissingColumns=True)

    def scrape_fresh(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(served, records) of requests that name a freshness tier, or none.

        served: scrape()'s columns, content (the page as JSON), from_cache, crawled_at and
        within_sla. A request without tier never sees the cache; a fresh copy is served
        without a fetch and records nothing; a stale or missing one is fetched, and if that
        fails a stale copy is served with within_sla false. An unknown tier is an error
        before any fetch. records: what the fetches add to the cache, for
        freshness.merge_state.
        """
        cache = self.cache if self.cache is not None else self.spark.createDataFrame([], "url string, watched_tier string, max_staleness_seconds bigint, crawled_at timestamp, content string")
        limit = freshness.tier_column(F.col("tier_asked"), 0)
        asked = requests.withColumnRenamed("tier", "tier_asked").withColumn("max_seconds", limit)
        wrong = asked.where("tier_asked is not null and max_seconds is null").select("request_id", "url", F.lit("unknown_tier").alias("error_kind"))
        fine = asked.where("tier_asked is null or max_seconds is not null")
        held = freshness.lookup(fine, cache.select("url", F.col("crawled_at").alias("was_at"), "content"))
        fresh = F.col("max_seconds").isNotNull() & F.col("content").isNotNull() & freshness.within_sla(F.col("was_at"), self._now(), F.col("max_seconds"))
        held = stores.materialize(held.withColumn("fresh", F.coalesce(fresh, F.lit(False))), "scrape-held")
        hits = held.where("fresh").select("request_id", "url", "content", F.lit(True).alias("from_cache"), F.col("was_at").alias("crawled_at"), F.lit(True).alias("within_sla"))
        got = stores.materialize(self.scrape(held.where("not fresh")), "scrape-got")
        page = F.to_json(F.struct("markdown", "title", "final_url"))
        j = got.join(held.where("not fresh").select("request_id", "tier_asked", "max_seconds", "was_at", F.col("content").alias("old")), "request_id")
        saved = F.col("error_kind").isNotNull() & F.col("old").isNotNull() & F.col("max_seconds").isNotNull()
        out = j.select(*[c for c in got.columns if c != "error_kind"], F.when(~saved, F.col("error_kind")).alias("error_kind"), F.when(saved, F.col("old")).when(F.col("error_kind").isNull(), page).alias("content"), saved.alias("from_cache"),
                       F.when(saved, F.col("was_at")).when(F.col("error_kind").isNull(), self._now()).alias("crawled_at"), F.when(saved, F.lit(False)).when(F.col("error_kind").isNull() & F.col("max_seconds").isNotNull(), F.lit(True)).alias("within_sla"))
        records = j.where("error_kind is null and max_seconds is not null").select("url", F.xxhash64("request_id").alias("seq"), F.col("tier_asked").alias("tier"), self._now().alias("crawled_at"), page.alias("content"))
        return out.unionByName(hits, allowMissingColumns=True).unionByName(wrong, allowMissingColumns=True), records

    def crawl(self, jobs: DataFrame, **options) -> DataFrame:
        """frontier.crawl() with scrape() as its page processor."""

        def scrape(requests: DataFrame) -> DataFrame:
            keyed = requests.withColumn("request_id", F.concat_ws("-", "crawl_id", F.col("seq").cast("string")))
            got = self.scrape(keyed.select("request_id", "url", "skip_robots")).select("request_id", "tier", "final_url", "html", "markdown", "error_kind")
            return keyed.join(got, "request_id").drop("request_id")

        return frontier.crawl(jobs, scrape, **options)

    def extract(self, requests: DataFrame, schema: dict) -> DataFrame:
        """Verified fields (request_id, final_url, field, position, value, confidence, quote, support_score, verified, flagged), and a row with error_kind of each request that failed.

        The schema is checked before anything is fetched; a fresh fetch serves every request.
        """
        Validator(schema)
        Validator(tool_schema(schema))
        call = self._need(self.extractor, "extractor")
        pages = stores.materialize(self.scrape(requests), "extract-pages")
        answers = stores.materialize(extraction.extract(pages.where("error_kind is null").select("request_id", "text"), schema, call), "extract-answers")
        failed = pages.where("error_kind is not null").select("request_id", "error_kind").unionByName(answers.where("error_kind is not null").select("request_id", "error_kind"))
        done = verify.verify(extraction.fields(answers), pages.select("request_id", "text"), key="request_id")
        out = done.withColumn("flagged", verify.is_flagged(F.col("confidence"), F.col("verified"), F.col("support_score")))
        return out.join(pages.select("request_id", "final_url"), "request_id").unionByName(failed, allowMissingColumns=True)

    def search(self, query: str, limit: int = 10) -> DataFrame:
        if not query.strip() or not 1 <= limit <= 20:
            raise ValueError("a query and a limit of 1 to 20 are needed")
        return self._need(self.searcher, "searcher")(query, limit)

    def local_searcher(self, documents: DataFrame) -> Callable[[str, int], DataFrame]:
        return lambda query, limit: search.top_k(documents, query, limit)

    def fresh(self, requests: DataFrame) -> DataFrame:
        """Serving decisions of timed requests (url, seq, ts, tier, ok)."""
        return freshness.replay(requests.withColumn("max_seconds", freshness.tier_column(F.col("tier"), 0)))

    def replay(self, captured: DataFrame, replayed: DataFrame) -> DataFrame:
        return replay.differences(captured, replayed)
