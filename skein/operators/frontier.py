"""Crawling as a level-by-level frontier.

One level is one plan: take the pages that wait, scrape them, extract links, drop what was
seen, number the rest in discovery order and admit as many as the crawl's cap leaves.
Breadth-first levels give the pages, depths and order of a sequential first-in-first-out
crawl, because links are taken by (order of the parent, place on its page).
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import html as H
from skein.functions import urls
from skein.sources.stores import crawl_page_key, forget, materialize, numbered, snapshot_key

PAGE = "crawl_id string, seq bigint, url string, depth int, status string, attempt_count int, last_error string, tier string, final_url string"
TERMINAL = ("success", "failed")
log = logging.getLogger(__name__)


def discover(fetched: DataFrame, jobs: DataFrame) -> DataFrame:
    """(crawl_id, url, depth, parent_seq, pos): links of fetched pages within the bounds of their job.

    fetched: crawl_id, seq, depth, final_url, html. Pages at the depth limit are not
    expanded. Patterns are translated once per job.
    """
    bounds = jobs.select(F.col("id").alias("crawl_id"), "max_depth", "same_domain_only", urls.globs_to_regexes("include_patterns").alias("inc"), urls.globs_to_regexes("exclude_patterns").alias("exc"))
    open_ = fetched.join(bounds.select("crawl_id", "max_depth"), "crawl_id").where(F.col("depth") < F.col("max_depth"))
    each = H.links(open_, carry=("crawl_id", "seq", "depth", "final_url")).join(bounds.drop("max_depth"), "crawl_id")
    same = ~F.coalesce("same_domain_only", F.lit(True)) | (urls.host(F.col("link")) == urls.host(F.col("final_url")))
    ok = each.where(same & urls.allowed_by(urls.path(F.col("link")), F.col("inc"), F.col("exc")))
    return ok.select("crawl_id", F.col("link").alias("url"), (F.col("depth") + 1).alias("depth"), F.col("seq").alias("parent_seq"), "pos")


def admit(found: DataFrame, pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """(crawl_id, url, depth, seq): new pages in discovery order, as many as the cap leaves.

    pages: crawl_id, url, seq of all pages so far, the root included. The first discovery
    of a URL decides its depth. URLs are numbered in parts, so a crawl with most of the rows
    is not one task.
    """
    first = found.groupBy("crawl_id", "url").agg(F.min(F.struct("parent_seq", "pos", "depth")).alias("f"))
    new = first.join(pages.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti")
    have = pages.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("have"), F.max("seq").alias("last"))
    cap = jobs.select(F.col("id").alias("crawl_id"), "max_pages").join(have, "crawl_id")
    ranked = numbered(new.select("crawl_id", "url", "f.depth", "f.parent_seq", "f.pos"), "crawl_id", ["parent_seq", "pos", "url"], "rank")
    slots = F.greatest(F.col("max_pages") - F.col("have"), F.lit(0))
    return ranked.join(cap, "crawl_id").where(F.col("rank") <= slots).select("crawl_id", "url", "depth", (F.col("last") + F.col("rank")).cast("bigint").alias("seq"))


def corpus_scrape(corpus: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A scrape for crawl() that looks pages up in a corpus (url, final_url, html, status_code or none); what is not there or not 2xx fails."""
    cols = {c: c in corpus.columns for c in ("status_code", "markdown")}
    body = corpus.where(F.col("status_code").between(200, 299)) if cols["status_code"] else corpus
    body = body.dropDuplicates(["url"]).select("url", "final_url", "html", *(["status_code"] if cols["status_code"] else []), *(["markdown"] if cols["markdown"] else []))

    def scrape(requests: DataFrame) -> DataFrame:
        there = body.withColumn("tier", F.lit("static"))
        return requests.join(there, "url", "left").withColumn("error_kind", F.when(F.col("tier").isNull(), "all_tiers_failed"))

    return scrape


def _swallow(what: str, sink: Callable[[DataFrame], None] | None, rows: DataFrame) -> None:
    """A side effect never breaks a page: its failure is logged."""
    if sink is not None:
        try:
            sink(rows)
        except Exception as e:
            log.warning("%s sink failed: %s", what, e)


def crawl(
    jobs: DataFrame, scrape: Callable[[DataFrame], DataFrame], state: DataFrame | None = None, preflight: Column | None = None,
    contents: Callable[[DataFrame], None] | None = None, snapshots: Callable[[DataFrame], None] | None = None, costs: Callable[[DataFrame], None] | None = None, most_levels: int | None = None,
) -> DataFrame:
    """Every page of the jobs after the crawl, with the columns of PAGE.

    jobs: id, root_url, max_depth, max_pages, same_domain_only, include_patterns,
    exclude_patterns, and ignore_robots_txt or none. scrape(requests) gets (crawl_id, seq,
    depth, url, skip_robots) and returns them with tier, final_url, html and error_kind
    (NULL: success), and markdown or none. state: pages of an earlier run (PAGE); those that
    succeeded or failed are done and not touched, pending ones are taken up again, and crawls
    it knows get no new root. preflight: a message over the request's columns, NULL to go on;
    such a page fails without an attempt. Sinks get the pages of a level: contents (key,
    body), snapshots (key, body as JSON), costs (crawl_id, seq, tier, success); what they
    raise is logged.

    The root is stored as given, links as browsers serialise them, so `https://h` and
    `https://h/` are two pages. Children are admitted before their parent counts as done:
    both are one level's write. Every level is written to the shared folder, which cuts the
    lineage; the loop runs at most one more time than the largest depth limit of the jobs.
    """
    jobs = materialize(jobs.dropDuplicates(["id"]), "crawl-jobs")
    roots = jobs.select(F.col("id").alias("crawl_id"), F.lit(0).cast("bigint").alias("seq"), F.col("root_url").alias("url"), F.lit(0).alias("depth"), F.lit("pending").alias("status"), F.lit(0).alias("attempt_count"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("final_url"))
    if state is not None:
        known = state.select("crawl_id").distinct()
        roots = roots.join(known, "crawl_id", "left_anti").unionByName(state.select(*roots.columns).join(jobs.select(F.col("id").alias("crawl_id")), "crawl_id", "left_semi"))
    pages = materialize(roots, "crawl-pages")
    open_robots = F.coalesce(F.col("ignore_robots_txt"), F.lit(False)) if "ignore_robots_txt" in jobs.columns else F.lit(False)
    flags = jobs.select(F.col("id").alias("crawl_id"), open_robots.alias("skip_robots"))
    deepest = jobs.agg(F.max("max_depth")).first()[0] or 0
    for _ in range((deepest if most_levels is None else min(deepest, most_levels)) + 1):
        todo = pages.where(~F.col("status").isin(*TERMINAL) & (F.col("status") != "paused")).join(flags, "crawl_id").select("crawl_id", "seq", "depth", "url", "skip_robots", "attempt_count")
        if todo.isEmpty():
            break
        todo = todo.withColumn("held_back", (preflight if preflight is not None else F.lit(None)).cast("string"))
        out = scrape(todo.where("held_back is null").drop("held_back"))
        got = materialize(out if "markdown" in out.columns else out.withColumn("markdown", F.lit(None).cast("string")), "crawl-level")
        done = got.select("crawl_id", "seq", "url", "depth", F.when(F.col("error_kind").isNull(), "success").otherwise("failed").alias("status"), (F.col("attempt_count") + 1).alias("attempt_count"), F.col("error_kind").alias("last_error"), "tier", F.when(F.col("error_kind").isNull(), F.col("final_url")).alias("final_url"))
        back = todo.where("held_back is not null").select("crawl_id", "seq", "url", "depth", F.lit("failed").alias("status"), "attempt_count", F.col("held_back").alias("last_error"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("final_url"))
        good = got.where("error_kind is null")
        new = admit(discover(good.select("crawl_id", "seq", "depth", "final_url", "html"), jobs), pages, jobs)
        fresh = new.select("crawl_id", "seq", "url", "depth", F.lit("pending").alias("status"), F.lit(0).alias("attempt_count"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("final_url"))
        settled = done.unionByName(back)
        rest = pages.join(todo.select("crawl_id", "seq"), ["crawl_id", "seq"], "left_anti").select(*roots.columns)
        before, pages = pages, materialize(rest.unionByName(settled).unionByName(fresh), "crawl-pages")
        _swallow("cost", costs, got.select("crawl_id", "seq", "tier", F.col("error_kind").isNull().alias("success")))
        _swallow("content", contents, good.select(crawl_page_key(F.col("crawl_id"), F.col("seq")).alias("key"), F.coalesce("markdown", F.lit("")).alias("body")))
        whole = F.struct("url", "final_url", "tier", "html", "markdown")
        _swallow("snapshot", snapshots, good.select(snapshot_key(F.concat_ws("-", "crawl_id", F.col("seq").cast("string"))).alias("key"), F.to_json(whole).alias("body")))
        forget(before)
        forget(got)
    return pages


def page_counts(pages: DataFrame) -> DataFrame:
    """Pages of each crawl by status; second deliveries of an id count once."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return pages.dropDuplicates(["id"]).groupBy("crawl_id").agg(F.count(F.lit(1)).alias("total"), n("success"), n("failed"), n("pending"), n("paused"))


def crawl_overview(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Every job with its page counts, 0 without pages."""
    return jobs.select(F.col("id").alias("crawl_id"), "root_url").join(page_counts(pages), "crawl_id", "left").fillna(0, ["total", "success", "failed", "pending", "paused"])


def paused_of_session(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Paused pages of jobs that run under a session, with that session."""
    j = jobs.where("auth_session_id is not null").select(F.col("id").alias("crawl_id"), "auth_session_id", "max_depth", "max_pages")
    return pages.dropDuplicates(["id"]).where("status = 'paused'").join(j, "crawl_id").select(F.col("id").alias("page_id"), "crawl_id", "url", "depth", "auth_session_id", "max_depth", "max_pages")


def ordered_pages(pages: DataFrame) -> DataFrame:
    """Pages by crawl and discovery, id breaking ties, with their place in that order; a crawl of any size is numbered in parts."""
    d = pages.dropDuplicates(["id"]).select("id", "crawl_id", "url", "discovered_at")
    return numbered(d, "crawl_id", ["discovered_at", "id"]).select("crawl_id", "place", "id", "url")
