"""The queries of the core operators over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import crypto, hosts, robots, urls
from skein.functions import html as H
from skein.functions.jsonschema import conforms
from skein.functions.text import strings_match, strip_headings, utf16_length
from skein.operators import freshness, frontier, ledger, replay, requests, search, verify
from skein.sources import stores
from skein.sources.stores import table
from skein.streaming import tables as streams

AGENT = "skein"
# The rules that robots_decision applies to every site.
ROBOTS = "User-agent: *\nDisallow: /faq/\nAllow: /faq/l\nDisallow: /*/d*-\nAllow: /docs/d\n\nUser-agent: other\nDisallow: /\n"
QUERY = "harbour office release timetable garden la de"
NOW = "2024-01-25 12:00:00"
SCHEMA = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 80}}, "required": ["k"]}
KEY = bytes(range(32))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_HOST = r"nullif(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"
_PATH = r"CASE WHEN regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?[^/?#]*([^?#]*)', 1) END"
_ORIGIN = r"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1))"
_EVEN = r"lower(trim(regexp_replace({c}, '[\t-\r \x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g')))"


@query(r"""
SELECT result_id, regexp_extract(final_url, '^[A-Za-z][A-Za-z0-9+.\-]*', 0) AS scheme, """ + _HOST.format(u="final_url") + " AS host, " + _PATH.format(u="final_url") + r""" AS path,
       regexp_replace(final_url, '#.*$', '') AS plain, regexp_matches(final_url, '^(?i)https?://') AS web
FROM scrape_results WHERE final_url IS NOT NULL""")
def url_parts(spark, d):
    u = F.col("final_url")
    return table(spark, d, "scrape_results").where("final_url is not null").select("result_id", F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*", 0).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.without_fragment(u).alias("plain"), urls.is_web(u).alias("web"))


@query("SELECT result_id, lower(regexp_extract(final_url, '^[A-Za-z]+://[^/?#]*')) || coalesce(nullif(regexp_extract(final_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(final_url, '[?][^#]*') AS url FROM scrape_results WHERE final_url IS NOT NULL")
def url_normalized(spark, d):
    u = F.col("final_url")
    return table(spark, d, "scrape_results").where("final_url is not null").select("result_id", urls.resolve_url(u, u).alias("url"))


@query("SELECT result_id, regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1) AS title FROM scrape_results")
def page_title_raw(spark, d):
    return table(spark, d, "scrape_results").select("result_id", H.raw_title(F.col("html")).alias("title"))


_STRIP = "html"
for _tag in ("nav", "footer", "header", "aside"):
    _STRIP = rf"regexp_replace({_STRIP}, '(?s)<{_tag}\b[^>]*>.*?</{_tag}>', '', 'g')"


@query(f"SELECT result_id, length({_STRIP}) AS chars, md5({_STRIP}) AS body FROM scrape_results")
def strip_boilerplate_native(spark, d):
    s = H.strip_tags_native(F.col("html"))
    return table(spark, d, "scrape_results").select("result_id", s.alias("s")).select("result_id", F.length("s").alias("chars"), F.md5("s").alias("body"))


@query()
def page_content(spark, d):
    return stores.spread(table(spark, d, "scrape_results").select("result_id", "html")).select("result_id", H.content(F.col("html")).alias("c")).select("result_id", "c.title", "c.markdown", "c.text")


# every href of the tables is root-relative or absolute; other forms are covered by the link cases of skein.plans.cases
_LINKS = r"""
WITH a AS (SELECT result_id, crawl_id, final_url, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS hs FROM scrape_results WHERE final_url IS NOT NULL),
e AS (SELECT result_id, crawl_id, final_url, unnest(hs) AS href, unnest(range(len(hs))) AS pos FROM a),
r AS (SELECT result_id, crawl_id, final_url, pos, CASE WHEN regexp_matches(href, '^(?i)https?://') THEN regexp_replace(href, '#.*$', '') WHEN href LIKE '/%' THEN """ + _ORIGIN.format(u="final_url") + r""" || regexp_replace(href, '#.*$', '') END AS link FROM e),
x AS (SELECT * REPLACE (array_to_string(list_transform(string_split(link, ''), lambda c: CASE WHEN unicode(c) > 127 THEN url_encode(c) ELSE c END), '') AS link) FROM r WHERE link IS NOT NULL),
l AS (SELECT result_id, crawl_id, final_url, link, min(pos)::INT AS pos FROM x GROUP BY ALL)
"""


def _links(spark, d):
    t = table(spark, d, "scrape_results").where("final_url is not null").select("result_id", "crawl_id", "final_url", "html")
    return H.links(t, carry=("result_id", "crawl_id", "final_url"))


@query(_LINKS + "SELECT result_id, link, pos FROM l")
def links_full(spark, d):
    return _links(spark, d).select("result_id", "link", "pos")


_RX = r"list_transform({p}, lambda x: '^' || replace(replace(x, '/**', '(?:/[^/.][^/]*)*/?'), '*', '[^/.][^/]*') || '$')"


@query(_LINKS + ", j AS (SELECT id, max(include_patterns) AS inc, max(exclude_patterns) AS exc FROM crawl_jobs GROUP BY id), b AS (SELECT l.*, inc, exc, " + _PATH.format(u="link") + r""" AS p FROM l JOIN j ON l.crawl_id = j.id)
SELECT result_id, link FROM b
WHERE (coalesce(len(inc), 0) = 0 OR len(list_filter(inc, lambda x: regexp_matches(p, CASE WHEN x LIKE '%/**' THEN '^' || replace(x, '/**', '/') || '(?:[^/.][^/]*(?:/[^/.][^/]*)*/?)?$' ELSE '^' || replace(x, '*', '[^/.][^/]*') || '$' END))) > 0)
  AND len(list_filter(coalesce(exc, []), lambda x: regexp_matches(p, CASE WHEN x LIKE '%/**' THEN '^' || replace(x, '/**', '/') || '(?:[^/.][^/]*(?:/[^/.][^/]*)*/?)?$' ELSE '^' || replace(x, '*', '[^/.][^/]*') || '$' END))) = 0""")
def links_within_bounds(spark, d):
    jobs = table(spark, d, "crawl_jobs").dropDuplicates(["id"]).select(F.col("id").alias("crawl_id"), urls.globs_to_regexes("include_patterns").alias("inc"), urls.globs_to_regexes("exclude_patterns").alias("exc"))
    j = _links(spark, d).join(jobs, "crawl_id")
    return j.where(urls.allowed_by(urls.path(F.col("link")), F.col("inc"), F.col("exc"))).select("result_id", "link")


@query(_LINKS + """
, p AS (SELECT DISTINCT id, crawl_id, url FROM crawl_pages),
have AS (SELECT crawl_id, count(*) AS n FROM p GROUP BY crawl_id),
f AS (SELECT crawl_id, link, min(struct_pack(a := result_id, b := pos)) AS f FROM l WHERE crawl_id IS NOT NULL GROUP BY crawl_id, link),
new AS (SELECT f.*, row_number() OVER (PARTITION BY f.crawl_id ORDER BY f.f.a, f.f.b) AS rank FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.crawl_id = f.crawl_id AND p.url = f.link))
SELECT new.crawl_id, link AS url, rank FROM new JOIN have ON new.crawl_id = have.crawl_id JOIN crawl_jobs j ON j.id = new.crawl_id WHERE rank <= greatest(max_pages - n, 0)""")
def crawl_admitted_links(spark, d):
    found = _links(spark, d).where("crawl_id is not null").select("crawl_id", F.col("link").alias("url"), F.lit(1).alias("depth"), F.col("result_id").alias("parent_seq"), "pos")
    pages = table(spark, d, "crawl_pages").select("id", "crawl_id", "url").dropDuplicates(["id"]).withColumn("seq", F.lit(0).cast("bigint"))
    return frontier.admit(found, pages, table(spark, d, "crawl_jobs")).select("crawl_id", "url", F.col("seq").alias("rank"))


@query()
def crawl_graph(spark, d):
    t = table(spark, d, "scrape_results").where("final_url is not null")
    # the tables hold no root pages, so every crawl starts from its least address
    start = t.where("crawl_id is not null").groupBy(F.col("crawl_id").alias("id")).agg(F.min("final_url").alias("root_url"))
    jobs = table(spark, d, "crawl_jobs").drop("root_url").join(start, "id")
    return frontier.crawl(jobs, frontier.corpus_scrape(t.select(F.col("final_url").alias("url"), "final_url", "html")))


_STATUS = "count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'paused') AS paused"


@query(f"SELECT crawl_id, count(*) AS total, {_STATUS} FROM (SELECT DISTINCT id, crawl_id, status FROM crawl_pages) GROUP BY crawl_id")
def crawl_page_counts(spark, d):
    return frontier.page_counts(table(spark, d, "crawl_pages"))


@query(f"""WITH c AS (SELECT crawl_id, count(*) AS total, {_STATUS} FROM (SELECT DISTINCT id, crawl_id, status FROM crawl_pages) GROUP BY crawl_id)
SELECT j.id AS crawl_id, root_url, coalesce(total, 0) AS total, coalesce(success, 0) AS success, coalesce(failed, 0) AS failed, coalesce(pending, 0) AS pending, coalesce(paused, 0) AS paused
FROM crawl_jobs j LEFT JOIN c ON c.crawl_id = j.id""")
def crawl_overview(spark, d):
    return frontier.crawl_overview(table(spark, d, "crawl_jobs"), table(spark, d, "crawl_pages"))


@query("""SELECT p.id AS page_id, p.crawl_id, p.url, p.depth, j.auth_session_id, j.max_depth, j.max_pages
FROM (SELECT DISTINCT id, crawl_id, url, depth, status FROM crawl_pages) p JOIN crawl_jobs j ON p.crawl_id = j.id WHERE p.status = 'paused' AND j.auth_session_id IS NOT NULL""")
def crawl_paused_join(spark, d):
    return frontier.paused_of_session(table(spark, d, "crawl_jobs"), table(spark, d, "crawl_pages"))


@query("""SELECT crawl_id, row_number() OVER (PARTITION BY crawl_id ORDER BY discovered_at, id) AS place, id, url
FROM (SELECT DISTINCT id, crawl_id, url, discovered_at FROM crawl_pages)""")
def crawl_pages_ordered(spark, d):
    return frontier.ordered_pages(table(spark, d, "crawl_pages"))


@query("""WITH j AS (SELECT id, coalesce(max_depth, 2) AS d, coalesce(max_pages, 50) AS p FROM crawl_jobs)
SELECT id, concat_ws(',', CASE WHEN d NOT BETWEEN 0 AND 10 THEN 'max_depth' END, CASE WHEN p NOT BETWEEN 1 AND 500 THEN 'max_pages' END) AS at_fault, CASE WHEN d BETWEEN 0 AND 10 AND p BETWEEN 1 AND 500 THEN NULL ELSE 'client' END AS error_kind FROM j""")
def requests_checked(spark, d):
    out = requests.crawls(requests.defaults(table(spark, d, "crawl_jobs")))
    return out.select("id", F.array_join("at_fault", ",").alias("at_fault"), "error_kind")


_SUPPORTED = f"""
WITH c AS (SELECT DISTINCT citation_id, result_id, request_id, field, quote, support_score, verified FROM citations),
v AS (SELECT c.*, coalesce({_EVEN.format(c="c.quote")} <> '' AND contains({_EVEN.format(c="s.text")}, {_EVEN.format(c="c.quote")}), false) AS ok FROM c LEFT JOIN scrape_results s ON c.result_id = s.result_id)
"""


def _verified(spark, d):
    cites = table(spark, d, "citations").dropDuplicates(["citation_id"])
    return verify.verify(cites, table(spark, d, "scrape_results"))


@query(_SUPPORTED + "SELECT citation_id, ok AS verified, CASE WHEN ok THEN coalesce(support_score, 0.0) ELSE 0.0 END AS support_score FROM v")
def citation_verified(spark, d):
    return _verified(spark, d).select("citation_id", "verified", "support_score")


@query(_SUPPORTED + """SELECT field, count(*) AS fields, count(*) FILTER (quote IS NOT NULL) AS cited, round(count(*) FILTER (coalesce(ok = verified, false)) / count(*), 6) AS field_accuracy,
round(count(*) FILTER (quote IS NOT NULL AND ok) / count(*) FILTER (quote IS NOT NULL), 6) AS citation_rate,
round(count(*) FILTER (coalesce(confidence < 0.7, false) OR (ok AND s >= 0.7)) / count(*), 6) AS soft_rate
FROM (SELECT *, support_score AS confidence, CASE WHEN ok THEN coalesce(support_score, 0.0) ELSE 0.0 END AS s FROM v) GROUP BY field""")
def citation_rates(spark, d):
    claimed = table(spark, d, "citations").dropDuplicates(["citation_id"]).select("citation_id", F.col("verified").alias("claimed"), F.col("support_score").alias("confidence"))
    v = _verified(spark, d).join(claimed, "citation_id")
    return verify.rates(v.withColumns({"matched": F.col("claimed") == F.col("verified"), "cited": F.col("quote").isNotNull()}), ["field"])


@query(_SUPPORTED + """SELECT request_id, string_agg(field, ',' ORDER BY citation_id) FILTER (coalesce(support_score, 0) < 0.7 OR NOT ok) AS flagged FROM v WHERE request_id IS NOT NULL GROUP BY request_id""")
def flagged_fields(spark, d):
    cites = table(spark, d, "citations").dropDuplicates(["citation_id"]).where("request_id is not null")
    conf = cites.select("citation_id", F.col("support_score").alias("confidence"))
    filled = _verified(spark, d).where("request_id is not null").join(conf, "citation_id").withColumnRenamed("citation_id", "position")
    out = verify.flagged_fields(filled)
    return out.select("request_id", F.nullif(F.array_join("flagged", ","), F.lit("")).alias("flagged"))


@query(r"""WITH t AS (SELECT result_id, title, regexp_extract(markdown, '(?m)^#[ \t]+(.*)$', 1) AS h FROM scrape_results WHERE title IS NOT NULL AND markdown IS NOT NULL)
SELECT result_id, lower(regexp_replace(title, '^[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g')) = lower(regexp_replace(h, '^[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g')) AS matched FROM t""")
def field_match(spark, d):
    t = table(spark, d, "scrape_results").where("title is not null and markdown is not null")
    return t.select("result_id", strings_match(F.col("title"), F.regexp_extract("markdown", r"(?m)^#[ \t]+(.*)$", 1)).alias("matched"))


@query(r"SELECT result_id, length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]+', '', 'g')) AS units, md5(regexp_replace(markdown, '(?m)^#+[ \t]*', '', 'g')) AS plain FROM scrape_results WHERE text IS NOT NULL AND markdown IS NOT NULL")
def text_units(spark, d):
    t = table(spark, d, "scrape_results").where("text is not null and markdown is not null")
    return t.select("result_id", utf16_length(F.col("text")).alias("units"), F.md5(strip_headings(F.col("markdown"))).alias("plain"))


_U = r"(length({c}) + length(regexp_replace({c}, '[^\x{{10000}}-\x{{10FFFF}}]+', '', 'g')))"


@query(f"""WITH r AS (SELECT DISTINCT final_url AS url FROM scrape_results WHERE final_url IS NOT NULL),
s AS (SELECT final_url AS url, arg_min(text, result_id) AS text FROM scrape_results WHERE final_url IS NOT NULL AND status_code < 300 AND text IS NOT NULL GROUP BY final_url),
h AS (SELECT final_url AS url, arg_min(markdown, result_id) AS text FROM scrape_results WHERE final_url IS NOT NULL AND tier_used = 'headless' AND markdown IS NOT NULL GROUP BY final_url),
j AS (SELECT r.url, s.text AS st, h.text AS ht, s.url IS NOT NULL AS s_ok, h.url IS NOT NULL AS h_ok, s.url IS NULL OR {_U.format(c="s.text")} < 200 AS want FROM r LEFT JOIN s ON r.url = s.url LEFT JOIN h ON r.url = h.url),
w AS (SELECT *, want AND h_ok AND (NOT s_ok OR {_U.format(c="ht")} > {_U.format(c="st")}) AS wins FROM j)
SELECT url, CASE WHEN wins THEN 'headless' WHEN s_ok THEN 'static' END AS tier, CASE WHEN NOT wins AND NOT s_ok THEN 'all_tiers_failed' END AS error_kind,
       'static:' || s_ok || CASE WHEN want THEN ',headless:' || h_ok ELSE '' END AS tried, md5(CASE WHEN wins THEN ht WHEN s_ok THEN st END) AS body FROM w""")
def scrape_two_tiers(spark, d):
    t = table(spark, d, "scrape_results").where("final_url is not null").withColumnRenamed("final_url", "url")
    first = lambda ok, text: t.where(ok).groupBy("url").agg(F.min(F.struct("result_id", utf16_length(F.col(text)).alias("units"))).alias("f")).select("url", "f.*")
    s, h = first("status_code < 300 and text is not null", "text"), first("tier_used = 'headless' and markdown is not null", "markdown")
    chosen = stores.choose_tiers(t.select("url").distinct(), s, h)
    # the choice is made on lengths; only the winner's row is looked up
    ref = s.select("url", F.lit("static").alias("tier"), "result_id").unionByName(h.select("url", F.lit("headless").alias("tier"), "result_id"))
    body = t.select("result_id", F.md5("text").alias("s_body"), F.md5("markdown").alias("h_body"))
    out = chosen.join(ref, ["url", "tier"], "left").join(body, "result_id", "left")
    tried = F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["tier"], a["success"].cast("string"))), ",")
    return out.select("url", "tier", "error_kind", tried.alias("tried"), F.when(F.col("tier") == "headless", F.col("h_body")).otherwise(F.col("s_body")).alias("body"))


_REQ = f"""
WITH e AS (SELECT user_id::VARCHAR AS url, event_id AS seq, epoch_us(ts) // 1000 AS t_ms, CASE event_type WHEN 'view' THEN 86400 WHEN 'signup' THEN NULL ELSE 3600 END AS lim, event_type <> 'error' AS ok, CASE event_type WHEN 'view' THEN 'standard' WHEN 'signup' THEN 'unknown' ELSE 'news' END AS tier, ts FROM events)
"""


def _requests(spark, d):
    tier = F.when(F.col("event_type") == "view", "standard").when(F.col("event_type") == "signup", "unknown").otherwise("news")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), tier.alias("tier"), (F.col("event_type") != "error").alias("ok"))
    return e.withColumn("max_seconds", freshness.tier_column(F.col("tier"), 0))


_FOLD = _REQ.replace("WITH e", "WITH RECURSIVE e") + """
, o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY t_ms, seq) AS n FROM e),
f AS (
  SELECT url, seq, n, CASE WHEN lim IS NULL THEN 'unknown' WHEN ok THEN 'fetch' ELSE 'error' END AS decision, CASE WHEN lim IS NOT NULL AND ok THEN t_ms END AS crawled FROM o WHERE n = 1
  UNION ALL
  SELECT o.url, o.seq, o.n, CASE WHEN o.lim IS NULL THEN 'unknown' WHEN f.crawled IS NOT NULL AND o.t_ms - f.crawled <= o.lim * 1000 THEN 'hit' WHEN o.ok THEN 'fetch' WHEN f.crawled IS NOT NULL THEN 'stale' ELSE 'error' END,
         CASE WHEN o.lim IS NULL OR (f.crawled IS NOT NULL AND o.t_ms - f.crawled <= o.lim * 1000) THEN f.crawled WHEN o.ok THEN o.t_ms ELSE f.crawled END
  FROM f JOIN o ON o.url = f.url AND o.n = f.n + 1)
SELECT url, seq, decision, crawled AS crawled_ms FROM f"""


@query(_FOLD)
def freshness_replay(spark, d):
    return freshness.replay(_requests(spark, d)).select("url", "seq", "decision", F.unix_millis("crawled_at").alias("crawled_ms"))


#: As _FOLD with fetches of value x 150 ms: what takes over 15 s serves the stale copy and is written back when it ends.
_RACE = _REQ.replace("WITH e", "WITH RECURSIVE e").replace("FROM events", "FROM (SELECT * FROM events)").replace(", ts FROM", ", ts, floor(value * 150)::BIGINT AS late FROM") + """
, o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY t_ms, seq) AS n FROM e),
f AS (
  SELECT url, seq, n, CASE WHEN lim IS NULL THEN 'unknown' WHEN ok THEN 'fetch' ELSE 'error' END AS decision, CASE WHEN lim IS NOT NULL AND ok THEN t_ms END AS crawled, []::BIGINT[] AS pend FROM o WHERE n = 1
  UNION ALL
  SELECT url, seq, n, decision, CASE WHEN decision = 'fetch' THEN t_ms ELSE c END, CASE WHEN decision = 'stale' AND ok AND late > 15000 THEN list_append(p, t_ms + late) ELSE p END
  FROM (SELECT *, CASE WHEN lim IS NULL THEN 'unknown' WHEN c IS NOT NULL AND t_ms - c <= lim * 1000 THEN 'hit' WHEN c IS NOT NULL AND late > 15000 THEN 'stale' WHEN ok THEN 'fetch' WHEN c IS NOT NULL THEN 'stale' ELSE 'error' END AS decision
        FROM (SELECT o.*, coalesce(list_max(list_filter(f.pend, lambda x: x <= o.t_ms)), f.crawled) AS c, list_filter(f.pend, lambda x: x > o.t_ms) AS p FROM f JOIN o ON o.url = f.url AND o.n = f.n + 1)))
SELECT url, seq, decision, crawled AS crawled_ms FROM f"""


@query(_RACE)
def freshness_race(spark, d):
    late = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.floor(F.col("value") * 150).cast("bigint").alias("latency_ms"))
    return freshness.replay(_requests(spark, d).join(late, "seq")).select("url", "seq", "decision", F.unix_millis("crawled_at").alias("crawled_ms"))


@query(_REQ + f"SELECT url, seq, epoch_ms(TIMESTAMP '{NOW}') - t_ms <= lim * 1000 AS fresh, (epoch_ms(TIMESTAMP '{NOW}') - t_ms) / 1000.0 AS age FROM e WHERE lim IS NOT NULL")
def freshness_within_sla(spark, d):
    now = F.lit(NOW).cast("timestamp")
    r = _requests(spark, d).where("max_seconds is not null")
    return r.select("url", "seq", freshness.within_sla(F.col("ts"), now, F.col("max_seconds")).alias("fresh"), ((F.unix_millis(now) - F.unix_millis("ts")) / 1000.0).cast("double").alias("age"))


_STATE = _REQ + """
, s AS (SELECT url, min(struct_pack(a := lim, b := seq, c := tier)) AS s, max(struct_pack(a := seq, b := t_ms)) AS l FROM e WHERE lim IS NOT NULL GROUP BY url)
"""


def _state(spark, d):
    return freshness.tighten(_requests(spark, d).withColumns({"crawled_at": F.col("ts"), "content": F.col("seq").cast("string")}))


@query(_STATE + "SELECT url, s.c AS watched_tier, s.a AS max_staleness_seconds, s.c = 'news' AS proactive, l.b AS crawled_ms, l.a::VARCHAR AS content, l.b + s.a * 1000 AS due_ms FROM s")
def freshness_tighten(spark, d):
    return _state(spark, d).select("url", "watched_tier", F.col("max_staleness_seconds").cast("bigint").alias("max_staleness_seconds"), "proactive", F.unix_millis("crawled_at").alias("crawled_ms"), "content", F.unix_millis("next_due_at").alias("due_ms"))


@query(_STATE + "SELECT url, l.b + s.a * 1000 AS due_ms FROM s WHERE s.c = 'news' AND l.b + s.a * 1000 <= epoch_ms(TIMESTAMP '2024-01-30 20:00:00')")
def freshness_due(spark, d):
    return freshness.due(_state(spark, d), F.lit("2024-01-30 20:00:00").cast("timestamp")).select("url", F.unix_millis("next_due_at").alias("due_ms"))


@query(_STATE + ", u AS (SELECT DISTINCT c_custkey::VARCHAR AS url FROM customer) SELECT u.url, s.url IS NOT NULL AS existed FROM u LEFT JOIN s ON u.url = s.url")
def freshness_delete(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("url"))
    return freshness.delete(_state(spark, d), keys)[1]


@query("SELECT result_id, unnest(range(len(attempts))) AS attempt, unnest(attempts).tier AS tier, unnest(attempts).success AS success FROM scrape_results")
def ledger_attempts(spark, d):
    return ledger.attempts(table(spark, d, "scrape_results")).withColumn("attempt", F.col("attempt").cast("bigint"))


@query("SELECT id, request_id, tier, success, cents FROM (SELECT DISTINCT * FROM cost_events) WHERE request_id IS NOT NULL AND request_id <> '' AND cents IS NOT NULL")
def ledger_valid_events(spark, d):
    return ledger.valid_events(ledger.once(table(spark, d, "cost_events")))[0].select("id", "request_id", "tier", "success", "cents")


@query("""WITH c AS (SELECT request_id, sum(cents) AS n FROM (SELECT DISTINCT * FROM cost_events) WHERE request_id IS NOT NULL GROUP BY request_id), r AS (SELECT DISTINCT request_id FROM scrape_results WHERE request_id IS NOT NULL)
SELECT r.request_id, coalesce(n, 0)::BIGINT AS cost_cents FROM r LEFT JOIN c ON r.request_id = c.request_id""")
def cost_for_request(spark, d):
    r = table(spark, d, "scrape_results").where("request_id is not null").select("request_id").distinct()
    return ledger.request_costs(r, ledger.once(table(spark, d, "cost_events")))


@query("SELECT DISTINCT s.request_id FROM scrape_results s WHERE EXISTS (SELECT 1 FROM cost_events c WHERE c.request_id = s.request_id)")
def has_cost_event(spark, d):
    r = table(spark, d, "scrape_results").select("request_id").distinct()
    return ledger.with_events(r, table(spark, d, "cost_events"))


_DAILY = "SELECT CAST((created_at AT TIME ZONE 'UTC')::DATE AS VARCHAR) AS day, tier, count(*) AS events, count(*) FILTER (success) AS successes, sum(cents)::BIGINT AS cents FROM (SELECT DISTINCT * FROM cost_events) GROUP BY ALL"


@query(_DAILY)
def cost_daily(spark, d):
    return ledger.daily(ledger.once(table(spark, d, "cost_events")))


@query(_DAILY)
def stream_cost_daily(spark, d):
    once = streams.deduplicated_costs(streams.stream(spark, d, "cost_events"), "400 days")
    return ledger.daily(streams.run_available(once, "stream-costs"))


@query("SELECT epoch_ms(date_trunc('day', ts)) AS start_ms, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_event_windows(spark, d):
    out = streams.run_batches(streams.windowed_events(streams.stream(spark, d, "events")), "stream-windows", "complete")
    return out.select(F.unix_millis("start").alias("start_ms"), "event_type", "n")


_SAME = """
WITH s AS (SELECT * FROM scrape_results WHERE request_id IS NOT NULL), a AS (SELECT s.* FROM s JOIN (SELECT request_id, min(result_id) AS i FROM s GROUP BY request_id) m ON s.result_id = m.i),
b AS (SELECT s.* FROM s JOIN (SELECT request_id, max(result_id) AS i FROM s GROUP BY request_id) m ON s.result_id = m.i)
"""


def _first_and_last(spark, d):
    t = table(spark, d, "scrape_results").where("request_id is not null")
    pick = lambda f: t.join(t.groupBy("request_id").agg(f("result_id").alias("result_id")).select("result_id"), "result_id", "left_semi")
    return pick(F.min), pick(F.max).withColumn("status_code", F.when(F.col("result_id") % 7 == 0, 500).otherwise(F.col("status_code"))).withColumn("html", F.when(F.col("result_id") % 5 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")))


@query(_SAME + """, j AS (SELECT a.request_id, a.status_code AS s0, a.final_url AS u0, b.final_url AS u1, a.tier_used AS t0, b.tier_used AS t1, CASE WHEN b.result_id % 7 = 0 THEN 500 ELSE b.status_code END AS s1, a.html AS h0, CASE WHEN b.result_id % 5 = 0 THEN b.html || ' ' ELSE b.html END AS h1, b.markdown AS m FROM a JOIN b ON a.request_id = b.request_id)
SELECT request_id, concat_ws('; ', CASE WHEN u0 IS DISTINCT FROM u1 THEN 'final_url changed (' || coalesce(u0, 'null') || ' -> ' || coalesce(u1, 'null') || ')' END, CASE WHEN s0 IS DISTINCT FROM s1 THEN 'status_code changed (' || coalesce(s0::VARCHAR, 'null') || ' -> ' || coalesce(s1::VARCHAR, 'null') || ')' END, CASE WHEN t0 IS DISTINCT FROM t1 THEN 'tier_used changed (' || coalesce(t0, 'null') || ' -> ' || coalesce(t1, 'null') || ')' END, CASE WHEN h0 IS DISTINCT FROM h1 THEN 'source page content changed (html differs)' END) AS differences,
       u0 IS NOT DISTINCT FROM u1 AND t0 IS NOT DISTINCT FROM t1 AND s0 IS NOT DISTINCT FROM s1 AND h0 IS NOT DISTINCT FROM h1 AS reproduced, sha256(h1) AS html_sha256, sha256(m) AS markdown_sha256 FROM j""")
def replay_differences(spark, d):
    a, b = _first_and_last(spark, d)
    return replay.differences(a, b).select("request_id", F.array_join("differences", "; ").alias("differences"), "reproduced", "html_sha256", "markdown_sha256")


@query("""SELECT DISTINCT id, 'crawl-pages/' || crawl_id || '/' || id || '.md' AS key, crawl_id AS parsed_crawl, id AS parsed_page, 'request-snapshots/' || request_id || '.json' AS snapshot, 'freshness/' || sha256(url) || '.json' AS fresh FROM crawl_pages""")
def store_keys(spark, d):
    k = stores.crawl_page_key(F.col("crawl_id"), F.col("id"))
    back = stores.parse_crawl_page_key(k)
    return table(spark, d, "crawl_pages").select("id", k.alias("key"), back[0].alias("parsed_crawl"), back[1].alias("parsed_page"), stores.snapshot_key(F.col("request_id")).alias("snapshot"), stores.freshness_key(F.col("url")).alias("fresh")).distinct()


@query("""SELECT request_id, result_id, final_url, status_code FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY fetched_at DESC NULLS LAST, result_id DESC) AS n FROM scrape_results WHERE request_id IS NOT NULL) WHERE n = 1""")
def snapshot_latest(spark, d):
    t = table(spark, d, "scrape_results").select("request_id", "result_id", "final_url", "status_code", "fetched_at")
    return stores.latest_snapshots(t, ["fetched_at", "result_id"]).select("request_id", "result_id", "final_url", "status_code")


@query("""WITH k AS (SELECT DISTINCT 'crawl-pages/' || crawl_id || '/' || id || '.md' AS key, status FROM crawl_pages) SELECT key FROM k WHERE status = 'success' AND key LIKE 'crawl-pages/5%'""")
def store_prefix(spark, d):
    p = table(spark, d, "crawl_pages").dropDuplicates(["id"])
    store = p.where("status = 'success'").select(stores.crawl_page_key(F.col("crawl_id"), F.col("id")).alias("key"), F.col("url").alias("body"))
    return stores.list_prefix(store, "crawl-pages/5")


_IP = "((event_id * 2654435761 + 40503) % 4294967296)"
_BLOCK = " OR ".join(f"n BETWEEN {hosts._number(b)} AND {hosts._number(b) + (1 << 32 - k) - 1}" for b, k in hosts.BLOCKED_IPV4)


@query(f"""WITH i AS (SELECT event_id, {_IP} AS n FROM events)
SELECT event_id, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS ip, {_BLOCK} AS blocked FROM i""")
def blocked_addresses(spark, d):
    n = F.pmod(F.col("event_id") * 2654435761 + 40503, F.lit(4294967296))
    part = lambda k: F.pmod(F.floor(F.col("n") / k), F.lit(256)).cast("string")
    e = table(spark, d, "events").select("event_id", n.alias("n")).select("event_id", F.concat_ws(".", part(16777216), part(65536), part(256), part(1)).alias("ip"))
    return e.withColumn("blocked", hosts.is_blocked(F.col("ip")))


@query(f"""WITH i AS (SELECT user_id, {_IP} AS n FROM events) SELECT user_id::VARCHAR AS host, bool_or({_BLOCK}) AS blocked FROM i GROUP BY user_id""")
def blocked_hosts(spark, d):
    n = F.pmod(F.col("event_id") * 2654435761 + 40503, F.lit(4294967296))
    part = lambda k: F.pmod(F.floor(F.col("n") / k), F.lit(256)).cast("string")
    r = table(spark, d, "events").select(F.col("user_id").cast("string").alias("host"), n.alias("n")).select("host", F.concat_ws(".", part(16777216), part(65536), part(256), part(1)).alias("address"))
    return hosts.public_hosts(r.select("host"), r)


@query("WITH u AS (SELECT DISTINCT id, " + _PATH.format(u="url") + """ AS p FROM crawl_pages) SELECT id, p AS path,
CASE WHEN p LIKE '/docs/d%' AND regexp_matches(p, '^/.*/d.*-') THEN true WHEN p LIKE '/faq/l%' THEN true WHEN regexp_matches(p, '^/.*/d.*-') OR p LIKE '/faq/%' THEN false ELSE true END AS robots_allowed FROM u""")
def robots_decision(spark, d):
    pages = table(spark, d, "crawl_pages").select("id", urls.origin(F.col("url")).alias("origin"), urls.path(F.col("url")).alias("path")).distinct()
    texts = pages.select("origin").distinct().select("origin", F.lit(ROBOTS).alias("text"), F.lit(NOW).cast("timestamp").alias("fetched_at"))
    return robots.decide(pages, robots.rule_table(texts, AGENT)).select("id", "path", "robots_allowed")


@query(r"""WITH s AS (SELECT doc_id, len(list_intersect(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), ['harbour', 'office', 'release', 'timetable', 'garden', 'la', 'de'])) AS score FROM documents WHERE text IS NOT NULL)
SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def search_top_k(spark, d):
    return search.top_k(table(spark, d, "documents"), QUERY, 20)


@query("""SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 80 AS valid FROM events""")
def schema_valid(spark, d):
    return table(spark, d, "events").select("event_id", conforms(SCHEMA)("props").alias("valid"))


@query("SELECT request_id, md5(final_url) AS state, NULL::VARCHAR AS error, 12 AS iv_bytes, 16 AS tag_bytes FROM scrape_results WHERE final_url IS NOT NULL")
def session_roundtrip(spark, d):
    keys = crypto.Keys({1: KEY, 2: KEY[::-1]}, 2)
    t = table(spark, d, "scrape_results").where("final_url is not null").select("request_id", F.col("final_url").alias("state"))
    sealed = crypto.seal(t, "state", keys).withColumns({"iv_bytes": F.octet_length("sealed.iv"), "tag_bytes": F.octet_length("sealed.auth_tag")})
    return crypto.open_sealed(sealed, keys).select("request_id", F.md5("opened").alias("state"), "error", "iv_bytes", "tag_bytes")


@query(_FOLD)
def stream_freshness(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    tier = F.when(F.col("event_type") == "view", "standard").when(F.col("event_type") == "signup", "unknown").otherwise("news")
    e = streams.stream(spark, d, "events", 1000).select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), tier.alias("tier"), (F.col("event_type") != "error").alias("ok"))
    out = streams.replay_stream(e.withColumn("max_seconds", freshness.tier_column(F.col("tier"), 0)))
    return streams.run_batches(out, "stream-freshness")
