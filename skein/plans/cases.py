"""Queries of operators whose results the tables don't hold: inputs and expected results are built from the same rows.

Pages, addresses, rules and answers are templates filled with columns of a table, one of
several per row; the SQL fills the templates of the expected results in the same way. The
expected results are written down from what the operators promise, not from their output.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.engine import Engine
from skein.functions import html as H
from skein.functions import robots, urls
from skein.functions.hosts import is_blocked
from skein.functions.jsonschema import conforms
from skein.operators import benchmark, extraction, freshness, replay, search, verify
from skein.plans.catalog import _REQ, _requests, query
from skein.sources import fetch, stores
from skein.sources.stores import table

SLOTS = {"{key}": "p_partkey", "{name}": "p_name", "{brand}": "p_brand", "{size}": "p_size"}


def _q(s: str | None) -> str:
    return "NULL::VARCHAR" if s is None else "'" + s.replace("'", "''") + "'"


def filled(template: str | None) -> Column:
    """A template with the columns of part in its slots."""
    out = F.lit(template)
    for slot, c in SLOTS.items():
        if template is not None and slot in template:
            out = F.replace(out, F.lit(slot), F.col(c).cast("string"))
    return out


def filled_sql(template: str | None) -> str:
    out = _q(template)
    for slot, c in SLOTS.items():
        if template is not None and slot in template:
            out = f"replace({out}, '{slot}', {c}::VARCHAR)"
    return out


def by_case(values: list, make=filled, key: str = "p_partkey") -> Column:
    """The value of the row's case: cases take turns by key."""
    out = F.lit(None)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.pmod(F.col(key), F.lit(len(values))) == i, make(v)).otherwise(out)
    return out


def by_case_sql(values: list, make=filled_sql, key: str = "p_partkey") -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN {make(v)}" for i, v in enumerate(values)) + " END"


# (page, title, markdown, text)
PAGES = [
    (
        "<html><head><title> {name} &amp; {brand} </title></head><body><header>Shop</header><nav><a href=\"/nav/{key}\">Menu</a></nav><article><h1>{name}</h1><p>The {name} by {brand} is one of our own, made with care.</p><p>It comes in size {size}, with a label, a box and a note.</p></article><aside>More</aside><footer>Legal</footer></body></html>",
        "{name} & {brand}", "# {name}\n\nThe {name} by {brand} is one of our own, made with care.\n\nIt comes in size {size}, with a label, a box and a note.",
        "{name}The {name} by {brand} is one of our own, made with care.It comes in size {size}, with a label, a box and a note.",
    ),
    (
        "<head><title></title></head><body><div role=\"banner\">B</div><div role=\"navigation\">N</div><div class=\"x-cookie-y\">C</div><div id=\"consent-box\">D</div><main><h1>{name}</h1><p>The {name} by {brand} is one of our own, made with care.</p><div class=\"newsletter\">Sign up</div><div class=\"a modal b\">M</div><div class=\"popup-1\">P</div><p class=\"subscribe-now\">S</p><div class=\"advertisement\">A</div><div class=\"promo\">R</div><div class=\"Cookie\">Kept {key}, as case counts.</div></main></body>",
        "", "# {name}\n\nThe {name} by {brand} is one of our own, made with care.\n\nKept {key}, as case counts.", "{name}The {name} by {brand} is one of our own, made with care.Kept {key}, as case counts.",
    ),
    (
        "<title>{name}</title><article><h1>{name}</h1><p>A <b>bold</b> and <em>fine</em> text about <a href=\"/p/{key}?x=1\">{name}</a>, with <code>c{key}</code>.</p><ul><li>one {size}</li><li>two</li></ul><ol><li>first</li><li>second</li></ol><p>Closing words, long enough for a paragraph, of {brand}.</p></article>",
        "{name}", "# {name}\n\nA **bold** and _fine_ text about [{name}](/p/{key}?x=1), with `c{key}`.\n\n*   one {size}\n*   two\n\n1.  first\n2.  second\n\nClosing words, long enough for a paragraph, of {brand}.",
        "{name}A bold and fine text about {name}, with c{key}.one {size}twofirstsecondClosing words, long enough for a paragraph, of {brand}.",
    ),
    (
        "<title>{brand}</title><body><article><h1>{name}</h1><h2>Use of {name}</h2><p>Before use, read all of this note on the {name}.<br>Then start.</p><pre>a  b\nc {key}</pre><blockquote><p>Said by {brand}, a maker of things, in a letter.</p></blockquote><hr><p>After use, clean it, dry it, and put it in its box <img src=\"/i/{key}.png\" alt=\"pic\">.</p></article></body>",
        "{brand}", "# {name}\n\n## Use of {name}\n\nBefore use, read all of this note on the {name}.  \nThen start.\n\n```\na  b\nc {key}\n```\n\n> Said by {brand}, a maker of things, in a letter.\n\n* * *\n\nAfter use, clean it, dry it, and put it in its box ![pic](/i/{key}.png).",
        "{name}Use of {name}Before use, read all of this note on the {name}.Then start.a  b\nc {key}Said by {brand}, a maker of things, in a letter.After use, clean it, dry it, and put it in its box .",
    ),
    ("<title>{name}</title><nav>n</nav><main> Short {key} </main><article>later</article><footer>f</footer>", "{name}", "Short {key}", "Short {key}"),
    ("<title></title><body><nav>n</nav><div>Only {key} here</div></body>", None, "Only {key} here", "Only {key} here"),
    ("<title>{name}</title><body><h1>{name}</h1><div><p>The {name} by {brand} is one of our own, made with care.</p><p>It comes in size {size}, with a label, a box and a note.</p></div></body>", "{name}",
     "# {name}\n\nThe {name} by {brand} is one of our own, made with care.\n\nIt comes in size {size}, with a label, a box and a note.", "The {name} by {brand} is one of our own, made with care.It comes in size {size}, with a label, a box and a note."),
]


@query(f"SELECT p_partkey, {by_case_sql([p[1] for p in PAGES])} AS title, {by_case_sql([p[2] for p in PAGES])} AS markdown, {by_case_sql([p[3] for p in PAGES])} AS text FROM part")
def content_cases(spark, d):
    t = stores.spread(table(spark, d, "part").select("p_partkey", by_case([p[0] for p in PAGES]).alias("html")))
    return t.select("p_partkey", H.content(F.col("html")).alias("c")).select("p_partkey", "c.title", "c.markdown", "c.text")


BASE = "https://Shop.example/part/{key}/index.html?q=1"
LINK_PAGE = (
    "<body><a href=\"/a/{key}\">1</a><a href=\"b/{key}#top\">2</a><a href='../c'>3</a><a href=d>4</a><a>no</a><a href=\"\">empty</a><a href=\"#x\">5</a><a href=\"mailto:a@b.example\">mail</a>"
    "<p><a class=x href=\"HTTP://Other.example:80/x y\">6</a></p><a href=\"//cdn.shop.example/z?k={key}\">7</a><a href=\"/a/{key}\">again</a><A HREF=\"?p=2\">8</A><nav><a href=\"/n&amp;{key}\">9</a></nav><a href=\"https://u@shop.example:8443/{key}\">10</a></body>"
)
# place among the anchors with an href, address
LINKS = [
    (0, "https://shop.example/a/{key}"), (1, "https://shop.example/part/{key}/b/{key}"), (2, "https://shop.example/part/c"), (3, "https://shop.example/part/{key}/d"), (4, "https://shop.example/part/{key}/index.html?q=1"),
    (6, "http://other.example/x%20y"), (7, "https://cdn.shop.example/z?k={key}"), (9, "https://shop.example/part/{key}/index.html?p=2"), (10, "https://shop.example/n&{key}"), (11, "https://u@shop.example:8443/{key}"),
]


def _link_cases(spark, d) -> DataFrame:
    return H.links(table(spark, d, "part").select("p_partkey", filled(BASE).alias("final_url"), filled(LINK_PAGE).alias("html")), carry=("p_partkey", "final_url"))


@query(" UNION ALL ".join(f"SELECT p_partkey, {i} AS pos, {filled_sql(u)} AS link FROM part" for i, u in LINKS))
def link_cases(spark, d):
    return _link_cases(spark, d).select("p_partkey", "pos", "link")


@query("SELECT p_partkey, 10 AS links, 8 AS same_host FROM part")
def links_same_host(spark, d):
    # a subdomain is another host, a port makes no difference
    same = urls.host(F.col("link")) == urls.host(F.col("final_url"))
    return _link_cases(spark, d).groupBy("p_partkey").agg(F.count(F.lit(1)).cast("int").alias("links"), F.count_if(same).cast("int").alias("same_host"))


# base, href, address as a browser serialises it
URLS = [
    ("https://H{key}.Example:443/a/b?x=1", "c", "https://h{key}.example/a/c"), ("https://h.example/{key}/b", "../../c/./d/..", "https://h.example/c/"), ("http://h.example", "", None), ("http://h.example/a", "?q=ü{key}", "http://h.example/a?q=%C3%BC{key}"),
    ("http://h.example/a", "/für{key}#x", "http://h.example/f%C3%BCr{key}"), ("http://h.example/a", "//o.example:80/p{key}", "http://o.example/p{key}"), ("http://h.example/a", "tel:{key}", None), ("http://h.example/a", "JavaScript:void({key})", None),
    ("http://h.example/a", "\\b{key}", "http://h.example/b{key}"), ("http://h.example/a{key}", "#top", "http://h.example/a{key}"), ("http://h.example/a", "https://o.example:x{key}/", None), ("nope{key}", "/a", None),
    ("http://h.example", " HTTPS://O.example/{key} ", "https://o.example/{key}"), ("http://h.example/x/", "y z/{key}", "http://h.example/x/y%20z/{key}"), ("http://h.example/x/%7e{key}", ".", "http://h.example/x/"), ("http://h.example:8080/x", "/{key}", "http://h.example:8080/{key}"),
    ("http://h.example/a?b", "", None), ("http://h.example/a", "/b/%2e%2e/{key}", "http://h.example/{key}"), ("http://h.example/a", "/b\t/{key}\n", "http://h.example/b/{key}"), ("http://h.example/a", "http:/rel{key}", "http://h.example/rel{key}"),
]


@query(f"SELECT p_partkey, {by_case_sql([u[2] for u in URLS])} AS url, {by_case_sql([u[2] for u in URLS])} IS NOT NULL AS resolved FROM part")
def url_cases(spark, d):
    t = table(spark, d, "part").select("p_partkey", by_case([u[0] for u in URLS]).alias("base"), by_case([u[1] for u in URLS]).alias("href"))
    return t.select("p_partkey", urls.resolve_url("base", "href").alias("url")).withColumn("resolved", F.col("url").isNotNull())


# include patterns, exclude patterns, path, whether it is within bounds
GLOBS = [
    (["/a/*"], None, "/a/{key}", True), (["/a/*"], None, "/a/{key}/c", False), (["/a/*"], [], "/a/.{key}", False), (["/a/**"], None, "/a/{key}/c/d", True), (["/a/**"], None, "/b/{key}", False), (["/**/z{1,2}"], None, "/x/{key}/z2", True),
    (["/{a,b}/?*"], None, "/b/{key}", True), (["/{a,b}/?"], None, "/c/x", False), (["!/a/*"], None, "/a/{key}", False), (["!/a/*"], None, "/b/{key}", True), (["#/a/*"], None, "/a/{key}", False), ([], ["/a/*"], "/a/{key}", False),
    (None, ["/b"], "/a/{key}", True), (["/a/*", "/b/*"], ["/b/**"], "/b/{key}", False), (["/[a-c]/*"], None, "/b/{key}", True), (["/[!a-c]/*"], None, "/b/{key}", False), (["/a.b/*"], None, "/axb/{key}", False), (["/a/*.html"], None, "/a/{key}.html", True),
]


@query(f"SELECT p_partkey, {by_case_sql([g[3] for g in GLOBS], lambda v: str(v).lower())} AS within FROM part")
def glob_cases(spark, d):
    rules = spark.createDataFrame([(i, g[0], g[1]) for i, g in enumerate(GLOBS)], "n int, inc array<string>, exc array<string>")
    rules = rules.select("n", urls.globs_to_regexes("inc").alias("inc"), urls.globs_to_regexes("exc").alias("exc"))
    t = table(spark, d, "part").withColumn("n", F.pmod("p_partkey", F.lit(len(GLOBS))).cast("int")).select("p_partkey", "n", by_case([g[2] for g in GLOBS]).alias("path"))
    return t.join(F.broadcast(rules), "n").select("p_partkey", urls.allowed_by(F.col("path"), F.col("inc"), F.col("exc")).alias("within"))  # a rule per case


# address, whether it is blocked; {size} is 1 to 50
ADDRESSES = [
    ("2001:4860::{size}", False), ("::", True), ("::1", True), ("fe80::{size}", True), ("feaf::{size}", True), ("fec0::{size}", False), ("fc00::{size}", True), ("FD12:3456::{size}", True), ("::ffff:10.0.0.{size}", True), ("::FFFF:8.8.8.{size}", False),
    ("::ffff:7f00:1", False), ("abcd:", True), ("1:{size}", True), ("1:2:3:4:5:6:7:8:{size}", True), (":::{size}", True), ("2001:db8::{size}::1", True), ("12345::{size}", True), ("1:2:3:4:5:6:7:{size}", False), ("300.1.1.{size}", True), ("8.8.8.{size}.", True),
    ("172.15.0.{size}", False), ("172.31.0.{size}", True), ("8.8.4.{size}", False), ("host{size}", True), ("", True), (None, True), ("1::1.2.3.{size}", False), ("fe80::1%eth{size}", True), ("64:ff9b::1.2.3.{size}", False), ("100.64.0.{size}", True),
]


@query(f"SELECT p_partkey, {by_case_sql([a[1] for a in ADDRESSES], lambda v: str(v).lower())} AS blocked FROM part")
def address_cases(spark, d):
    return table(spark, d, "part").select("p_partkey", is_blocked(by_case([a[0] for a in ADDRESSES])).alias("blocked"))


# address, final address, status, page, error kind: the site answers by the path
WEB = [
    ("http://ok.example/{key}", "http://ok.example/{key}", 200, "<p>page</p>", None), ("http://ok.example/hop/{key}", "http://ok.example/{key}", 200, "<p>page</p>", None), ("http://ok.example/hop/hop/hop/hop/hop/{key}", "http://ok.example/{key}", 200, "<p>page</p>", None),
    ("http://ok.example/hop/hop/hop/hop/hop/hop/{key}", None, None, None, "fetch"), ("http://ok.example/inward/{key}", None, None, None, "fetch"), ("http://ok.example/nowhere/{key}", None, None, None, "fetch"), ("http://ok.example/missing/{key}", None, None, None, "fetch"),
    ("http://ok.example/image/{key}", None, None, None, "fetch"), ("http://ok.example/boom/{key}", None, None, None, "fetch"), ("http://private.example/{key}", None, None, None, "fetch"), ("http://unknown.example/{key}", None, None, None, "fetch"), ("ftp://ok.example/{key}", None, None, None, "fetch"),
    ("http://[bad/{key}", None, None, None, "fetch"), ("http://ok.example/xml/{key}", "http://ok.example/xml/{key}", 200, "<p>page</p>", None),
]


def canned_lookup(host, port):
    if host.startswith("unknown"):
        raise OSError("no such host")
    return [(0, 0, 0, "", ("10.0.0.7" if host.startswith("private") else "93.184.216.34", 0))]


def canned_get(url):
    path = url.partition(".example")[2]
    if path.startswith("/hop/"):
        return 302, {"location": path[4:]}, ""
    if path.startswith("/inward/"):
        return 302, {"location": "http://private.example/x"}, ""
    if path.startswith("/boom/"):
        raise LookupError("an unknown charset")
    kind = "image/png" if path.startswith("/image/") else "application/xhtml+xml" if path.startswith("/xml/") else "text/html"
    return (302 if path.startswith("/nowhere/") else 404 if path.startswith("/missing/") else 200), {"content-type": kind}, "<p>page</p>"


@query(f"SELECT {by_case_sql([w[0] for w in WEB])} AS url, {by_case_sql([w[1] for w in WEB])} AS final_url, {by_case_sql([w[2] for w in WEB], lambda v: 'NULL::INT' if v is None else str(v))} AS status_code, {by_case_sql([w[3] for w in WEB])} AS html, {by_case_sql([w[4] for w in WEB])} AS error_kind FROM part")
def fetch_cases(spark, d):
    t = stores.spread(table(spark, d, "part").select(by_case([w[0] for w in WEB]).alias("url")))
    return fetch.fetch_table(t, lambda u: fetch.fetch_static(u, canned_get, canned_lookup)).select("url", "final_url", "status_code", "html", "error_kind")


class CannedBrowser:
    """Renders by address: /inner asks for a private address, /bad answers 500, /crash breaks; the session shows in the page."""

    def render(self, url, state, allow):
        if "/inner/" in url:
            allow("http://private.example/pixel")
        if "/crash/" in url:
            raise RuntimeError("page crashed")
        return url + "?shown", 500 if "/bad/" in url else 200, f"<p>{state}</p>"

    def close(self):
        pass


# address, session, page, error kind
SHOWN = [("http://ok.example/{key}", None, "<p>None</p>", None), ("http://ok.example/in/{key}", "s{size}", "<p>s{size}</p>", None), ("http://ok.example/inner/{key}", None, None, "fetch"), ("http://ok.example/bad/{key}", None, None, "fetch"), ("http://ok.example/crash/{key}", None, None, "fetch"), ("http://private.example/{key}", None, None, "fetch")]


@query(f"SELECT {by_case_sql([w[0] for w in SHOWN])} AS url, CASE WHEN {by_case_sql([w[3] for w in SHOWN])} IS NULL THEN {by_case_sql([w[0] for w in SHOWN])} || '?shown' END AS final_url, {by_case_sql([w[2] for w in SHOWN])} AS html, {by_case_sql([w[3] for w in SHOWN])} AS error_kind FROM part")
def render_cases(spark, d):
    t = table(spark, d, "part").select(by_case([w[0] for w in SHOWN]).alias("url"), by_case([w[1] for w in SHOWN]).alias("state"))
    return fetch.fetch_rendered(t, CannedBrowser, lookup=canned_lookup).select("url", "final_url", "html", "error_kind")


# robots text, path, whether the agent may read it
ROBOTS = [
    ("User-agent: *\nDisallow: /a", "/a/{key}", False), ("User-agent: *\nDisallow: /a\nAllow: /a/{size}", "/a/{size}", True), ("User-agent: *\nDisallow: /*.pdf$", "/x/{key}.pdf", False), ("User-agent: *\nDisallow: /*.pdf$", "/x/{key}.pdf.html", True),
    ("User-agent: other\nDisallow: /", "/{key}", True), ("User-agent: skein\nUser-agent: other\nDisallow: /b # no\n\nUser-agent: *\nDisallow: /", "/a/{key}", True), ("user-agent: SKEIN\ndisallow: /", "/{key}", False), ("", "/{key}", True), (None, "/{key}", True),
    ("User-agent: *\nDisallow:", "/{key}", True), ("User-agent: *\nAllow: /p\nDisallow: /p", "/p{key}", True), ("nonsense\nDisallow: /", "/{key}", True),
]


@query(f"SELECT p_partkey, {by_case_sql([r[2] for r in ROBOTS], lambda v: str(v).lower())} AS allowed FROM part")
def robots_cases(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.concat(F.lit("http://h"), F.col("p_partkey").cast("string")).alias("origin"), by_case([r[0] for r in ROBOTS]).alias("text"), by_case([r[1] for r in ROBOTS]).alias("path"))
    rules = robots.rule_table(t.select("origin", "text", F.lit("2024-01-01").cast("timestamp").alias("fetched_at")), "skein")
    return robots.decide(t.select("p_partkey", "origin", "path"), rules).select("p_partkey", F.col("robots_allowed").alias("allowed"))


@query("""SELECT p_partkey, CASE WHEN p_size < 20 THEN 'kept ' || p_partkey WHEN p_partkey % 3 = 0 THEN '' ELSE 'read http://h' || p_partkey || '.example/robots.txt' END AS text, p_size >= 20 AS renewed FROM part""")
def robots_refreshed(spark, d):
    """A cache whose texts are p_size x 3 minutes old, with an hour to live: under 20 they are kept."""
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    t = table(spark, d, "part").select("p_partkey", F.concat(F.lit("http://h"), F.col("p_partkey").cast("string"), F.lit(".example")).alias("origin"), (now - F.expr("make_interval(0, 0, 0, 0, 0, p_size * 3, 0)")).alias("fetched_at"))
    read = lambda o: fetch.robots_text(o, lambda u: (404 if int(u[8:].partition(".")[0]) % 3 == 0 else 200, {}, f"read {u}"), canned_lookup)
    out = fetch.refresh_robots(t.select("origin"), t.select("origin", F.concat(F.lit("kept "), F.col("p_partkey").cast("string")).alias("text"), "fetched_at"), now, read)
    return t.select("p_partkey", "origin").join(out, "origin").select("p_partkey", "text", (F.col("fetched_at") == now).alias("renewed"))


WORDS = "words of the page, " * 20
# the plain page's status and text, the rendered page's (or none), address, session; tier, whose page is served, error kind, attempts
TIERS = [
    (200, WORDS, 200, WORDS * 2, "http://h.example/{key}", False, "static", "plain", None, "static:true"), (200, "thin, but a text of its own", 200, WORDS, "http://h.example/{key}", False, "headless", "shown", None, "static:true,headless:true"),
    (200, "thin, but a longer text of its own", 200, "thin, but a text of its own", "http://h.example/{key}", False, "static", "plain", None, "static:true,headless:true"), (404, WORDS, 200, "thin, but a text of its own", "http://h.example/{key}", False, "headless", "shown", None, "static:false,headless:true"),
    (200, "thin, but a text of its own", 503, WORDS, "http://h.example/{key}", False, "static", "plain", None, "static:true,headless:false"), (404, WORDS, None, None, "http://h.example/{key}", False, None, None, "all_tiers_failed", "static:false,headless:false"),
    (200, WORDS, 200, "thin, but a text of its own", "http://h.example/{key}", True, "headless", "shown", None, "headless:true"), (200, WORDS, 500, WORDS, "http://h.example/{key}", True, None, None, "all_tiers_failed", "headless:false"),
    (200, WORDS, 200, WORDS, "http://h.example/no/{key}", False, None, None, "robots_disallowed", None), (200, WORDS, 200, WORDS, "ftp://h.example/{key}", False, None, None, "client", None), (200, WORDS, None, None, "http://h.example/no/skip/{key}", False, "static", "plain", None, "static:true"),
]


def _page(kind: str, text: str | None) -> str | None:
    return None if text is None else f"<html><head><title>{kind} {{name}}</title></head><body><article><h1>{kind} {{key}}</h1><p>{text}</p></article></body></html>"


_MD = [None if t[7] is None else f"# {t[7]} {{key}}\n\n" + (t[1] if t[7] == "plain" else t[3]).strip() for t in TIERS]
_CODE = [None if t[7] is None else t[0] if t[7] == "plain" else t[2] for t in TIERS]


@query(f"""SELECT p_partkey::VARCHAR AS request_id, {by_case_sql([t[6] for t in TIERS])} AS tier, {by_case_sql([None if t[7] is None else t[7] + ' {name}' for t in TIERS])} AS title, {by_case_sql(_MD)} AS markdown,
{by_case_sql([None if t[7] is None else t[4] + '/' + t[7] for t in TIERS])} AS final_url, {by_case_sql(_CODE, lambda v: 'NULL::INT' if v is None else str(v))} AS status_code, {by_case_sql([t[8] for t in TIERS])} AS error_kind, {by_case_sql([t[9] for t in TIERS])} AS tried FROM part""")
def scrape_cases(spark, d):
    """Engine.scrape over a plain and a rendered corpus: the page that is served comes whole from one of them."""
    t = table(spark, d, "part")
    number = lambda v: F.lit(v).cast("int")
    side = lambda kind, code, text: t.select(by_case([x[4] for x in TIERS]).alias("url"), F.concat(by_case([x[4] for x in TIERS]), F.lit("/" + kind)).alias("final_url"), by_case([x[code] for x in TIERS], number).alias("status_code"), by_case([_page(kind, x[text]) for x in TIERS]).alias("html")).where("status_code is not null")
    rules = spark.createDataFrame([("http://h.example", [(False, "^/no/", 4)])], "origin string, rules array<struct<allow:boolean,pattern:string,len:int>>")
    req = t.select(F.col("p_partkey").cast("string").alias("request_id"), by_case([x[4] for x in TIERS]).alias("url"), by_case(["/skip/" in x[4] for x in TIERS], F.lit).alias("skip_robots"), by_case([x[5] for x in TIERS], F.lit).alias("session"))
    out = Engine(spark, corpus=side("plain", 0, 1), rendered=side("shown", 2, 3), robots=rules).scrape(req)
    tried = F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["tier"], a["success"].cast("string"))), ",")
    return out.select("request_id", "tier", "title", "markdown", "final_url", "status_code", "error_kind", tried.alias("tried"))


# tier asked for, age of the cached copy in seconds (None: none), status of a fetch; from cache, within the limit, error kind
CACHED = [
    ("standard", 86400, 200, True, True, None), ("standard", 86401, 200, False, True, None), ("news", 3600, 500, True, True, None), ("news", 3601, 200, False, True, None), ("news", 3601, 500, True, False, None), (None, 1, 200, False, None, None),
    (None, 1, 500, False, None, "all_tiers_failed"), ("news", None, 200, False, True, None), ("news", None, 500, False, None, "all_tiers_failed"), ("hourly", 1, 200, None, None, "unknown_tier"),
]
_BOOL = lambda v: "NULL::BOOLEAN" if v is None else str(v).lower()


@query(f"""SELECT p_partkey::VARCHAR AS request_id, {by_case_sql([c[3] for c in CACHED], _BOOL)} AS from_cache, {by_case_sql([c[4] for c in CACHED], _BOOL)} AS within_sla, {by_case_sql([c[5] for c in CACHED])} AS error_kind,
{by_case_sql([None if c[5] else 'cached {key}' if c[3] else '# plain {key}' for c in CACHED])} AS heading FROM part""")
def scrape_cached(spark, d):
    """Engine.scrape_fresh: the cache before the fetch, judged by the tier of the request."""
    import datetime as dt

    now = dt.datetime(2024, 6, 1, 12, tzinfo=dt.UTC)
    t, url = table(spark, d, "part"), filled("http://h.example/{key}")
    corpus = t.select(url.alias("url"), url.alias("final_url"), by_case([c[2] for c in CACHED], F.lit).alias("status_code"), filled(_page("plain", WORDS)).alias("html"))
    age = by_case([c[1] for c in CACHED], lambda v: F.lit(v).cast("int"))
    cache = t.select(url.alias("url"), F.timestamp_seconds(F.lit(int(now.timestamp())) - age).alias("crawled_at"), filled('{"markdown": "cached {key}"}').alias("content")).where("crawled_at is not null")
    req = t.select(F.col("p_partkey").cast("string").alias("request_id"), url.alias("url"), by_case([c[0] for c in CACHED]).alias("tier"), F.lit(False).alias("skip_robots"))
    served, _ = Engine(spark, corpus=corpus, rendered=corpus.where("false"), cache=cache, clock=lambda: now).scrape_fresh(req)
    heading = F.split(F.get_json_object("content", "$.markdown"), "\n")[0]
    return served.select("request_id", "from_cache", "within_sla", "error_kind", heading.alias("heading"))


_ATLAS = "https://atlas.example"
_JOBS = [("all", 3, 1_000_000, True, None, None, False), ("capped", 3, 40, True, None, None, False), ("bounded", 3, 1_000_000, True, ["/r/*", "/n/*", "/s/1*"], ["/n/3"], False), ("wide", 1, 50, False, None, None, False), ("root", 0, 50, True, [], [], False), ("open", 3, 1_000_000, True, None, None, True)]
_JOB_SQL = ", ".join(f"('{j}', {d}, {c}, {str(j == 'bounded').lower()}, {str(not s).lower()}, {str(o).lower()})" for j, d, c, s, _, _, o in _JOBS)


@query(f"""WITH j(id, deep, cap, bounded, wide, open) AS (VALUES {_JOB_SQL}),
r AS (SELECT *, r_regionkey <> 4 AS ok FROM region),
n AS (SELECT nation.*, n_nationkey::VARCHAR LIKE '1%' AS shut FROM nation),
p AS (
  SELECT id, 0 AS depth, 0 AS a, 0 AS b, 0 AS c, '/' AS path, 'success' AS status, 1 AS tries, NULL AS error FROM j
  UNION ALL SELECT id, 1, r_regionkey, 0, 0, '/r/' || r_regionkey, CASE WHEN ok THEN 'success' ELSE 'failed' END, ok::INT, CASE WHEN NOT ok THEN 'held back' END FROM j, r WHERE deep >= 1
  UNION ALL SELECT id, 1, 1000, 0, 0, 'off', 'failed', 1, 'all_tiers_failed' FROM j WHERE deep >= 1 AND wide
  UNION ALL SELECT id, 2, r_regionkey, n_nationkey, 0, '/n/' || n_nationkey, CASE WHEN shut AND NOT open THEN 'failed' ELSE 'success' END, 1, CASE WHEN shut AND NOT open THEN 'robots_disallowed' END
    FROM j, r, n WHERE deep >= 2 AND r.ok AND n_regionkey = r_regionkey AND NOT (bounded AND n_nationkey = 3)
  UNION ALL SELECT id, 3, r_regionkey, n_nationkey, s_suppkey, '/s/' || s_suppkey, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 THEN 'failed' ELSE 'success' END, 1, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 THEN 'all_tiers_failed' END
    FROM j, r, n, supplier WHERE deep >= 3 AND r.ok AND n_regionkey = r_regionkey AND (open OR NOT shut) AND s_nationkey = n_nationkey AND NOT (bounded AND (n_nationkey = 3 OR s_suppkey::VARCHAR NOT LIKE '1%'))),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, a, b, c) - 1 AS seq FROM p)
SELECT id AS crawl_id, seq, CASE WHEN path = 'off' THEN 'https://off.example/' ELSE '{_ATLAS}' || path END AS url, depth, status, tries AS attempt_count, error AS last_error FROM o JOIN j USING (id) WHERE seq < cap""")
def crawl_cases(spark, d):
    """Engine.crawl over a site of regions, nations and suppliers: bounds, caps, robots, pre-flight, failures, order."""
    link = lambda kind, key: F.concat(F.lit(f'<a href="/{kind}/'), F.col(key).cast("string"), F.lit('">x</a>'))
    joined = lambda df, by, key, kind: df.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, link(kind, key).alias("a")))), lambda x: x["a"]), "").alias("links"))
    region, nation, supplier = (table(spark, d, x) for x in ("region", "nation", "supplier"))
    one = lambda kind, key, links, df, status=None: df.select(F.concat(F.lit(f"{_ATLAS}/{kind}/"), F.col(key).cast("string")).alias("url"), (F.lit(200) if status is None else status).alias("status_code"), links.alias("html"))
    root = joined(region.withColumn("g", F.lit(0)), "g", "r_regionkey", "r").select(F.lit(_ATLAS + "/").alias("url"), F.lit(200).alias("status_code"), F.concat("links", F.lit('<a href="https://off.example">x</a>')).alias("html"))
    pages = root.unionByName(one("r", "n_regionkey", F.concat(F.lit('<a href="/">up</a>'), F.col("links")), joined(nation, "n_regionkey", "n_nationkey", "n")))
    pages = pages.unionByName(one("n", "s_nationkey", F.col("links"), joined(supplier, "s_nationkey", "s_suppkey", "s")))
    # nations without suppliers have a page without links
    pages = pages.unionByName(one("n", "n_nationkey", F.lit(""), nation.join(supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left_anti")))
    pages = pages.unionByName(one("s", "s_suppkey", F.lit('<a href="/">up</a>'), supplier.where("s_suppkey % 7 != 0"), F.when(F.col("s_suppkey") % 11 == 0, 500).otherwise(200)))
    corpus = pages.withColumn("final_url", F.col("url"))
    jobs = spark.createDataFrame([(j, _ATLAS + "/", *rest) for j, *rest in _JOBS], "id string, root_url string, max_depth int, max_pages int, same_domain_only boolean, include_patterns array<string>, exclude_patterns array<string>, ignore_robots_txt boolean")
    rules = spark.createDataFrame([(_ATLAS, [(False, "^/n/1", 4)])], "origin string, rules array<struct<allow:boolean,pattern:string,len:int>>")
    out = Engine(spark, corpus=corpus, rendered=corpus.where("false"), robots=rules).crawl(jobs, preflight=F.when(F.col("url").endswith("/r/4"), "held back"))
    return out.select("crawl_id", "seq", "url", "depth", "status", "attempt_count", "last_error")


EXTRACT = {"type": "object", "properties": {"name": {"type": "string"}, "size": {"type": "integer", "minimum": 0}}, "required": ["name"]}


def canned_model(text, tool):
    """A model that answers by the first word of the text."""
    kind, _, rest = text.partition(" ")
    if kind == "down":
        return 503, ""
    if kind == "mute":
        return 200, json.dumps({"choices": [{"message": {"content": "no tool"}}]})
    name, _, size = rest.rpartition(" ")
    data = {"name": name, "size": -1 if kind == "odd" else int(size)}
    args = json.dumps({"data": data, "confidence": {"name": 0.9, "none": 1}, "citations": {"name": {"quote": name.upper(), "supportScore": 0.8}, "size": {"quote": 3, "supportScore": 1}}})
    return 200, json.dumps({"choices": [{"message": {"tool_calls": [{"function": {"name": extraction.TOOL, "arguments": args[:-1] if kind == "cut" else args}}]}}]})


@query("""WITH t AS (SELECT *, ['fine', 'down', 'mute', 'odd', 'cut'][1 + p_partkey % 5] AS kind FROM part)
SELECT p_partkey, 'name' AS field, '"' || p_name || '"' AS value, 0.9::DOUBLE AS confidence, upper(p_name) AS quote, 0.8::DOUBLE AS support_score, true AS verified, NULL AS error_kind FROM t WHERE kind = 'fine'
UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR, 0.0, '', 0.0, false, NULL FROM t WHERE kind = 'fine'
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, 'upstream' FROM t WHERE kind <> 'fine'""")
def extract_cases(spark, d):
    """The model's answers checked, filled and verified: the call's failures are rows."""
    kind = by_case(["fine", "down", "mute", "odd", "cut"], F.lit)
    pages = stores.spread(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("request_id"), F.concat_ws(" ", kind, "p_name", F.col("p_size").cast("string")).alias("text")))
    answers = stores.materialize(extraction.extract(pages, EXTRACT, canned_model), "extract-cases")
    good = verify.verify(extraction.fields(answers), pages, key="request_id").withColumn("error_kind", F.lit(None).cast("string"))
    bad = answers.where("error_kind is not null").select("request_id", "error_kind")
    return good.unionByName(bad, allowMissingColumns=True).select(F.col("request_id").cast("bigint").alias("p_partkey"), "field", "value", "confidence", "quote", "support_score", "verified", "error_kind")


@query("""WITH f AS (SELECT DISTINCT request_id, field FROM citations WHERE request_id IS NOT NULL),
c AS (SELECT request_id, field, max(support_score) AS confidence FROM citations WHERE support_score IS NOT NULL GROUP BY ALL),
q AS (SELECT request_id, field, max(quote) AS quote, 0.5::DOUBLE AS support_score FROM citations WHERE citation_id % 3 <> 0 GROUP BY ALL)
SELECT f.request_id, f.field, coalesce(confidence, 0.0) AS confidence, coalesce(quote, '') AS quote, coalesce(q.support_score, 0.0) AS support_score
FROM f LEFT JOIN c ON f.request_id = c.request_id AND f.field = c.field LEFT JOIN q ON f.request_id = q.request_id AND f.field = q.field""")
def citations_filled(spark, d):
    t = table(spark, d, "citations")
    fields = t.where("request_id is not null").select("request_id", "field").distinct()
    conf = t.where("support_score is not null").groupBy("request_id", "field").agg(F.max("support_score").alias("confidence"))
    cite = t.where("citation_id % 3 != 0").groupBy("request_id", "field").agg(F.max("quote").alias("quote")).withColumn("support_score", F.lit(0.5))
    return verify.fill_citations(fields, conf, cite)


@query("""SELECT p_partkey, p_partkey % 3 = 0 AS data_differs, concat_ws('; ', CASE WHEN p_partkey % 4 = 0 AND p_partkey % 5 <> 0 THEN 'extraction model changed (m1 -> m2)' END, CASE WHEN p_partkey % 3 = 0 THEN 'extraction_llm_nondeterministic' END) AS notes FROM part""")
def replay_extractions(spark, d):
    t = table(spark, d, "part")
    data = lambda plus: F.to_json(F.struct("p_name", (F.col("p_size") + plus).alias("p_size")))
    was = t.select("p_partkey", data(F.lit(0)).alias("data"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise("m1").alias("model"))
    now = t.select("p_partkey", data(F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)).alias("data"), F.when(F.col("p_partkey") % 4 == 0, "m2").otherwise("m1").alias("model"))
    return replay.extraction_differences(was, now, "p_partkey").select("p_partkey", "data_differs", F.array_join("notes", "; ").alias("notes"))


@query("""WITH i AS (SELECT DISTINCT request_id FROM cost_events WHERE request_id IS NOT NULL UNION SELECT DISTINCT request_id FROM crawl_pages WHERE request_id IS NOT NULL)
SELECT request_id, CASE WHEN request_id NOT IN (SELECT request_id FROM scrape_results WHERE request_id IS NOT NULL) THEN 'not_found' WHEN request_id IN (SELECT request_id FROM crawl_pages WHERE request_id IS NOT NULL) THEN 'crawl_page' END AS error_kind FROM i""")
def replay_refused(spark, d):
    ids = table(spark, d, "cost_events").select("request_id").unionByName(table(spark, d, "crawl_pages").select("request_id")).where("request_id is not null")
    return replay.replayable(ids, table(spark, d, "scrape_results").where("request_id is not null"), table(spark, d, "crawl_pages"))


@query("""SELECT p_name AS query, i AS rank, 't' || p_partkey || '-' || i AS title, 'http://h/' || i AS url, CASE WHEN i = 1 THEN NULL ELSE p_brand END AS snippet FROM part, range(2) r(i) WHERE p_partkey % 4 <> 0 AND p_partkey % 7 <> 0""")
def search_answers(spark, d):
    """A search service's answers: two results each, none where the list or the JSON is missing."""
    item = lambda i: F.struct(F.concat(F.lit("t"), F.col("p_partkey").cast("string"), F.lit(f"-{i}")).alias("title"), F.lit(f"http://h/{i}").alias("url"), (F.lit(None).cast("string") if i == 1 else F.col("p_brand")).alias("description"))
    body = F.when(F.col("p_partkey") % 4 == 0, "{}").when(F.col("p_partkey") % 7 == 0, "not json").otherwise(F.to_json(F.struct(F.struct(F.array(item(0), item(1)).alias("results")).alias("web"))))
    return search.parse_answers(table(spark, d, "part").select(F.col("p_name").alias("query"), body.alias("body"))).select("query", "rank", "title", "url", "snippet")


def canned_search(asked):
    if asked["q"].endswith("7"):
        return 429, "slow down"
    if asked["q"].endswith("8"):
        raise TimeoutError("no answer")
    return 200, json.dumps({"web": {"results": [{"title": f"{asked['q']} {asked.get('freshness', 'any')} {asked['count']}", "url": "http://h/"}]}})


@query("""SELECT 'part ' || p_partkey AS query, CASE WHEN p_partkey % 5 = 4 THEN 'client' WHEN p_partkey % 10 IN (7, 8) THEN 'upstream' END AS error_kind,
CASE WHEN p_partkey % 5 <> 4 AND p_partkey % 10 NOT IN (7, 8) THEN 'part ' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN ' pd' WHEN 1 THEN ' pw' WHEN 2 THEN ' py' ELSE ' any' END || ' 5' END AS title FROM part""")
def search_asked(spark, d):
    """A search service asked through its port: the vocabulary of time spans, and failures as rows."""
    t = stores.spread(table(spark, d, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("query"), by_case(["day", "week", "year", None, "hour"]).alias("span")))
    got = stores.materialize(search.ask(t, canned_search, 5), "search-asked")
    return got.select("query", "error_kind").join(search.parse_answers(got.where("body is not null")).select("query", "title"), "query", "left")


@query("""SELECT 'upper' AS runner, count(*) AS fields, count(*) FILTER (p_partkey % 4 <> 0) AS cited, round(count(*) FILTER (p_partkey % 4 <> 0 AND p_partkey % 3 <> 0) / count(*), 6) AS field_accuracy,
round(count(*) FILTER (p_partkey % 4 <> 0 AND p_partkey % 5 <> 0) / count(*) FILTER (p_partkey % 4 <> 0), 6) AS citation_rate, round(count(*) FILTER (p_partkey % 4 <> 0 AND (p_partkey % 5 <> 0 OR p_partkey % 7 = 0)) / count(*), 6) AS soft_rate FROM part""")
def benchmark_rates(spark, d):
    """A runner over labelled fixtures: it leaves out every fourth, errs on every third and cites what is not there on every fifth."""
    t = table(spark, d, "part")
    fixtures = t.select(F.col("p_partkey").alias("fixture_id"), F.lit("http://h/").alias("url"), F.concat(F.lit("The part is a "), F.col("p_name"), F.lit(".")).alias("text"))
    name = F.regexp_extract("text", "is a (.*)[.]$", 1)

    def upper(rows: DataFrame) -> DataFrame:
        i = F.col("fixture_id")
        value = F.when(i % 3 == 0, "wrong").otherwise(F.concat(F.lit(" "), F.upper(name)))
        return rows.where(i % 4 != 0).select("fixture_id", F.lit("name").alias("field"), value.alias("value"), F.when(i % 7 == 0, 0.5).otherwise(0.9).alias("confidence"), F.when(i % 5 == 0, "not there").otherwise(F.upper(name)).alias("quote"), F.lit(0.8).alias("support_score"))

    benchmark.RUNNERS["upper"] = upper
    return benchmark.run("upper", fixtures, t.select(F.col("p_partkey").alias("fixture_id"), F.lit("name").alias("field"), F.col("p_name").alias("value")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS body, c_custkey % 5 <> 0 AS listed FROM customer""")
def blob_cases(spark, d):
    """Blobs under a prefix: put, put again, delete, get and list, and a neighbour's prefix untouched."""
    t = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("key"), "c_name", "c_mktsegment")
    folder = f"{stores.shared_dir(spark).rstrip('/')}/skein-{spark.sparkContext.applicationId}/blobs-{uuid.uuid4().hex}"
    mine, other = stores.Blobs(spark, folder, "mine/"), stores.Blobs(spark, folder, "other/")
    mine.put(t.select("key", F.col("c_name").alias("body")))
    mine.put(t.where("c_custkey % 3 = 0").select("key", F.col("c_mktsegment").alias("body")))
    other.put(t.where("c_custkey % 5 = 0").select("key", F.lit("theirs").alias("body")))
    mine.delete(t.where("c_custkey % 5 = 0").select("key"))
    there = mine.list("c/").withColumn("listed", F.lit(True))
    return t.join(mine.get(t), "key").join(there, "key", "left").select("c_custkey", "body", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'new ' || c_name WHEN c_custkey % 4 = 2 THEN NULL ELSE c_name END AS body FROM customer""")
def store_cases(spark, d):
    """The content store as a table: upsert, delete, get."""
    t = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key"), "c_name")
    store = stores.put(t.select("key", F.col("c_name").alias("body")), t.where("c_custkey % 4 = 1").select("key", F.concat(F.lit("new "), F.col("c_name")).alias("body")))
    store = stores.remove(store, t.where("c_custkey % 4 = 2").select("key"))
    return stores.get(store, t.select("c_custkey", "key")).select("c_custkey", "body")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS size FROM part")
def snapshot_bodies(spark, d):
    """Stored snapshots read back; malformed bodies and missing ones read as missing."""
    body = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("int").alias("size")))
    t = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 6 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 0, F.substring(body, 1, 9)).otherwise(body).alias("body"))
    return stores.snapshots_of(t.withColumnRenamed("p_partkey", "key"), "name string, size int").select(F.col("key").alias("p_partkey"), "snapshot.name", "snapshot.size")


@query(_REQ + """, s AS (SELECT url, max(seq) AS last, arg_min(tier, lim::BIGINT * 1000000000 + seq) AS tier FROM e WHERE lim IS NOT NULL GROUP BY url)
SELECT url, CASE WHEN last % 3 = 0 OR last % 7 = 1 THEN NULL ELSE 'page ' || last END AS markdown, last % 7 <> 1 AS existed, tier AS watched_tier FROM s""")
def freshness_composite(spark, d):
    """Records whose bodies are stored apart: written body first, looked up, and some deleted."""
    folder = f"{stores.shared_dir(spark).rstrip('/')}/skein-{spark.sparkContext.applicationId}/fresh-{uuid.uuid4().hex}"
    bodies = stores.Blobs(spark, folder)
    page = F.when(F.col("seq") % 3 == 0, '{"markdown": 1}').otherwise(F.concat(F.lit('{"markdown": "page '), F.col("seq").cast("string"), F.lit('"}')))
    rec = _requests(spark, d).withColumns({"crawled_at": F.col("ts"), "content": page})
    state = stores.materialize(freshness.record_composite(bodies, freshness.tighten(rec.where("false")), rec), "composite-state")
    last = rec.where("max_seconds is not null").groupBy("url").agg(F.max("seq").alias("last"))
    left, _ = freshness.delete_composite(bodies, state, last.where("last % 7 = 1").select("url"))
    found = freshness.lookup_composite(bodies, last.select("url"), left).select("url", F.get_json_object("content", "$.markdown").alias("markdown"))
    there = left.select("url", F.lit(True).alias("existed"))
    return state.select("url", "watched_tier").join(found, "url").join(there, "url", "left").select("url", "markdown", F.coalesce("existed", F.lit(False)).alias("existed"), "watched_tier")


NESTED = {"$defs": {"box": {"type": "object", "properties": {"size": {"type": "integer", "maximum": 40}, "inner": {"$ref": "#/$defs/box"}}, "required": ["size"]}}, "type": "object", "properties": {"name": {"type": "string", "pattern": "^[a-m]"}, "boxes": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/box"}}}, "required": ["name", "boxes"], "x-note": "unknown keywords are tolerated"}


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN false WHEN p_partkey % 5 = 1 THEN p_name[1] BETWEEN 'a' AND 'm' AND p_size <= 40 ELSE p_name[1] BETWEEN 'a' AND 'm' AND p_size <= 40 AND p_size + 5 <= 40 END AS valid FROM part")
def schema_cases(spark, d):
    """Schemas with references that lead back to themselves."""
    box = F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit("}"))
    deep = F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit(', "inner": {"size": '), (F.col("p_size") + 5).cast("string"), F.lit("}}"))
    item = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 == 1, box).otherwise(deep)
    return table(spark, d, "part").select("p_partkey", conforms(NESTED)(F.concat(F.lit('{"name": "'), F.col("p_name"), F.lit('", "boxes": ['), item, F.lit("]}"))).alias("valid"))
