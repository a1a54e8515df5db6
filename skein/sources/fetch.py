"""Live fetching behind ports; nothing here runs unless a caller asks for it."""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.hosts import blocked

# Limits of fetches.
TIMEOUT_SECONDS, RENDER_SECONDS, REDIRECTS, CONTEXTS, ROBOTS_TTL = 10, 20, 5, 5, 3600
SCHEMA = "url string, final_url string, status_code int, html string, error_kind string, error string"


class FetchError(Exception):
    """A fetch that failed; kind names the class of failure."""

    kind = "fetch"


class Internal(FetchError):
    """A failure of the engine's own, such as a browser that is not there."""

    kind = "internal"


def public_address(address: str) -> bool:
    return not blocked(address)


def assert_public(url: str, lookup: Callable = socket.getaddrinfo) -> None:
    """Fails for other schemes than http(s), hosts that do not resolve, and hosts with any non-public address."""
    u = urlsplit(url)
    if u.scheme not in ("http", "https") or not u.hostname:
        raise FetchError(f"scheme or host not allowed: {url}")
    try:
        found = {x[4][0] for x in lookup(u.hostname, None)}
    except OSError as e:
        raise FetchError(f"{u.hostname} does not resolve: {e}") from None
    if not found or not all(map(public_address, found)):
        raise FetchError(f"{u.hostname} resolves to an address that is not public")


def fetch_static(url: str, get: Callable | None = None, lookup: Callable = socket.getaddrinfo) -> tuple[str, int, str]:
    """(final URL, status, html). Every hop is checked; more than 5 redirects, a missing Location, a status outside 2xx or another content type than html or xml fail.

    get(url) returns (status, headers with lower-case names, body); the default uses the standard library without following redirects.
    """
    get = get or _get
    at = url
    for _ in range(REDIRECTS + 1):
        assert_public(at, lookup)
        status, headers, body = get(at)
        if 300 <= status < 400:
            if not headers.get("location"):
                raise FetchError(f"redirect without location at {at}")
            at = urljoin(at, headers["location"])
            continue
        if not 200 <= status < 300:
            raise FetchError(f"HTTP {status}")
        kind = headers.get("content-type", "")
        if "html" not in kind and "xml" not in kind:
            raise FetchError(f"unsupported content type {kind!r}")
        return at, status, body
    raise FetchError("too many redirects")


def _get(url: str) -> tuple[int, dict, str]:
    import http.client

    u = urlsplit(url)
    kind = http.client.HTTPSConnection if u.scheme == "https" else http.client.HTTPConnection
    c = kind(u.hostname, u.port, timeout=TIMEOUT_SECONDS)
    try:
        c.request("GET", (u.path or "/") + (f"?{u.query}" if u.query else ""), headers={"User-Agent": "skein/1"})
        r = c.getresponse()
        headers = {k.lower(): v for k, v in r.getheaders()}
        return r.status, headers, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except OSError as e:
        raise FetchError(str(e)) from None
    finally:
        c.close()


def _rows(urls: Iterator[str], fetch: Callable[[str], tuple[str, int, str]]) -> pd.DataFrame:
    out = []
    for u in urls:
        try:
            final, status, html = fetch(u)
            out.append((u, final, status, html, None, None))
        except Exception as e:  # one bad address or answer must not end the task
            out.append((u, None, None, None, getattr(e, "kind", "fetch"), str(e) or type(e).__name__))
    return pd.DataFrame(out, columns=["url", "final_url", "status_code", "html", "error_kind", "error"]).astype({"status_code": "Int32"})


def fetch_table(urls: DataFrame, fetch: Callable[[str], tuple[str, int, str]] = fetch_static) -> DataFrame:
    """(url, final_url, status_code, html, error_kind, error): a request that fails, however it fails, is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _rows(b["url"], fetch)

    return urls.select("url").distinct().mapInPandas(run, SCHEMA)


class Browser(Protocol):
    """A renderer of one task. render() must call allow(url) before each request of the page, which raises for addresses that are not public."""

    def render(self, url: str, state: str | None, allow: Callable[[str], None]) -> tuple[str, int, str]: ...

    def close(self) -> None: ...


def fetch_rendered(requests: DataFrame, launch: Callable[[], Browser], contexts: int = CONTEXTS, lookup: Callable = socket.getaddrinfo) -> DataFrame:
    """fetch_table() through browsers: requests (url, state or none), state being an opened session.

    As many tasks as contexts run at a time, each with one browser that is launched on its
    first page and closed whatever happens. A browser that cannot be launched is error_kind
    internal; a status outside 2xx fails. (url, state) pairs are rendered once.
    """
    has = "state" in requests.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Browser] = []

        def fetch(url: str, state: str | None) -> tuple[str, int, str]:
            assert_public(url, lookup)
            if not held:
                try:
                    held.append(launch())
                except Exception as e:
                    raise Internal(f"no browser: {e}") from None
            final, status, html = held[0].render(url, state, lambda u: assert_public(u, lookup))
            if not 200 <= status < 300:
                raise FetchError(f"HTTP {status}")
            return final, status, html

        try:
            for b in batches:
                states = [s if isinstance(s, str) else None for s in b["state"]]
                yield pd.concat([_rows([u], lambda x, s=s: fetch(x, s)) for u, s in zip(b["url"], states, strict=True)] or [_rows([], fetch)])
        finally:
            for browser in held:
                browser.close()

    cols = requests.select("url", F.col("state") if has else F.lit(None).cast("string").alias("state")).distinct()
    return cols.repartition(contexts).mapInPandas(run, SCHEMA)


def robots_text(origin: str, get: Callable | None = None, lookup: Callable = socket.getaddrinfo) -> str:
    """The robots text of an origin; every failure (address, status, redirects) gives '', which allows all."""
    get, at = get or _get, f"{origin}/robots.txt"
    try:
        for _ in range(REDIRECTS + 1):
            assert_public(at, lookup)
            status, headers, body = get(at)
            if 300 <= status < 400 and headers.get("location"):
                at = urljoin(at, headers["location"])
                continue
            return body if 200 <= status < 300 else ""
    except Exception:
        return ""
    return ""


def refresh_robots(origins: DataFrame, cache: DataFrame, now: Column, read: Callable[[str], str] = robots_text, ttl_seconds: int = ROBOTS_TTL) -> DataFrame:
    """The robots cache (origin, text, fetched_at) for origins: a text younger than ttl_seconds is kept, the others are read anew."""
    last = cache.groupBy("origin").agg(F.max_by(F.struct("text", "fetched_at"), "fetched_at").alias("c")).select("origin", "c.text", "c.fetched_at")
    asked = origins.select("origin").where("origin is not null").distinct().join(last, "origin", "left")
    young = F.coalesce(F.unix_millis(now) - F.unix_millis("fetched_at") < ttl_seconds * 1000, F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"origin": b["origin"], "text": [read(o) for o in b["origin"]]}, dtype=object)

    new = asked.where(~young).select("origin").mapInPandas(run, "origin string, text string").withColumn("fetched_at", now)
    return asked.where(young).select("origin", "text", "fetched_at").unionByName(new)
