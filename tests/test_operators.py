import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein.engine import Engine, NotConfigured
from skein.operators import freshness, frontier, ledger, replay, requests, search, verify
from skein.sources import fetch, stores

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_fold(spark):
    rows = [("u", 1, at(0), 3600, True), ("u", 2, at(3600), 3600, False), ("u", 3, at(3600.001), 3600, False), ("u", 4, at(4000), 86400, False), ("u", 5, at(8000), 3600, True), ("u", 6, at(8001), None, True), ("v", 1, at(0), 3600, False), ("v", 2, at(1), 3600, None)]
    req = spark.createDataFrame(rows, "url string, seq long, ts timestamp, max_seconds long, ok boolean")
    want = {("u", 1): "fetch", ("u", 2): "hit", ("u", 3): "stale", ("u", 4): "hit", ("u", 5): "fetch", ("u", 6): "unknown", ("v", 1): "error", ("v", 2): "error"}
    assert {(r.url, r.seq): r.decision for r in freshness.replay(req).collect()} == want
    assert freshness.replay(req.limit(0)).count() == 0
    # a row that comes late in seq is folded where its time belongs
    late = spark.createDataFrame([("u", 1, at(5000), 3600, True), ("u", 2, at(0), 3600, True), ("u", 3, at(5100), 3600, True)], req.schema)
    assert {r.seq: r.decision for r in freshness.replay(late).collect()} == {2: "fetch", 1: "fetch", 3: "hit"}


def test_slow_refetch(spark):
    rows = [(1, 0, True, 99_000), (2, 4000, True, 20_000), (3, 4010, True, 100), (4, 8000, True, 16_000), (5, 8016, True, 0), (6, 20_000, False, 16_000), (7, 20_100, True, 15_000)]
    req = spark.createDataFrame([("u", i, at(t), 3600, ok, ms) for i, t, ok, ms in rows], "url string, seq long, ts timestamp, max_seconds long, ok boolean, latency_ms long")
    # a miss is waited for; 2 serves the old copy, 3 refetches before 2 lands, 5 hits what 4 wrote back
    assert {r.seq: r.decision for r in freshness.replay(req).collect()} == {1: "fetch", 2: "stale", 3: "fetch", 4: "stale", 5: "hit", 6: "stale", 7: "fetch"}


def test_tighten_and_due(spark):
    rows = [("u", 1, "standard", at(0), "a"), ("u", 2, "news", at(10), "b"), ("u", 3, "standard", at(20), "c"), ("w", 4, "none", at(0), "x")]
    rec = spark.createDataFrame(rows, "url string, seq long, tier string, crawled_at timestamp, content string")
    s = freshness.tighten(rec).collect()
    assert len(s) == 1 and s[0].watched_tier == "news" and s[0].proactive and s[0].content == "c" and s[0].next_due_at == at(3620)
    state = freshness.tighten(rec)
    later = spark.createDataFrame([("u", 9, "standard", at(100), "d")], rec.schema)
    m = freshness.merge_state(state, later).first()
    assert m.watched_tier == "news" and m.content == "d" and m.next_due_at == at(3700)
    assert freshness.due(state, F.lit(at(3620))).count() == 1 and freshness.due(state, F.lit(at(3619))).count() == 0
    left, gone = freshness.delete(state, spark.createDataFrame([("u",), ("z",), ("z",)], "url string"))
    assert left.count() == 0 and {r.url: r.existed for r in gone.collect()} == {"u": True, "z": False}
    hit = freshness.lookup(spark.createDataFrame([("u",)], "url string"), state.withColumn("content", F.lit('{"markdown": 3}'))).first()
    assert hit.watched_tier is not None or hit.content is None


def test_ledger(spark):
    ev = spark.createDataFrame([(1, "r", None, None, 2.0), (2, "", "x", True, 1.0), (3, "r", "x", False, 1.5), (4, None, "x", True, 1.0), (5, "r", "x", True, float("nan")), (6, "r", "x", True, float("inf"))], "id int, request_id string, tier string, success boolean, cents double")
    ok, bad = ledger.valid_events(ev)
    assert [(r.id, r.tier, r.success) for r in ok.collect()] == [(1, "static", True)] and bad.count() == 5
    req = spark.createDataFrame([("r", 7), ("s", 7)], "request_id string, cost_cents int")
    assert {r.request_id: r.cost_cents for r in ledger.request_costs(req, ok).collect()} == {"r": 2, "s": 0}


def test_replay(spark):
    sch = "request_id string, final_url string, status_code int, tier_used string, html string, markdown string, extra int"
    a = spark.createDataFrame([("1", "u", 200, "static", "h", "m", 1), ("2", None, None, None, None, None, 1)], sch)
    b = spark.createDataFrame([("1", "v", 404, "static", "H", "other", 1), ("2", None, None, None, None, None, 1)], sch)
    got = {r.request_id: r for r in replay.differences(a, b).collect()}
    assert got["1"].differences == ["final_url changed (u -> v)", "status_code changed (200 -> 404)", "source page content changed (html differs)"] and not got["1"].reproduced
    assert got["2"].reproduced and got["2"].differences == []


def test_verify(spark):
    pages = spark.createDataFrame([(1, "The  Quick fox"), (2, None)], "result_id long, text string")
    c = spark.createDataFrame([(1, 1, "quick FOX", 0.9, False), (2, 1, "slow", 0.9, True), (3, 2, "x", 0.9, True), (4, 9, "x", 0.9, True), (5, 1, None, None, None), (6, 1, " ", 0.8, True)], "citation_id int, result_id long, quote string, support_score double, verified boolean")
    got = {r.citation_id: (r.verified, r.support_score) for r in verify.verify(c, pages).collect()}
    assert got == {1: (True, 0.9), 2: (False, 0.0), 3: (False, 0.0), 4: (False, 0.0), 5: (False, 0.0), 6: (False, 0.0)}
    f = spark.createDataFrame([("r", "a", 0, 0.7, True, 0.7), ("r", "b", 1, 0.69, True, 0.9), ("r", "c", 2, 0.9, False, 0.9), ("r", "d", 3, None, True, 0.9)], "request_id string, field string, position int, confidence double, verified boolean, support_score double")
    assert verify.flagged_fields(f).first().flagged == ["b", "c", "d"]
    fields = spark.createDataFrame([("r", "a", 0), ("r", "b", 1)], "request_id string, field string, position int")
    conf = spark.createDataFrame([("r", "a", 0.5), ("r", "z", 0.5)], "request_id string, field string, confidence double")
    cite = spark.createDataFrame([("r", "z", "q", 0.5)], "request_id string, field string, quote string, support_score double")
    assert [(r.field, r.confidence, r.quote, r.support_score) for r in verify.fill_citations(fields, conf, cite).orderBy("position").collect()] == [("a", 0.5, "", 0.0), ("b", 0.0, "", 0.0)]


def site(spark, edges):
    rows = [(u, u, "".join(f'<a href="{x}">x</a>' for x in out)) for u, out in edges.items()]
    return spark.createDataFrame(rows, "url string, final_url string, html string")


JOB = "id string, root_url string, max_depth int, max_pages int, same_domain_only boolean, include_patterns array<string>, exclude_patterns array<string>"


def test_crawl(spark):
    h = "https://h.test"
    pages = site(spark, {h: ["/a", "/b", "/a#x"], f"{h}/a": ["/c"], f"{h}/c": ["/", "https://off.test/"], f"{h}/b": [], f"{h}/": ["/d"]})
    corpus = frontier.corpus_scrape(pages)
    jobs = spark.createDataFrame([("1", h, 3, 20, True, None, None), ("2", h, 3, 2, True, [], []), ("3", h, 0, 9, True, None, None), ("4", h, 9, 9, False, ["/a", "/c"], ["/b"])], JOB)
    got = {}
    for r in frontier.crawl(jobs, corpus).collect():
        got.setdefault(r.crawl_id, []).append((r.seq, r.url, r.depth, r.status == "success"))
    assert sorted(got["1"]) == [(0, h, 0, True), (1, f"{h}/a", 1, True), (2, f"{h}/b", 1, True), (3, f"{h}/c", 2, True), (4, f"{h}/", 3, True)]
    assert sorted(got["2"]) == [(0, h, 0, True), (1, f"{h}/a", 1, True)]
    assert len(got["3"]) == 1 and [x[1] for x in sorted(got["4"])] == [h, f"{h}/a", f"{h}/c"]
    assert frontier.crawl(jobs.limit(0), corpus).count() == 0


def test_crawl_gate_and_side_effects(spark):
    h = "https://h.test"
    pages = site(spark, {h: ["/a", "/b"], f"{h}/a": ["/c"], f"{h}/b": ["/d"], f"{h}/c": [], f"{h}/d": []})
    jobs = spark.createDataFrame([("1", h, 3, 20, True, None, None)], JOB)
    seen = []

    def broken(rows):
        seen.append(rows.count())
        raise OSError("no space")

    first = frontier.crawl(jobs, frontier.corpus_scrape(pages), contents=broken, most_levels=0)
    assert {(r.url, r.status, r.attempt_count) for r in first.collect()} == {(h, "success", 1), (f"{h}/a", "pending", 0), (f"{h}/b", "pending", 0)} and seen == [1]
    kept = []
    again = frontier.crawl(jobs, frontier.corpus_scrape(pages.where("url != 'https://h.test'")), state=first, preflight=F.when(F.col("url").endswith("/b"), "over quota"), snapshots=lambda r: kept.extend(r.collect()))
    got = {r.url: (r.seq, r.status, r.attempt_count, r.last_error) for r in again.collect()}
    # the root is done and not fetched again; /b fails without an attempt and is not expanded
    assert got == {h: (0, "success", 1, None), f"{h}/a": (1, "success", 1, None), f"{h}/b": (2, "failed", 0, "over quota"), f"{h}/c": (3, "success", 1, None)}
    assert {r.key for r in kept} == {"request-snapshots/1-1.json", "request-snapshots/1-3.json"}
    gone = frontier.crawl(jobs, frontier.corpus_scrape(pages.where("url not like '%/a'")))
    assert {r.url: (r.status, r.last_error) for r in gone.collect()}[f"{h}/a"] == ("failed", "all_tiers_failed")


def test_numbered(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 4}", (i * 7919) % 1000) for i in range(3000)]
    d = spark.createDataFrame(rows, "id int, g string, o int")
    got = {r.id: r.place for r in stores.numbered(d, "g", ["o", "id"]).collect()}
    want = {}
    for i, g, o in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[i] = (g, o)
    place, last = 0, None
    for i, (g, _) in want.items():
        place, last = (1, g) if g != last else (place + 1, g)
        assert got[i] == place
    assert stores.numbered(d.limit(0), "g", ["o", "id"]).count() == 0


def test_scrape_tiers(spark):
    req = spark.createDataFrame([("a", False), ("b", False), ("c", None), ("d", False), ("e", False), ("f", True), ("g", True)], "url string, session boolean")
    s = spark.createDataFrame([("a", "x" * 200, "plain"), ("b", "x" * 199, "plain"), ("c", "short", "plain"), ("e", None, "plain"), ("f", "x" * 300, "plain"), ("g", "x" * 300, "plain")], "url string, text string, title string")
    h = spark.createDataFrame([("a", "y" * 500, "shown"), ("b", "y" * 199, "shown"), ("c", "longer text", "shown"), ("f", "z", "shown")], s.schema)
    got = {r.url: (r.tier, r.error_kind, r.title, len(r.attempts)) for r in stores.scrape_tiers(req, s, h).collect()}
    want = {"a": ("static", None, "plain", 1), "b": ("static", None, "plain", 2), "c": ("headless", None, "shown", 2), "d": (None, "all_tiers_failed", None, 2), "e": ("static", None, "plain", 2), "f": ("headless", None, "shown", 1), "g": (None, "all_tiers_failed", None, 1)}
    assert got == want
    none = {r.url: (r.tier, r.error_kind) for r in stores.scrape_tiers(req, s, None).collect()}
    assert none["a"] == ("static", None) and none["b"] == (None, "internal") == none["d"] == none["f"]


def test_stores(spark, tmp_path):
    st = spark.createDataFrame([("p/1", "a"), ("p/2", "b")], "key string, body string")
    new = spark.createDataFrame([("p/2", "B"), ("q", "c")], st.schema)
    both = stores.put(st, new)
    assert {r.key: r.body for r in both.collect()} == {"p/1": "a", "p/2": "B", "q": "c"}
    assert stores.list_prefix(both, "p/").count() == 2 and stores.remove(both, new.select("key")).count() == 1
    assert stores.get(both, spark.createDataFrame([("none",)], "key string")).first().body is None
    b = stores.Blobs(spark, str(tmp_path / "b"), "tenant/")
    b.ensure()
    b.ensure()
    assert b.list().count() == 0
    b.put(st)
    b.put(new)
    b.delete(spark.createDataFrame([("p/1",), ("nope",)], "key string"))
    assert {r.key for r in b.list().collect()} == {"p/2", "q"} and {r.key for r in b.list("p/").collect()} == {"p/2"}
    assert {r.key: r.body for r in b.get(both).collect()} == {"p/1": None, "p/2": "B", "q": "c"}
    assert stores.Blobs(spark, str(tmp_path / "b"), "other/").list().count() == 0
    snap = spark.createDataFrame([("r", 1, "a"), ("r", 2, None), (None, 3, "c")], "request_id string, n int, v string")
    assert [tuple(r) for r in stores.latest_snapshots(snap, ["n"]).collect()] == [("r", 2, None)]
    bodies = spark.createDataFrame([("x", '{"v": "a"}'), ("y", "{broken"), ("z", None)], "key string, body string")
    assert {r.key: r.snapshot and r.snapshot.v for r in stores.snapshots_of(bodies, "v string").collect()} == {"x": "a", "y": None, "z": None}
    ddl = {"2_b": "CREATE TABLE IF NOT EXISTS mig_b (k STRING) USING parquet LOCATION '%s';" % (tmp_path / "mb"), "1_a": "CREATE TABLE IF NOT EXISTS mig_a (k STRING) USING parquet LOCATION '%s'; ;" % (tmp_path / "ma")}
    assert stores.migrate(spark, ddl) == stores.migrate(spark, ddl) == ["1_a", "2_b"] and spark.catalog.tableExists("mig_b")
    for t in ("mig_a", "mig_b"):
        spark.sql(f"DROP TABLE {t}")


def test_shared_folder(spark, monkeypatch):
    t = stores.materialize(spark.range(3), "t")
    path = t._skein_path
    assert t.count() == 3 and stores.shared_dir(spark) in path
    stores.forget(t)
    import os

    assert not os.path.exists(path.removeprefix("file://"))

    class Cluster:  # a session of a cluster without a shared folder
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})())

    with pytest.raises(RuntimeError, match="checkpoint"):
        stores.shared_dir(Cluster)


def test_fetch():
    open_ = lambda h, p: [(0, 0, 0, "", ("8.8.8.8", 0))]
    shut = lambda h, p: [(0, 0, 0, "", ("8.8.8.8", 0)), (0, 0, 0, "", ("10.0.0.1", 0))]
    pages = {"http://a/": (302, {"location": "/b"}, ""), "http://a/b": (200, {"content-type": "text/html"}, "ok"), "http://a/c": (302, {"location": "/c"}, ""), "http://a/d": (302, {}, ""), "http://a/e": (404, {}, ""), "http://a/f": (200, {"content-type": "image/png"}, "")}
    assert fetch.fetch_static("http://a/", pages.get, open_) == ("http://a/b", 200, "ok")
    for bad in ("http://a/c", "http://a/d", "http://a/e", "http://a/f", "ftp://a/"):
        with pytest.raises(fetch.FetchError):
            fetch.fetch_static(bad, pages.get, open_)
    with pytest.raises(fetch.FetchError):
        fetch.fetch_static("http://a/", pages.get, shut)


def open_host(h, p):
    return [(0, 0, 0, "", ("10.0.0.1" if h.startswith("private") else "8.8.8.8", 0))]


def test_fetch_rows(spark):
    def get(url):
        if "boom" in url:
            raise LookupError("bad port")
        return 200, {"content-type": "text/html"}, "ok"

    urls = spark.createDataFrame([("http://a/",), ("http://a/boom",), ("http://private/",), ("http://[x/",), (None,)], "url string")
    got = {r.url: (r.status_code, r.error_kind) for r in fetch.fetch_table(urls, lambda u: fetch.fetch_static(u, get, open_host)).collect()}
    assert got == {"http://a/": (200, None), "http://a/boom": (None, "fetch"), "http://private/": (None, "fetch"), "http://[x/": (None, "fetch"), None: (None, "fetch")}


class Fake:
    """A browser that notes its launches and closings in a folder."""

    def __init__(self, folder):
        import pathlib
        import uuid

        self.note = lambda what: (pathlib.Path(folder) / f"{what}-{uuid.uuid4().hex}").touch()
        self.note("launch")

    def render(self, url, state, allow):
        if "inner" in url:
            allow("http://private/image")
        if "crash" in url:
            raise KeyError("crash")
        return url + "#end", 500 if "bad" in url else 200, f"<p>{state}</p>"

    def close(self):
        self.note("close")


def test_rendered_rows(spark, tmp_path):
    import os

    folder = str(tmp_path)
    req = spark.createDataFrame([(f"http://a/{x}", None) for x in ("1", "2", "bad", "crash", "inner")] + [("http://a/1", "s"), ("http://private/", None)], "url string, state string")
    got = {(r.url, r.html or r.error_kind) for r in fetch.fetch_rendered(req, lambda: Fake(folder), 2, open_host).collect()}
    assert got == {("http://a/1", "<p>None</p>"), ("http://a/1", "<p>s</p>"), ("http://a/2", "<p>None</p>"), ("http://a/bad", "fetch"), ("http://a/crash", "fetch"), ("http://a/inner", "fetch"), ("http://private/", "fetch")}
    names = os.listdir(folder)
    assert 1 <= sum(n.startswith("launch") for n in names) == sum(n.startswith("close") for n in names) <= 2

    def none():
        raise OSError("not installed")

    assert {r.error_kind for r in fetch.fetch_rendered(req.where("url = 'http://a/1'"), none, 2, open_host).collect()} == {"internal"}


def test_robots_refresh(spark):
    now = F.lit(at(7200)).cast("timestamp")
    cache = spark.createDataFrame([("http://a", "old", at(3601)), ("http://b", "old", at(3600)), ("http://b", "older", at(0))], "origin string, text string, fetched_at timestamp")
    origins = spark.createDataFrame([("http://a",), ("http://b",), ("http://c",), ("http://c",), (None,)], "origin string")
    got = {r.origin: (r.text, r.fetched_at) for r in fetch.refresh_robots(origins, cache, now, lambda o: o[-1]).collect()}
    assert got == {"http://a": ("old", at(3601)), "http://b": ("b", at(7200)), "http://c": ("c", at(7200))}
    hop = {"http://a/robots.txt": (301, {"location": "/r"}, ""), "http://a/r": (200, {}, "User-agent: *"), "http://b/robots.txt": (404, {}, "x"), "http://l/robots.txt": (302, {"location": "/robots.txt"}, "")}
    assert [fetch.robots_text(o, hop.get, open_host) for o in ("http://a", "http://b", "http://l", "http://private", "http://none")] == ["User-agent: *", "", "", "", ""]


def test_search(spark):
    d = spark.createDataFrame([(3, "a b"), (1, "A, B!"), (2, None), (4, "z")], "doc_id long, text string")
    assert [(r.doc_id, r.score) for r in search.top_k(d, "a b", 2).collect()] == [(1, 2), (3, 2)]
    a = spark.createDataFrame([("q", '{"web":{"results":[{"title":"t","url":"u","description":"d"}]}}'), ("r", "{}"), ("s", "nope")], "query string, body string")
    assert [(r.query, r.title) for r in search.parse_answers(a).collect()] == [("q", "t")]


def html_page(title, words):
    return f"<html><head><title>{title}</title></head><body><article><h1>{title}</h1><p>" + "word, " * words + "</p></article></body></html>"


def test_engine(spark):
    req = spark.createDataFrame([("1", "http://a/", False), ("2", "ftp://a/", False), ("3", "http://x/no", False), ("4", "http://thin/", False), ("5", "http://gone/", False), ("6", "http://x/no", True), ("7", "http://a/", None)], "request_id string, url string, skip_robots boolean")
    with pytest.raises(NotConfigured):
        Engine(spark).scrape(req)
    cols = "url string, final_url string, status_code int, html string"
    corpus = spark.createDataFrame([("http://a/", "http://a/x", 200, html_page("A", 80)), ("http://a/", "http://a/x", 200, html_page("A", 80)), ("http://thin/", "http://thin/", 200, html_page("Thin", 8)), ("http://gone/", "http://gone/", 404, html_page("Gone", 80)), ("http://x/no", "http://x/no", 200, html_page("X", 80))], cols)
    shown = spark.createDataFrame([("http://thin/", "http://thin/shown", 201, html_page("Shown", 90)), ("http://a/", "http://a/never", 200, html_page("Never", 900))], cols)
    rules = spark.createDataFrame([("http://x", [(False, "^/no", 3)])], "origin string, rules array<struct<allow:boolean,pattern:string,len:int>>")
    e = Engine(spark, corpus=corpus, rendered=shown, robots=rules)
    got = {r.request_id: (r.tier, r.error_kind, r.title, r.status_code, r.final_url) for r in e.scrape(req).collect()}
    assert got == {
        "1": ("static", None, "A", 200, "http://a/x"), "7": ("static", None, "A", 200, "http://a/x"), "2": (None, "client", None, None, None), "3": (None, "robots_disallowed", None, None, None),
        "4": ("headless", None, "Shown", 201, "http://thin/shown"), "5": (None, "all_tiers_failed", None, None, None), "6": ("static", None, "X", 200, "http://x/no"),
    }
    page = e.scrape(req.where("request_id = '4'")).first()
    assert page.markdown.startswith("# Shown") and page.text.startswith("Shown") and [a.success for a in page.attempts] == [True, True]
    under = e.scrape(req.where("request_id in ('1', '5')").withColumn("session", F.lit(True)))
    assert {r.request_id: (r.tier, r.error_kind, r.title, len(r.attempts)) for r in under.collect()} == {"1": ("headless", None, "Never", 1), "5": (None, "all_tiers_failed", None, 1)}
    assert {r.error_kind for r in Engine(spark, corpus=corpus).scrape(req.where("request_id = '4'")).collect()} == {"internal"}
    with pytest.raises(ValueError, match="limit"):
        e.search("q", 50)


def test_engine_cache(spark):
    cols = "url string, final_url string, status_code int, html string"
    corpus = spark.createDataFrame([("http://a/", "http://a/", 200, html_page("A", 80)), ("http://b/", "http://b/", 500, "")], cols)
    page = '{"markdown": "old"}'
    cache = spark.createDataFrame([("http://a/", at(0), page), ("http://b/", at(0), page), ("http://c/", at(0), '{"markdown": 3}')], "url string, crawled_at timestamp, content string")
    e = Engine(spark, corpus=corpus, rendered=corpus.limit(0), cache=cache, clock=lambda: at(7200))
    rows = [("1", "http://a/", "standard"), ("2", "http://a/", "news"), ("3", "http://a/", None), ("4", "http://b/", "news"), ("5", "http://b/", None), ("6", "http://c/", "news"), ("7", "http://a/", "hourly")]
    req = spark.createDataFrame([(*r, False) for r in rows], "request_id string, url string, tier string, skip_robots boolean")
    served, records = e.scrape_fresh(req)
    got = {r.request_id: (r.from_cache, r.within_sla, r.crawled_at, r.error_kind) for r in served.collect()}
    assert got == {
        "1": (True, True, at(0), None), "2": (False, True, at(7200), None), "3": (False, None, at(7200), None), "4": (True, False, at(0), None),
        "5": (False, None, None, "all_tiers_failed"), "6": (False, None, None, "all_tiers_failed"), "7": (None, None, None, "unknown_tier"),
    }
    assert [(r.url, r.tier, r.crawled_at) for r in records.collect()] == [("http://a/", "news", at(7200))]
    state = freshness.merge_state(freshness.tighten(records.limit(0)), records)
    assert state.first().watched_tier == "news"


def test_engine_extract_and_crawl(spark):
    import json

    schema = {"type": "object", "properties": {"name": {"type": "string"}, "n": {"type": "integer"}}, "required": ["name"]}

    def model(text, tool):
        if text.startswith("Down"):
            return 503, ""
        if text.startswith("Bad"):
            return 200, "{}"
        data = {"name": "x", "n": 3} if text.startswith("Good") else {"name": 5}
        args = {"data": data, "confidence": {"name": 0.9, "gone": 1}, "citations": {"name": {"quote": "WORD,  word", "supportScore": 0.8}, "n": {"quote": 7, "supportScore": 1}}}
        return 200, json.dumps({"choices": [{"message": {"tool_calls": [{"function": {"name": "record_extraction", "arguments": json.dumps(args)}}]}}]})

    names = ["Good", "Down", "Bad", "Odd"]
    corpus = spark.createDataFrame([(f"http://{n}/", f"http://{n}/end", 200, html_page(n, 80)) for n in names], "url string, final_url string, status_code int, html string")
    req = spark.createDataFrame([(n, f"http://{n}/", False) for n in [*names, "Lost"]], "request_id string, url string, skip_robots boolean")
    e = Engine(spark, corpus=corpus, rendered=corpus.limit(0), extractor=model)
    got = {(r.request_id, r.field): (r.value, r.confidence, r.quote, r.support_score, r.verified, r.flagged, r.final_url, r.error_kind) for r in e.extract(req, schema).collect()}
    bad = (None,) * 7
    assert got == {
        ("Good", "name"): ('"x"', 0.9, "WORD,  word", 0.8, True, False, "http://Good/end", None), ("Good", "n"): ("3", 0.0, "", 0.0, False, True, "http://Good/end", None),
        ("Down", None): (*bad, "upstream"), ("Bad", None): (*bad, "upstream"), ("Odd", None): (*bad, "upstream"), ("Lost", None): (*bad, "all_tiers_failed"),
    }
    with pytest.raises(NotConfigured):
        Engine(spark, corpus=corpus).extract(req, schema)
    jobs = spark.createDataFrame([("1", "http://Good/", 1, 5, True, None, None)], JOB)
    assert {(r.url, r.status, r.tier) for r in e.crawl(jobs).collect()} == {("http://Good/", "success", "static")}


def test_replayable(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "request_id string")
    cap, pages = spark.createDataFrame([("a",), ("b",), ("a",)], "request_id string"), spark.createDataFrame([("b",), (None,)], "request_id string")
    assert {r.request_id: r.error_kind for r in replay.replayable(ids, cap, pages).collect()} == {"a": None, "b": "crawl_page", "c": "not_found"}


def test_composite(spark, tmp_path):
    b = stores.Blobs(spark, str(tmp_path / "f"))
    rec = spark.createDataFrame([("u", 1, "standard", at(0), '{"markdown": "m"}'), ("v", 2, "news", at(0), "nope"), ("w", 3, "none", at(0), '{"markdown": "m"}')], "url string, seq long, tier string, crawled_at timestamp, content string")
    state = freshness.record_composite(b, freshness.tighten(rec.limit(0)), rec)
    ask = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    hit = lambda: {r.url for r in freshness.lookup_composite(b, ask, state).collect() if r.content}
    assert hit() == {"u"} and state.count() == 2 and b.list("freshness/").count() == 2
    left, gone = freshness.delete_composite(b, state, ask.where("url = 'u'"))
    assert left.count() == 1 and gone.first().existed and b.list().count() == 1 and hit() == set()


def test_streams(spark, tmp_path):
    from skein.streaming import tables

    rows = [("u", i, at(1800 * i), 3600, i % 5 != 4) for i in range(12)] + [("v", 0, at(0), 3600, False)]
    req = spark.createDataFrame(rows, "url string, seq long, ts timestamp, max_seconds long, ok boolean")
    want = {(r.url, r.seq): r.decision for r in freshness.replay(req).collect()}
    for k in range(3):  # three files are three micro-batches: state is handed on
        req.where(f"seq >= {4 * k} and seq < {4 * k + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    src = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = {(r.url, r.seq): r.decision for r in tables.run_batches(tables.replay_stream(src), "t").collect()}
    assert got == want


def test_requests(spark):
    d = spark.createDataFrame([("http://a/", None, None), ("ftp://a", 11, 0), (None, 0, 500)], "root_url string, max_depth int, max_pages int")
    got = [r.at_fault for r in requests.crawls(requests.defaults(d)).collect()]
    assert got == [[], ["root_url", "max_depth", "max_pages"], ["root_url"]]
    q = spark.createDataFrame([("a", 20), (" ", 21), (None, 1)], "query string, limit int")
    assert [r.at_fault for r in requests.searches(q).collect()] == [[], ["query", "limit"], ["query"]]
    assert [r.error_kind for r in requests.scrapes(d.withColumnRenamed("root_url", "url")).collect()] == [None, "client", "client"]


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(10).coalesce(1)
    assert stores.spread(one).rdd.getNumPartitions() == cores
    many = spark.range(0, 10, 1, cores + 3)
    assert stores.spread(many) is many
    shuffled = one.groupBy("id").count()
    assert stores.spread(shuffled) is shuffled
