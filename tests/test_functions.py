import pytest
from pyspark.sql import functions as F

from skein.functions import crypto, hosts, robots, text, urls
from skein.functions.html import page_content
from skein.functions.jsonschema import SchemaError, Validator, conforms, tool_schema


def col(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_spaces_and_units(spark):
    assert col(spark, ["  A ﻿ b\n", "", None, "\u0085x"], text.even_spaces) == ["a b", "", None, "\u0085x"]
    assert col(spark, ["😀a", "", None], text.utf16_length) == [3, 0, None]
    assert col(spark, ["## A\n##\nb"], text.strip_headings) == ["A\n\nb"]


def test_quotes_and_matches(spark):
    rows = spark.createDataFrame([("a  B", "x A b y", True), ("", "x", False), (" \n", "x", False), (None, "x", False), ("q", None, False)], "q string, t string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", text.quote_supported(F.col("q"), F.col("t")).alias("got")).collect())
    n = spark.createDataFrame([(1.009, 1.0, True), (1.01, 1.0, False), (float("nan"), float("nan"), False), (None, None, True), (None, 1.0, False)], "a double, b double, want boolean")
    assert all(r.got == r.want for r in n.select("want", text.numbers_match(F.col("a"), F.col("b")).alias("got")).collect())
    s = spark.createDataFrame([(" A ", "a", True), ("a  b", "a b", False), (None, None, True), (None, "", False)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in s.select("want", text.strings_match(F.col("a"), F.col("b")).alias("got")).collect())


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("https://H.test:443/a/b?x=1", "c", "https://h.test/a/c"), ("https://h.test/a/b", "../../c/./d/..", "https://h.test/c/"), ("http://h.test", "", None),
        ("http://h.test/a", "?q=ü", "http://h.test/a?q=%C3%BC"), ("http://h.test/a", "/für#x", "http://h.test/f%C3%BCr"), ("http://h.test/a", "//o.test:80/p", "http://o.test/p"),
        ("http://h.test/a", "mailto:x@y", None), ("http://h.test/a", "JavaScript:void(0)", None), ("http://h.test/a", "\\b", "http://h.test/b"), ("http://h.test/a", "#top", "http://h.test/a"),
        ("http://h.test/a", "https://o.test:x/", None), (None, "/a", None), ("nope", "/a", None), ("http://h.test", "http://h.test", "http://h.test/"),
    ],
)
def test_resolve(base, href, want):
    assert urls.resolve(base, href) == want


@pytest.mark.parametrize(
    ("glob", "hits", "misses"),
    [
        ("/a/*", ["/a/b", "/a/b.html"], ["/a/b/c", "/a/", "/a/.x"]), ("/a/**", ["/a/b", "/a/b/c"], ["/b", "/a/.x/c"]), ("/**/z", ["/z", "/a/b/z"], ["/a/zz"]),
        ("/{a,b}/?", ["/a/x", "/b/y"], ["/c/x", "/a/xy"]), ("!/a/*", ["/b"], ["/a/b"]), ("#x", [], ["#x"]), ("/[ab]1", ["/a1"], ["/c1"]), ("/a.b", ["/a.b"], ["/axb"]),
    ],
)
def test_glob(glob, hits, misses):
    import re

    rx = re.compile(urls.glob_to_regex(glob))
    assert all(rx.search(h) for h in hits) and not any(rx.search(m) for m in misses)


def test_bounds(spark):
    d = spark.createDataFrame([("/a/x", ["/a/*"], None, True), ("/b", ["/a/*"], None, False), ("/b", [], None, True), ("/b", None, ["/b"], False), ("/a/x", ["/a/*"], ["/a/**"], False)], "p string, inc array<string>, exc array<string>, want boolean")
    d = d.withColumns({"inc": urls.globs_to_regexes("inc"), "exc": urls.globs_to_regexes("exc")})
    assert all(r.got == r.want for r in d.select("want", urls.allowed_by(F.col("p"), F.col("inc"), F.col("exc")).alias("got")).collect())


def test_blocked(spark):
    ips = ["8.8.8.8", "10.1.2.3", "172.15.0.1", "172.16.0.1", "169.254.169.254", "::1", "fe80::1", "fd00::1", "2001:db8::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "300.1.1.1", "x", None]
    assert col(spark, ips, hosts.is_blocked) == [False, True, False, True, True, True, True, True, False, True, False, True, True, True]


def test_robots(spark):
    rules = robots.parse_rules("User-agent: a\nUser-agent: *\nDisallow: /x\nAllow: /x/y$\n\nUser-agent: b\nDisallow: /", "mine")
    assert [(r["allow"], r["len"]) for r in rules] == [(False, 2), (True, 5)]
    assert robots.parse_rules(None, "mine") == []
    req = spark.createDataFrame([("o", "/x/z", False), ("o", "/x/y", True), ("o", "/x/y2", False), ("p", "/x", True)], "origin string, path string, want boolean")
    table = robots.rule_table(spark.createDataFrame([("o", "User-agent: *\nDisallow: /x\nAllow: /x/y$", 1)], "origin string, text string, fetched_at int"), "mine")
    assert all(r.robots_allowed == r.want for r in robots.decide(req, table).collect())


PAGE = """<html><head><title> A &amp; B </title><script>"</p>"</script></head><body><nav><a href="/n">nav</a></nav><div id="cookie-banner">We use cookies</div>
<main><article><h1>Head</h1><p>First paragraph, long enough to be taken as running text of the page.<p>Second <b>bold</b> one with <a href="/l?a=1">link</a>, and a <code>code</code>.
<ul><li>one<li>two</ul><pre>x  y</pre></article></main><div class="promo-box">Buy</div><footer>Copyright</footer></body></html>"""


def test_content():
    c = page_content(PAGE)
    assert c["title"] == "A & B" and c["hrefs"] == ["/n", "/l?a=1"]
    for bad in ("We use cookies", "Copyright", "Buy", "nav"):
        assert bad not in c["markdown"] and bad not in c["text"]
    for good in ("# Head", "**bold**", "[link](/l?a=1)", "*   one\n*   two", "```\nx  y\n```"):
        assert good in c["markdown"]
    stub = page_content("<title>Stub</title><nav>a</nav><footer>b</footer>")
    assert stub["title"] == "Stub" and stub["markdown"] == "" == stub["text"]
    assert page_content(None) == {"title": None, "markdown": "", "text": "", "hrefs": []}
    assert page_content("<main>only</main>")["markdown"] == "only"


def test_schema(spark):
    v = Validator({"type": "object", "properties": {"a": {"$ref": "#/$defs/n"}}, "required": ["a"], "$defs": {"n": {"type": "object", "properties": {"next": {"$ref": "#/$defs/n"}, "v": {"type": "integer"}}}}, "x-note": 1})
    assert v.valid({"a": {"v": 1, "next": {"v": 2}}}) and not v.valid({"a": {"next": {"v": "2"}}}) and not v.valid({})
    assert not Validator({"type": "integer"}).valid(True) and Validator({"enum": [1, "a"]}).valid("a") and not Validator({"enum": [1]}).valid(True)
    for bad in ({"type": "nope"}, {"$ref": "#/none"}, {"properties": 3}, 5):
        with pytest.raises(SchemaError):
            Validator(bad)
    assert col(spark, ['{"k": 1}', "{", None, "{}"], lambda c: conforms({"type": "object", "required": ["k"]})(c)) == [True, False, None, False]
    Validator(tool_schema({"type": "object", "properties": {"a": {"type": "string"}}}))


def test_sessions(spark):
    keys = crypto.Keys({1: b"a" * 32, 2: b"b" * 32}, 2)
    df = spark.createDataFrame([(1, "state"), (2, ""), (3, None)], "id int, state string")
    sealed = crypto.seal(df, "state", keys)
    got = {r.id: (r.opened, r.error) for r in crypto.open_sealed(sealed, keys).collect()}
    assert got == {1: ("state", None), 2: ("", None), 3: (None, None)}
    other = {r.id: r.error for r in crypto.open_sealed(sealed, crypto.Keys({1: b"a" * 32}, 1)).collect()}
    assert other[1] == "unknown_key"
    wrong = {r.id: r.error for r in crypto.open_sealed(sealed, crypto.Keys({2: b"c" * 32}, 2)).collect()}
    assert wrong[1] == "tampered"
    with pytest.raises(ValueError, match="no key"):
        crypto.Keys({1: b"a" * 32}, 2)
    assert "aaaa" not in repr(keys)




def test_schema_of_deep_values(spark):
    loop = {"$defs": {"n": {"anyOf": [{"type": "integer"}, {"type": "object", "properties": {"x": {"$ref": "#/$defs/n"}}, "required": ["x"]}]}}, "$ref": "#/$defs/n"}
    deep = lambda n, end: '{"x": ' * n + end + "}" * n
    assert col(spark, [deep(300, "1"), deep(1500, "1"), deep(1500, '"s"'), deep(100_000, "1")], lambda c: conforms(loop)(c)) == [True, True, False, None]
    assert Validator({"$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"$ref": "#/$defs/a"}}, "$ref": "#/$defs/a"}).valid(3)


def test_blocked_alike_in_fetchers(spark):
    ips = ["8.8.8.8", "10.1.2.3", "::1", "::ffff:10.0.0.1", "abcd:", "1:2", "x", None, "2001:4860::1", "fe80::1%eth0", "1.2.3.4.5", "FD00::1"]
    assert col(spark, ips, hosts.is_blocked) == [hosts.blocked(x) for x in ips]


def test_remote_keys(spark):
    import base64

    asked = []

    def ask(version):
        asked.append(version)
        return (200, base64.b64encode(bytes([version]) * 32).decode()) if version < 3 else (404, "") if version == 3 else (500, "x" * 900)

    remote = crypto.RemoteKeys(ask)
    assert remote.get(None) is None and remote.get(3) is None and remote.get(1) == remote.get(1) == b"\1" * 32 and asked == [3, 1]
    keys = remote.keys([1, 3], 2)
    assert sorted(keys.keys) == [1, 2]
    sealed = crypto.seal(spark.createDataFrame([(1, "state")], "id int, state string"), "state", keys)
    assert crypto.open_sealed(sealed, keys).first().opened == "state"
    with pytest.raises(RuntimeError, match="500") as e:
        remote.get(4)
    assert len(str(e.value)) < 540
    with pytest.raises(ValueError, match="no key"):
        remote.keys([1], 3)
