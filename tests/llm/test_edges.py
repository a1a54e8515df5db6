"""Every operator against empty tables, NULLs, empty and long texts, repeats and clashing column names."""

import pytest
from pyspark.sql import functions as F

from skein.llm import body, encoding, glyphs, lines, mix, neardup, residue, spans, tokens

PAGES = "result_id long, request_id string, crawl_id string, final_url string, title string, markdown string, text string, html string, status_code int, key string, keys int, site string, n int, band long, rep long, label int, h long, sig string, kind string, word string, bucket long, line_no int"
LONG = "word " * 40_000


def pages(spark):
    tail = ("k", 1, "s", 1, 1, 1, 1, 1, "g", "x", "w", 1, 1)
    rows = [
        (1, None, None, None, None, None, None, None, None),
        (2, "r", "c", "http://a.test/x", "", "", "", "", 200),
        (3, "r", "c", "not a url", " ", "\n\n", " \n", "<p>", 200),
        (4, "r", "c", "http://a.test/y", "T", LONG, LONG, "<html><body><div><h1>T</h1><p>" + LONG + "</p></div></body></html>", None),
        (5, "r", "c", "http://a.test/z", "T", LONG, LONG, "<" * 500, 404),
        (5, "r", "c", "http://a.test/z", "T", LONG, LONG, "<" * 500, 404),
        (None, "r", "c", "http://a.test/z", "T", "a b c " * 30, "x", "<p>x</p>", 200),
    ]
    return spark.createDataFrame([r + tail for r in rows], PAGES)


CITES = "citation_id long, result_id long, request_id string, field string, quote string, support_score double, verified boolean, text string, form string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, pos int, sig long, rep long, shard long, ids array<int>, copies int, share double"
PLANS = "plan string, source string, target_share double, max_repeats int, tokens long, n_docs int"


def cites(spark):
    return spark.createDataFrame([(1, 4, "r", "f", "ｗｏｒｄ word", 0.5, None, "t", "f"), (1, 4, "r", "f", "ｗｏｒｄ word", 0.5, None, "t", "f"), (2, 4, None, None, None, None, None, None, None), (3, 4, None, None, " ", None, None, None, None), (4, 9, None, None, "x", None, None, None, None), (None, 4, None, None, "ｗｏｒｄ", None, None, None, None), (6, 4, "r", "f", "​", 0.5, None, "t", "f")], CITES)


def docs(spark):
    tail = (1, 1, 1, 1, 1, [1], 1, 0.1)
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n", None, None, 2), (4, LONG, "en", "a", 5), (5, LONG, "en", "b", 5), (6, "x\x00y" * 100, "en", "b", 5), (None, LONG, "en", "b", 5), (7, "z" + "x\x00y" * 100, "en", None, 5)]
    return spark.createDataFrame([r + tail for r in rows], DOCS)


def plans(spark):
    return spark.createDataFrame([("p", "a", 0.5, 2, 1, 1), ("p", "b", 0.5, None, 1, 1), ("p", "gone", 0.5, 2, 1, 1), ("q", "b", None, 3, 1, 1), (None, "a", 0.1, 1, 1, 1), ("p", None, 0.1, 1, 1, 1)], PLANS)


OPERATORS = {
    "residue": lambda p, c, d, m: residue.residue(p),
    "clean": lambda p, c, d, m: residue.clean_pages(p),
    "damaged": lambda p, c, d, m: encoding.damaged(p),
    "similar": lambda p, c, d, m: neardup.similar_pairs(p),
    "groups": lambda p, c, d, m: neardup.groups(p),
    "lines": lambda p, c, d, m: lines.boilerplate_lines(p),
    "strip": lambda p, c, d, m: lines.strip_lines(p),
    "forms": lambda p, c, d, m: glyphs.found_only_by_form(c, p),
    "normalized": lambda p, c, d, m: glyphs.normalized(p, "result_id", "text"),
    "surroundings": lambda p, c, d, m: body.surroundings(p),
    "main": lambda p, c, d, m: body.main_text(p),
    "ids": lambda p, c, d, m: tokens.token_ids(d),
    "copies": lambda p, c, d, m: mix.mix(d, m)[0],
    "shares": lambda p, c, d, m: mix.mix(d, m)[1],
    "pairs": lambda p, c, d, m: spans.shared_pairs(d),
    "parts": lambda p, c, d, m: spans.shared_parts(d),
}
EXPECT = {
    "residue": set(), "lines": set(), "forms": {(1,)}, "pairs": {(4, 5), (6, 7)}, "similar": {(4, 5)},
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    got = OPERATORS[name](pages(spark), cites(spark), docs(spark), plans(spark)).collect()
    if name in EXPECT:
        assert {tuple(r)[: len(next(iter(EXPECT[name]), ()))] for r in got} == EXPECT[name]
    if name == "ids":
        by = {r.doc_id: r.ids for r in got}
        assert by[1] == [] == by[2] and len(got) == 8
    if name == "parts":
        by = {r.doc_id: (r.chars, r.shared_chars, r.partners) for r in got}
        assert by[1] == (0, 0, 0) == by[2] and by[4] == (len(LONG), len(LONG), 1) and by[6] == (300, 300, 1) and by[7] == (301, 300, 1)
    if name == "strip":
        by = {r.result_id: r.markdown for r in got}
        assert by[1] is None and by[2] == "" and by[4] == LONG
    if name == "main":
        by = {r.result_id: r.body for r in got if r.result_id}
        assert by[1] is None and by[4].strip() == LONG.strip()
    if name == "shares":
        p = {(r.plan, r.source): r for r in got}
        assert p["p", "gone"].tokens == 0 and p["p", "b"].tokens == 0 and p["p", "a"].share == 1.0 and p["q", "b"].tokens == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(spark, name):
    nothing = [f(spark).where(F.lit(False)) for f in (pages, cites, docs, plans)]
    assert OPERATORS[name](*nothing).count() == 0
