"""Queries p1 to p9 over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import body, encoding, glyphs, lines, mix, neardup, residue, spans, tokens
from skein.llm.common import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "scrape_results")).select("result_id")


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "scrape_results")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged(table(spark, d, "scrape_results")).select("result_id", "field").distinct()


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged(table(spark, d, "scrape_results"))


def p2_learned(spark: SparkSession, d: str) -> DataFrame:
    return encoding.learn(encoding.words(table(spark, d, "scrape_results"), ("text", "title")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "scrape_results"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "scrape_results"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.boilerplate_lines(table(spark, d, "scrape_results")).select("result_id", "line_no")


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return lines.strip_lines(table(spark, d, "scrape_results"))


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    return lines.site_blocks(table(spark, d, "scrape_results"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.found_only_by_form(table(spark, d, "citations"), table(spark, d, "scrape_results"))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.normalized(table(spark, d, "scrape_results"), "result_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return body.surroundings(table(spark, d, "scrape_results"))


def p6_body(spark: SparkSession, d: str) -> DataFrame:
    return body.main_text(table(spark, d, "scrape_results"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_plans"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_plans"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_parts(table(spark, d, "documents"))


_KEYED = r"""
WITH p AS (
  SELECT result_id, regexp_replace(lower(regexp_extract(final_url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS site,
         string_split(coalesce(markdown, ''), chr(10)) AS ls
  FROM scrape_results WHERE final_url IS NOT NULL),
l AS (
  SELECT result_id, site, unnest(range(1, len(ls) + 1)) AS line_no, lower(regexp_replace(unnest(ls), '[^\p{L}]+', '', 'g')) AS k
  FROM p WHERE site <> ''),
n AS (SELECT site, count(DISTINCT result_id) AS pages FROM p WHERE site <> '' GROUP BY site),
hot AS (
  SELECT l.site, k FROM l JOIN n ON l.site = n.site WHERE k <> '' GROUP BY l.site, k, pages
  HAVING count(DISTINCT result_id) >= 8 AND count(DISTINCT result_id) * 5 >= pages)
"""

_CLEAN = _KEYED + """
, f AS (SELECT DISTINCT result_id, line_no FROM l JOIN hot ON l.site = hot.site AND l.k = hot.k),
e AS (SELECT result_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT result_id, string_split(markdown, chr(10)) AS ls FROM scrape_results WHERE markdown IS NOT NULL)),
c AS (SELECT e.result_id, string_agg(line, chr(10) ORDER BY e.line_no) FILTER (f.line_no IS NULL) AS left_, count(f.line_no) AS gone FROM e LEFT JOIN f ON e.result_id = f.result_id AND e.line_no = f.line_no GROUP BY e.result_id)
SELECT s.result_id, CASE WHEN s.markdown IS NOT NULL THEN coalesce(left_, '') END AS markdown, coalesce(gone, 0) AS lines_removed FROM scrape_results s LEFT JOIN c ON s.result_id = c.result_id
"""

_BLOCKS = _KEYED.replace("WITH p AS", "WITH RECURSIVE p AS") + """
, q AS (SELECT site, result_id, k, lead(k) OVER (PARTITION BY result_id ORDER BY line_no) AS k2 FROM l WHERE k <> ''),
g AS (
  SELECT q.site, k AS a, k2 AS b FROM q JOIN n ON q.site = n.site WHERE k2 IS NOT NULL AND (q.site, k) IN (SELECT (site, k) FROM hot) AND (q.site, k2) IN (SELECT (site, k) FROM hot)
  GROUP BY q.site, k, k2, pages HAVING count(DISTINCT result_id) >= 8 AND count(DISTINCT result_id) * 5 >= pages),
u AS (SELECT site, a, b FROM g UNION SELECT site, b, a FROM g),
r AS (SELECT site, k AS a, k AS b FROM hot UNION SELECT r.site, r.a, u.b FROM r JOIN u ON r.site = u.site AND r.b = u.a),
c AS (SELECT site, a AS k, min(b) AS block FROM r GROUP BY site, a),
m AS (SELECT l.site, k, count(DISTINCT result_id) AS n FROM l WHERE (l.site, k) IN (SELECT (site, k) FROM hot) GROUP BY l.site, k)
SELECT c.site, count(*) AS lines, min(n) AS least_pages, max(n) AS most_pages FROM c JOIN m ON c.site = m.site AND c.k = m.k GROUP BY c.site, block
"""

_WORDS = r"""
WITH w AS (
  SELECT result_id, list_filter(string_split_regex(lower(markdown), '[ \t\r\n]+'), lambda x: x <> '') AS ws FROM scrape_results WHERE markdown IS NOT NULL),
s AS (
  SELECT result_id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS sh FROM w WHERE len(ws) >= 60),
e AS (SELECT result_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.result_id AS x, b.result_id AS y, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.result_id < b.result_id GROUP BY ALL)
SELECT x AS result_id_a, y AS result_id_b FROM c WHERE k * 10 >= 7 * (na + nb - k)
"""

_SPANS = """
WITH g AS (
  SELECT DISTINCT doc_id, w FROM (SELECT doc_id, substr(text, unnest(range(1, length(text) - 198)), 200) AS w FROM documents WHERE length(text) >= 200)),
h AS (SELECT w FROM g GROUP BY w HAVING count(*) > 1),
m AS (SELECT g.doc_id, g.w FROM g JOIN h ON g.w = h.w)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM m a JOIN m b ON a.w = b.w AND a.doc_id < b.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_kinds": p1_kinds,
    "p2_found": p2_found, "p2_repaired": p2_repaired, "p2_learned": p2_learned,
    "p3_found": p3_found, "p3_groups": p3_groups,
    "p4_found": p4_found, "p4_clean": p4_clean, "p4_blocks": p4_blocks,
    "p5_found": p5_found, "p5_forms": p5_forms,
    "p6_found": p6_found, "p6_body": p6_body,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_shared": p9_shared,
}

SQL: dict[str, str] = {
    "p3_found": _WORDS,
    "p9_found": _SPANS,
    "p4_blocks": _BLOCKS, "p4_clean": _CLEAN,
    "p4_found": _KEYED + "SELECT result_id, line_no FROM l JOIN hot ON l.site = hot.site AND l.k = hot.k",
}
