"""Problem 4: lines repeated across one site's documents.

Method: a weighted graph of lines. Nodes are the lines of a site (by their letters in
lower case), weighted by the pages they stand on; edges join lines that follow each other,
weighted likewise. Nodes and edges of high support are kept. Connected components are the
site's boilerplate blocks; a node that no kept edge meets is a block of one line, by its own
support. Occurrences of blocks are looked up in every page and deleted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import host_of, join_sites, materialize, spread

MIN_PAGES = 8
MIN_SHARE = 0.2
#: Rows of one site that share a part of a join.
SITE_ROWS = 200_000


def line_key(line: Column) -> Column:
    """64-bit key of a line's letters in lower case; NULL for a line without letters."""
    letters = F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))
    return F.when(letters != "", F.xxhash64(letters))


def keyed_pages(pages: DataFrame, text: str = "markdown", carry: tuple[str, ...] = ()) -> DataFrame:
    """(result_id, carry..., site, sid, keys): the key of each line in order; sid is a 64-bit key of the site, NULL without one."""
    own = pages.select("result_id", *carry, host_of(F.col("final_url")).alias("site"), F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), line_key).alias("keys"))
    return own.select("result_id", *carry, "site", F.when(F.col("site").isNotNull(), F.xxhash64("site")).alias("sid"), "keys")


def _of_sites(keyed: DataFrame) -> DataFrame:
    return keyed.where("site is not null and result_id is not null")


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Union-find over one site's kept edges; a site has at most 1 / MIN_SHARE x lines-per-page nodes."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
    nodes = list(up)
    return pd.DataFrame({"sid": [pdf["sid"].iloc[0]] * len(nodes), "key": nodes, "block": [find(x) for x in nodes]})


def _supported(counted: DataFrame, sites: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    return counted.where(F.col("n") >= min_pages).join(sites, "sid").where(F.col("n") >= min_share * F.col("rows"))


def _pages_with(each: DataFrame, by: list[str], twice: DataFrame) -> DataFrame:
    """Rows of each (result_id, by...) counted as n distinct result_ids per by; twice: result_ids of several rows.

    Only rows of those ids are made distinct; the rest is counted as it lies, so partial
    counts meet in the shuffle instead of ids.
    """
    once = each.join(twice, "result_id", "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    more = each.join(twice, "result_id", "left_semi").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return once.unionByName(more).groupBy(*by).agg(F.sum("n").alias("n"))


def line_graph(keyed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes (sid, key, n), edges (sid, a, b, n), sites (sid, site, rows)), all of high support and written.

    A line or a pair of lines counts once per result_id, however often its page holds it or
    was delivered. Lines without letters don't part the lines around them.
    """
    twice = materialize(keyed.groupBy("result_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("result_id"), "line-twice")
    sites = materialize(_pages_with(keyed.select("result_id", "sid", "site"), ["sid", "site"], twice).withColumnRenamed("n", "rows"), "line-sites")
    lines = keyed.select("result_id", "sid", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("key"))
    nodes = materialize(_supported(_pages_with(lines, ["sid", "key"], twice), sites, min_pages, min_share).select("sid", "key", "n"), "line-nodes")
    kept = nodes.groupBy("sid").agg(F.collect_list("key").alias("nodes"))
    runs = join_sites(keyed, kept, sites, "sid", "result_id", SITE_ROWS).where("nodes is not null").withColumn("run", F.filter("keys", lambda k: k.isNotNull()))
    pair = F.zip_with(F.slice("run", 1, F.greatest(F.size("run") - 1, F.lit(0))), F.slice("run", 2, F.greatest(F.size("run") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    both = F.filter(pair, lambda e: F.array_contains("nodes", e["a"]) & F.array_contains("nodes", e["b"]))
    steps = runs.select("result_id", "sid", F.explode(F.array_distinct(both)).alias("e")).select("result_id", "sid", "e.a", "e.b")
    edges = materialize(_supported(_pages_with(steps, ["sid", "a", "b"], twice), sites, min_pages, min_share).select("sid", "a", "b", "n"), "line-edges")
    return nodes, edges, sites


def line_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sid, key, n, block): each node with its component of the graph, itself where no kept edge meets it."""
    joined = edges.select("sid", "a", "b").groupBy("sid").applyInPandas(_components, "sid bigint, key bigint, block bigint")
    return nodes.join(joined, ["sid", "key"], "left").withColumn("block", F.coalesce("block", "key"))


def marked(keyed: DataFrame, blocks: DataFrame, sites: DataFrame, alone: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(result_id, carry..., marks): lines of each page that belong to an occurrence of a block, as (line_no, block).

    An occurrence is a run of lines of one block, lines without letters aside. With alone a
    single line is an occurrence too; without it only two or more in a row are.
    """
    maps = blocks.groupBy("sid").agg(F.map_from_entries(F.collect_list(F.struct("key", "block"))).alias("block_of"))
    each = join_sites(keyed, maps, sites, "sid", "result_id", SITE_ROWS)
    line = F.transform("keys", lambda k, i: F.struct((i + 1).cast("bigint").alias("line_no"), k.alias("key")))
    named = F.transform(F.filter(line, lambda x: x["key"].isNotNull()), lambda x: F.struct(x["line_no"].alias("line_no"), F.try_element_at("block_of", x["key"]).alias("block")))
    each = each.select("result_id", *carry, named.alias("all"))
    if not alone:
        beside = lambda i: F.try_element_at("all", i)["block"]
        runs = F.transform("all", lambda x, i: F.struct(x["line_no"].alias("line_no"), F.when(F.coalesce(x["block"] == F.when(i > 0, beside(F.when(i > 0, i).otherwise(1))), F.lit(False)) | F.coalesce(x["block"] == beside(i + 2), F.lit(False)), x["block"]).alias("block")))
        each = each.select("result_id", *carry, runs.alias("all"))
    return each.select("result_id", *carry, F.filter("all", lambda x: x["block"].isNotNull()).alias("marks"))


def boilerplate_lines(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, alone: bool = True) -> DataFrame:
    """(result_id, line_no, block): every line of an occurrence of a block, lines counted from 1.

    Pages without final_url belong to no site; NULL and empty markdown holds no lines. For
    alone see marked().
    """
    keyed = materialize(_of_sites(keyed_pages(spread(pages.select("result_id", "final_url", "markdown")))), "line-keys")
    nodes, edges, sites = line_graph(keyed, min_pages, min_share)
    hits = marked(keyed, materialize(line_blocks(nodes, edges), "line-blocks"), sites, alone)
    return hits.select("result_id", F.explode("marks").alias("x")).select("result_id", "x.line_no", "x.block").dropDuplicates(["result_id", "line_no"])


def site_blocks(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(site, lines, least_pages, most_pages): one row per block with its distinct lines and the least and most pages one of them stands on."""
    keyed = materialize(_of_sites(keyed_pages(spread(pages.select("result_id", "final_url", "markdown")))), "line-keys")
    nodes, edges, sites = line_graph(keyed, min_pages, min_share)
    per = line_blocks(nodes, edges).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("n").alias("least_pages"), F.max("n").alias("most_pages"))
    return per.join(sites, "sid").select("site", "lines", "least_pages", "most_pages")


def strip_lines(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, alone: bool = True) -> DataFrame:
    """(result_id, markdown, lines_removed): each page without the occurrences of its site's blocks.

    NULL markdown stays NULL; a page of no site comes back as it is. For alone see marked().
    """
    keyed = materialize(_of_sites(keyed_pages(spread(pages.select("result_id", "final_url", "markdown")))), "line-keys")
    nodes, edges, sites = line_graph(keyed, min_pages, min_share)
    hits = marked(keyed_pages(pages, carry=("markdown",)), materialize(line_blocks(nodes, edges), "line-blocks"), sites, alone, ("markdown",))
    lines, gone = F.split("markdown", "\n", -1), F.transform("marks", lambda x: x["line_no"])
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains("gone", (i + 1).cast("bigint")), F.lit(False)))
    own = hits.select("result_id", "markdown", gone.alias("gone"))
    return own.select("result_id", F.array_join(kept, "\n").alias("markdown"), F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).alias("lines_removed"))
