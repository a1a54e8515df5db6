"""Search over a local table, and parsing of a search service's answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of time spans in a search service's vocabulary.
SPANS = {"day": "pd", "week": "pw", "month": "pm", "year": "py"}
_ANSWER = "struct<web:struct<results:array<struct<title:string,url:string,description:string,age:string>>>>"


def top_k(documents: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(doc_id, score): the k documents with most distinct words of query, ties by doc_id.

    A top-k report: the limit is the feature. NULL texts score nothing.
    """
    words = sorted(set(query.lower().split()))
    have = F.split(F.lower("text"), r"[^\p{L}\p{N}]+", -1)
    score = F.size(F.array_intersect(have, F.array(*map(F.lit, words)))) if words else F.lit(0)
    return documents.select("doc_id", F.coalesce(score, F.lit(0)).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


def ask(queries: DataFrame, get: Callable[[dict], tuple[int, str]], limit: int = 10) -> DataFrame:
    """(query, body, error_kind, error) of a search service: queries (query, span or none), span being a key of SPANS.

    get(parameters) returns (status, body). An unknown span is a client's error before any
    call; a status outside 2xx or a call that fails is upstream's.
    """
    has = "span" in queries.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q, span in zip(b["query"], b["span"], strict=True):
                if isinstance(span, str) and span not in SPANS:
                    out.append((q, None, "client", f"unknown span {span!r}"))
                    continue
                try:
                    status, body = get({"q": q, "count": limit} | ({"freshness": SPANS[span]} if isinstance(span, str) else {}))
                    ok = 200 <= status < 300
                    out.append((q, body if ok else None, None if ok else "upstream", None if ok else f"search answered {status}"))
                except Exception as e:  # a failing call is its row's error
                    out.append((q, None, "upstream", str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["query", "body", "error_kind", "error"], dtype=object)

    cols = queries.select("query", F.col("span") if has else F.lit(None).cast("string").alias("span"))
    return cols.mapInPandas(run, "query string, body string, error_kind string, error string")


def parse_answers(answers: DataFrame, body: str = "body") -> DataFrame:
    """(query, rank, title, url, snippet, published_at): results in the service's order; a missing list gives none."""
    a = answers.select("query", F.posexplode(F.from_json(body, _ANSWER)["web"]["results"]).alias("rank", "r"))
    return a.select("query", "rank", "r.title", "r.url", F.col("r.description").alias("snippet"), F.col("r.age").alias("published_at"))
