"""Extraction by a model behind a port: the call, the checks of its answer, and its fields."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.jsonschema import Validator, tool_schema

ANSWER = "request_id string, error_kind string, error string, names array<string>, vals array<string>, confidence array<double>, quotes array<string>, scores array<double>"
#: Name of the one tool a model must call.
TOOL = "record_extraction"


def _number(x) -> float:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else 0.0


def read_answer(status: int, body: str, check: Validator) -> dict:
    """The data, confidence and citations of a model's answer; ValueError for one that is none.

    A status outside 2xx, an answer without the tool's call, arguments that are no JSON and
    data that does not conform are errors.
    """
    if not 200 <= status < 300:
        raise ValueError(f"model answered {status}")
    try:
        calls = json.loads(body)["choices"][0]["message"]["tool_calls"]
        args = next(c["function"]["arguments"] for c in calls if c["function"]["name"] == TOOL)
    except (ValueError, LookupError, TypeError, StopIteration):
        raise ValueError("no tool call in the answer") from None
    try:
        got = json.loads(args)
    except (ValueError, TypeError):
        raise ValueError("the tool's arguments are no JSON") from None
    if not isinstance(got, dict) or not isinstance(got.get("data"), dict) or not check.valid(got["data"]):
        raise ValueError("the data does not conform to the schema")
    return got


def filled(got: dict) -> tuple[list[str], list[str], list[float], list[str], list[float]]:
    """(names, values as JSON, confidences, quotes, scores) over the keys of data.

    A missing or mistyped confidence is 0, a missing or mistyped quote '' with score 0; what
    is said about keys that data lacks is dropped.
    """
    conf = got.get("confidence") if isinstance(got.get("confidence"), dict) else {}
    cite = got.get("citations") if isinstance(got.get("citations"), dict) else {}
    names = list(got["data"])
    quotes, scores = [], []
    for n in names:
        c = cite.get(n)
        ok = isinstance(c, dict) and isinstance(c.get("quote"), str)
        quotes.append(c["quote"] if ok else "")
        scores.append(_number(c.get("supportScore")) if ok else 0.0)
    return names, [json.dumps(got["data"][n], ensure_ascii=False) for n in names], [_number(conf.get(n)) for n in names], quotes, scores


def extract(pages: DataFrame, schema: dict, call: Callable[[str, dict], tuple[int, str]]) -> DataFrame:
    """The checked answer to each page (request_id, text), see ANSWER; a call that fails is a row with error_kind upstream.

    call(text, schema of the tool) returns (status, body). One call per row: request_ids
    should be unique.
    """
    check, tool = Validator(schema), tool_schema(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["request_id"], b["text"], strict=True):
                try:
                    rows.append((i, None, None, *filled(read_answer(*call(t or "", tool), check))))
                except Exception as e:  # whatever the port raises is that row's failure
                    rows.append((i, "upstream", str(e) or type(e).__name__, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["request_id", "error_kind", "error", "names", "vals", "confidence", "quotes", "scores"], dtype=object)

    return pages.select("request_id", "text").mapInPandas(run, ANSWER)


def fields(answers: DataFrame) -> DataFrame:
    """(request_id, position, field, value, confidence, quote, support_score, verified): one row per field of the good answers."""
    zipped = F.arrays_zip("names", "vals", "confidence", "quotes", "scores")
    each = answers.where("error_kind is null").select("request_id", F.posexplode(zipped).alias("position", "f"))
    return each.select("request_id", "position", F.col("f.names").alias("field"), F.col("f.vals").alias("value"), "f.confidence", F.col("f.quotes").alias("quote"), F.col("f.scores").alias("support_score"), F.lit(False).alias("verified"))
